"""Deduplication reports: fingerprint, link, cluster, and say what was skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.chunking import binary_signature
from siltstone.operators.components import connected_components
from siltstone.operators.matching import binary_pairs, lsh_candidates, text_blocks, text_pairs
from siltstone.runtime import materialise


def clusters(members: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster_id, status, exact): the cluster is its smallest id; ``exact`` if its tier-1 keys are equal.

    ``status``: grouped, single, or skipped for rows without a fingerprint.
    """
    comps = connected_components(links)
    named = reps.join(comps, reps["rep"] == comps["node"], "left").select("tier1", F.coalesce("component", "rep").alias("cluster"))
    rows = members.join(named, "tier1", "left")
    stats = rows.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"), F.min("tier1").alias("k1"), F.max("tier1").alias("k2"))
    out = rows.join(stats, "cluster", "left")
    status = F.when(F.col("cluster").isNull(), "skipped").when(F.col("n") > 1, "grouped").otherwise("single")
    return out.select("id", F.col("cluster").alias("cluster_id"), status.alias("status"), F.when(F.col("n") > 1, F.col("k1") == F.col("k2")).otherwise(F.lit(False)).alias("exact"))


def text_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_jaccard: float = T.MATCH_JACCARD) -> DataFrame:
    """Clusters of near-duplicate texts under the signature verdict."""
    members, reps, sigs = text_signatures(docs, key, text)
    return clusters(members, reps, _text_links(sigs, min_jaccard))


def text_signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, tier1), representatives (tier1, rep) and their signatures (id, sig)."""
    keyed = materialise(T.identified(docs, key, text), "signatures")
    members = keyed.select("id", "tier1")
    reps = materialise(members.filter("tier1 IS NOT NULL").groupBy("tier1").agg(F.min("id").alias("rep")), "reps")
    sigs = keyed.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").filter("sig IS NOT NULL").select("id", "sig")
    return members, reps, materialise(sigs, "sigs")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, jaccard, copy): matching pairs of representatives, and each other member b of a representative a."""
    members, reps, sigs = text_signatures(docs, key, text)
    copies = members.join(reps, "tier1").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("copy"))
    return text_pairs(sigs).withColumn("copy", F.lit(False)).unionByName(copies)


def lookup(docs: DataFrame, asked: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id): LSH candidates of the rows that ``asked`` (of ``id``) picks, among all rows.

    Representatives meet in the buckets; queries and hits are then their members.
    """
    members, reps, sigs = text_signatures(docs, key, text)
    rows = materialise(members.join(reps, "tier1").select("id", "rep"), "members")
    queries = rows.filter(asked).select(F.col("id").alias("query_id"), F.col("rep").alias("query_rep"))
    own = sigs.join(queries.select(F.col("query_rep").alias("id")).distinct(), "id", "left_semi")
    hits = materialise(lsh_candidates(own, sigs).select(F.col("query_id").alias("query_rep"), F.col("id").alias("rep")), "candidates")
    return queries.join(hits, "query_rep").join(rows, "rep").select("query_id", "id")


def _text_links(sigs: DataFrame, min_jaccard: float) -> DataFrame:
    """Links that give the components: to the smallest member of every block first, then only
    between rows that are still apart."""
    blocks = materialise(text_blocks(sigs, min_jaccard), "blocks")
    low = blocks.groupBy("band", "block").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    star = blocks.join(low, ["band", "block"]).filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    sig = lambda c, s: sigs.select(F.col("id").alias(c), F.col("sig").alias(s))
    verified = lambda p: p.join(sig("a", "sa"), "a").join(sig("b", "sb"), "b").filter(T.jaccard_estimate(F.col("sa"), F.col("sb")) >= min_jaccard).select("a", "b")
    first = materialise(verified(star), "links")
    comps = connected_components(first)
    placed = blocks.join(comps, blocks["id"] == comps["node"], "left").select("band", "block", "id", F.coalesce("component", "id").alias("c"))
    still = placed.groupBy("band", "block").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("band", "block")
    left = materialise(placed.join(still, ["band", "block"]), "blocks")
    rest = left.alias("x").join(left.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.c") < F.col("y.c")))
    rest = rest.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    return materialise(first.union(verified(rest)), "links")


def binary_dedup(items: DataFrame, key: str = "doc_id", data: str = "content") -> DataFrame:
    """Clusters of byte payloads that share at least half of their chunks."""
    keyed = materialise(items.select(F.col(key).alias("id"), F.sha2(F.col(data), 256).alias("tier1"), binary_signature(F.col(data)).alias("digests")), "chunks")
    members = keyed.select("id", "tier1")
    reps = materialise(members.filter("tier1 IS NOT NULL").groupBy("tier1").agg(F.min("id").alias("rep")), "reps")
    own = keyed.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "digests")
    return clusters(members, reps, materialise(binary_pairs(own).select("a", "b"), "links"))


def report(rows: DataFrame) -> DataFrame:
    """One row per cluster with more than one member, members as a sorted JSON array."""
    groups = rows.filter("status = 'grouped'").groupBy("cluster_id").agg(F.max("exact").alias("exact"), F.array_sort(F.collect_list("id")).alias("members"))
    return groups.select("cluster_id", F.to_json(F.struct("exact", "members")).alias("report"))

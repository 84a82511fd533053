"""Matching and deduplicating files of any kind by their second tier.

``match`` scores given pairs; ``media_dedup`` finds all links among described files and clusters them.
Signatures of different modalities can't be compared: such a pair is an error of its own, not a score of 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import types as t
from siltstone.functions.u64 import hamming64
from siltstone.operators.components import connected_components
from siltstone.operators.describe import describe
from siltstone.operators.matching import (
    AUDIO_VOTES,
    BINARY_JACCARD,
    IMAGE_HAMMING,
    VIDEO_SCORE,
    audio_votes,
    binary_pairs,
    hamming_pairs,
    is_match,
    modal_votes,
    scalar_distance,
    text_pairs,
)
from siltstone.runtime import materialise

#: The smallest number of votes is this less a distance.
VOTE_TOP = (1 << 32) - 1


@F.pandas_udf(t.struct(votes=t.LONG, delta=t.LONG))
def pair_votes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    side = lambda x: (np.array([p[k] for p in x], np.int64) for k in ("t", "f"))
    rows = [None if x is None or y is None else modal_votes(*side(x), *side(y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame([(0, None) if r is None else r for r in rows], columns=["votes", "delta"]).astype({"votes": "Int64", "delta": "Int64"})


def set_jaccard(a: Column, b: Column) -> Column:
    """Exact similarity of two arrays of distinct values; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def match(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """Verdicts of pairs (a, b) of described keys.

    (a, b, modality, score, bound, distance, matched, error): ``score`` and ``bound`` as the report lines say them.
    A file that was refused passes its refusal on; two modalities are a BadValue.
    """
    side = lambda k: described.select(F.col("key").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("modality", "phash", "minhash", "chunks", "peaks", "error")))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    cross = F.struct(F.lit("BadValue").alias("kind"), F.lit("signatures of different modalities").alias("message"))
    wrong = F.coalesce("error_a", "error_b", F.when(F.col("modality_a") != F.col("modality_b"), cross))
    both = both.withColumn("error", wrong)
    fine = F.col("error").isNull()
    lane = lambda m: fine & (F.col("modality_a") == m)
    # Each lane's columns are null in the others, so Python sees landmarks only.
    audio = lambda c: F.when(lane("audio"), F.col(c))
    both = both.withColumn("v", pair_votes(audio("peaks_a"), audio("peaks_b")))
    hamming = F.when(lane("image"), hamming64(F.col("phash_a"), F.col("phash_b")))
    share = F.when(lane("text"), T.jaccard_estimate(F.col("minhash_a"), F.col("minhash_b"))).when(lane("binary"), set_jaccard(F.col("chunks_a"), F.col("chunks_b")))
    both = both.withColumns({"hamming": hamming, "votes": F.when(lane("audio"), F.col("v.votes")), "share": share})
    line = F.when(lane("image"), F.format_string("hamming=%d", "hamming")).when(lane("audio"), F.concat(F.format_string("votes=%d", "votes"), F.when(F.col("v.delta").isNull(), "").otherwise(F.format_string(" delta_t=%d", "v.delta"))))
    line = line.when(fine, F.format_string("jaccard=%.6f", "share"))
    bounds = {"image": f"hamming <= {IMAGE_HAMMING}", "audio": f"votes >= {AUDIO_VOTES}", "text": f"jaccard >= {T.MATCH_JACCARD}", "binary": f"jaccard >= {BINARY_JACCARD}", "video": f"frames >= {VIDEO_SCORE}"}
    bound = F.when(fine, F.create_map(*(F.lit(x) for kv in bounds.items() for x in kv))[F.col("modality_a")])
    scores = (F.col("modality_a"), F.col("hamming"), F.col("votes"), F.col("share"))
    return both.select("a", "b", F.when(fine, F.col("modality_a")).alias("modality"), line.alias("score"), bound.alias("bound"), F.when(fine, scalar_distance(*scores)).alias("distance"), F.when(fine, is_match(*scores)).alias("matched"), "error")


def match_json(matches: DataFrame) -> DataFrame:
    return matches.select("a", "b", F.to_json(F.struct("a", "b", "modality", "score", "distance", "bound", "matched")).alias("json"))


def hash_json(described: DataFrame) -> DataFrame:
    """(key, json) of the files that have a first tier."""
    return described.filter("tier1 IS NOT NULL").select("key", F.to_json(F.struct(F.col("key").alias("file"), "tier1")).alias("json"))


def media_dedup(files: DataFrame, threshold: int | None = None, key: str = "path", content: str = "content") -> DataFrame:
    """(id, modality, cluster_id, status, exact, error) of every file.

    Files of one modality link under its advisory bound, or with a threshold where their distance is at most
    that; clusters are components, named by the smallest key; ``exact`` if all first tiers are equal. Refused files
    are ``skipped`` with their reason. A sound with too few landmarks to match even itself stays single.
    """
    rows = materialise(describe(files, key, content), "described")
    own = rows.filter("error IS NULL").withColumn("self", F.when(F.col("modality") == "audio", pair_votes("peaks", "peaks")["votes"]))
    least = AUDIO_VOTES if threshold is None else max(0, VOTE_TOP - threshold)
    lonely = (F.col("modality") == "audio") & (F.col("self") < least)
    kind = F.concat_ws("|", "modality", "tier1", F.when(lonely, F.col("key").cast("string")))
    own = materialise(own.withColumn("kind", kind), "own")
    reps = materialise(own.groupBy("kind").agg(F.min("key").alias("rep")), "reps")
    first = materialise(own.join(reps, (own["kind"] == reps["kind"]) & (own["key"] == reps["rep"]), "left_semi"), "firsts")
    share = None if threshold is None else max(0.0, 1.0 - (threshold + 0.5) / 1e6)
    part = lambda m: first.filter(F.col("modality") == m)
    links = hamming_pairs(part("image").select(F.col("key").alias("id"), F.col("phash").alias("hash")), IMAGE_HAMMING if threshold is None else min(63, threshold)).select("a", "b")
    peaks = part("audio").filter(~lonely).select(F.col("key").alias("id"), F.explode("peaks").alias("p")).select("id", "p.t", "p.f")
    links = links.unionByName(audio_votes(peaks, peaks, max(1, least)).filter("query_id < id").select(F.col("query_id").alias("a"), F.col("id").alias("b")))
    links = links.unionByName(text_pairs(part("text").select(F.col("key").alias("id"), F.col("minhash").alias("sig")), T.MATCH_JACCARD if share is None else share).select("a", "b"))
    links = links.unionByName(binary_pairs(part("binary").select(F.col("key").alias("id"), F.col("chunks").alias("digests")), BINARY_JACCARD if share is None else share).select("a", "b"))
    comps = connected_components(materialise(links, "links"))
    placed = own.join(reps, "kind").join(comps, F.col("rep") == comps["node"], "left").select("key", "modality", "tier1", F.coalesce("component", "rep").alias("cluster_id"))
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("tier1").alias("k1"), F.max("tier1").alias("k2"))
    done = placed.join(sizes, "cluster_id").select(F.col("key").alias("id"), "modality", "cluster_id", F.when(F.col("n") > 1, "grouped").otherwise("single").alias("status"), ((F.col("n") > 1) & (F.col("k1") == F.col("k2"))).alias("exact"), F.lit(None).cast("struct<kind:string,message:string>").alias("error"))
    skipped = rows.filter("error IS NOT NULL").select(F.col("key").alias("id"), "modality", F.lit(None).cast(dict(done.dtypes)["cluster_id"]).alias("cluster_id"), F.lit("skipped").alias("status"), F.lit(False).alias("exact"), "error")
    return done.unionByName(skipped)

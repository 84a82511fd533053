"""Similarity joins over fingerprints: text, 64-bit hashes, chunk sets, audio landmarks, frame chains.

All are lossless: blocks follow from the verdict by the pigeonhole principle, and every candidate is
verified. Equal fingerprints are one representative where the verdict depends on it alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siltstone.functions import text as T
from siltstone.functions import types as t
from siltstone.functions import votes
from siltstone.functions.u64 import hamming64, hex64
from siltstone.runtime import materialise

# Verdict thresholds of the lanes.
IMAGE_HAMMING, AUDIO_VOTES, BINARY_JACCARD, VIDEO_SCORE, FRAME_HAMMING = 10, 8, 0.5, 0.8, 10


def text_mismatches(min_jaccard: float = T.MATCH_JACCARD, n: int = T.SIGNATURE_WORDS) -> int:
    return next(m for m in range(n, -1, -1) if (n - m) / n >= min_jaccard)


def text_blocks(sigs: DataFrame, min_jaccard: float = T.MATCH_JACCARD, key: str = "id") -> DataFrame:
    """(band, block, id): matching signatures agree on the block of a band."""
    bands = T.band_slices(text_mismatches(min_jaccard))
    blocks = F.array(*(F.xxhash64(F.slice("sig", a + 1, s)) for a, s in bands))
    return sigs.select(key, F.posexplode(blocks).alias("band", "block"))


def text_pairs(sigs: DataFrame, min_jaccard: float = T.MATCH_JACCARD) -> DataFrame:
    """(a, b, jaccard), a < b, of all matching rows of (id, sig); give it distinct signatures."""
    b = text_blocks(sigs, min_jaccard)
    pairs = b.alias("x").join(b.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id")))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", T.jaccard_estimate(F.col("sa"), F.col("sb")).alias("jaccard")).filter(F.col("jaccard") >= min_jaccard)


def lsh_candidates(queries: DataFrame, index: DataFrame, bands: int = T.BANDS, rows: int = T.ROWS) -> DataFrame:
    """(query_id, id): members of the buckets that a query's stripes fall into, each once."""
    keys = T.lsh_keys(bands, rows)
    q = queries.select(F.col("id").alias("query_id"), F.posexplode(keys("sig")).alias("band", "key"))
    i = index.select("id", F.posexplode(keys("sig")).alias("band", "key"))
    return q.join(i, ["band", "key"]).select("query_id", "id").distinct()


def hamming_search(queries: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """(query_id, id, distance) of all index hashes within the radius of a query hash.

    With radius r, one of r + 1 disjoint bit blocks is equal, so the join is an equi-join on
    (block, bits); duplicates in the index all answer.
    """
    blocks = min(64, radius + 1)
    size = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]

    def cut(h: Column) -> Column:
        at, out = 0, []
        for s in size:
            out.append(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << s) - 1 if s < 64 else -1)))
            at += s
        return F.array(*out)

    if radius >= 64:
        raise ValueError("every hash is within 64 bits; ask for a smaller radius")
    q = queries.select(F.col("id").alias("query_id"), F.col("hash").alias("qh"), F.posexplode(cut(F.col("hash"))).alias("block", "bits"))
    i = index.select("id", "hash", F.posexplode(cut(F.col("hash"))).alias("block", "bits"))
    d = hamming64(F.col("qh"), F.col("hash"))
    return q.join(i, ["block", "bits"]).filter(d <= radius).select("query_id", "id", d.alias("distance")).distinct()


def hamming_pairs(hashes: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance), a < b, of all rows (id, hash) within the radius of each other."""
    found = hamming_search(hashes, hashes, radius).filter("query_id < id")
    return found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance")


def binary_pairs(chunks: DataFrame, min_jaccard: float = BINARY_JACCARD) -> DataFrame:
    """(a, b, jaccard) of rows (id, digests) by exact set similarity; two empty sets have 1."""
    size = chunks.select("id", F.size("digests").alias("n"))
    long = chunks.select("id", F.explode("digests").alias("d"))
    shared = long.alias("x").join(long.alias("y"), (F.col("x.d") == F.col("y.d")) & (F.col("x.id") < F.col("y.id"))).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("i"))
    none = size.filter("n = 0")
    empty = none.alias("x").join(none.alias("y"), (F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("jaccard"))
    j = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    out = shared.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", j.alias("jaccard")).unionByName(empty).filter(F.col("jaccard") >= min_jaccard)


def modal_votes(ta: np.ndarray, fa: np.ndarray, tb: np.ndarray, fb: np.ndarray) -> tuple[int, int] | None:
    """(votes, offset) of two landmark lists: the most frequent time offset (ties: the smallest) and its neighbours."""
    order = np.argsort(fb, kind="stable")
    tb, fb = tb[order], fb[order]
    lo = np.searchsorted(fb, fa, "left")
    n = np.searchsorted(fb, fa, "right") - lo
    if not n.sum():
        return None
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    d, v = np.unique(np.repeat(ta, n) - tb[at], return_counts=True)
    i = int(np.argmax(v))
    return int(v[np.abs(d - d[i]) <= 1].sum()), int(d[i])


#: Landmarks and rows of a side that a task holds at once.
TILE_LANDMARKS, TILE_ROWS = 1 << 20, 2048


def audio_votes(queries: DataFrame, index: DataFrame, at_least: int = 1) -> DataFrame:
    """(query_id, id, votes, delta) of landmark rows (id, t, f), for pairs with ``at_least`` so many votes.

    Votes are counted per time offset; the modal offset (ties: the smallest) and its neighbours
    within one frame add up. Landmarks without a band meet none; where one has no time, its offset is null
    and comes after all others. Both sides are dealt into tiles of bounded size, and every two tiles meet in
    one task: a side is sent once for each tile of the other, never for each pair.
    """
    spark = queries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # In order of their bands they compress well.
    lists = lambda df: materialise(df.filter("f IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("p")).select("id", "p.t", "p.f"), "landmarks")
    q, i = lists(queries), lists(index)

    def tiles(df: DataFrame, least: int) -> int:
        rows, landmarks = df.agg(F.count("*"), F.sum(F.size("t"))).first()
        return max(1, min(rows, max(least, -(-rows // TILE_ROWS), -(-(landmarks or 0) // TILE_LANDMARKS))))

    nq, ni = tiles(q, 1), tiles(i, parts)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = lambda like, name: F.lit(None).cast(dict(like.dtypes)["id"]).alias(name)
    left = q.select(own(nq).alias("tq"), other(ni).alias("ti"), F.lit(True).alias("query"), F.col("id").alias("query_id"), key(i, "id"), "t", "f")
    right = i.select(other(nq).alias("tq"), own(ni).alias("ti"), F.lit(False).alias("query"), key(q, "query_id"), "id", "t", "f")
    # The work is in the pairs, not in their bytes, so tasks are not merged by size, and few tiles share one.
    dealt = left.unionByName(right).repartition(min(4 * nq * ni, 16 * parts), "tq", "ti").sortWithinPartitions("tq", "ti", "query")
    out = StructType([StructField("query_id", q.schema["id"].dataType), StructField("id", i.schema["id"].dataType), StructField("votes", t.LONG), StructField("delta", t.LONG)])
    found = dealt.mapInArrow(lambda batches: _tile_votes(batches, at_least), out)
    return found.select("query_id", "id", "votes", F.col("delta").cast(dict(queries.dtypes)["t"]).alias("delta"))


def _tile_votes(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.RecordBatch]:
    """Votes between the queries and the items of each tile; rows come sorted by it."""
    now, held = None, {True: [], False: []}
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tq", "ti", "query")]
        ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], 0)) + 1 if batch.num_rows else []
        for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            if a == b:
                continue
            tile = (cols[0][a], cols[1][a])
            if tile != now:
                yield from _pair_votes(held, at_least)
                now, held = tile, {True: [], False: []}
            held[bool(cols[2][a])].append(batch.slice(a, b - a))
    yield from _pair_votes(held, at_least)


def _pair_votes(held: dict[bool, list[pa.RecordBatch]], at_least: int, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    if not held[True] or not held[False]:
        return
    (qid, q), (iid, i) = _side(held[True], "query_id"), _side(held[False], "id")

    def flush(found: list) -> pa.RecordBatch:
        a, b, v, d, known = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([qid.take(pa.array(a)), iid.take(pa.array(b)), pa.array(v.astype(np.int64)), pa.array(d, mask=~known)], ["query_id", "id", "votes", "delta"])

    found, n = [], 0
    for x in votes.tile_votes(q, i, at_least):
        found.append(x)
        n += len(x[0])
        if n >= rows:
            yield flush(found)
            found, n = [], 0
    if n:
        yield flush(found)


def _side(batches: list[pa.RecordBatch], key: str) -> tuple[pa.Array, votes.Side]:
    """Ids and landmarks of the rows."""
    table = pa.Table.from_batches(batches)
    times, bands = (table[c].combine_chunks() for c in ("t", "f"))
    row = np.repeat(np.arange(table.num_rows), pc.list_value_length(times).to_numpy(zero_copy_only=False))
    flat, f = times.flatten(), bands.flatten().to_numpy(zero_copy_only=False)
    void = flat.is_null().to_numpy(zero_copy_only=False)
    return table[key].combine_chunks(), votes.side(table.num_rows, row, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), f.astype(np.int64), void)


def video_score(a: Column, b: Column, most: int = FRAME_HAMMING) -> Column:
    """Share of index-aligned frames within the Hamming limit, over the shorter chain; 1 without frames."""
    n = F.least(F.size(a), F.size(b))
    hits = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (hamming64(x, y) <= most).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(n == 0, F.lit(1.0)).otherwise(hits / n)


def scalar_distance(modality: Column, hamming: Column, votes: Column, score: Column) -> Column:
    """One ascending axis for all lanes."""
    share = F.round((1 - score) * 1e6).cast("long")
    return F.when(modality == "image", hamming.cast("long")).when(modality == "audio", F.lit(4294967295) - votes.cast("long")).otherwise(share)


def is_match(modality: Column, hamming: Column, votes: Column, score: Column) -> Column:
    return (
        F.when(modality == "image", hamming <= IMAGE_HAMMING)
        .when(modality == "audio", votes >= AUDIO_VOTES)
        .when(modality == "binary", score >= BINARY_JACCARD)
        .otherwise(score >= VIDEO_SCORE)
    )


def signature_head(sig: Column, n: int = 4) -> Column:
    """The first words of a signature in hex, as reports show them."""
    return F.array_join(F.transform(F.slice(sig, 1, n), hex64), " ")

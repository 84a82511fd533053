"""Deduplication of a stream: exact copies by their tier-1 key, within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators.matching import text_blocks


def exact(stream: DataFrame, column: str = "text", event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each canonical text; state for a key goes once the watermark has passed it."""
    keyed = stream.withColumn("tier1", F.sha2(F.encode(text.canonicalize(F.col(column)), "UTF-8"), 256))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["tier1"])


def near(stream: DataFrame, index: DataFrame, column: str = "text", min_jaccard: float = text.MATCH_JACCARD) -> DataFrame:
    """(id, match, jaccard): rows of a stream of (id, text) against a static table of (id, sig).

    A stream-static equi-join on the lossless bands; pairs that meet in several bands come once per
    micro-batch row and are verified exactly.
    """
    rows = stream.select("id", text.signature(F.col(column)).alias("sig"))
    blocks = text_blocks(rows.select(F.struct("id", "sig").alias("id"), "sig"), min_jaccard).select("id.*", "band", "block")
    known = text_blocks(index.select(F.struct("id", "sig").alias("id"), "sig"), min_jaccard).select(F.col("id.id").alias("match"), F.col("id.sig").alias("other"), "band", "block")
    j = text.jaccard_estimate(F.col("sig"), F.col("other"))
    hits = blocks.join(known, ["band", "block"]).select("id", "match", "band", j.alias("jaccard")).filter(F.col("jaccard") >= min_jaccard)
    return hits

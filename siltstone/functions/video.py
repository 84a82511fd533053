"""Video fingerprints from frame hashes: slot sampling, chain signature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import types as t
from siltstone.functions.text import minhash
from siltstone.functions.u64 import U, fnv1a_spans, signed, splitmix

# Slots per second, frames per shingle, seed stream.
SLOTS_PER_SECOND, SHINGLE_FRAMES = 2, 3
SEED_STREAM = 0x564944454D483634
SEEDS = splitmix(SEED_STREAM, 128)


def sample(frames: DataFrame, key: str, pts: str, frame: str, timescale: int) -> DataFrame:
    """The first frame of every slot in order of presentation time (ties: the smaller frame), with its slot."""
    slot = F.floor(SLOTS_PER_SECOND * F.col(pts) / F.lit(timescale)).cast("long")
    order = Window.partitionBy(key, "slot").orderBy(pts, frame)
    return frames.withColumn("slot", slot).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def chain_signature_of(hashes: np.ndarray) -> np.ndarray:
    """MinHash over runs of up to three frame hashes, each as big-endian bytes."""
    k = min(SHINGLE_FRAMES, len(hashes))
    if not k:
        return minhash(np.zeros(0, U), SEEDS)
    data = np.frombuffer(hashes.astype(">u8").tobytes(), np.uint8)
    at = np.arange(len(hashes) - k + 1) * 8
    return minhash(fnv1a_spans(data, at, at + 8 * k), SEEDS)


@F.pandas_udf(t.array(t.LONG))
def chain_signature(hashes: pd.Series) -> pd.Series:
    return hashes.map(lambda x: None if x is None else signed(chain_signature_of(np.asarray(x, np.int64).view(U))))

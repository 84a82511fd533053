"""Text identity: canonical form, word shingles, MinHash signatures, LSH stripes."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import types as t
from siltstone.functions.u64 import MIX_A, MIX_B, U, fnv1a_spans, mix64, signed, splitmix

# Shingle length, signature length, seed stream, Unicode White_Space, default LSH shape.
SHINGLE_WORDS, SIGNATURE_WORDS = 3, 128
SEED_STREAM = 0x544558544D483634
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BANDS, ROWS = 16, 8
MATCH_JACCARD = 0.8

_gap = re.compile(f"[{WHITE_SPACE}]+")
#: Python takes these for blanks, Unicode White_Space doesn't.
_odd = re.compile("[\x1c-\x1f]")
SEEDS = splitmix(SEED_STREAM, SIGNATURE_WORDS)


_trail = re.compile(f"[{WHITE_SPACE}]+\\Z")


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    return (_trail.sub("", text) if _odd.search(text) else text.rstrip()) + "\n"


def words_of(text: str) -> list[str]:
    return [x for x in _gap.split(text) if x] if _odd.search(text) else text.split()


def shingle_hashes(text: str, k: int = SHINGLE_WORDS) -> np.ndarray:
    """FNV-1a of each run of min(k, words) words of a canonical text, joined by single blanks."""
    return batch_hashes([text], k)[0]


def batch_hashes(texts: list[str], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` of many canonical texts, one after another, and where each begins (one more than texts)."""
    words = [words_of(x) for x in texts]
    counts = np.array([len(w) for w in words], np.int64)
    data = " ".join(" ".join(w) for w in words if w).encode() + b" "
    buffer = np.frombuffer(data, np.uint8)
    stop = np.flatnonzero(buffer == 32)
    start = np.concatenate(([0], stop[:-1] + 1))
    size = np.minimum(k, counts)
    n = np.where(counts > 0, counts - size + 1, 0)
    ptr = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])) - ptr[:-1], n) + np.arange(ptr[-1])
    return fnv1a_spans(buffer, start[first], stop[first + np.repeat(size, n) - 1]), ptr


def minhash(elements: np.ndarray, seeds: np.ndarray = SEEDS) -> np.ndarray:
    """Unsigned minimum per seed; all ones for an empty set."""
    return batch_minhash(elements, np.array([0, len(elements)]), seeds)[0]


def batch_minhash(elements: np.ndarray, ptr: np.ndarray, seeds: np.ndarray = SEEDS, block: int = 128) -> np.ndarray:
    """``minhash`` of each stretch of the elements, in two buffers that fit the caches."""
    out = np.full((len(ptr) - 1, len(seeds)), (1 << 64) - 1, U)
    z, x = np.empty((block, len(seeds)), U), np.empty((block, len(seeds)), U)
    for d, (lo, hi) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)):
        for i in range(lo, hi, block):
            m = min(block, hi - i)
            a, b = z[:m], x[:m]
            np.bitwise_xor(elements[i : i + m, None], seeds[None, :], out=a)
            for shift, factor in ((30, MIX_A), (27, MIX_B)):
                np.right_shift(a, U(shift), out=b)
                np.bitwise_xor(a, b, out=a)
                np.multiply(a, U(factor), out=a)
            np.right_shift(a, U(31), out=b)
            np.bitwise_xor(a, b, out=a)
            np.minimum(out[d], a.min(0), out=out[d])
    return out


def signatures_of(texts: list[str]) -> np.ndarray:
    """Signatures of canonical texts, one row each."""
    return batch_minhash(*batch_hashes(texts))


def signature_of(text: str) -> np.ndarray:
    return signatures_of([canonical(text)])[0]


def _pieces(texts: list[str], most: int = 1 << 20):
    """Stretches of about ``most`` characters."""
    lo, n = 0, 0
    for i, x in enumerate(texts):
        n += len(x)
        if n >= most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tier1, sig) of every row in one pass: canonical form, its SHA-256 and its signature; null for a null text."""
    def run(batches):
        for b in batches:
            ids, raw = b["id"], b["text"].to_pylist()
            for lo, hi in _pieces([x or "" for x in raw]):
                part = raw[lo:hi]
                some = [i for i, x in enumerate(part) if x is not None]
                canon = [canonical(part[i]) for i in some]
                tier1, sig = [None] * len(part), [None] * len(part)
                for i, x, s in zip(some, canon, signed(signatures_of(canon)) if some else [], strict=True):
                    tier1[i], sig[i] = hashlib.sha256(x.encode()).hexdigest(), s
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(tier1, pa.string()), pa.array(sig, pa.list_(pa.int64()))], names=["id", "tier1", "sig"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, tier1 string, sig array<long>")


@F.pandas_udf(t.STRING)
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(t.STRING)
def nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


@F.pandas_udf(t.STRING)
def canonicalize(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else canonical(x))


@F.pandas_udf(t.array(t.LONG))
def signature(text: pd.Series) -> pd.Series:
    """MinHash signature of a text (null stays null)."""
    out: list = [None] * len(text)
    some = [i for i, x in enumerate(text) if x is not None]
    canon = [canonical(text.iloc[i]) for i in some]
    for lo, hi in _pieces(canon):
        for i, s in zip(some[lo:hi], signed(signatures_of(canon[lo:hi])), strict=True):
            out[i] = s
    return pd.Series(out, dtype=object)


def words(canonical_text: Column) -> Column:
    gap = "[" + WHITE_SPACE.replace("\t-\r", "\\x09-\\x0D").replace("\x85", "\\x85").replace("\xa0", "\\xA0") + "]+"
    return F.filter(F.split(canonical_text, gap), lambda w: w != "")


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures, over the shorter one; 1 without positions."""
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.when(n == 0, F.lit(1.0)).otherwise(same / n)


def stripe_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket key of each band of many signatures: (items, bands)."""
    if sig.shape[1] != bands * rows:
        raise ValueError("signature length must be bands times rows")
    acc = np.repeat(splitmix_one(np.arange(bands, dtype=U))[None, :], len(sig), 0)
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        acc = splitmix_one(acc ^ parts[:, :, r])
    return acc


def splitmix_one(state: np.ndarray) -> np.ndarray:
    """First output of a generator seeded with each value."""
    return mix64(state + U(0x9E3779B97F4A7C15))


def lsh_keys(bands: int = BANDS, rows: int = ROWS):
    @F.pandas_udf(t.array(t.LONG))
    def keys(sig: pd.Series) -> pd.Series:
        return pd.Series(list(signed(stripe_keys(np.stack(sig.to_list()).astype(np.int64).view(U), bands, rows)).tolist()) if len(sig) else [])

    return keys


def band_slices(most_mismatches: int, n: int = SIGNATURE_WORDS) -> list[tuple[int, int]]:
    """Disjoint bands, one more than mismatches: a matching pair agrees on one band entirely."""
    bands = most_mismatches + 1
    size = [n // bands + (i < n % bands) for i in range(bands)]
    at = np.concatenate(([0], np.cumsum(size)))
    return [(int(a), int(s)) for a, s in zip(at, size, strict=False)]

"""Unsigned 64-bit arithmetic on numpy arrays, and scalar hashes as Arrow UDFs.

Spark has no unsigned type: a BIGINT column holds the bit pattern, and unsigned order is the order
of ``x ^ -2^63``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import types as t

U = np.uint64
# FNV-1a offset and prime, the splitmix64 increment and multipliers.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
ALL = (1 << 64) - 1


def mix64(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(MIX_A)
    z = (z ^ (z >> U(27))) * U(MIX_B)
    return z ^ (z >> U(31))


def splitmix(seed: int, n: int) -> np.ndarray:
    """The first n outputs of the generator."""
    state = np.arange(1, n + 1, dtype=U) * U(GAMMA) + U(seed & ALL)
    return mix64(state)


def splitmix_bytes(seed: int, n: int) -> bytes:
    return splitmix(seed, -(-n // 8)).astype("<u8").tobytes()[:n]


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & ALL
    return h


def fnv1a_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV-1a of many byte spans of one buffer, stepping through all spans at once."""
    h = np.full(len(start), FNV_OFFSET, U)
    size = end - start
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    acc = h.copy()
    for k in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -k, "left"))
        acc[:live] = (acc[:live] ^ data[s[:live] + k].astype(U)) * U(FNV_PRIME)
    h[order] = acc
    return h


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


@F.pandas_udf(t.LONG)
def fnv1a64(data: pd.Series) -> pd.Series:
    parts = [b"" if x is None else bytes(x) for x in data]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    out = signed(fnv1a_spans(np.frombuffer(b"".join(parts), np.uint8), at[:-1], at[1:]))
    return pd.Series(out, dtype="Int64").where(data.notna())


@F.pandas_udf(t.LONG)
def adler32(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.adler32(bytes(x))).astype("Int64")


def crc32(data: Column) -> Column:
    return F.crc32(data)


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def hex64(x: Column) -> Column:
    """The bit pattern as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def digest_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def parse_digest(text: Column, n_bytes: int) -> Column:
    """Hex in either case to bytes; null unless it has exactly ``n_bytes``."""
    return F.when(text.rlike(f"^[0-9A-Fa-f]{{{2 * n_bytes}}}$"), F.unhex(text))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_bytes(a: Column, b: Column, n: int) -> Column:
    """Differing bits of two digests of ``n`` bytes, eight bytes at a time."""
    def word(x: Column, i: int) -> Column:
        piece = F.substring(F.hex(x), 1 + 16 * i, min(16, 2 * (n - 8 * i)))
        high = F.conv(F.substring(F.lpad(piece, 16, "0"), 1, 8), 16, 10).cast("long")
        low = F.conv(F.substring(F.lpad(piece, 16, "0"), 9, 8), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(low)

    return sum((hamming64(word(a, i), word(b, i)) for i in range(-(-n // 8))), F.lit(0))


#: Digest length in bytes of the named algorithms; the others have none.
OUTPUT_LEN = {"sha1": 20, "sha256": 32, "sha512": 64, "blake3": 32, "md5": 16, "xxhash64": 8, "fastcdc": 4}


def output_len(name: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in OUTPUT_LEN.items() for x in kv))
    return m[F.lower(name)]

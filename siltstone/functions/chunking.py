"""Content-defined chunking with a Gear rolling hash, and the binary signature over its chunks."""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import types as t
from siltstone.functions.u64 import ALL, U

#: Table entry i: the first eight bytes of MD5 over 64 bytes of value i.
GEAR = np.array([int.from_bytes(hashlib.md5(bytes([i]) * 64).digest()[:8], "big") for i in range(256)], U)
# Published masks by number of one-bits (5 to 25), sizes and level of the signature, size limits.
MASKS = dict(enumerate((
    0x0000000001804110, 0x0000000001803110, 0x0000000018035100, 0x0000001800035300, 0x0000019000353000, 0x0000590003530000, 0x0000D90003530000,
    0x0000D90103530000, 0x0000D90303530000, 0x0000D90313530000, 0x0000D90F03530000, 0x0000D90303537000, 0x0000D90703537000, 0x0000D90707537000,
    0x0000D91707537000, 0x0000D91747537000, 0x0000D91767537000, 0x0000D93767537000, 0x0000D93777537000, 0x0000D93777577000, 0x0000DB3777577000,
), 5))
MIN, AVG, MAX, LEVEL = 2048, 8192, 32768, 2
LIMITS = {"min": (64, 1 << 20), "avg": (256, 4 << 20), "max": (1024, 16 << 20)}
WINDOW = 64
#: Bytes that are rolled at once, eight times as many in memory.
TILE = 1 << 14


def validate(lo: int, avg: int, hi: int) -> None:
    for name, v in (("min", lo), ("avg", avg), ("max", hi)):
        if not LIMITS[name][0] <= v <= LIMITS[name][1]:
            raise ValueError(f"{name} size {v} outside {LIMITS[name]}")
    if not lo <= avg <= hi:
        raise ValueError("sizes must be ordered")


def select_masks(avg: int, level: int = LEVEL) -> tuple[int, int]:
    """Strict and loose mask, ``level`` bits above and below the power of two nearest to ``avg``."""
    if not 0 <= level <= 3:
        raise ValueError("level must be 0 to 3")
    floor = avg.bit_length() - 1
    bits = floor + (2 * avg >= 3 << floor)
    return MASKS[bits + level], MASKS[bits - level]


def _rolled(data: np.ndarray) -> np.ndarray:
    """Gear fingerprints of bytes with nothing before the first one."""
    f, x, span = GEAR[data], np.empty(len(data), U), 1
    while span < min(WINDOW, len(data)):
        np.left_shift(f[:-span], U(span), out=x[span:])
        f[span:] += x[span:]
        span *= 2
    return f


def _hits(data: np.ndarray, masks: tuple[int, int]) -> list[np.ndarray]:
    """Places whose fingerprint shows none of a mask's bits, tile by tile; those under WINDOW count what comes before as nothing."""
    found: list[list[np.ndarray]] = [[] for _ in masks]
    for at in range(0, len(data), TILE):
        lead = min(at, WINDOW - 1)
        f = _rolled(data[at - lead : at + TILE])[lead:]
        for out, m in zip(found, masks, strict=True):
            out.append(np.flatnonzero(f & U(m) == 0) + at)
    return [np.concatenate(x) for x in found]


def chunks(data: bytes, lo: int = MIN, avg: int = AVG, hi: int = MAX, level: int = LEVEL) -> list[tuple[int, int, int]]:
    """(hash, offset, length) of every chunk; the byte that triggers a cut begins the next chunk."""
    return chunks_of([data], lo, avg, hi, level)[0]


def chunks_of(parts: list[bytes], lo: int = MIN, avg: int = AVG, hi: int = MAX, level: int = LEVEL) -> list[list[tuple[int, int, int]]]:
    """``chunks`` of many inputs.

    Fingerprints far enough from a chunk's start don't depend on it, so cuts are searched once in all
    inputs put together; only the first WINDOW of a chunk are rolled anew.
    """
    validate(lo, avg, hi)
    masks = select_masks(avg, level)
    out: list = [[(0, 0, len(x))] if x else [] for x in parts]
    some = [i for i, x in enumerate(parts) if len(x) > lo]
    if not some:
        return out
    data = np.frombuffer(b"".join(parts[i] for i in some), np.uint8)
    hits = _hits(data, masks)
    base = 0
    for i in some:
        n = len(parts[i])
        here = [h[np.searchsorted(h, base) : np.searchsorted(h, base + n)] - base for h in hits]
        out[i] = _cuts(data[base : base + n], here, masks, lo, avg, hi)
        base += n
    return out


def _cuts(data: np.ndarray, hits: list[np.ndarray], masks: tuple[int, int], lo: int, avg: int, hi: int) -> list[tuple[int, int, int]]:
    n, out, at = len(data), [], 0
    strict, loose = masks
    while at < n:
        left = n - at
        if left <= lo:
            out.append((0, at, left))
            break
        end = min(left, hi)
        center = min(avg, end)
        first = at + lo
        near = _rolled(data[first : min(first + WINDOW, at + end)])
        cut = None
        for (a, z), mask, far in (((first, at + center), strict, hits[0]), ((max(first, at + center), at + end), loose, hits[1])):
            a2, z2 = a - first, min(z - first, len(near))
            if a2 < z2:
                hit = np.flatnonzero(near[a2:z2] & U(mask) == 0)
                if len(hit):
                    cut = a + int(hit[0])
                    break
            i = int(np.searchsorted(far, max(a, first + WINDOW)))
            if i < len(far) and far[i] < z:
                cut = int(far[i])
                break
        stop = at + end if cut is None else cut
        last = stop - 1 if cut is None else cut
        fp = int(near[last - first]) if last - first < len(near) else int(_rolled(data[last - WINDOW + 1 : last + 1])[-1])
        out.append((fp, at, stop - at))
        at = stop
    return out


def buzhash(data: bytes) -> int:
    """Rolling 64-byte window of rotated table entries, after the last byte."""
    fp = 0
    rot = lambda x: ((x << 1) | (x >> 63)) & ALL
    g = [int(x) for x in GEAR]
    for i, b in enumerate(data):
        fp = rot(fp) ^ g[b]
        if i >= WINDOW:
            fp ^= g[data[i - WINDOW]]
    return fp


def chunk_digests(data: bytes) -> list[bytes]:
    return _digests(data, chunks(data))


def _digests(data: bytes, found: list[tuple[int, int, int]]) -> list[bytes]:
    view = memoryview(data)
    return sorted({hashlib.sha256(view[o : o + n]).digest() for _, o, n in found})


def _each(data: pd.Series, f) -> pd.Series:
    some = [i for i, x in enumerate(data) if x is not None]
    parts = [bytes(data.iloc[i]) for i in some]
    out: list = [None] * len(data)
    for i, x, c in zip(some, parts, chunks_of(parts), strict=True):
        out[i] = f(x, c)
    return pd.Series(out, dtype=object)


@F.pandas_udf(t.array(t.struct(hash=t.LONG, offset=t.LONG, length=t.INT)))
def fastcdc(data: pd.Series) -> pd.Series:
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    return _each(data, lambda _, c: [{"hash": sign(h), "offset": o, "length": n} for h, o, n in c])


@F.pandas_udf(t.array(t.BINARY))
def binary_signature(data: pd.Series) -> pd.Series:
    """The distinct SHA-256 digests of the chunks, ascending."""
    return _each(data, _digests)

"""Vectorised tokenising and rolling hashes over Arrow text columns.

Everything works on the concatenated UTF-8 buffer of a batch with numpy, so no Python object is
made for a word. Byte classes are ASCII only, hence a multi-byte character never splits a word
and lower-casing touches A-Z alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Word bytes of the two word classes that the operators use.
NON_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the two polynomial hashes (bytes in a word, words in a window).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
INV = lambda b: pow(b, -1, 1 << 64)


@lru_cache(maxsize=16)
def _powers(base: int, log_n: int) -> np.ndarray:
    n = 1 << log_n
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64, at least ``n`` of them."""
    return _powers(base, max(10, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multiplications), a bijection."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # byte offsets of the texts, one more than texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last byte
    ptr: np.ndarray  # word offsets of the texts, one more than texts

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.n)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word; equal words have equal hashes in every batch and process."""
        if not len(self.start):
            return np.zeros(0, U64)
        out = np.empty(len(self.start), U64)
        step = 1 << 22  # bytes handled at once, so that temporaries stay small
        lo = 0
        while lo < len(self.start):
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, base + step, "right")))
            d = self.data[base : self.end[hi - 1]]
            p = powers(BYTE_BASE, len(d) + 1)
            acc = np.zeros(len(d) + 1, U64)
            np.cumsum((d.astype(U64) + U64(1)) * p[: len(d)], out=acc[1:])
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            inv = powers(INV(BYTE_BASE), len(d) + 1)
            out[lo:hi] = mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(U64) * U64(0x632BE59BD9B4E019))
            lo = hi
        return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    return raw, at - at[0]


def split(texts: pa.Array, lower: bool, word_bytes: np.ndarray = NON_SPACE) -> Words:
    data, at = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    np.take(word_bytes, data, out=inside[:-1])
    first = inside[:-1].copy()
    before = inside[:-1]
    first[1:] &= ~before[:-1]
    heads = at[:-1][(at[:-1] < len(data)) & (np.diff(at) > 0)]
    first[heads] = before[heads]
    last = inside[:-1].copy()
    last[:-1] &= ~before[1:]
    tails = at[1:][np.diff(at) > 0] - 1
    last[tails] = before[tails]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def windows(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of each ``k`` consecutive words of one text, and where each starts."""
    n = np.maximum(np.diff(ptr) - k + 1, 0)
    at = np.repeat(ptr[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    if not len(at):
        return np.zeros(0, U64), at
    p = powers(WORD_BASE, len(h) + 1)
    acc = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[: len(h)], out=acc[1:])
    inv = powers(INV(WORD_BASE), len(h) + 1)
    return mix((acc[at + k] - acc[at]) * inv[at]), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

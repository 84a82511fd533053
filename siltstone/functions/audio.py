"""Audio landmarks: framed spectra, band maxima, peaks in frequency and time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import types as t

# Analysis geometry.
RATE, WINDOW, HOP = 44100, 4096, 2048
STRIDE, FIRST_BIN, BANDS, RADIUS = 8, 3, 58, 4


def mono(samples: np.ndarray) -> np.ndarray:
    """Mean over channels (frames, channels), truncated toward zero."""
    total = samples.astype(np.int64).sum(1)
    return (np.sign(total) * (np.abs(total) // samples.shape[1])).astype(np.int32)


def band_energy(signal: np.ndarray) -> np.ndarray:
    """(frames, bands): largest squared magnitude of each run of bins under a symmetric Hann window."""
    n = (len(signal) - WINDOW) // HOP + 1 if len(signal) >= WINDOW else 0
    if not n:
        return np.zeros((0, BANDS))
    frames = np.lib.stride_tricks.sliding_window_view(signal.astype(np.float64), WINDOW)[::HOP][:n]
    spectrum = np.fft.rfft(frames * np.hanning(WINDOW), axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return power[:, FIRST_BIN : FIRST_BIN + BANDS * STRIDE].reshape(n, BANDS, STRIDE).max(2)


def peaks_of(signal: np.ndarray) -> list[tuple[int, int]]:
    """(frame, band) of the landmarks, ascending.

    Above the left neighbour, at least the right one (beyond the edge counts as -1), and strictly
    above the same band in the four frames on either side.
    """
    e = band_energy(signal)
    if not len(e):
        return []
    wide = np.pad(e, ((0, 0), (1, 1)), constant_values=-1.0)
    own = (e > wide[:, :-2]) & (e >= wide[:, 2:])
    tall = np.pad(e, ((RADIUS, RADIUS), (0, 0)), constant_values=-np.inf)
    for d in range(-RADIUS, RADIUS + 1):
        if d:
            own &= e > tall[RADIUS + d : RADIUS + d + len(e)]
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(own), strict=True)]


def fingerprint(peaks: list[tuple[int, int]]) -> int:
    """One bit for the lowest band of each frame that has a landmark."""
    low: dict[int, int] = {}
    for a, b in peaks:
        low[a] = min(b, low.get(a, b))
    out = 0
    for b in low.values():
        out |= 1 << (b % 64)
    return out


@F.pandas_udf(t.array(t.struct(t=t.INT, f=t.INT)))
def landmarks(pcm: pd.Series) -> pd.Series:
    """Landmarks of mono 32-bit little-endian PCM at the fixed rate."""
    return pcm.map(lambda x: None if x is None else [{"t": a, "f": b} for a, b in peaks_of(np.frombuffer(bytes(x), "<i4"))])


@F.pandas_udf(t.array(t.INT))
def to_mono(samples: pd.Series, channels: pd.Series) -> pd.Series:
    """Mono frames of interleaved samples (null unless they fill their frames)."""
    def one(x, c):
        return None if x is None or c != c or c < 1 or len(x) % int(c) else mono(np.asarray(x, np.int64).reshape(-1, int(c)))

    return pd.Series([one(*x) for x in zip(samples, channels, strict=True)])


@F.pandas_udf(t.LONG)
def fingerprint_of(peaks: pd.Series) -> pd.Series:
    """``fingerprint`` of lists of (t, f)."""
    def one(x):
        if x is None:
            return None
        v = fingerprint([(p["t"], p["f"]) for p in x])
        return v - (1 << 64) if v >> 63 else v

    return pd.Series([one(x) for x in peaks], dtype="Int64")

"""Deterministic files for tests and benchmarks: pictures, tones, prose and blobs of any size."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import types as t
from siltstone.functions.audio import RATE
from siltstone.functions.u64 import splitmix, splitmix_bytes
from siltstone.sources import png

_VOWELS, _CONSONANTS = "aeiou", "bdfgklmnprstv"


def patterned(width: int, height: int, seed: int = 1) -> np.ndarray:
    """A smooth RGB picture: sums of waves whose directions and lengths come from the seed."""
    y, x = np.mgrid[0:height, 0:width]
    u = splitmix(seed, 12).astype(float) / 2.0**64
    waves = [np.sin((u[3 * c] - 0.5) * x / 9 + (u[3 * c + 1] - 0.5) * y / 9 + 6 * u[3 * c + 2]) for c in range(4)]
    return np.stack([np.clip(128 + 60 * waves[c] + 50 * waves[3], 0, 255) for c in range(3)], 2).astype(np.uint8)


def perturbed(image: np.ndarray, amount: int, seed: int = 1) -> np.ndarray:
    """Every sample moved by at most ``amount``."""
    noise = np.frombuffer(splitmix_bytes(seed, image.size), np.uint8).reshape(image.shape).astype(int) % (2 * amount + 1) - amount
    return np.clip(image.astype(int) + noise, 0, 255).astype(np.uint8)


def bmp24(image: np.ndarray) -> bytes:
    """An RGB picture as an uncompressed 24-bit bitmap, bottom row first."""
    h, w = image.shape[:2]
    line = -(-3 * w // 4) * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * line, 2835, 2835, 0, 0)
    return struct.pack("<2sIHHI", b"BM", 54 + h * line, 0, 0, 54) + head + rows.tobytes()


def tone(freqs: tuple[float, ...], seconds: float, rate: int = RATE) -> np.ndarray:
    """Tones that take turns every tenth of a second, as 16-bit samples, so that their landmarks have times."""
    x = np.arange(int(seconds * rate))
    f = np.asarray(freqs, float)[(x * 10 // rate) % len(freqs)]
    return (9000 * np.sin(2 * np.pi * np.cumsum(f) / rate)).astype(np.int16)


def wav16(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Mono 16-bit samples as a RIFF file."""
    data = samples.astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def prose(size: int, seed: int = 1) -> str:
    """``size`` ASCII characters of made-up sentences."""
    out, n, u = [], 0, splitmix(seed, size // 2 + 8)
    for v in u.tolist():
        word = "".join(_CONSONANTS[(v >> (9 * i)) % 13] + _VOWELS[(v >> (9 * i + 4)) % 5] for i in range(1 + (v >> 60) % 3))
        word += ". " if (v >> 56) % 11 == 0 else " "
        out.append(word)
        n += len(word)
        if n >= size:
            break
    return "".join(out)[:size]


def blob(size: int, seed: int = 1) -> bytes:
    return splitmix_bytes(seed, size)


def _gray(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, width)


def _zipped(data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("empty", b"")
        z.writestr("content", data)
    return out.getvalue()


def _files(make):
    @F.pandas_udf(t.BINARY)
    def column(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else make(bytes(x)))

    return column


#: Files around payloads: gray pictures of 48 columns (whole rows), 16-bit mono sounds, archives and streams.
WIDTH = 48
png_of = _files(lambda x: png.encode(_gray(x, WIDTH)))
bmp_of = _files(lambda x: bmp24(np.repeat(_gray(x, WIDTH)[:, :, None], 3, 2)))
wav_of = _files(lambda x: wav16(np.frombuffer(x, "<i2")))
zip_of = _files(_zipped)
zlib_of = _files(zlib.compress)

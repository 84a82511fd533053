"""Raster steps: luma, isometries, box average, cosine transform, perceptual hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import types as t

# Hash grid and the block that is kept.
GRID, KEEP = 32, 8
MAX_PIXELS_BYTES = 1 << 30


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rounded integer BT.601 luma."""
    whole = F.lit(299) * r + F.lit(587) * g + F.lit(114) * b + F.lit(500)
    return ((whole - whole % 1000) / 1000).cast("int")


def to_8_bit(v: Column) -> Column:
    return F.shiftright(v, 8)


def gray(image: np.ndarray) -> np.ndarray:
    """(h, w) or (h, w, channels) of 8 or 16 bits to 8-bit gray; alpha is dropped."""
    if image.dtype == np.uint16:
        image = (image >> 8).astype(np.uint8)
    if image.ndim == 2:
        return image
    if image.shape[2] < 3:
        return image[:, :, 0]
    x = image.astype(np.int64)
    return ((299 * x[:, :, 0] + 587 * x[:, :, 1] + 114 * x[:, :, 2] + 500) // 1000).astype(np.uint8)


def rgb_payload(image: np.ndarray) -> bytes:
    """What tier 1 hashes: RGB bytes row by row, gray replicated, alpha dropped, 16 bits cut to 8."""
    if image.dtype == np.uint16:
        image = (image >> 8).astype(np.uint8)
    if image.ndim == 2 or image.shape[2] < 3:
        flat = image if image.ndim == 2 else image[:, :, 0]
        image = np.repeat(flat[:, :, None], 3, 2)
    return np.ascontiguousarray(image[:, :, :3]).tobytes()


def _bounds(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    j = np.arange(n_out)
    lo, hi = j * n_in // n_out, (j + 1) * n_in // n_out
    center = np.minimum((2 * j + 1) * n_in // (2 * n_out), n_in - 1)
    empty = lo >= hi
    return np.where(empty, center, lo), np.where(empty, center + 1, hi)


def box_average(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rounded mean of each source box, by an integral image."""
    if width <= 0 or height <= 0:
        raise ValueError("output dimension is zero")
    x = image.astype(np.int64)
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1, *x.shape[2:]), np.int64)
    total[1:, 1:] = x.cumsum(0).cumsum(1)
    y0, y1 = _bounds(x.shape[0], height)
    x0, x1 = _bounds(x.shape[1], width)
    s = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    n = ((y1 - y0)[:, None] * (x1 - x0)[None, :]).reshape(height, width, *[1] * (x.ndim - 2))
    return ((2 * s + n) // (2 * n)).astype(image.dtype)


def basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II matrix; its transpose is the inverse."""
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def dct2(x: np.ndarray) -> np.ndarray:
    return basis(len(x)) @ x


def idct2(x: np.ndarray) -> np.ndarray:
    return basis(len(x)).T @ x


def dct2_2d(x: np.ndarray) -> np.ndarray:
    return basis(x.shape[0]) @ (x @ basis(x.shape[1]).T)


def idct2_2d(x: np.ndarray) -> np.ndarray:
    return basis(x.shape[0]).T @ (x @ basis(x.shape[1]))


def median(values: np.ndarray) -> float | None:
    """The lower middle value; none of nothing."""
    return None if not len(values) else float(np.sort(values)[(len(values) - 1) // 2])


def phash(image: np.ndarray) -> int:
    """64 bits, row by row from the highest: coefficient above the median of all but the first."""
    small = box_average(gray(image), GRID, GRID).astype(np.float64)
    kept = dct2_2d(small)[:KEEP, :KEEP].ravel()
    return int("".join("1" if x > median(kept[1:]) else "0" for x in kept), 2)


#: The eight isometries of a square, by name; each takes and gives an array.
ISOMETRIES = {
    "identity": lambda a: a,
    "flip_h": lambda a: a[:, ::-1],
    "flip_v": lambda a: a[::-1],
    "rot90": lambda a: np.rot90(a, -1),
    "rot180": lambda a: np.rot90(a, 2),
    "rot270": lambda a: np.rot90(a, 1),
    "transpose": lambda a: np.swapaxes(a, 0, 1),
    "transverse": lambda a: np.swapaxes(a, 0, 1)[::-1, ::-1],
}
#: EXIF orientation tags 1 to 8 in order.
ORIENTATION = ("identity", "flip_h", "rot180", "flip_v", "transpose", "rot90", "transverse", "rot270")


def apply_orientation(image: np.ndarray, tag: int) -> np.ndarray:
    if not 1 <= tag <= 8:
        raise ValueError("orientation must be 1 to 8")
    return np.ascontiguousarray(ISOMETRIES[ORIENTATION[tag - 1]](image))


def variants(image: np.ndarray) -> list[np.ndarray]:
    """All eight isometries of a square."""
    if image.shape[0] != image.shape[1]:
        raise ValueError("only a square has all eight")
    return [np.ascontiguousarray(f(image)) for f in ISOMETRIES.values()]


def center_square(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    n = min(h, w)
    y, x = (h - n) // 2, (w - n) // 2
    return image[y : y + n, x : x + n]


def from_bytes(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    if width * height * channels > MAX_PIXELS_BYTES or len(data) != width * height * channels:
        raise ValueError("raster size")
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[:, :, 0] if channels == 1 else a


@F.pandas_udf(t.LONG)
def image_phash(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
    """Perceptual hash of raw rasters (null if the sizes don't fit)."""
    def one(d, w, h, c):
        if d is None or w != w or h != h or c != c or not w * h:
            return None
        try:
            v = phash(from_bytes(bytes(d), int(w), int(h), int(c)))
        except ValueError:
            return None
        return v - (1 << 64) if v >> 63 else v

    return pd.Series([one(*x) for x in zip(data, width, height, channels, strict=True)], dtype="Int64")


@F.pandas_udf(t.DOUBLE)
def median_of(values: pd.Series) -> pd.Series:
    """``median`` of lists."""
    return pd.Series([None if x is None else median(np.asarray(x, float)) for x in values], dtype="Float64")


@F.pandas_udf(t.BINARY)
def oriented(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, tag: pd.Series) -> pd.Series:
    """Raw rasters turned upright by their orientation tag (null if a size or tag doesn't fit)."""
    def one(d, w, h, c, o):
        if d is None or any(x != x for x in (w, h, c, o)):
            return None
        try:
            return apply_orientation(from_bytes(bytes(d), int(w), int(h), int(c)), int(o)).tobytes()
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(data, width, height, channels, tag, strict=True)])


@F.pandas_udf(t.array(t.BINARY))
def square_variants(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
    """The eight isometries of the middle square of raw rasters, in the order of ``ISOMETRIES``."""
    def one(d, w, h, c):
        if d is None or any(x != x for x in (w, h, c)):
            return None
        try:
            return [x.tobytes() for x in variants(center_square(from_bytes(bytes(d), int(w), int(h), int(c))))]
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(data, width, height, channels, strict=True)])

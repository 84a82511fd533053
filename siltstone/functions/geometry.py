"""Geometric evidence: corners, steered binary descriptors, robust affine fits, time warping, 3x3 algebra."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import types as t
from siltstone.functions.u64 import ALL, GAMMA, splitmix

# Corner threshold and arc, patch radius, descriptor seed and bits, fit and band defaults.
CORNER, ARC, PATCH = 20, 9, 15
SEED, BITS = 0x4F52423332363130, 256
PIXELS, ITERATIONS, BAND = 4.0, 500, 0.10
RING = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))


def _stream(seed: int, block: int = 4096):
    while True:
        yield from (int(x) for x in splitmix(seed, block))
        seed = (seed + block * GAMMA) & ALL


def _pairs() -> np.ndarray:
    """Test pairs drawn from the square and kept when both ends lie in the disk."""
    out, s = [], _stream(SEED)
    while len(out) < BITS:
        x1, y1, x2, y2 = (v % (2 * PATCH + 1) - PATCH for v in islice(s, 4))
        if max(x1 * x1 + y1 * y1, x2 * x2 + y2 * y2) <= PATCH * PATCH:
            out.append((x1, y1, x2, y2))
    return np.array(out)


PAIRS = _pairs()


def corner_scores(gray: np.ndarray) -> np.ndarray:
    """For each pixel the best arc's smallest contrast; 0 within three pixels of the border."""
    h, w = gray.shape
    out = np.zeros((h, w), np.int32)
    if h < 7 or w < 7:
        return out
    g = gray.astype(np.int32)
    d = np.stack([g[3 + y : h - 3 + y, 3 + x : w - 3 + x] for x, y in RING]) - g[3 : h - 3, 3 : w - 3]
    d = np.concatenate((d, d[: ARC - 1]))
    arcs = np.lib.stride_tricks.sliding_window_view(d, ARC, axis=0)
    bright, dark = arcs.min(-1).max(0), (-arcs.max(-1)).max(0)
    out[3 : h - 3, 3 : w - 3] = np.maximum(0, np.maximum(bright, dark))
    return out


def fast9(gray: np.ndarray, threshold: int = CORNER) -> list[tuple[int, int, int]]:
    """(x, y, score) of the corners in row order."""
    s = corner_scores(gray)
    return [(int(x), int(y), int(s[y, x])) for y, x in zip(*np.nonzero(s > threshold), strict=True)]


def suppress(corners: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Corners that no neighbour beats; of equal neighbours the earlier in the list stays."""
    at = {(x, y): (s, -i) for i, (x, y, s) in enumerate(corners)}
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    return [c for i, c in enumerate(corners) if all(at.get((c[0] + a, c[1] + b), (-1, 0)) < (c[2], -i) for a, b in near)]


def top_corners(corners: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    return sorted(corners, key=lambda c: (-c[2], c[1], c[0]))[:most]


def orientation(gray: np.ndarray, x: int, y: int) -> float | None:
    """Angle of the intensity centroid of the square patch; none if it leaves the image."""
    h, w = gray.shape
    if not (PATCH <= x < w - PATCH and PATCH <= y < h - PATCH):
        return None
    p = gray[y - PATCH : y + PATCH + 1, x - PATCH : x + PATCH + 1].astype(np.int64)
    k = np.arange(-PATCH, PATCH + 1)
    return float(np.arctan2(float((p * k[:, None]).sum()), float((p * k[None, :]).sum())))


def descriptor(gray: np.ndarray, x: int, y: int) -> bytes | None:
    theta = orientation(gray, x, y)
    if theta is None:
        return None
    c, s = np.cos(theta), np.sin(theta)
    away = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(int)
    values = []
    for a, b in ((PAIRS[:, 0], PAIRS[:, 1]), (PAIRS[:, 2], PAIRS[:, 3])):
        px, py = x + away(a * c - b * s), y + away(a * s + b * c)
        if (px < 0).any() or (py < 0).any() or (px >= gray.shape[1]).any() or (py >= gray.shape[0]).any():
            return None
        values.append(gray[py, px])
    return np.packbits(values[0] < values[1]).tobytes()


def orb(gray: np.ndarray, most: int = 500) -> list[dict]:
    out = []
    for x, y, _ in top_corners(suppress(fast9(gray)), most) if most else []:
        d = descriptor(gray, x, y)
        if d is not None:
            out.append({"x": x, "y": y, "angle": orientation(gray, x, y), "desc": d})
    return out


def solve3(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-12) -> np.ndarray | None:
    """Solution of a 3x3 system; none if it is singular relative to its size."""
    scale = np.abs(a).max()
    if not np.isfinite(scale) or scale == 0 or abs(np.linalg.det(a / scale)) <= tolerance:
        return None
    return np.linalg.solve(a, b)


def inverse3(a: np.ndarray) -> np.ndarray | None:
    return solve3(a, np.eye(3))


def rotation(m: np.ndarray) -> float:
    return float(np.arctan2(m[1, 0] - m[0, 1], m[0, 0] + m[1, 1]))


def scale(m: np.ndarray) -> float:
    return float(np.sqrt(abs(m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0])))


def ransac_affine(src: np.ndarray, dst: np.ndarray, pixels: float = PIXELS, iterations: int = ITERATIONS, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(2x3 model, inlier indices, mean error): most inliers, then the smaller mean error, then the earlier draw."""
    if len(src) != len(dst) or len(src) < 3:
        raise ValueError("at least three point pairs are needed")
    s, n, best, key = _stream(seed), len(src), None, None
    one = np.column_stack((src, np.ones(n)))
    for _ in range(iterations):
        pick: list[int] = []
        for v in islice(s, 64):
            if v % n not in pick:
                pick.append(v % n)
                if len(pick) == 3:
                    break
        if len(pick) < 3:
            continue
        m = solve3(one[pick], dst[pick])
        if m is None:
            continue
        e2 = ((one @ m - dst) ** 2).sum(1)
        ok = np.flatnonzero(e2 <= pixels * pixels)
        error = float(np.sqrt(e2[ok]).mean()) if len(ok) else float("inf")
        if key is None or (-len(ok), error) < key:
            key, best = (-len(ok), error), (m.T.copy(), ok, error)
    if best is None:
        raise ValueError("no fit")
    return best


def dtw(cost: np.ndarray, band: float = BAND) -> float:
    """Mean cost per step of the cheapest warping path in the band; 1 if there is none. Negative: no band."""
    n, m = cost.shape
    if not n or not m:
        return 1.0
    width = max(band * max(n, m), 2.0)
    i = np.arange(n + 1)
    lo = np.ones(n + 1) if band < 0 else np.floor(np.maximum(i * m / n - width, 1.0))
    hi = np.full(n + 1, m) if band < 0 else np.floor(np.minimum(i * m / n + width, m))
    # Cells of one antidiagonal depend on the two before it alone; places are rows.
    inf = float("inf")
    before, last = (np.full(n + 1, inf) for _ in range(2))
    before_steps, steps = (np.zeros(n + 1, np.int64) for _ in range(2))
    before[0] = 0.0
    for d in range(2, n + m + 1):
        r = np.arange(max(1, d - m), min(n, d - 1) + 1)
        r = r[(d - r >= lo[r]) & (d - r <= hi[r])]
        here, here_steps = np.full(n + 1, inf), np.zeros(n + 1, np.int64)
        # The diagonal wins ties, then the row above.
        best, count = before[r - 1], before_steps[r - 1]
        for x, k in ((last[r - 1], steps[r - 1]), (last[r], steps[r])):
            best, count = np.where(x < best, x, best), np.where(x < best, k, count)
        here[r], here_steps[r] = best + cost[r - 1, d - r - 1], count + 1
        before, before_steps, last, steps = last, steps, here, here_steps
    return float(last[n] / steps[n]) if last[n] < inf and steps[n] else 1.0


def dtw_series(a: np.ndarray, b: np.ndarray, band: float = BAND) -> float:
    return dtw(np.abs(np.asarray(a, float)[:, None] - np.asarray(b, float)[None, :]), band)


@F.pandas_udf(t.DOUBLE)
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else dtw_series(x, y) for x, y in zip(a, b, strict=True)], dtype="Float64")


@F.pandas_udf(t.array(t.struct(x=t.INT, y=t.INT, angle=t.DOUBLE, desc=t.BINARY)))
def orb_features(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Features of 8-bit gray rasters, strongest first."""
    return pd.Series([None if p is None else orb(np.frombuffer(bytes(p), np.uint8).reshape(int(h), int(w))) for p, w, h in zip(pixels, width, height, strict=True)])


@F.pandas_udf(t.struct(model=t.array(t.DOUBLE), inliers=t.array(t.INT), error=t.DOUBLE, rotation=t.DOUBLE, scale=t.DOUBLE))
def affine_fit(src: pd.Series, dst: pd.Series) -> pd.DataFrame:
    """Robust affine fit of two lists of (x, y) (null where there is none): the 2x3 model row by row, inliers, mean error."""
    fields = ("model", "inliers", "error", "rotation", "scale")

    def one(a, b):
        if a is None or b is None:
            return dict.fromkeys(fields)
        try:
            m, ok, e = ransac_affine(*(np.array([(p["x"], p["y"]) for p in x], float).reshape(-1, 2) for x in (a, b)))
        except ValueError:
            return dict.fromkeys(fields)
        return dict(zip(fields, (m.ravel().tolist(), ok.tolist(), e, rotation(m), scale(m)), strict=True))

    return pd.DataFrame([one(*x) for x in zip(src, dst, strict=True)], columns=list(fields), dtype=object)


def project(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points (n, 2) through a 2x3 model."""
    return points @ m[:, :2].T + m[:, 2]


def det3(a: np.ndarray) -> float:
    """Determinant along the first row."""
    minor = lambda j: np.delete(a[1:], j, 1)
    return float(sum((-1) ** j * a[0, j] * (minor(j)[0, 0] * minor(j)[1, 1] - minor(j)[0, 1] * minor(j)[1, 0]) for j in range(3)))


def multiply3(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * b[None, :, :]).sum(1)


def apply3(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (a * v[None, :]).sum(1)

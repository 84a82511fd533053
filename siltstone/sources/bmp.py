"""BMP: 24 and 32 bits, bit fields, and run-length coded 8 bits, to RGBA rows."""

from __future__ import annotations

import numpy as np

from siltstone.sources.errors import Reader, Refused, bad, truncated, unsupported

MAX_BYTES = 1 << 30


def _scaled(raw: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.full(raw.shape, 255, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    if top & (top + 1):
        raise bad("a colour mask with gaps")
    return ((((raw & mask) >> shift) * 255 + top // 2) // top).astype(np.uint8)


def header(data: bytes) -> dict:
    r = Reader(data)
    if r.take(2, "magic") != b"BM":
        raise Refused("InvalidMagic", "bmp")
    r.take(8, "file header")
    start, size = r.le(4, "data offset"), r.le(4, "header size")
    if size not in (40, 108, 124):
        raise unsupported(f"header of {size} bytes")
    width, height = r.le(4, "width", True), r.le(4, "height", True)
    planes, bits, packing = r.le(2, "planes"), r.le(2, "bits"), r.le(4, "compression")
    r.take(12, "sizes")
    used = r.le(4, "colours")
    r.take(4, "important colours")
    if width <= 0 or height == 0 or planes != 1:
        raise bad("dimensions")
    if width * abs(height) * 4 > MAX_BYTES:
        raise Refused("TooLarge", "raster")
    if (bits, packing) not in {(24, 0), (32, 0), (16, 3), (32, 3), (8, 1), (8, 0)}:
        raise unsupported(f"{bits} bits with compression {packing}")
    return {"start": start, "size": size, "width": width, "height": height, "bits": bits, "packing": packing, "used": used}


def decode(data: bytes) -> np.ndarray:
    """(h, w, 4) of 8 bits, top row first."""
    h = header(data)
    width, height, bits = h["width"], abs(h["height"]), h["bits"]
    after = 14 + h["size"]
    masks = (0xFF0000, 0xFF00, 0xFF, 0)
    if h["packing"] == 3:
        r = Reader(data, 54)
        masks = (r.le(4, "mask"), r.le(4, "mask"), r.le(4, "mask"), r.le(4, "mask") if h["size"] > 40 else 0)
        if h["size"] == 40:
            after += 12
        if any(a & b for i, a in enumerate(masks) for b in masks[:i]):
            raise bad("colour masks that overlap")
    if h["start"] < after:
        raise bad("pixels inside the headers")
    body = data[h["start"] :]
    if bits == 8:
        n = h["used"] or 256
        if n > 256 or after + 4 * n > len(data):
            raise bad("palette")
        palette = np.frombuffer(data[after : after + 4 * n], np.uint8).reshape(-1, 4)
        index = _runs(body, width, height) if h["packing"] == 1 else _rows(body, width, height, 8).reshape(height, -1)[:, :width]
        if int(index.max(initial=0)) >= n:
            raise bad("index beyond the palette")
        out = np.concatenate((palette[index][:, :, 2::-1], np.full((height, width, 1), 255, np.uint8)), 2)
    elif bits == 24:
        rows = _rows(body, width, height, 24)[:, : 3 * width].reshape(height, width, 3)
        out = np.concatenate((rows[:, :, ::-1], np.full((height, width, 1), 255, np.uint8)), 2)
    else:
        raw = _rows(body, width, height, bits)[:, : width * bits // 8].copy().view(f"<u{bits // 8}").astype(np.int64)
        out = np.stack([_scaled(raw, m) for m in masks], 2)
    return np.ascontiguousarray(out if h["height"] < 0 else out[::-1])


def _rows(body: bytes, width: int, height: int, bits: int) -> np.ndarray:
    line = (width * bits + 31) // 32 * 4
    if len(body) < line * height:
        raise truncated("pixels")
    return np.frombuffer(body[: line * height], np.uint8).reshape(height, line)


def _runs(body: bytes, width: int, height: int) -> np.ndarray:
    """Run-length rows, bottom first; what isn't written shows palette entry 0."""
    out, r, x, y = np.zeros((height, width), np.uint8), Reader(body), 0, 0
    while True:
        n, v = r.le(1, "run"), r.le(1, "run")
        if n:
            values = bytes([v]) * n
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            return out
        elif v == 2:
            x, y = x + r.le(1, "delta"), y + r.le(1, "delta")
            continue
        else:
            values = r.take(v, "absolute run")
            if v % 2:
                r.take(1, "pad")
        if y >= height or x + len(values) > width:
            raise bad("a run beyond its row")
        out[y, x : x + len(values)] = np.frombuffer(values, np.uint8)
        x += len(values)

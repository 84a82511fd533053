"""PNG: all colour types and depths, both interlacings, checked chunks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from siltstone.sources.archive import inflate_zlib
from siltstone.sources.errors import Refused, bad, truncated, unsupported

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: x0, y0, dx, dy of the passes of the interlaced form.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
MAX_IN, MAX_OUT = 64 << 20, 256 << 20


def _chunks(data: bytes):
    if data[:8] != MAGIC:
        raise Refused("InvalidMagic", "png")
    at, order = 8, []
    while True:
        if at + 12 > len(data):
            raise truncated("chunk")
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data):
            raise truncated("chunk body")
        if zlib.crc32(name + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise bad("chunk checksum")
        at += 12 + n
        if not order and name != b"IHDR" or order and name == b"IHDR":
            raise bad("IHDR must come first and once")
        if name not in (b"IHDR", b"PLTE", b"IDAT", b"IEND") and not name[0] & 0x20:
            raise unsupported(f"critical chunk {name!r}")
        if name == b"IDAT" and b"IDAT" in order and order[-1] != b"IDAT":
            raise bad("IDAT chunks must follow each other")
        if name in (b"PLTE", b"tRNS") and b"IDAT" in order:
            raise bad(f"{name.decode()} after IDAT")
        order.append(name)
        yield name, body
        if name == b"IEND":
            if at != len(data):
                raise bad("bytes after IEND")
            return


def header(body: bytes) -> tuple[int, int, int, int, int]:
    if len(body) != 13:
        raise bad("IHDR length")
    w, h, depth, kind, packing, filtering, lace = struct.unpack(">IIBBBBB", body)
    if not w or not h or w >> 31 or h >> 31 or kind not in CHANNELS or depth not in DEPTHS[kind] or packing or filtering or lace > 1:
        raise bad("IHDR")
    return w, h, depth, kind, lace


def _unfilter(raw: bytes, rows: int, line: int, step: int) -> np.ndarray:
    out = np.zeros((rows + 1, line), np.uint8)
    for y in range(rows):
        kind, cur = raw[y * (line + 1)], np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1)
        up = out[y]
        if kind == 0:
            out[y + 1] = cur
        elif kind == 1:
            pad = np.zeros(-(-line // step) * step, np.uint8)
            pad[:line] = cur
            out[y + 1] = np.cumsum(pad.reshape(-1, step), 0, dtype=np.uint8).ravel()[:line]
        elif kind == 2:
            out[y + 1] = cur + up
        elif kind in (3, 4):
            o, c, u = [0] * line, cur.tolist(), up.tolist()
            for i in range(line):
                a, b, d = (o[i - step], u[i], u[i - step]) if i >= step else (0, u[i], 0)
                if kind == 3:
                    p = (a + b) >> 1
                else:
                    e = a + b - d
                    pa, pb, pc = abs(e - a), abs(e - b), abs(e - d)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else d
                o[i] = (c[i] + p) & 255
            out[y + 1] = o
        else:
            raise bad("row filter")
    return out[1:]


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    if depth == 16:
        return rows.copy().view(">u2").astype(np.uint16).reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)[:, :width]
    return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)[:, :, None]


def decode(data: bytes) -> np.ndarray:
    """(h, w) gray, or (h, w, 3 or 4), of 8 or 16 bits."""
    if len(data) > MAX_IN:
        raise Refused("TooLarge", "png")
    head = palette = clear = None
    stream = []
    for name, body in _chunks(data):
        if name == b"IHDR":
            head = header(body)
        elif name == b"PLTE":
            if head[3] in (0, 4) or palette is not None or len(body) % 3 or not 3 <= len(body) <= 768:
                raise bad("PLTE")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            if head[3] in (4, 6) or head[3] == 3 and (palette is None or len(body) > len(palette)) or head[3] == 0 and len(body) != 2 or head[3] == 2 and len(body) != 6:
                raise bad("tRNS")
            clear = body
        elif name == b"IDAT":
            stream.append(body)
    w, h, depth, kind, lace = head
    channels = CHANNELS[kind]
    step = max(1, depth * channels // 8)
    passes = ADAM7 if lace else ((0, 0, 1, 1),)
    sizes = [(-(-(w - x) // dx), -(-(h - y) // dy)) if w > x and h > y else (0, 0) for x, y, dx, dy in passes]
    lines = [(pw * depth * channels + 7) // 8 for pw, _ in sizes]
    total = sum((line + 1) * ph for (pw, ph), line in zip(sizes, lines, strict=True) if pw and ph)
    if w * h * channels * (2 if depth == 16 else 1) > MAX_OUT:
        raise Refused("TooLarge", "raster")
    raw = inflate_zlib(b"".join(stream), total)
    if len(raw) != total:
        raise bad("pixel data length")
    out, at = np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8), 0
    for (x, y, dx, dy), (pw, ph), line in zip(passes, sizes, lines, strict=True):
        if pw and ph:
            out[y::dy, x::dx] = _samples(_unfilter(raw[at : at + (line + 1) * ph], ph, line, step), pw, depth, channels)
            at += (line + 1) * ph
    full = 65535 if depth == 16 else 255
    if kind == 3:
        if palette is None or int(out.max(initial=0)) >= len(palette):
            raise bad("index beyond the palette")
        rgb = palette[out[:, :, 0]]
        if clear is None:
            return rgb
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.dstack((rgb, alpha[out[:, :, 0]]))
    alpha = None
    if clear is not None:
        key = np.frombuffer(clear, ">u2").astype(np.int64)
        alpha = np.where((out.astype(np.int64) == key).all(2), 0, full).astype(out.dtype)
    if kind in (0, 4):
        g = out[:, :, 0] * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else out[:, :, 0]
        a = out[:, :, 1] if kind == 4 else alpha
        return g if a is None else np.dstack((g, g, g, a))
    return out if alpha is None else np.dstack((out, alpha))


def encode(image: np.ndarray) -> bytes:
    """A plain 8-bit file (stored rows), for fixtures."""
    a = image[:, :, None] if image.ndim == 2 else image
    kind = {1: 0, 3: 2, 4: 6}[a.shape[2]]
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 0)) + chunk(b"IEND", b"")

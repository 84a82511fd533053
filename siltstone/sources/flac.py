"""FLAC: constant, verbatim and fixed-predictor subframes; linear prediction is refused."""

from __future__ import annotations

import numpy as np

from siltstone.sources.errors import Refused, bad, truncated, unsupported
from siltstone.sources.wav import Pcm

# Block sizes, sample rates and sample sizes by code, and fixed predictors.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
PREDICT = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _crc(data: bytes, poly: int, bits: int) -> int:
    crc, top, mask = 0, 1 << (bits - 1), (1 << bits) - 1
    for b in data:
        crc ^= b << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
    return crc


class Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos, self.end = data, at * 8, len(data) * 8

    def get(self, n: int) -> int:
        if self.pos + n > self.end:
            raise truncated("frame")
        first, last = self.pos // 8, (self.pos + n + 7) // 8
        v = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.pos - n)
        self.pos += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.get(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.get(1):
            n += 1
        return n

    def coded(self) -> int:
        b, n = self.get(8), 0
        while b & (0x80 >> n):
            n += 1
        if n in (1, 8):
            raise bad("coded number")
        v = b & (0x7F >> n)
        for _ in range(max(0, n - 1)):
            c = self.get(8)
            if c >> 6 != 2:
                raise bad("coded number")
            v = v << 6 | c & 63
        return v


def streaminfo(data: bytes) -> tuple[dict, int]:
    if data[:4] != b"fLaC":
        raise Refused("InvalidMagic", "flac")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise truncated("metadata")
        kind, n = data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if len(body) < n:
            raise truncated("metadata")
        if kind == 127 or (info is None) != (kind == 0):
            raise bad("metadata block")
        if kind == 0:
            if n != 34:
                raise bad("stream info")
            v = int.from_bytes(body[10:18], "big")
            info = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "total": v & (1 << 36) - 1}
        last, at = data[at] >> 7, at + 4 + n
        if last:
            return info, at


def _residual(b: Bits, size: int, order: int) -> list[int]:
    method = b.get(2)
    if method > 1:
        raise bad("residual method")
    width, parts = 4 + method, b.get(4)
    if size % (1 << parts) or size >> parts < order:
        raise bad("residual partitions")
    out: list[int] = []
    for i in range(1 << parts):
        n, k = (size >> parts) - (order if not i else 0), b.get(width)
        if k == (1 << width) - 1:
            raw = b.get(5)
            out += [b.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            v = b.unary() << k | (b.get(k) if k else 0)
            out.append(v >> 1 ^ -(v & 1))
    return out


def _subframe(b: Bits, size: int, bits: int) -> np.ndarray:
    if b.get(1):
        raise bad("subframe padding")
    kind = b.get(6)
    waste = b.unary() + 1 if b.get(1) else 0
    bits -= waste
    if bits <= 0:
        raise bad("wasted bits")
    if kind == 0:
        out = [b.signed(bits)] * size
    elif kind == 1:
        out = [b.signed(bits) for _ in range(size)]
    elif 8 <= kind <= 12:
        c = PREDICT[kind - 8]
        if len(c) > size:
            raise bad("predictor order")
        out = [b.signed(bits) for _ in c]
        for e in _residual(b, size, len(c)):
            out.append(e + sum(w * out[-1 - j] for j, w in enumerate(c)))
    elif kind >= 32:
        raise unsupported("linear prediction")
    else:
        raise bad("subframe type")
    return np.array(out, np.int64) << waste


def decode(data: bytes) -> Pcm:
    info, at = streaminfo(data)
    blocks, done = [], 0
    while len(data) - at >= 2:
        b = Bits(data, at)
        if b.get(14) != 0x3FFE or b.get(1):
            raise bad("frame sync")
        b.get(1)
        size, rate, layout, width = b.get(4), b.get(4), b.get(4), b.get(3)
        if b.get(1) or size == 0 or rate == 15 or layout > 10 or width == 3:
            raise bad("frame header")
        b.coded()
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else b.get(8) + 1 if size == 6 else b.get(16) + 1 if size == 7 else 256 << (size - 8)
        hz = info["rate"] if not rate else RATES.get(rate) or (b.get(8) * 1000 if rate == 12 else b.get(16) * (1 if rate == 13 else 10))
        head = b.pos // 8
        if b.get(8) != _crc(data[at:head], 7, 8):
            raise bad("frame header checksum")
        bits = BITS[width] if width else info["bits"]
        channels = layout + 1 if layout < 8 else 2
        if (hz, bits, channels) != (info["rate"], info["bits"], info["channels"]):
            raise bad("frame differs from the stream")
        side = {8: 1, 9: 0, 10: 1}.get(layout)
        s = [_subframe(b, n, bits + (i == side)) for i in range(channels)]
        if layout == 8:
            s[1] = s[0] - s[1]
        elif layout == 9:
            s[0] = s[0] + s[1]
        elif layout == 10:
            m = s[0] << 1 | s[1] & 1
            s = [(m + s[1]) >> 1, (m - s[1]) >> 1]
        end = (b.pos + 7) // 8
        if int.from_bytes(data[end : end + 2], "big") != _crc(data[at:end], 0x8005, 16) or end + 2 > len(data):
            raise bad("frame checksum")
        blocks.append(np.stack(s, 1))
        done, at = done + n, end + 2
        if info["total"] and done > info["total"]:
            raise bad("more samples than declared")
    if len(data) != at:
        raise truncated("frame")
    out = np.concatenate(blocks) if blocks else np.zeros((0, info["channels"]), np.int64)
    return Pcm(info["rate"], info["channels"], out.astype(np.int32))

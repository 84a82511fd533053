"""WAV: integer and float PCM to interleaved 32-bit samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from siltstone.sources.errors import Reader, Refused, bad, truncated, unsupported


@dataclass
class Pcm:
    rate: int
    channels: int
    samples: np.ndarray  # (frames, channels) int32


def decode(data: bytes) -> Pcm:
    """First ``fmt `` and ``data`` chunk win; integers keep their scale; a partial frame is dropped."""
    r = Reader(data)
    if r.take(4, "riff") != b"RIFF":
        raise Refused("InvalidMagic", "riff")
    r.take(4, "riff size")
    if r.take(4, "wave") != b"WAVE":
        raise Refused("InvalidMagic", "wave")
    fmt = body = None
    while (fmt is None or body is None) and r.left >= 8:
        name, size = r.take(4, "chunk"), r.le(4, "chunk size")
        chunk = r.take(size, "chunk body")
        if size % 2 and r.left:
            r.take(1, "pad")
        if name == b"fmt " and fmt is None:
            fmt = chunk
        elif name == b"data" and body is None:
            body = chunk
    if fmt is None or body is None:
        raise truncated("fmt and data chunks")
    f = Reader(fmt)
    tag, channels, rate, _, align, bits = f.le(2, "tag"), f.le(2, "channels"), f.le(4, "rate"), f.le(4, "bytes a second"), f.le(2, "align"), f.le(2, "bits")
    if not channels or not rate:
        raise bad("channels and rate")
    if (tag, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise unsupported(f"format {tag} with {bits} bits")
    if align != channels * bits // 8:
        raise bad("block align")
    body = body[: len(body) // align * align]
    if tag == 3:
        x = np.frombuffer(body, "<f4" if bits == 32 else "<f8").astype(np.float64) * 2.0**31
        x = np.nan_to_num(np.sign(x) * np.floor(np.abs(x) + 0.5), nan=0.0, posinf=2.0**31, neginf=-(2.0**31))
        out = np.clip(x, -(2**31), 2**31 - 1).astype(np.int64).astype(np.int32)
    elif bits == 8:
        out = np.frombuffer(body, np.uint8).astype(np.int32) - 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        out = ((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8
    else:
        out = np.frombuffer(body, f"<i{bits // 8}").astype(np.int32)
    return Pcm(rate, channels, out.reshape(-1, channels))

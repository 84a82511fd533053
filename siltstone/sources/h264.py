"""H.264 byte streams: units, and what sequence and picture parameter sets say. Pictures are not decoded."""

from __future__ import annotations

import re

from siltstone.sources.errors import bad, truncated, unsupported

PROFILES = {66: "baseline", 77: "main", 88: "extended", 100: "high"}


def units(stream: bytes) -> list[bytes]:
    """Units between start codes, trailing zeros dropped."""
    cuts = [(m.start(), m.end()) for m in re.finditer(b"\x00\x00\x01", stream)]
    ends = [a for a, _ in cuts[1:]] + [len(stream)]
    return [u for (_, s), e in zip(cuts, ends, strict=True) if (u := stream[s:e].rstrip(b"\0"))]


def payload(unit: bytes) -> bytes:
    """Without the unit's header byte and its emulation-prevention bytes."""
    return re.sub(b"\x00\x00\x03", b"\x00\x00", unit[1:])


class Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def u(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise truncated("parameter set")
        v = self.bits[self.at : self.at + n]
        self.at += n
        return int(v, 2) if v else 0

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise bad("exp-Golomb code")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        v = self.ue()
        return (v + 1) // 2 if v % 2 else -(v // 2)


def sequence(unit: bytes) -> dict:
    """Profile, level and picture size of a sequence parameter set (8-bit 4:2:0, frames only)."""
    if not unit or unit[0] & 31 != 7:
        raise bad("no sequence parameter set")
    b = Bits(payload(unit))
    code, _, level = b.u(8), b.u(8), b.u(8)
    if code not in PROFILES:
        raise unsupported(f"h264 profile {code}")
    if b.ue() > 31:
        raise bad("parameter set id")
    if code == 100:
        if b.ue() != 1:
            raise unsupported("h264 chroma format")
        if b.ue() or b.ue():
            raise unsupported("h264 bit depth")
        if b.u(1) or b.u(1):
            raise unsupported("h264 transform bypass or scaling matrix")
    frame_bits = b.ue() + 4
    order = b.ue()
    if frame_bits > 16 or order > 2:
        raise bad("counter sizes")
    if order == 0:
        b.ue()
    elif order == 1:
        b.u(1)
        b.se()
        b.se()
        for _ in range(b.ue()):
            b.se()
    references = b.ue()
    b.u(1)
    w, h, frames = b.ue() + 1, b.ue() + 1, b.u(1)
    if not frames:
        raise unsupported("h264 interlaced")
    b.u(1)
    crop = [b.ue() for _ in range(4)] if b.u(1) else [0] * 4
    width, height = 16 * w - 2 * (crop[0] + crop[1]), 16 * h - 2 * (crop[2] + crop[3])
    if width <= 0 or height <= 0:
        raise bad("cropping")
    return {"profile": PROFILES[code], "level": level, "width": width, "height": height, "references": references, "order": order}


def picture(unit: bytes) -> dict:
    """Entropy coding of a picture parameter set; slice groups are refused."""
    if not unit or unit[0] & 31 != 8:
        raise bad("no picture parameter set")
    b = Bits(payload(unit))
    ident, seq, cabac = b.ue(), b.ue(), b.u(1)
    b.u(1)
    if b.ue():
        raise unsupported("h264 slice groups")
    return {"id": ident, "sequence": seq, "cabac": bool(cabac)}

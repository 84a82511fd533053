"""MPEG-1 audio frames: headers and the walk over a file. Samples are not decoded."""

from __future__ import annotations

from dataclasses import dataclass

from siltstone.sources.errors import Refused, bad, truncated, unsupported

# Fixed values of the standard: kilobits a second by layer and index, rates by index, samples a frame.
KBITS = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
RATES = (44100, 48000, 32000)
SAMPLES = {1: 384, 2: 1152, 3: 1152}
MODES = ("stereo", "joint", "dual", "single")


@dataclass(frozen=True)
class Header:
    layer: int
    protected: bool
    kbits: int
    rate: int
    padded: bool
    mode: str
    extension: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == "single" else 2

    @property
    def samples(self) -> int:
        return SAMPLES[self.layer]

    @property
    def size(self) -> int:
        """Bytes of the frame with its header; layer I counts in slots of four."""
        slot = 4 if self.layer == 1 else 1
        return (self.samples // 8 // slot * self.kbits * 1000 // self.rate + self.padded) * slot


def parse(data: bytes) -> Header:
    if len(data) < 4:
        raise truncated("frame header")
    w = int.from_bytes(data[:4], "big")
    field = lambda at, n: w >> at & (1 << n) - 1
    version, layer, kbits, rate = field(19, 2), field(17, 2), field(12, 4), field(10, 2)
    if field(21, 11) != 0x7FF or version == 1 or layer == 0 or kbits == 15 or rate == 3:
        raise bad("frame header")
    if version != 3:
        raise unsupported("MPEG-2 audio")
    if kbits == 0:
        raise unsupported("free bit rate")
    layer = 4 - layer
    return Header(layer, not field(16, 1), KBITS[layer][kbits], RATES[rate], bool(field(9, 1)), MODES[field(6, 2)], field(4, 2))


def skip_tag(data: bytes) -> int:
    """Where the first frame should be: after a tag with its seven-bit size, if there is one."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = sum((b & 127) << 7 * (3 - i) for i, b in enumerate(data[6:10]))
    return 10 + size + (10 if data[5] & 16 else 0)


def info(data: bytes) -> dict:
    """layer, kbits, rate, channels of the first frame; frames and samples of the whole file.

    After the first frame anything that is no header ends the stream; a short last frame is refused,
    and so is a change of rate or channels.
    """
    at, first, frames = skip_tag(data), None, 0
    while True:
        try:
            h = parse(data[at : at + 4])
        except Refused:
            if first is None:
                raise Refused("InvalidMagic", "MPEG audio sync") from None
            break
        if at + h.size > len(data):
            raise truncated("frame")
        if first is not None and (h.rate, h.channels) != (first.rate, first.channels):
            raise bad("rate or channels change")
        first = first or h
        tag = data[at + 4 : at + 44]
        if frames or b"Xing" not in tag and b"Info" not in tag:
            frames += 1
        at += h.size
    return {"layer": first.layer, "kbits": first.kbits, "rate": first.rate, "channels": first.channels, "frames": frames, "samples": frames * first.samples}

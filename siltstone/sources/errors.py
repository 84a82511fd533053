"""Refusals are data: a decoder raises one of these and a UDF turns it into a struct."""

from __future__ import annotations

KINDS = ("Truncated", "InvalidMagic", "BadValue", "Unsupported", "TooLarge", "Decode")


class Refused(ValueError):
    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message = kind, message


def truncated(what: str) -> Refused:
    return Refused("Truncated", what)


def bad(what: str) -> Refused:
    return Refused("BadValue", what)


def unsupported(what: str) -> Refused:
    return Refused("Unsupported", what)


class Reader:
    """Bounds-checked little- or big-endian reads."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int, what: str) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise truncated(what)
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def le(self, n: int, what: str, sign: bool = False) -> int:
        return int.from_bytes(self.take(n, what), "little", signed=sign)

    def be(self, n: int, what: str, sign: bool = False) -> int:
        return int.from_bytes(self.take(n, what), "big", signed=sign)

    @property
    def left(self) -> int:
        return self.end - self.at

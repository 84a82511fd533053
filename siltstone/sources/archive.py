"""Inflate with ceilings, ZIP members, and XML events."""

from __future__ import annotations

import re
import zlib
from xml.parsers import expat

from siltstone.sources.errors import Reader, Refused, bad, truncated, unsupported

MAX_OUT = 256 << 20


def _inflate(data: bytes, wbits: int, most: int, tail: bool) -> bytes:
    d = zlib.decompressobj(wbits)
    try:
        out = d.decompress(data, most + 1)
    except zlib.error as e:
        raise bad(f"deflate stream: {e}") from None
    if len(out) > most:
        raise Refused("TooLarge", "inflated data")
    if not d.eof:
        raise truncated("deflate stream")
    if d.unused_data and not tail:
        raise bad("bytes after the stream")
    return out


def inflate_raw(data: bytes, most: int = MAX_OUT) -> bytes:
    return _inflate(data, -15, most, True)


def inflate_zlib(data: bytes, most: int = MAX_OUT) -> bytes:
    """A zlib stream: header, checksum, and nothing after it."""
    if len(data) < 2:
        raise truncated("zlib header")
    if data[0] & 15 != 8 or data[0] >> 4 > 7 or (data[0] << 8 | data[1]) % 31:
        raise bad("zlib header")
    if data[1] & 0x20:
        raise unsupported("preset dictionary")
    return _inflate(data, 15, most, False)


def inflate_auto(data: bytes, most: int = MAX_OUT) -> bytes:
    if data[:2] == b"\x1f\x8b":
        raise unsupported("gzip")
    wrapped = len(data) >= 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and not (data[0] << 8 | data[1]) % 31
    return inflate_zlib(data, most) if wrapped else inflate_raw(data, most)


def zip_members(data: bytes) -> list[dict]:
    """The central directory: name, method, sizes, checksum, offset. Nothing is extracted."""
    floor = max(0, len(data) - 65557)
    at = data.rfind(b"PK\x05\x06", floor)
    while at >= 0 and at + 22 + int.from_bytes(data[at + 20 : at + 22], "little") != len(data):
        at = data.rfind(b"PK\x05\x06", floor, at)
    if at < 0:
        raise Refused("InvalidMagic", "end of central directory")
    r = Reader(data, at + 4)
    disk, first, here, count = (r.le(2, "directory end") for _ in range(4))
    size, start = r.le(4, "directory size"), r.le(4, "directory offset")
    if 0xFFFF in (here, count) or 0xFFFFFFFF in (size, start):
        raise unsupported("zip64")
    if disk or first or here != count:
        raise unsupported("several disks")
    if start + size > at:
        raise bad("directory beyond its end record")
    r, out = Reader(data, start, start + size), []
    for _ in range(count):
        if r.take(4, "entry") != b"PK\x01\x02":
            raise bad("directory entry")
        r.take(4, "versions")
        flags, method = r.le(2, "flags"), r.le(2, "method")
        r.take(4, "time")
        crc, packed, full = r.le(4, "crc"), r.le(4, "size"), r.le(4, "size")
        n, extra, comment = r.le(2, "name"), r.le(2, "extra"), r.le(2, "comment")
        r.take(8, "attributes")
        offset = r.le(4, "offset")
        name = r.take(n, "name")
        r.take(extra + comment, "extra")
        if 0xFFFFFFFF in (packed, full, offset):
            raise unsupported("zip64")
        try:
            text = name.decode("utf-8")
        except UnicodeDecodeError:
            raise bad("member name") from None
        out.append({"name": text, "flags": flags, "method": method, "crc": crc, "packed": packed, "size": full, "offset": offset})
    if r.left:
        raise bad("bytes after the last directory entry")
    return out


def zip_extract(data: bytes, member: dict, most: int = MAX_OUT) -> bytes:
    if member["flags"] & 1:
        raise unsupported("encryption")
    if member["method"] not in (0, 8):
        raise unsupported(f"method {member['method']}")
    r = Reader(data, member["offset"])
    if r.take(4, "local header") != b"PK\x03\x04":
        raise bad("local header")
    r.take(2, "version")
    if (r.le(2, "flags"), r.le(2, "method")) != (member["flags"], member["method"]):
        raise bad("local header differs from the directory")
    r.take(16, "local sizes")
    n, extra = r.le(2, "name"), r.le(2, "extra")
    r.take(n + extra, "name")
    body = r.take(member["packed"], "member")
    out = body if member["method"] == 0 else inflate_raw(body, most)
    if len(out) != member["size"] or zlib.crc32(out) != member["crc"]:
        raise bad("member checksum")
    if member["flags"] & 8:
        if data[r.at : r.at + 4] == b"PK\x07\x08":
            r.take(4, "descriptor")
        if (r.le(4, "descriptor"), r.le(4, "descriptor"), r.le(4, "descriptor")) != (member["crc"], member["packed"], member["size"]):
            raise bad("data descriptor")
    return out


def xml_events(data: bytes) -> list[tuple[str, str, dict]]:
    """(kind, name or text, attributes): start, end and text events in order."""
    out: list[tuple[str, str, dict]] = []
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = lambda n, a: out.append(("start", n, dict(a)))
    p.EndElementHandler = lambda n: out.append(("end", n, {}))
    p.CharacterDataHandler = lambda t: out.append(("text", t, {}))
    try:
        p.Parse(re.sub(rb"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", b"", data, count=1), True)
    except expat.ExpatError as e:
        raise bad(f"xml: {e}") from None
    return out

"""MP4: boxes to a sample table of the first video track; fragmented files are refused."""

from __future__ import annotations

from siltstone.sources.errors import Reader, Refused, bad, truncated, unsupported

BRANDS = (b"isom", b"iso2", b"iso4", b"iso5", b"iso6", b"mp41", b"mp42", b"avc1", b"M4V ", b"qt  ", b"dash")


def boxes(data: bytes, at: int, end: int):
    """(type, first body byte, end) of the boxes in a range."""
    while at < end:
        r = Reader(data, at, end)
        size, kind = r.be(4, "box size"), r.take(4, "box type")
        if size == 1:
            size = r.be(8, "large box size")
        stop = end if size == 0 else at + size
        if stop < r.at or stop > end:
            raise truncated(f"box {kind!r}")
        yield kind, r.at, stop
        at = stop


def _find(data: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for kind, a, z in boxes(data, at, end):
        if kind == path[0]:
            return (a, z) if len(path) == 1 else _find(data, a, z, *path[1:])
    return None


def _need(data: bytes, span: tuple[int, int], *path: bytes) -> Reader:
    got = _find(data, *span, *path)
    if got is None:
        raise bad(f"missing {path[-1].decode()}")
    return Reader(data, *got)


def _full(r: Reader) -> tuple[int, int]:
    return r.be(1, "version"), r.be(3, "flags")


def _runs(r: Reader, n: int, signed_last: bool = False) -> list[tuple[int, ...]]:
    return [(r.be(4, "run"), r.be(4, "run", signed_last)) for _ in range(n)]


def demux(data: bytes) -> dict:
    """timescale, width, height, avcc, samples: (index, offset, size, dts, pts, key)."""
    top = list(boxes(data, 0, len(data)))
    if not top or top[0][0] != b"ftyp":
        raise Refused("InvalidMagic", "ftyp must come first")
    brands = data[top[0][1] : top[0][2]]
    if not any(brands[i : i + 4] in BRANDS for i in (0, *range(8, len(brands) - 3, 4))):
        raise unsupported("brand")
    if any(k == b"moof" for k, *_ in top):
        raise unsupported("fragments")
    moovs = [(a, z) for k, a, z in top if k == b"moov"]
    if len(moovs) != 1:
        raise bad("one moov is needed")
    if _find(data, *moovs[0], b"mvex"):
        raise unsupported("fragments")
    for kind, a, z in boxes(data, *moovs[0]):
        if kind == b"trak":
            h = _need(data, (a, z), b"mdia", b"hdlr")
            h.take(8, "handler")
            if h.take(4, "handler") == b"vide":
                return _track(data, (a, z))
    raise unsupported("no video track")


def _track(data: bytes, trak: tuple[int, int]) -> dict:
    r = _need(data, trak, b"mdia", b"mdhd")
    version, _ = _full(r)
    r.take(16 if version else 8, "times")
    scale = r.be(4, "timescale")
    if not scale:
        raise bad("timescale")
    got = _find(data, *trak, b"mdia", b"minf", b"stbl")
    if got is None:
        raise bad("missing stbl")
    d = _need(data, got, b"stsd")
    _full(d)
    d.take(4, "entries")
    start = d.at
    kind, a, z = next(boxes(data, start, d.end))
    if kind not in (b"avc1", b"avc3"):
        raise unsupported(f"codec {kind!r}")
    e = Reader(data, a, z)
    e.take(24, "sample entry")
    width, height = e.be(2, "width"), e.be(2, "height")
    conf = _find(data, a + 78, z, b"avcC")

    r = _need(data, got, b"stts")
    _full(r)
    times = _runs(r, r.be(4, "count"))
    span = _find(data, *got, b"ctts")
    comp = None
    if span:
        r = Reader(data, *span)
        version, _ = _full(r)
        comp = _runs(r, r.be(4, "count"), True)
    span = _find(data, *got, b"stsz")
    if span:
        r = Reader(data, *span)
        _full(r)
        same, n = r.be(4, "size"), r.be(4, "count")
        sizes = [same] * n if same else [r.be(4, "size") for _ in range(n)]
    else:
        r = _need(data, got, b"stz2")
        _full(r)
        r.take(3, "reserved")
        width_bits, n = r.be(1, "field size"), r.be(4, "count")
        if width_bits not in (4, 8, 16):
            raise bad("field size")
        raw = int.from_bytes(r.take((n * width_bits + 7) // 8, "sizes"), "big")
        pad = (8 - n * width_bits % 8) % 8
        sizes = [raw >> pad + width_bits * (n - 1 - i) & (1 << width_bits) - 1 for i in range(n)]
    r = _need(data, got, b"stsc")
    _full(r)
    plan = [(r.be(4, "chunk"), r.be(4, "samples"), r.be(4, "description")) for _ in range(r.be(4, "count"))]
    wide = _find(data, *got, b"co64")
    r = Reader(data, *wide) if wide else _need(data, got, b"stco")
    _full(r)
    chunks = [r.be(8 if wide else 4, "offset") for _ in range(r.be(4, "count"))]
    span = _find(data, *got, b"stss")
    keys = None
    if span:
        r = Reader(data, *span)
        _full(r)
        keys = {r.be(4, "sync") for _ in range(r.be(4, "count"))}

    if sum(c for c, _ in times) != len(sizes) or comp and sum(c for c, _ in comp) < len(sizes):
        raise bad("time table length")
    steps = [d for c, d in times for _ in range(c)]
    shift = [d for c, d in comp for _ in range(c)] if comp else [0] * len(sizes)
    out, i, dts = [], 0, 0
    for j, offset in enumerate(chunks, 1):
        per = next((n for first, n, _ in reversed(plan) if first <= j), 0)
        for _ in range(per):
            if i >= len(sizes):
                break
            if offset + sizes[i] > len(data):
                raise bad("sample beyond the file")
            out.append((i, offset, sizes[i], dts, dts + shift[i], keys is None or i + 1 in keys))
            offset, dts, i = offset + sizes[i], dts + steps[i], i + 1
    if i != len(sizes):
        raise bad("chunk table length")
    return {"timescale": scale, "width": width, "height": height, "avcc": data[conf[0] : conf[1]] if conf else b"", "samples": out}


def parse_avcc(conf: bytes) -> tuple[int, list[bytes], list[bytes]]:
    """NAL length size, sequence and picture parameter sets."""
    r = Reader(conf)
    if r.be(1, "version") != 1:
        raise unsupported("avcC version")
    r.take(3, "profile")
    size = (r.be(1, "length size") & 3) + 1
    if size == 3:
        raise bad("NAL length of three bytes")
    sps = [r.take(r.be(2, "sps"), "sps") for _ in range(r.be(1, "count") & 31)]
    return size, sps, [r.take(r.be(2, "pps"), "pps") for _ in range(r.be(1, "count"))]


def to_annexb(sample: bytes, length_size: int) -> bytes:
    r, out = Reader(sample), []
    while r.left:
        n = r.be(length_size, "NAL length")
        if not n:
            raise bad("empty NAL")
        out.append(b"\0\0\0\1" + r.take(n, "NAL"))
    return b"".join(out)

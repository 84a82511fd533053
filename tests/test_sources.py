import io
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import audio, raster
from siltstone.sources import archive, bmp, detect, flac, media, mp4, png, wav
from siltstone.sources.errors import Refused

rng = np.random.default_rng(1)


def wav_bytes(samples, rate=44100):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def bmp_bytes(rgb):
    h, w, _ = rgb.shape
    line = (3 * w + 3) // 4 * 4
    body = b"".join(row[:, ::-1].tobytes().ljust(line, b"\0") for row in rgb[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def filtered_png(a, lace=False):
    """Rows take the five filters in turn; interlaced on request."""
    def chunk(n, b):
        return struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))

    def rows(img):
        h, w, c = img.shape
        prev, out = np.zeros(w * c, int), b""
        for y in range(h):
            cur = img[y].ravel().astype(int)
            left = np.concatenate((np.zeros(c, int), cur[:-c]))
            corner = np.concatenate((np.zeros(c, int), prev[:-c]))
            p = left + prev - corner
            pa, pb, pc = abs(p - left), abs(p - prev), abs(p - corner)
            paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, prev, corner))
            guess = [0, left, prev, (left + prev) // 2, paeth][y % 5]
            out += bytes([y % 5]) + ((cur - guess) % 256).astype(np.uint8).tobytes()
            prev = cur
        return out

    h, w, c = a.shape
    if lace:
        parts = [a[y::dy, x::dx] for x, y, dx, dy in png.ADAM7]
        raw = b"".join(rows(p) for p in parts if p.size)
    else:
        raw = rows(a)
    kind = {1: 0, 3: 2, 4: 6}[c]
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, int(lace))) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(7, 5, 3), (16, 16, 4), (1, 1, 1), (33, 2, 1)])
@pytest.mark.parametrize("lace", [False, True])
def test_png_round_trip(shape, lace):
    a = rng.integers(0, 256, shape, np.uint8)
    got = png.decode(filtered_png(a, lace))
    assert (got.reshape(shape) == a).all()
    assert (png.decode(png.encode(a)).reshape(shape) == a).all()


def test_png_refusals():
    good = png.encode(np.zeros((4, 4, 3), np.uint8))
    for data, kind in ((good[:-1], "Truncated"), (b"x" + good, "InvalidMagic"), (good + b"x", "BadValue"), (good[:40] + b"\xff" + good[41:], "BadValue")):
        with pytest.raises(Refused) as e:
            png.decode(data)
        assert e.value.kind == kind


def test_bmp_equals_png():
    a = rng.integers(0, 256, (9, 11, 3), np.uint8)
    assert (bmp.decode(bmp_bytes(a))[:, :, :3] == a).all()
    assert raster.phash(bmp.decode(bmp_bytes(a))) == raster.phash(png.decode(png.encode(a)))


def test_bmp_runs():
    body = bytes([3, 1, 0, 3, 2, 0, 1, 0, 0, 0, 0, 2, 1, 1, 2, 2, 0, 1])
    palette = bytes([10, 20, 30, 0, 40, 50, 60, 0, 70, 80, 90, 0])
    start = 54 + len(palette)
    data = b"BM" + struct.pack("<IHHI", 0, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, 6, 3, 1, 8, 1, 0, 0, 0, 3, 0) + palette + body
    a = bmp.decode(data)
    assert a[2, :, 2].tolist() == [40, 40, 40, 70, 10, 40] and a[1, :, 2].tolist() == [10] * 6 and a[0, :, 2].tolist() == [10, 70, 70, 10, 10, 10]


def test_wav_and_mono():
    s = rng.integers(-32768, 32768, (500, 2))
    p = wav.decode(wav_bytes(s))
    assert (p.samples == s).all() and p.rate == 44100
    assert audio.mono(np.array([[-3, 0], [3, 0], [-1, -2]])).tolist() == [-1, 1, -1]
    with pytest.raises(Refused):
        wav.decode(wav_bytes(s)[:-1])


def _flac(samples, rate=44100):
    """One verbatim and fixed-predictor encoder: enough for a round trip."""
    bits = ""
    put = lambda v, n: format(v & (1 << n) - 1, f"0{n}b")
    info = struct.pack(">HH", 4096, 4096) + b"\0" * 6 + ((rate << 44) | (1 << 41) | (15 << 36) | len(samples)).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info
    head = bytes([0xFF, 0xF8, 0x70 | 9, (8 << 4) | (4 << 1), 0]) + struct.pack(">H", len(samples) - 1)
    head += bytes([flac._crc(head, 7, 8)])
    left, side = samples[:, 0], samples[:, 0] - samples[:, 1]
    bits += put(0, 1) + put(9, 6) + put(0, 1) + put(int(left[0]), 16)
    d = np.diff(left)
    bits += put(0, 2) + put(0, 4) + put(10, 4)
    for e in d.tolist():
        z = 2 * e if e >= 0 else -2 * e - 1
        bits += "0" * (z >> 10) + "1" + put(z, 10)
    bits += put(0, 1) + put(1, 6) + put(0, 1) + "".join(put(int(v), 17) for v in side)
    bits += "0" * (-len(bits) % 8)
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    return out + frame + flac._crc(frame, 0x8005, 16).to_bytes(2, "big")


def test_flac_round_trip_equals_wav():
    s = rng.integers(-3000, 3000, (300, 2))
    assert (flac.decode(_flac(s)).samples == s).all()
    assert media._sound(_flac(s), "flac") == media._sound(wav_bytes(s), "wav")
    with pytest.raises(Refused):
        flac.decode(_flac(s)[:-3])


def test_zip_inflate_xml():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello " * 50, zipfile.ZIP_DEFLATED)
        z.writestr("é/b", b"\x00\x01", zipfile.ZIP_STORED)
    data = out.getvalue()
    got = {m["name"]: archive.zip_extract(data, m) for m in archive.zip_members(data)}
    assert got == {"a.txt": b"hello " * 50, "é/b": b"\x00\x01"}
    assert archive.inflate_auto(zlib.compress(b"x" * 99)) == b"x" * 99
    for broken in (zlib.compress(b"x") + b"y", zlib.compress(b"x")[:-1], b"\x1f\x8bxx"):
        with pytest.raises(Refused):
            archive.inflate_auto(broken)
    with pytest.raises(Refused) as e:
        archive.inflate_zlib(zlib.compress(b"x" * 99), 98)
    assert e.value.kind == "TooLarge"
    assert archive.xml_events(b"<!DOCTYPE a><a b='1'>x&amp;<c/></a>") == [("start", "a", {"b": "1"}), ("text", "x&", {}), ("start", "c", {}), ("end", "c", {}), ("end", "a", {})]
    with pytest.raises(Refused):
        archive.xml_events(b"<a></b>")


def _mp4(sizes, keys=(1,)):
    box = lambda k, *b: struct.pack(">I", 8 + len(b"".join(b))) + k + b"".join(b)
    full = lambda k, b: box(k, b"\0\0\0\0" + b)
    ftyp = box(b"ftyp", b"isom\0\0\0\0isom")
    avcc = b"\x01\x42\x00\x1e\xff\xe1\x00\x02ab\x01\x00\x01c"

    def moov(at):
        entry = box(b"avc1", b"\0" * 24 + struct.pack(">HH", 64, 48) + b"\0" * 50, box(b"avcC", avcc))
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1) + entry), full(b"stts", struct.pack(">III", 1, len(sizes), 100)),
            full(b"ctts", struct.pack(">IIIII", 2, 1, 50, len(sizes) - 1, 0)), full(b"stsz", struct.pack(">II", 0, len(sizes)) + b"".join(struct.pack(">I", s) for s in sizes)),
            full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), full(b"stco", struct.pack(">II", 1, at)), full(b"stss", struct.pack(">I", len(keys)) + b"".join(struct.pack(">I", k) for k in keys)),
        )
        return box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 600, 0)), full(b"hdlr", b"\0\0\0\0vide" + b"\0" * 12), box(b"minf", stbl))))

    n = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(n) + box(b"mdat", b"".join(bytes([i]) * s for i, s in enumerate(sizes)))


def test_mp4_samples():
    data = _mp4([5, 7, 2], (1, 3))
    d = mp4.demux(data)
    assert [(i, s, dts, pts, k) for i, _, s, dts, pts, k in d["samples"]] == [(0, 5, 0, 50, True), (1, 7, 100, 100, False), (2, 2, 200, 200, True)]
    assert all(data[o : o + s] == bytes([i]) * s for i, o, s, *_ in d["samples"])
    assert (d["timescale"], d["width"], d["height"]) == (600, 64, 48)
    assert mp4.parse_avcc(d["avcc"]) == (4, [b"ab"], [b"c"])
    assert mp4.to_annexb(b"\0\0\0\2xy\0\0\0\1z", 4) == b"\0\0\0\1xy\0\0\0\1z"
    for broken in (data[:-1], data[8:], data.replace(b"moov", b"moof")):
        with pytest.raises(Refused):
            mp4.demux(broken)


def test_decoders_as_columns(spark):
    a = rng.integers(0, 256, (40, 40, 3), np.uint8)
    rows = [("p", png.encode(a)), ("b", bmp_bytes(a)), ("bad", png.encode(a)[:50]), ("j", b"\xff\xd8\xff\xe0"), ("t", b"text"), ("n", None)]
    df = spark.createDataFrame(rows, "k string, content binary").withColumn("d", detect.detect(F.col("content")))
    got = {r.k: r for r in df.select("k", "d", media.decode_image("content", F.col("d.format")).alias("i")).collect()}
    assert got["p"].i.phash == got["b"].i.phash and got["p"].i.payload == got["b"].i.payload == a.tobytes()
    assert got["bad"].i.error.kind == "Truncated" and got["j"].i.error.kind == "Truncated" and got["j"].d.format == "jpeg"
    s = media.sine((440.0, 1000.0, 3000.0), 1.5)[:, None]
    df = spark.createDataFrame([(wav_bytes(s), "wav"), (wav_bytes(s, 48000), "wav"), (b"ID3", "mp3")], "c binary, f string")
    got = df.select(media.decode_audio("c", "f").alias("a")).collect()
    assert got[0].a.frames == len(s) and got[0].a.peaks is not None and got[1].a.peaks is None and got[2].a.error.kind == "Unsupported"


def test_isometries():
    a = np.arange(6).reshape(2, 3)
    f = raster.ISOMETRIES
    assert f["rot90"](a).tolist() == [[3, 0], [4, 1], [5, 2]]
    for x in (1, 2, 3, 4, 5, 6, 7, 8):
        assert sorted(raster.apply_orientation(a, x).ravel().tolist()) == list(range(6))
    with pytest.raises(ValueError):
        raster.apply_orientation(a, 9)
    assert len({v.tobytes() for v in raster.variants(np.arange(9).reshape(3, 3))}) == 8
    x = rng.normal(size=(8, 8))
    assert np.allclose(raster.idct2_2d(raster.dct2_2d(x)), x)

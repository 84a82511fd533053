"""Decoders as column functions; a refusal fills ``error`` and leaves the rest null.

Filter on format and length before these: Spark can't look into them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions import audio, raster
from siltstone.functions import types as t
from siltstone.sources import archive, bmp, flac, jpeg, mp4, pdf, png, wav
from siltstone.sources.errors import Refused, unsupported

ERROR = t.struct(kind=t.STRING, message=t.STRING)


def _refuse(what: str) -> Callable:
    def decode(_: bytes):
        raise unsupported(what)

    return decode


IMAGES = {"png": png.decode, "bmp": bmp.decode, "jpeg": jpeg.decode, "gif": _refuse("gif")}
SOUNDS = {"wav": wav.decode, "flac": flac.decode, "mp3": _refuse("mp3")}


def _guard(f: Callable[[bytes], dict], fields: tuple[str, ...]) -> Callable:
    def one(*args):
        if args[0] is None:
            return None
        try:
            return f(bytes(args[0]), *args[1:]) | {"error": None}
        except Refused as e:
            return dict.fromkeys(fields) | {"error": {"kind": e.kind, "message": e.message}}

    return one


def _rows(f: Callable, fields: tuple[str, ...], *cols: pd.Series) -> pd.DataFrame:
    one = _guard(f, fields)
    empty = dict.fromkeys((*fields, "error"))
    return pd.DataFrame([one(*x) or empty for x in zip(*cols, strict=True)], columns=[*fields, "error"], dtype=object)


def _image(data: bytes, fmt: str) -> dict:
    a = IMAGES.get(fmt, _refuse(f"image format {fmt}"))(data)
    v = raster.phash(a)
    return {"width": a.shape[1], "height": a.shape[0], "channels": 1 if a.ndim == 2 else a.shape[2], "payload": raster.rgb_payload(a), "phash": v - (1 << 64) if v >> 63 else v}


@F.pandas_udf(t.struct(width=t.INT, height=t.INT, channels=t.INT, payload=t.BINARY, phash=t.LONG, error=ERROR))
def decode_image(content: pd.Series, fmt: pd.Series) -> pd.DataFrame:
    """Size, tier-1 payload and perceptual hash of one decode."""
    return _rows(_image, ("width", "height", "channels", "payload", "phash"), content, fmt)


def _sound(data: bytes, fmt: str) -> dict:
    p = SOUNDS.get(fmt, _refuse(f"audio format {fmt}"))(data)
    m = audio.mono(p.samples).astype("<i4")
    payload = p.rate.to_bytes(4, "little") + len(m).to_bytes(8, "little") + m.tobytes()
    peaks = [{"t": a, "f": b} for a, b in audio.peaks_of(m)] if p.rate == audio.RATE else None
    return {"rate": p.rate, "channels": p.channels, "frames": len(m), "payload": payload, "peaks": peaks}


@F.pandas_udf(t.struct(rate=t.INT, channels=t.INT, frames=t.LONG, payload=t.BINARY, peaks=t.array(t.struct(t=t.INT, f=t.INT)), error=ERROR))
def decode_audio(content: pd.Series, fmt: pd.Series) -> pd.DataFrame:
    """Rate, size, tier-1 payload, and landmarks where the rate is the fixed one."""
    return _rows(_sound, ("rate", "channels", "frames", "payload", "peaks"), content, fmt)


@F.pandas_udf(t.struct(timescale=t.INT, width=t.INT, height=t.INT, samples=t.array(t.struct(index=t.INT, offset=t.LONG, size=t.INT, dts=t.LONG, pts=t.LONG, key=t.BOOL)), error=ERROR))
def mp4_samples(content: pd.Series) -> pd.DataFrame:
    def f(data: bytes) -> dict:
        d = mp4.demux(data)
        names = ("index", "offset", "size", "dts", "pts", "key")
        return {k: d[k] for k in ("timescale", "width", "height")} | {"samples": [dict(zip(names, s, strict=True)) for s in d["samples"]]}

    return _rows(f, ("timescale", "width", "height", "samples"), content)


@F.pandas_udf(t.struct(text=t.STRING, pages=t.INT, error=ERROR))
def pdf_text(content: pd.Series) -> pd.DataFrame:
    """The text layer, pages joined by form feeds; the first page that fails refuses the document."""
    def f(data: bytes) -> dict:
        d = pdf.Document(data)
        return {"text": d.text(), "pages": len(d.pages)}

    return _rows(f, ("text", "pages"), content)


@F.pandas_udf(t.struct(members=t.array(t.struct(name=t.STRING, size=t.LONG, content=t.BINARY)), error=ERROR))
def zip_members(content: pd.Series) -> pd.DataFrame:
    def f(data: bytes) -> dict:
        return {"members": [{"name": m["name"], "size": m["size"], "content": archive.zip_extract(data, m)} for m in archive.zip_members(data)]}

    return _rows(f, ("members",), content)


@F.pandas_udf(t.array(t.struct(kind=t.STRING, name=t.STRING)))
def xml_events(content: pd.Series) -> pd.Series:
    def f(x):
        try:
            return None if x is None else [{"kind": k, "name": n} for k, n, _ in archive.xml_events(bytes(x))]
        except Refused:
            return None

    return content.map(f)


@F.pandas_udf(t.BINARY)
def inflate(content: pd.Series) -> pd.Series:
    """Inflated bytes of a raw or zlib stream; null where refused."""
    def f(x):
        try:
            return None if x is None else archive.inflate_auto(bytes(x))
        except Refused:
            return None

    return content.map(f)


def sine(freqs: tuple[float, ...], seconds: float, rate: int = audio.RATE) -> np.ndarray:
    """A sum of tones as 16-bit samples, for fixtures."""
    x = np.arange(int(seconds * rate)) / rate
    return (8000 * sum(np.sin(2 * np.pi * f * x) for f in freqs)).astype(np.int16)

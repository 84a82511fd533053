"""Content sniffing as one CASE expression; nothing is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signatures in order of precedence as (offset, bytes in hex) pairs, format, modality.
# MP3 has a rule of its own, between FLAC and MP4.
SIGNATURES = (
    (((0, "89504E470D0A1A0A"),), "png", "image"),
    (((0, "FFD8FF"),), "jpeg", "image"),
    (((0, "424D"),), "bmp", "image"),
    (((0, "47494638"),), "gif", "binary"),
    (((0, "52494646"), (8, "57415645")), "wav", "audio"),
    (((0, "664C6143"),), "flac", "audio"),
    ((), "mp3", "audio"),
    (((4, "66747970"),), "mp4", "video"),
    (((0, "255044462D"),), "pdf", "text"),
    (((0, "504B"),), "zip", "binary"),
)


def _hex(content: Column, first: int, n: int) -> Column:
    return F.hex(F.substring(content, first, n))


def is_mp3(content: Column) -> Column:
    """An ID3 tag, or a sync word with valid version and layer; byte-order marks are not."""
    b = F.conv(_hex(content, 2, 1), 16, 10).cast("int")
    sync = (_hex(content, 1, 1) == "FF") & (b >= 0xE0) & ~b.isin(0xFE, 0xFF) & (b.bitwiseAND(F.lit(0x18)) != 0x08) & (b.bitwiseAND(F.lit(0x06)) != 0)
    return (_hex(content, 1, 3) == "494433") | F.coalesce(sync, F.lit(False))


def detect(content: Column) -> Column:
    """struct(format, modality, pending): the first matching signature, else text if valid UTF-8, else binary."""
    out = lambda f, m: F.struct(F.lit(f).alias("format"), F.lit(m).alias("modality"), F.lit(False).alias("pending"))
    case = F.when(content.isNull(), F.lit(None))
    for marks, fmt, modality in SIGNATURES:
        hit = F.lit(True) if marks else is_mp3(content)
        for at, mark in marks:
            hit = hit & (_hex(content, at + 1, len(mark) // 2) == mark)
        case = case.when(hit, out(fmt, modality))
    return case.when(F.is_valid_utf8(content), out("unknown", "text")).otherwise(out("unknown", "binary"))


def read_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Regular files of a folder: path, length, content. Contents are never sorted; reports order their own rows by path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return df.select("path", "length", "content")

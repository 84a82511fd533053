"""One record per file: tier-1 key, tier-2 signature and facts, or the refusal; and its renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import chunking, text
from siltstone.functions.u64 import hex64
from siltstone.operators.matching import signature_head
from siltstone.sources import detect, media


def describe(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, format, modality, tier1, phash, minhash, chunks, peaks, facts, error) of (key, content) rows.

    Every lane decodes once. Rows are split by modality before the decoders, so each runs on its own
    files only.
    """
    base = files.select(F.col(key).alias("key"), F.col(content).alias("content"), detect.detect(F.col(content)).alias("d")).select("key", "content", "d.format", "d.modality")
    none = {"tier1": "string", "phash": "bigint", "minhash": "array<bigint>", "chunks": "array<binary>", "peaks": "array<struct<t:int,f:int>>", "facts": "map<string,bigint>", "error": "struct<kind:string,message:string>"}

    def lane(df: DataFrame, **cols: Column) -> DataFrame:
        return df.select("key", "format", "modality", *((cols[c] if c in cols else F.lit(None)).cast(kind).alias(c) for c, kind in none.items()))

    def facts(**v: Column) -> Column:
        return F.create_map(*(x for k, c in v.items() for x in (F.lit(k), c.cast("long"))))

    pics = base.filter("modality = 'image'").withColumn("i", media.decode_image("content", "format"))
    sounds = base.filter("modality = 'audio'").withColumn("a", media.decode_audio("content", "format"))
    words = lambda: {"tier1": F.sha2(F.encode("canon", "UTF-8"), 256), "minhash": text.signature("canon"), "facts": facts(words=F.size(text.words(F.col("canon"))), canonical_bytes=F.octet_length("canon"))}
    texts = base.filter("modality = 'text' AND format <> 'pdf'").withColumn("canon", text.canonicalize(F.decode("content", "UTF-8")))
    blobs = base.filter("modality = 'binary'").withColumn("c", chunking.binary_signature("content"))
    clips = base.filter("modality = 'video'").withColumn("v", media.mp4_samples("content"))
    papers = base.filter("format = 'pdf'").withColumn("p", media.pdf_text("content")).withColumn("canon", text.canonicalize("p.text"))
    wrong_rate = F.when(F.col("a.error").isNull() & (F.col("a.rate") != 44100), F.struct(F.lit("BadValue").alias("kind"), F.lit("sample rate").alias("message"))).otherwise(F.col("a.error"))
    refused = lambda m: F.struct(F.lit("Unsupported").alias("kind"), F.lit(m).alias("message"))
    parts = [
        lane(pics, tier1=F.sha2("i.payload", 256), phash=F.col("i.phash"), facts=facts(width=F.col("i.width"), height=F.col("i.height"), channels=F.col("i.channels")), error=F.col("i.error")),
        lane(sounds, tier1=F.sha2("a.payload", 256), peaks=F.col("a.peaks"), facts=facts(rate=F.col("a.rate"), channels=F.col("a.channels"), frames=F.col("a.frames"), peaks=F.size("a.peaks")), error=wrong_rate),
        lane(texts, **words()),
        lane(blobs, tier1=F.sha2("content", 256), chunks=F.col("c"), facts=facts(bytes=F.length("content"), chunks=F.size("c"))),
        lane(clips, facts=facts(width=F.col("v.width"), height=F.col("v.height"), samples=F.size("v.samples")), error=F.coalesce("v.error", refused("h264"))),
        lane(papers, **words(), error=F.col("p.error")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_line(df: DataFrame) -> DataFrame:
    """Three-tier report lines."""
    tier2 = F.when(F.col("phash").isNotNull(), F.concat(F.lit("phash 0x"), hex64(F.col("phash")))).when(F.col("minhash").isNotNull(), F.concat(F.lit("minhash "), signature_head(F.col("minhash"))))
    tier2 = tier2.when(F.col("chunks").isNotNull(), F.concat(F.size("chunks").cast("string"), F.lit(" chunks"))).when(F.col("peaks").isNotNull(), F.concat(F.size("peaks").cast("string"), F.lit(" peaks")))
    line = F.when(F.col("error").isNotNull(), F.concat_ws(" ", F.lit("refused"), "error.kind", "error.message")).otherwise(F.concat_ws("\n", F.concat(F.lit("tier1: "), "tier1"), F.concat(F.lit("tier2: "), tier2)))
    return df.select("key", F.concat_ws("\n", F.concat_ws(" ", "key", "format", "modality"), line).alias("report"))


def to_json(df: DataFrame) -> DataFrame:
    sig = F.transform("minhash", hex64)
    return df.select("key", F.to_json(F.struct("key", "format", "modality", "tier1", hex64(F.col("phash")).alias("phash"), sig.alias("minhash"), F.transform("chunks", lambda c: F.lower(F.hex(c))).alias("chunks"), "peaks", "facts", "error")).alias("json"))

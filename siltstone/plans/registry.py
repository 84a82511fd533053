"""Queries over the driver's tables, with the SQL that must give the same rows.

The tables hold no media, so byte payloads are the UTF-8 texts, 64-bit hashes are sign bits of
``embeddings``, and signals are generated from row numbers by formulas that SQL can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import audio, chunking, raster, text, u64
from siltstone.functions.video import SEEDS as CHAIN_SEEDS
from siltstone.functions.video import SHINGLE_FRAMES
from siltstone.operators import calibrate as cal
from siltstone.operators import dedup, matching
from siltstone.plans import minhash_sql as mh
from siltstone.runtime import materialise, table
from siltstone.sources import detect as sniff
from siltstone.sources import fixtures

GAP = "[\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
CANON = f"(regexp_replace(lower(nfc_normalize(text)), '{GAP}$', '') || chr(10))"
WORDS = f"list_filter(regexp_split_to_array({CANON}, '{GAP}'), lambda w: w <> '')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _canon(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.canonicalize("text").alias("canon"))


def text_content_hash(spark, sf):
    return _canon(spark, sf).select("doc_id", F.sha2(F.encode("canon", "UTF-8"), 256).alias("tier1"))


def exact_groups(spark, sf):
    g = text_content_hash(spark, sf).groupBy("tier1").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return g.filter("n > 1")


def text_facts(spark, sf):
    return _canon(spark, sf).select("doc_id", F.size(text.words(F.col("canon"))).cast("long").alias("words"), F.octet_length("canon").cast("long").alias("canonical_bytes"))


def shingle_counts(spark, sf):
    w = _canon(spark, sf).select("doc_id", text.words(F.col("canon")).alias("w"))
    k = F.least(F.lit(text.SHINGLE_WORDS), F.size("w"))
    n = F.size("w") - k + 1
    grams = F.when(k > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", *(F.get(F.col("w"), i + j) for j in range(text.SHINGLE_WORDS)))))
    s = w.select("doc_id", F.coalesce(grams, F.array().cast("array<string>")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("shingles"), F.size(F.array_distinct("s")).cast("long").alias("distinct_shingles"))


def text_near_duplicates(spark, sf):
    """(a, b, jaccard, copy): pairs of distinct texts, each under its smallest id, and with ``copy`` each
    further row b of the text a. A pair holds for all copies of its sides."""
    return dedup.near_duplicates(_docs(spark, sf))


def text_dedup(spark, sf):
    return dedup.text_dedup(_docs(spark, sf)).withColumnRenamed("id", "doc_id")


def dedup_report(spark, sf):
    return dedup.report(dedup.text_dedup(_docs(spark, sf)))


def lsh_candidates(spark, sf):
    """(query_id, id) of every 50th row against all rows, copies on both sides included."""
    return dedup.lookup(_docs(spark, sf), F.col("id") % 50 == 0)


def binary_dedup(spark, sf):
    return dedup.binary_dedup(_docs(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("content"))).withColumnRenamed("id", "doc_id")


def cdc_chunks(spark, sf):
    c = _docs(spark, sf).select("doc_id", F.explode(chunking.fastcdc(F.encode("text", "UTF-8"))).alias("c"))
    return c.select("doc_id", "c.offset", "c.length", u64.hex64(F.col("c.hash")).alias("hash"))


def checksums(spark, sf):
    b = F.encode("text", "UTF-8")
    return _docs(spark, sf).select("doc_id", u64.sha256(b).alias("sha256"), F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.octet_length(b).cast("long").alias("bytes"))


def checksums_more(spark, sf):
    b = F.encode("text", "UTF-8")
    return _docs(spark, sf).select("doc_id", u64.crc32(b).alias("crc32"), u64.adler32(b).alias("adler32"), u64.hex64(u64.fnv1a64(b)).alias("fnv1a64"))


#: Byte prefixes put before each text, so that every rule of the sniffer has rows.
HEADS = ("", "89504E470D0A1A0A", "FFD8FF", "424D", "47494638", "5249464600000000574156", "524946460000000057415645", "664C6143", "494433", "FFFB", "FFFE", "FFFF", "FFE9", "FFF9", "0000000066747970", "255044462D", "504B", "C328")


def detect(spark, sf):
    head = F.element_at(F.array(*(F.unhex(F.lit(h)) for h in HEADS)), F.pmod("doc_id", F.lit(len(HEADS))).cast("int") + 1)
    d = sniff.detect(F.concat(head, F.encode("text", "UTF-8")))
    return _docs(spark, sf).select("doc_id", d.alias("d")).select("doc_id", "d.format", "d.modality", "d.pending")


def _hashes(spark, sf):
    """64 sign bits of each vector: the first component is the highest bit."""
    e = table(spark, sf, "embeddings")
    cols = e.columns
    vec = next(c for c, t in e.dtypes if t.startswith("array"))
    bits = F.transform(F.slice(vec, 1, 64), lambda v: F.when(v > 0, "1").otherwise("0"))
    return e.select(F.col(cols[0]).alias("id"), F.array_join(bits, "").alias("bits"), vec)


def _with_hash(spark, sf):
    b = _hashes(spark, sf)
    half = lambda a: F.conv(F.substring("bits", a, 32), 2, 10).cast("long")
    return b.select("id", F.shiftleft(half(1), 32).bitwiseOR(half(33)).alias("hash"))


RADIUS = 14


def hamming_search(spark, sf):
    h = materialise(_with_hash(spark, sf), "hashes")
    return matching.hamming_search(h.filter("id % 50 = 0"), h, RADIUS)


def hash_hex(spark, sf):
    return _with_hash(spark, sf).select("id", u64.hex64(F.col("hash")).alias("hex"), F.bit_count("hash").cast("long").alias("bits"))


def _labelled(spark, sf):
    """Neighbouring rows of labels as pairs: the distance mixes sizes and toxicity, same means equal quality."""
    l = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    x = l.join(d, "doc_id").select("doc_id", "n_chars", "quality", "toxic")
    return x.filter("quality IS NOT NULL").select((F.col("n_chars") % 23 + 5 * F.col("toxic")).cast("long").alias("distance"), (F.col("quality") == 1).alias("same"))


def calibrate_dedup(spark, sf):
    return cal.calibrate(_labelled(spark, sf), "dedup")


def calibrate_search(spark, sf):
    return cal.calibrate(_labelled(spark, sf), "search")


def evaluate(spark, sf):
    return cal.evaluate(_labelled(spark, sf), 11)


def _peaks(spark, sf):
    """Landmarks: line items as (supplier, time, band)."""
    l = table(spark, sf, "lineitem")
    return l.select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") % 97).cast("int").alias("t"), (F.col("l_partkey") % 59).cast("int").alias("f"))


def audio_votes(spark, sf):
    """Every 50th id against all; pairs that match."""
    p = _peaks(spark, sf).distinct()
    return matching.audio_votes(p.filter("id % 50 = 0"), p, matching.AUDIO_VOTES)


def audio_fingerprint(spark, sf):
    peaks = _peaks(spark, sf).groupBy("id").agg(F.collect_list(F.struct("t", "f")).alias("peaks"))
    return peaks.select("id", u64.hex64(audio.fingerprint_of("peaks")).alias("fingerprint"))


def video_slots(spark, sf):
    """The first frame of every half second, frames in order of presentation time."""
    from siltstone.functions import video

    l = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("id"), ((F.col("l_orderkey") % 5000) - 100).cast("long").alias("pts"), (F.col("l_linenumber") + 10 * F.col("l_partkey")).cast("long").alias("frame"))
    return video.sample(l, "id", "pts", "frame", timescale=600).select("id", "slot", "pts", "frame")


def luma(spark, sf):
    p = _pixels(spark, sf)
    return p.select("x", "y", raster.luma(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("luma"))


def _pixels(spark, sf):
    """A picture of 96 columns from the keys of the part table, as high as they need."""
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    return d.select((F.col("k") % 96).alias("x"), F.floor(F.col("k") / 96).alias("y"), (F.col("k") * 7 % 256).alias("r"), (F.col("k") * F.col("k") % 256).alias("g"), (F.col("k") * 31 % 251).alias("b"))


def to_mono(spark, sf):
    """Mono samples of every order: its lines are frames of two channels."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array((F.col("l_partkey") % 201 - 100).cast("int"), (F.col("l_suppkey") % 77 - 40).cast("int")).alias("frame"))
    s = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "frame"))).alias("r"))
    m = s.select("l_orderkey", F.arrays_zip(F.col("r.l_linenumber"), audio.to_mono(F.flatten("r.frame"), F.lit(2)).alias("m")).alias("z")).select("l_orderkey", F.explode("z").alias("z"))
    return m.select("l_orderkey", F.col("z.l_linenumber").alias("l_linenumber"), F.col("z.m").cast("long").alias("mono"))


def median(spark, sf):
    """Lower median of the quantities of every supplier."""
    q = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("q"))
    return q.select("l_suppkey", raster.median_of("q").alias("median"))


def _chains(spark, sf):
    """One chain of frame hashes a supplier: its line items in order."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", (F.col("l_partkey") * 7919).alias("h")))).alias("r"))
    return rows.select("id", F.transform("r", lambda x: x["h"]).alias("chain"))


def video_match(spark, sf):
    c = materialise(_chains(spark, sf), "chains")
    both = c.select(F.col("id").alias("a"), F.col("chain").alias("ca")).join(c.select((F.col("id") - 1).alias("a"), F.col("chain").alias("cb")), "a")
    return both.select("a", matching.video_score(F.col("ca"), F.col("cb")).cast("double").alias("score"))


def chain_signatures(spark, sf):
    from siltstone.functions import video

    return _chains(spark, sf).select("id", F.array_join(F.transform(video.chain_signature("chain"), u64.hex64), " ").alias("sig"))


def text_signatures(spark, sf):
    """All words of the signature."""
    return _canon(spark, sf).select("doc_id", matching.signature_head(text.signature("canon"), text.SIGNATURE_WORDS).alias("minhash"))


def distance_axis(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, ("image", "audio", "text", "binary", "video"))), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("m"), (F.col("l_partkey") % 65).alias("h"), (F.col("l_suppkey") % 30).alias("v"), ((F.col("l_partkey") % 129) / 128.0).cast("double").alias("s"))
    return l.select("l_orderkey", "l_linenumber", matching.scalar_distance(F.col("m"), F.col("h"), F.col("v"), F.col("s")).alias("distance"), matching.is_match(F.col("m"), F.col("h"), F.col("v"), F.col("s")).alias("matched"))


def describe(spark, sf):
    from siltstone.operators import describe as d

    head = F.element_at(F.array(*(F.unhex(F.lit(h)) for h in HEADS)), F.pmod("doc_id", F.lit(len(HEADS))).cast("int") + 1)
    files = _docs(spark, sf).select("doc_id", F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    return d.to_json(d.describe(files, "doc_id"))


def _rasters(spark, sf, width):
    """Whole texts as gray pictures: bytes row by row, as many rows as they need, the last filled with zeros."""
    d = _docs(spark, sf).select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("b")).withColumn("h", F.ceil(F.octet_length("b") / width).cast("int"))
    return d.select("doc_id", "h", F.rpad("b", F.col("h") * width, F.lit(b"\x00")).alias("px"))


def image_phash(spark, sf):
    """Perceptual hashes of whole texts as pictures of 48 columns; null for an empty one."""
    return _rasters(spark, sf, 48).select("doc_id", u64.hex64(raster.image_phash("px", F.lit(48), F.col("h"), F.lit(1))).alias("phash"))


def orb_features(spark, sf):
    """Features of whole texts as pictures of 64 columns."""
    from siltstone.functions import geometry

    f = _rasters(spark, sf, 64).select("doc_id", F.explode(geometry.orb_features("px", F.lit(64), F.col("h"))).alias("o"))
    return f.select("doc_id", "o.x", "o.y", F.lower(F.hex("o.desc")).alias("desc"))


def _decoded(spark, sf, file, fmt):
    from siltstone.sources import media

    d = _rasters(spark, sf, fixtures.WIDTH).filter("h > 0").withColumn("i", media.decode_image(file("px"), F.lit(fmt)))
    return d.select("doc_id", F.col("i.width").cast("long").alias("width"), F.col("i.height").cast("long").alias("height"), F.sha2("i.payload", 256).alias("tier1"))


def decode_png(spark, sf):
    """Whole texts as gray pictures, through PNG files and back."""
    return _decoded(spark, sf, fixtures.png_of, "png")


def decode_bmp(spark, sf):
    return _decoded(spark, sf, fixtures.bmp_of, "bmp")


def decode_wav(spark, sf):
    """Whole texts as samples, through WAV files and back: the first tier is over rate, length and 32-bit frames."""
    from siltstone.sources import media

    d = _docs(spark, sf).select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("b"))
    even = F.rpad("b", F.octet_length("b") + F.octet_length("b") % 2, F.lit(b"\x00"))
    a = d.select("doc_id", media.decode_audio(fixtures.wav_of(even), F.lit("wav")).alias("a"))
    return a.select("doc_id", F.col("a.frames").alias("frames"), F.sha2("a.payload", 256).alias("tier1"))


def unzip(spark, sf):
    """Whole texts through ZIP archives and back."""
    from siltstone.sources import media

    z = _docs(spark, sf).select("doc_id", F.explode(media.zip_members(fixtures.zip_of(F.encode("text", "UTF-8")))["members"]).alias("m"))
    return z.select("doc_id", "m.name", F.col("m.size").alias("size"), F.sha2("m.content", 256).alias("sha256"))


def inflate(spark, sf):
    """Whole texts through zlib streams and back."""
    from siltstone.sources import media

    return _docs(spark, sf).select("doc_id", F.sha2(media.inflate(fixtures.zlib_of(F.encode("text", "UTF-8"))), 256).alias("sha256"))


def time_warping(spark, sf):
    """Warped distance of the quantities of each supplier and the next, in order of their line items."""
    from siltstone.functions import geometry

    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("r"))
    s = materialise(rows.select("id", F.transform("r", lambda x: x["q"]).alias("q")), "series")
    both = s.select(F.col("id").alias("a"), F.col("q").alias("x")).join(s.select((F.col("id") - 1).alias("a"), F.col("q").alias("y")), "a")
    return both.select("a", F.round(geometry.dtw_distance("x", "y"), 9).alias("cost"))


QUERIES = {
    f.__name__: f
    for f in (
        text_content_hash, exact_groups, text_facts, shingle_counts, text_near_duplicates, text_dedup, dedup_report, lsh_candidates, binary_dedup, cdc_chunks,
        checksums, checksums_more, detect, hamming_search, hash_hex, calibrate_dedup, calibrate_search, evaluate, audio_votes, audio_fingerprint, video_slots, luma, to_mono, median,
        video_match, chain_signatures, text_signatures, distance_axis, describe, image_phash, orb_features, time_warping, decode_png, decode_bmp, decode_wav, unzip, inflate,
    )
}

_BITS = "(SELECT {id} AS id, list_reduce(list_transform({v}[1:64], lambda x: (x > 0)::UHUGEINT), lambda a, b: a * 2 + b)::UBIGINT AS hash FROM embeddings)".format(id="vec_id", v="embedding")
_LABELLED = "(SELECT (n_chars % 23 + 5 * toxic)::BIGINT AS distance, quality = 1 AS same FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"
_PEAKS = "(SELECT l_suppkey AS id, (l_orderkey % 97)::INT AS t, (l_partkey % 59)::INT AS f FROM lineitem)"


def _calibrate_sql(profile: str) -> str:
    b2 = cal.BETA[profile] ** 2
    order = "tp + fp" if profile == "dedup" else "-(tp + fp)"
    return f"""
WITH per AS (SELECT distance, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM {_LABELLED} GROUP BY distance),
cum AS (
  SELECT distance, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM per WINDOW w AS (ORDER BY distance)
  UNION ALL SELECT NULL, 0, 0, sum(p), sum(n) FROM per
), rates AS (
  SELECT *, CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp > 0 THEN tp / pos ELSE 0 END AS re FROM cum
), scored AS (
  SELECT *, CASE WHEN tp > 0 THEN (1 + {b2}) * pr * re / ({b2} * pr + re) ELSE 0 END AS score FROM rates
)
SELECT distance AS threshold, score::DOUBLE AS score, tp::BIGINT AS true_positives, fp::BIGINT AS false_positives, (pos - tp)::BIGINT AS false_negatives,
       (neg - fp)::BIGINT AS true_negatives, pr::DOUBLE AS precision, re::DOUBLE AS recall
FROM scored ORDER BY score DESC, {order} LIMIT 1"""


def _detect_sql() -> str:
    heads = ", ".join(f"'{h}'" for h in HEADS)
    case = ""
    for marks, fmt, modality in sniff.SIGNATURES:
        hit = " AND ".join(f"substr(h, {2 * at + 1}, {len(mark)}) = '{mark}'" for at, mark in marks)
        if not marks:
            hit = "substr(h, 1, 6) = '494433' OR (substr(h, 1, 2) = 'FF' AND length(h) >= 4 AND b >= 224 AND b NOT IN (254, 255) AND (b & 24) <> 8 AND (b & 6) <> 0)"
        case += f" WHEN {hit} THEN '{fmt}:{modality}'"
    return f"""
WITH x AS (SELECT doc_id, [{heads}][1 + (doc_id % {len(HEADS)})::INT] AS head, text FROM documents),
y AS (SELECT doc_id, head, head || hex(encode(text)) AS h FROM x),
z AS (SELECT doc_id, head, h, CASE WHEN length(h) >= 4 THEN ('0x' || substr(h, 3, 2))::INT ELSE 0 END AS b FROM y),
k AS (SELECT doc_id, CASE {case} WHEN head IN ('FFFE', 'FFFF', 'FFE9', 'FFF9', 'C328') THEN 'unknown:binary' ELSE 'unknown:text' END AS k FROM z)
SELECT doc_id, split_part(k, ':', 1) AS format, split_part(k, ':', 2) AS modality, false AS pending FROM k"""


SQL = {
    "text_content_hash": f"SELECT doc_id, sha256({CANON}) AS tier1 FROM documents",
    "exact_groups": f"SELECT sha256({CANON}) AS tier1, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "text_facts": f"SELECT doc_id, len({WORDS})::BIGINT AS words, strlen({CANON})::BIGINT AS canonical_bytes FROM documents",
    "shingle_counts": f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, len(w) - least({text.SHINGLE_WORDS}, len(w)) + 2), lambda i: array_to_string(w[i:i + {text.SHINGLE_WORDS - 1}], ' ')) END AS s FROM w)
SELECT doc_id, len(s)::BIGINT AS shingles, len(list_distinct(s))::BIGINT AS distinct_shingles FROM s""",
    "checksums": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1, strlen(text)::BIGINT AS bytes FROM documents",
    "detect": _detect_sql(),
    "hash_hex": f"SELECT id, lpad(lower(to_hex(hash)), 16, '0') AS hex, bit_count(hash)::BIGINT AS bits FROM {_BITS}",
    "hamming_search": f"SELECT q.id AS query_id, i.id, bit_count(xor(q.hash, i.hash))::INT AS distance FROM {_BITS} q, {_BITS} i WHERE q.id % 50 = 0 AND bit_count(xor(q.hash, i.hash)) <= {RADIUS}",
    "calibrate_dedup": _calibrate_sql("dedup"),
    "calibrate_search": _calibrate_sql("search"),
    "evaluate": f"""
WITH c AS (SELECT count(*) FILTER (distance <= 11 AND same) AS tp, count(*) FILTER (distance <= 11 AND NOT same) AS fp, count(*) FILTER (distance > 11 AND same) AS fn,
  count(*) FILTER (distance > 11 AND NOT same) AS tn, count(*) FILTER (distance IS NULL) AS skipped FROM {_LABELLED}),
r AS (SELECT *, CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT *, CASE WHEN tp > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r""",
    "audio_votes": f"""
WITH p AS (SELECT DISTINCT * FROM {_PEAKS}),
v AS (SELECT q.id AS query_id, s.id, q.t - s.t AS delta, count(*) AS v FROM p q JOIN p s ON q.f = s.f WHERE q.id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, sum(v) OVER (PARTITION BY query_id, id ORDER BY delta RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS votes, row_number() OVER (PARTITION BY query_id, id ORDER BY v DESC, delta) AS k FROM v)
SELECT query_id, id, votes::BIGINT AS votes, delta FROM r WHERE k = 1 AND votes >= {matching.AUDIO_VOTES}""",
    "audio_fingerprint": f"""
WITH f AS (SELECT id, t, min(f) AS f FROM {_PEAKS} GROUP BY ALL)
SELECT id, lpad(lower(to_hex(bit_or((1::UBIGINT << (f % 64)::UBIGINT)))), 16, '0') AS fingerprint FROM f GROUP BY id""",
    "video_slots": """
WITH l AS (SELECT l_suppkey % 40 AS id, ((l_orderkey % 5000) - 100)::BIGINT AS pts, (l_linenumber + 10 * l_partkey)::BIGINT AS frame FROM lineitem),
s AS (SELECT *, floor(2.0 * pts / 600)::BIGINT AS slot FROM l)
SELECT id, slot, pts, frame FROM s QUALIFY row_number() OVER (PARTITION BY id, slot ORDER BY pts, frame) = 1""",
    "video_match": """
WITH c AS (SELECT l_suppkey AS id, list(l_partkey * 7919 ORDER BY l_orderkey, l_linenumber, l_partkey * 7919) AS chain FROM lineitem GROUP BY 1),
p AS (SELECT a.id AS a, a.chain AS x, b.chain AS y, least(len(a.chain), len(b.chain)) AS n FROM c a JOIN c b ON b.id = a.id + 1)
SELECT a, CASE WHEN n = 0 THEN 1.0 ELSE len(list_filter(range(1, n + 1), lambda i: bit_count(xor(x[i], y[i])) <= 10)) / n END::DOUBLE AS score FROM p""",
    "distance_axis": """
WITH l AS (SELECT l_orderkey, l_linenumber, ['image', 'audio', 'text', 'binary', 'video'][1 + l_linenumber % 5] AS m, l_partkey % 65 AS h, l_suppkey % 30 AS v, ((l_partkey % 129) / 128.0)::DOUBLE AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE m WHEN 'image' THEN h WHEN 'audio' THEN 4294967295 - v ELSE round((1 - s) * 1e6)::BIGINT END AS distance,
       CASE m WHEN 'image' THEN h <= 10 WHEN 'audio' THEN v >= 8 WHEN 'binary' THEN s >= 0.5 ELSE s >= 0.8 END AS matched FROM l""",
    "luma": "SELECT k % 96 AS x, (k // 96)::BIGINT AS y, ((299 * (k * 7 % 256) + 587 * (k * k % 256) + 114 * (k * 31 % 251) + 500) // 1000)::BIGINT AS luma FROM (SELECT p_partkey AS k FROM part)",
    "to_mono": "SELECT l_orderkey, l_linenumber, trunc(((l_partkey % 201 - 100) + (l_suppkey % 77 - 40)) / 2.0)::BIGINT AS mono FROM lineitem",
    "median": "SELECT l_suppkey, quantile_disc(l_quantity, 0.5)::DOUBLE AS median FROM lineitem GROUP BY 1",
}


_PICTURE = f"""
WITH b AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text <> ''),
p AS (SELECT doc_id, ceil(length(x) / {2 * fixtures.WIDTH}.0)::BIGINT AS height, x FROM b)
SELECT doc_id, {fixtures.WIDTH}::BIGINT AS width, height, sha256(unhex(regexp_replace(rpad(x, (height * {2 * fixtures.WIDTH})::INT, '0'), '(..)', '\\1\\1\\1', 'g'))) AS tier1 FROM p"""
_LITTLE = "list_aggregate(list_transform(range(0, {n}), lambda i: lpad(to_hex(({v} >> (8 * i)) & 255), 2, '0')), 'string_agg', '')"
SQL |= {
    "decode_png": _PICTURE,
    "decode_bmp": _PICTURE,
    "decode_wav": f"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
e AS (SELECT doc_id, CASE WHEN length(x) % 4 = 2 THEN x || '00' ELSE x END AS x FROM b),
s AS (SELECT doc_id, (length(x) // 4)::BIGINT AS frames, replace(regexp_replace(regexp_replace(x, '(....)', '\\1|', 'g'), '([89A-F].)\\|', '\\1FFFF', 'g'), '|', '0000') AS wide FROM e)
SELECT doc_id, frames, sha256(unhex({_LITTLE.format(n=4, v="44100")} || {_LITTLE.format(n=8, v="frames")} || wide)) AS tier1 FROM s""",
    "unzip": """
SELECT doc_id, 'content' AS name, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 'empty', 0::BIGINT, sha256('') FROM documents WHERE text IS NOT NULL""",
    "inflate": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "text_signatures": f"{mh.of_texts(WORDS)} SELECT doc_id, {mh.digits()} AS minhash FROM documents LEFT JOIN sig USING (doc_id) GROUP BY doc_id",
    "text_near_duplicates": mh.near_duplicates(WORDS, CANON),
    "text_dedup": f"{mh.clusters(WORDS, CANON)} SELECT * FROM dedup",
    "dedup_report": mh.report(WORDS, CANON),
    "lsh_candidates": mh.lookup(WORDS),
    "checksums_more": mh.checksums(),
    "chain_signatures": mh.signatures(
        f"""WITH c AS (SELECT l_suppkey AS doc_id, list(lpad(to_hex(l_partkey * 7919), 16, '0') ORDER BY l_orderkey, l_linenumber, l_partkey * 7919) AS w FROM lineitem GROUP BY 1),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({SHINGLE_FRAMES}, len(w)) - 1], '') AS x FROM c, unnest(range(1, len(w) - least({SHINGLE_FRAMES}, len(w)) + 2)) AS t(i))""",
        CHAIN_SEEDS,
    )
    + f" SELECT doc_id AS id, {mh.digits()} AS sig FROM sig GROUP BY doc_id",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

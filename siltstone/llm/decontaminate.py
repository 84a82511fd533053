"""Benchmark decontamination by spaced seeds.

A spaced seed reads only some of the positions of a word window, so a substituted word at an
ignored position leaves the seed's hash as it was. Seeds of the benchmark and of the documents are
joined on their hash. A hit fixes an alignment of a document and an item, a diagonal; all words
that the two share on it are then compared, so it doesn't matter which of its hits was found.

Definitions:

* words are maximal runs of letters and digits of the lower-cased text (a non-ASCII character
  counts as a letter); null texts have none;
* an overlap is a stretch of a diagonal that begins and ends with equal words, has at least
  ``MIN_EQUAL`` equal words (all of a shorter item) and three quarters of its words equal. The
  overlap of a document and an item is the one with the most equal words, then the fewest words,
  then the smallest start in the document;
* benchmark items with fewer than ``MIN_WORDS`` words are too short to be evidence and match
  nothing; items under ``MIN_EQUAL`` words must occur whole and are seeded so;
* items with the same words form one class, named by its smallest ``item_id`` (null if it has
  none). Items with the same id and other words are other classes;
* one row per document and class with an overlap; documents without any have no row. Every document
  is matched, whatever its id; equal documents each have their own rows.

Every mask reads 6 words of 6 to 10. Of all ways to place the differing words of a shortest
overlap, the masks meet 99 % (13 words, 3 of them different: 98.9 %; from 20 words on 99.9 %);
tests enumerate them.

Scale: documents are read in one narrow pass. A Bloom filter of fixed size (``BLOOM_BITS``)
decides which documents may hit; only those are written, as hashes of their words, exploded and joined. The join is exact
whatever the filter lets through. The filter reaches the driver as at most BLOOM_BITS/64 numbers. A document's words are sent once, whatever it
hits; its items' words follow it in a sorted stream, so no task holds more than one of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.arrow import map_slices
from siltstone.runtime import materialise, table

#: 1: the position is read.
MASKS = ("11101011", "1100100111", "111111", "1011000111", "1110001011")
MIN_WORDS = 5
BLOOM_BITS = 1 << 26
PROBES = 3
#: An overlap has so many equal words (all of a shorter item), and that share (in quarters) of its words equal.
MIN_EQUAL, MIN_QUARTERS = 10, 3

_ODD = [pow(W.WORD_BASE, 2 * i + 3, 1 << 64) | 1 for i in range(32)]


def _read(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(h: np.ndarray, ptr: np.ndarray, span: int, read: list[int], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the read positions of every window, and where the window starts."""
    n = np.maximum(np.diff(ptr) - span + 1, 0)
    at = np.repeat(ptr[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    if not len(at):
        return np.zeros(0, W.U64), at
    m = len(h) - span + 1
    acc = np.full(m, salt, W.U64)
    for j, i in enumerate(read):
        acc += h[i : i + m] * W.U64(_ODD[j])
    return W.mix(acc[at]), at


#: (span, read positions, salt) of the masks, and of whole items that are too short to differ anywhere.
FAMILIES = [(len(m), _read(m), 1000 + i) for i, m in enumerate(MASKS)] + [(k, list(range(k)), k) for k in range(MIN_WORDS, MIN_EQUAL)]


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> W.U64(7 + 11 * i)) & W.U64(BLOOM_BITS - 1) for i in range(PROBES)]


def classes(bench: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(c, item_id, text): one row per distinct word sequence."""
    items = bench.select(F.col(item_id).alias("item_id"), F.lower(F.col(text)).alias("text"))
    normal = F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return items.groupBy(normal.alias("text")).agg(F.min("item_id").alias("item_id")).select(F.monotonically_increasing_id().alias("c"), "item_id", "text")


def class_seeds(items: DataFrame) -> DataFrame:
    """(seed, c, q) of every class."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        w = W.split(b["text"], False, W.ALNUM)
        h, n, out = w.hashes(), w.n, []
        for span, read, salt in FAMILIES:
            s, at = seeds(h, w.ptr, span, read, salt)
            doc = np.searchsorted(w.ptr, at, "right") - 1
            ok = n[doc] >= MIN_EQUAL if salt >= 1000 else n[doc] == span
            out.append((s[ok], doc[ok], (at - w.ptr[doc])[ok]))
        s, doc, q = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(W.signed(s)), b["c"].take(pa.array(doc)), pa.array(q.astype(np.int32))], names=["seed", "c", "q"])

    return map_slices(items.select("c", "text"), "text", "seed long, c long, q int", kernel)


def bloom(seed_rows: DataFrame) -> np.ndarray:
    """The filter's bytes, gathered as at most BLOOM_BITS / 64 numbers."""
    s = F.col("seed")
    bit = [F.shiftrightunsigned(s, 7 + 11 * i).bitwiseAND(F.lit(BLOOM_BITS - 1)) for i in range(PROBES)]
    words = seed_rows.select(F.explode(F.array(*bit)).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint8)


def best_overlap(same: np.ndarray, need: int) -> tuple[int, int, int] | None:
    """Start, words and equal words of the best overlap in the equalities along a diagonal."""
    at = np.flatnonzero(same)
    if len(at) < need:
        return None
    # From equal word i to equal word j there are j - i + 1 equal ones of at[j] - at[i] + 1. The share
    # is enough where rise[j] >= fall[i]; the last such j is found by the largest rise from there on.
    k = np.arange(len(at))
    rise, fall = 4 * (k + 1) - MIN_QUARTERS * (at + 1), 4 * k - MIN_QUARTERS * at
    later = np.maximum.accumulate(rise[::-1])  # ascending: largest rise of the last 1, 2, ... places
    last = len(at) - 1 - np.searchsorted(later, fall, "left")
    equal = last - k + 1
    i = np.lexsort((k, at[last] - at, -equal))[0]
    if equal[i] < need:
        return None
    return int(at[i]), int(at[last[i]] - at[i] + 1), int(equal[i])


def overlaps_on(x: np.ndarray, y: np.ndarray, diagonals: list[int]) -> tuple[int, int, int, int] | None:
    """(start in x, start in y, words, equal words) of the best overlap of x and y on any of the diagonals."""
    found = []
    for d in diagonals:
        lo, hi = max(0, d), min(len(x), len(y) + d)
        best = best_overlap(x[lo:hi] == y[lo - d : hi - d], min(MIN_EQUAL, len(y)))
        if best is not None:
            start, n, equal = best
            found.append((-equal, n, lo + start, lo + start - d))
    if not found:
        return None
    equal, n, p, q = min(found)
    return p, q, n, -equal


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_equal, item_words) of each overlap found, and the document's columns in ``keep``."""
    items = materialise(classes(bench), "classes")
    seed_rows = materialise(class_seeds(items), "seeds")
    bits = docs.sparkSession.sparkContext.broadcast(bloom(seed_rows))

    def find(b: pa.RecordBatch) -> pa.RecordBatch | None:
        w = W.split(b["_text"], False, W.ALNUM)
        h, table_, found = w.hashes(), bits.value, []
        for span, read, salt in FAMILIES:
            s, at = seeds(h, w.ptr, span, read, salt)
            for i in range(PROBES):
                x = (s >> W.U64(7 + 11 * i)) & W.U64(BLOOM_BITS - 1)
                ok = (table_[(x >> W.U64(3)).astype(np.int64)] >> (x & W.U64(7)).astype(np.uint8)) & 1 == 1
                s, at = s[ok], at[ok]
            found.append((s, at))
        s, at = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(s):
            return None
        order = np.argsort(at, kind="stable")
        s, at = s[order], at[order]
        doc = np.searchsorted(w.ptr, at, "right") - 1
        rows, first = np.unique(doc, return_index=True)
        ptr = pa.array(np.append(first, len(doc)).astype(np.int32))
        take, names = pa.array(rows), [c for c in b.schema.names if c != "_text"]
        own = pa.array([h[w.ptr[i] : w.ptr[i + 1]].tobytes() for i in rows.tolist()], pa.binary())
        lists = [pa.ListArray.from_arrays(ptr, pa.array(W.signed(s))), pa.ListArray.from_arrays(ptr, pa.array((at - w.ptr[doc]).astype(np.int32)))]
        return pa.RecordBatch.from_arrays([*(b[c].take(take) for c in names), own, *lists], names=[*names, "_words", "_seeds", "_at"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.lower(F.col(text)).alias("_text"))
    fields = "".join(f"`{c}` {x}, " for c, x in texts.dtypes if c != "_text")
    hits = map_slices(texts, "_text", f"{fields}_words binary, _seeds array<long>, _at array<int>", find)
    hits = materialise(hits.withColumn("_hit", F.monotonically_increasing_id()), "hits")
    exploded = hits.select("_hit", F.explode(F.arrays_zip("_seeds", "_at")).alias("x")).select("_hit", F.col("x._seeds").alias("seed"), F.col("x._at").alias("p"))
    pairs = exploded.join(seed_rows.hint("merge"), "seed").groupBy("_hit", "c").agg(F.collect_set(F.col("p") - F.col("q")).alias("diagonals"))

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        w = W.split(b["text"], False, W.ALNUM)
        h = w.hashes()
        return pa.RecordBatch.from_arrays([b["c"], pa.array([h[i:j].tobytes() for i, j in zip(w.ptr[:-1], w.ptr[1:], strict=True)], pa.binary())], names=["c", "words"])

    words = map_slices(items.select("c", "text"), "text", "c long, words binary", hashed)
    asked = pairs.join(words.hint("merge"), "c").select("_hit", "c", "diagonals", "words")
    stream = asked.unionByName(hits.select("_hit", F.lit(-1).cast("long").alias("c"), F.array().cast("array<int>").alias("diagonals"), F.col("_words").alias("words")))

    def verify(batches):
        hit, x = None, None
        for b in batches:
            rows = []
            for i, (own, c, diagonals, w) in enumerate(zip(*(b[k].to_pylist() for k in ("_hit", "c", "diagonals", "words")), strict=True)):
                y = np.frombuffer(w, np.uint64)
                if c < 0:
                    hit, x = own, y
                    continue
                assert own == hit
                best = overlaps_on(x, y, diagonals)
                if best is not None:
                    rows.append((i, *best, len(y)))
            if rows:
                i, *cols = (np.array(v, np.int64) for v in zip(*rows, strict=True))
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([b["_hit"].take(take), b["c"].take(take), *map(pa.array, cols)], names=["_hit", "c", *SPAN])

    spans = stream.repartition("_hit").sortWithinPartitions("_hit", "c").mapInArrow(verify, f"_hit long, c long, {', '.join(f'{x} long' for x in SPAN)}")
    out = spans.join(items.select("c", "item_id"), "c").join(hits.select("_hit", "doc_id", *keep), "_hit")
    return out.select("doc_id", *keep, "item_id", *SPAN)


SPAN = ("doc_start", "item_start", "n_words", "n_equal", "item_words")


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any overlap with the benchmark. A row goes for what its own text holds, whatever its id
    and whichever rows share it: rows are told apart by two hashes of their texts."""
    key = lambda t: (F.xxhash64(F.lit(1), t).alias("_k1"), F.xxhash64(F.lit(2), F.reverse(t)).alias("_k2"))
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").alias("_t"))
    found = decontaminate(rows.withColumns({"_k1": key(F.col("_t"))[0], "_k2": key(F.col("_t"))[1]}), table(spark, sf_dir, "benchmark"), text="_t", keep=("_k1", "_k2"))
    bad = materialise(found.select(F.col("_k1").alias("_b1"), F.col("_k2").alias("_b2")).distinct(), "contaminated")
    k1, k2 = key(docs["text"])
    return docs.join(bad, (k1 == bad["_b1"]) & (k2 == bad["_b2"]), "left_anti").select(*(f"`{c}`" for c in docs.columns))

"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio, all in SQL expressions.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials over
the buckets are counted: the raw corpus (every document) and the trusted target (documents whose
label says quality 1). A document's ratio is the sum over its n-grams of log(target / raw),
divided by the number of n-grams; it is kept when it passes the base rules and its ratio is not
further below the mean of the corpus than the mean of the trusted target is above it, both means
being over n-grams. That limit, 2 * mean(raw) - mean(target), follows from the two multinomials
alone; it moves with the share of trusted text as the ratios do. Nothing is drawn at random, every document gets its verdict.

Definitions: a null or blank text has no words, all statistics 0 and fails; with fewer than five
words there are no windows; without any trusted document the ratio is 0 for everyone. Rows are
independent, so repeated rows get equal verdicts. Several labels of one document: trusted if any
says 1.

Scale: texts meet their labels in one exchange, behind which both multinomials are counted with
map-side sums over a fixed number of buckets; the table of ratios has BUCKETS numbers and reaches the scoring pass as a scalar subquery, so scoring is
one narrow pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import table

BUCKETS = 1 << 14
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def hashes(w: Column) -> Column:
    """Each word is hashed once; pairs and windows hash these numbers."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _grams(h: Column) -> Column:
    ones = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    twos = F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: _bucket(F.get(h, i), F.get(h, i + 1)))
    return F.concat(ones, F.when(F.size(h) > 1, twos).otherwise(F.array().cast("array<int>")))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_w`` (words), and the base statistics of the contract."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", words(F.col(text))).withColumn("_h", hashes(F.col("_w")))
    w, h, n = F.col("_w"), F.col("_h"), F.size("_w")
    # slice() copies its whole input, get() doesn't. Hashes tell which texts can repeat a window at
    # all; in those the windows themselves are put together and sorted.
    five = lambda a, i: [F.get(a, i + j) for j in range(WINDOW)]
    starts = F.sequence(F.lit(0), n - WINDOW)
    df = df.withColumn("_hashes", F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*five(h, i)))))
    pairs = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *five(w, i)).alias("s"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size("_hashes") > F.size(F.array_distinct("_hashes")), pairs))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    s = F.col("_sorted")
    near = lambda x, i, d: (F.get(s, i + d)["s"] == x["s"])
    hit = F.filter(s, lambda x, i: F.coalesce(near(x, i, 1), F.lit(False)) | (F.when(i > 0, F.coalesce(near(x, i, -1), F.lit(False))).otherwise(F.lit(False))))
    df = df.withColumn("_at", F.array_sort(F.transform(hit, lambda x: x["i"])))
    at = F.col("_at")
    cover = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(cover, F.lit(0)).cast("long"),
    })


def ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row, one column ``r``: the array of log(target / raw) of every bucket, add-one smoothed, and then the
    smallest ratio to keep, ``cut``."""
    good = trusted.filter(F.col("quality") == 1).select(F.col(doc_id).alias("_good")).distinct()
    # Always merged: the labels grow with the documents, so neither side may be broadcast. Texts go
    # through this exchange once and both multinomials are counted behind it.
    marked = docs.join(good.hint("merge"), docs[doc_id] == good["_good"], "left").select(F.col(text).alias("_t"), F.col("_good").isNotNull().alias("_y"))
    # The hashes are a column of their own: inside a lambda an expression would run for every element.
    grams = marked.select(hashes(words(F.col("_t"))).alias("_h"), "_y").select(F.explode(_grams(F.col("_h"))).alias("b"), "_y")
    counted = grams.groupBy("b").agg(F.count("*").alias("c"), F.count_if("_y").alias("t"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    both = every.join(counted, "b", "left").fillna(0, ["c", "t"])
    sums = both.agg(F.sum("c").alias("n"), F.sum("t").alias("m"), F.array_sort(F.collect_list(F.struct("b", "c", "t"))).alias("a"))
    ratio = lambda x: F.log((x["t"] + 1.0) / (F.col("m") + float(BUCKETS))) - F.log((x["c"] + 1.0) / (F.col("n") + float(BUCKETS)))
    sums = sums.withColumn("r", F.transform("a", lambda x: F.when(F.col("m") > 0, ratio(x)).otherwise(F.lit(0.0))))
    mean = lambda k, total: F.aggregate(F.zip_with("a", "r", lambda x, r: x[k] * r), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.col(total), F.lit(1))
    sums = sums.withColumn("cut", 2 * mean("c", "n") - mean("t", "m"))
    return sums.select(F.concat("r", F.array("cut")).alias("r"))


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept)."""
    docs, text, doc_id = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id"
    r = ratios(docs, trusted, text, doc_id)
    df = base_columns(docs, text).withColumn("_g", _grams(F.col("_h")))
    df = df.withColumn("_r", r.scalar())
    total = F.aggregate("_g", F.lit(0.0), lambda a, b: a + F.element_at(F.col("_r"), b + 1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumn("llr", F.when(F.size("_g") > 0, total / F.size("_g")).otherwise(F.lit(0.0))).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("llr") >= F.element_at(F.col("_r"), BUCKETS + 1))
    return df.select(F.col(doc_id).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded random order, passed through ``PASSES``
times. The virtual finish time of a queue entry is the source's cumulative words up to it, divided
by the source's weight. All entries are taken in the order of their finish times until the budget
is used up; a source whose queue has ended leaves its share to the others by weight, which is
exactly the contract's reshared targets.

Definitions:

* size: words of the text, 0 for null; such documents are kept with nothing taken;
* sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ...;
* ``target`` of a source is its share of the budget: min(level * weight, 2 * size of the source)
  at the water level where these add up to the budget;
* the order within a source is by a hash of (seed, doc_id, text), ties by doc_id and size; rows equal
  in all are interchangeable. The result doesn't depend on partitioning, so reruns agree;
* the cut falls where the running total first passes the budget; the entry across it is taken when
  at least half of it lies inside. An empty table gives an empty result.

Scale: prefix sums are exact integers over a fixed grid of hash ranges (then of finish-time
ranges), so a source with a third of all rows is spread over all tasks. Tables of (source, range)
sums are the only thing that is summed by source. The texts are read once, narrowly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import materialise, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SEED = 20240501
#: Rows that a hash range or finish-time range should hold.
RANGE_ROWS = 2000


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: a word byte before a space or the end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """60 bits of an MD5 over seed, id and text: uniform also where ids are null or repeated, and the same in any SQL engine."""
    parts = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def source_table(sizes: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target): one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    # A source is full once level >= passes * size / weight. Going through the sources in that
    # order, the level of the others follows from what the full ones leave.
    ranked = per.withColumn("weight", w).withColumn("full_at", F.lit(float(passes)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = (
        ranked.withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("full_before", F.coalesce(F.sum(F.lit(passes) * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level_here", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
    )
    # level_here rises as long as the next source is full below it, then falls: its peak is the level.
    level = F.max("level_here").over(every)
    target = F.least(level * F.col("weight"), F.lit(float(passes)) * F.col("source_size"))
    return ranked.select("source", "source_size", "source_rows", "weight", "budget", target.cast("double").alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document, and the columns in ``keep``."""
    from pyspark.sql.types import StringType

    assert isinstance(docs.schema[source].dataType, StringType)
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        order_key(F.col(doc_id), F.col(text), seed).alias("_h"), *keep,
    )
    sizes = materialise(sizes, "mix-sizes")
    sources = materialise(source_table(sizes, share, passes, weights), "mix-sources")
    rows = sizes.count()
    bits = min(40, max(4, (rows // RANGE_ROWS).bit_length()))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    sizes = sizes.withColumn("_range", F.shiftright("_h", 60 - bits))
    sums = sizes.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    sums = sums.alias("a").join(F.broadcast(sources).alias("b") if _small(sources) else sources.alias("b"), same).select("a.source", "a._range", "a._before", "b.source_size", "b.source_rows", "b.weight", "b.budget", "b.target")
    inside = Window.partitionBy("source", "_range").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("_in", F.sum("size").over(inside))
    placed = sizes.alias("a").join(sums.alias("b"), same & (F.col("a._range") == F.col("b._range")))
    placed = placed.select(
        "a.doc_id", "a.source", "a.size", "a._h", *(F.col(f"a.{c}") for c in keep), "b.source_size", "b.weight", "b.budget", "b.target",
        (F.col("b._before") + F.col("a._in")).alias("_end"),
    )
    placed = materialise(placed, "mix-placed")
    finish = lambda p: (F.col("_end") + p * F.col("source_size")) / F.col("weight")
    # The cut: finish-time ranges are summed over all sources, and only the range that the budget
    # ends in is sorted by entry. Level and ranges scale with the data, so that range stays small.
    top = sources.agg(F.max(F.col("source_size") * passes / F.col("weight")).alias("t"), F.max("budget").alias("b")).first()
    if top is None or not top["t"]:
        return placed.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"), *keep)
    n_ranges = 1 << min(40, bits + 4)
    slot = lambda f: F.floor(f / F.lit(top["t"]) * n_ranges)
    entries = placed.filter("size > 0").select("doc_id", "source", "size", "_h", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), finish(p).alias("finish")) for p in range(passes)))).alias("e"))
    entries = entries.select("doc_id", "source", "size", "_h", "e.p", "e.finish").withColumn("slot", slot(F.col("finish")))
    total = entries.groupBy("slot").agg(F.sum("size").alias("words"))
    # The running total over the ranges, in two levels so that no task sums more than its block.
    block = 1 << ((bits + 4) // 2)
    blocks = total.groupBy(F.floor(F.col("slot") / block).alias("block")).agg(F.sum("words").alias("words"))
    b = _first_over(blocks, "block", top["b"], 0)
    s = _first_over(total.filter(F.floor(F.col("slot") / block) == b[0]), "slot", top["b"], b[1])
    cut = entries.filter(F.col("slot") == s[0])
    run = Window.orderBy("finish", F.col("source").isNull(), "source", "p", "_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.withColumn("run", F.sum("size").over(run) + F.lit(s[1])).filter((F.col("run") - F.col("size") / 2) <= F.lit(top["b"])).agg(F.max(F.struct("finish", F.col("source").isNull().alias("none"), "source", "p", "_h", "doc_id", "size")).alias("m")).first()["m"]
    if last is None:
        taken = lambda p: slot(finish(p)) < s[0]
    else:
        def taken(p: int) -> Column:
            f = finish(p)
            same_time = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")), F.lit(p), F.col("_h"), F.col("doc_id"), F.col("size"))
            edge = F.struct(F.lit(last["none"]), F.lit(last["source"] or ""), F.lit(last["p"]), F.lit(last["_h"]).cast("long"), F.lit(last["doc_id"]).cast(dict(docs.dtypes)[doc_id]), F.lit(last["size"]).cast("long"))
            return (f < last["finish"]) | ((f == last["finish"]) & (same_time <= edge))

    copies = sum((F.when(taken(p) & (F.col("size") > 0), 1).otherwise(0) for p in range(passes)), F.lit(0)).cast("long")
    out = placed.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *keep)


def _small(df: DataFrame, most: int = 50_000) -> bool:
    return df.limit(most + 1).count() <= most


def _first_over(sums: DataFrame, key: str, budget: float, base: int) -> tuple[int, int]:
    """The first key at which the running total reaches the budget, and the total before it."""
    run = sums.withColumn("run", F.sum("words").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(base))
    row = run.filter(F.col("run") >= F.lit(budget)).orderBy(key).limit(1).collect()
    if not row:
        row = run.orderBy(F.desc(key)).limit(1).collect()
    return row[0][key], row[0]["run"] - row[0]["words"]


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same mix for DuckDB. The whole queue is sorted at once there.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)})::INT] AS weight FROM per
), ranked AS (
  SELECT *, {PASSES}.0::DOUBLE * source_size / weight AS full_at, {SHARE}::DOUBLE * sum(source_size) OVER () AS budget FROM weighed
), levels AS (
  SELECT *, (budget - coalesce(sum({PASSES} * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level_here
  FROM ranked WINDOW w AS (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sources AS (
  SELECT *, least(max(level_here) OVER () * weight, {PASSES}.0::DOUBLE * source_size)::DOUBLE AS target FROM levels
), placed AS (
  SELECT d.*, s.source_size, s.weight, s.budget, s.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS e
  FROM d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), entries AS (
  SELECT *, (e + p * source_size)::DOUBLE / weight AS finish FROM placed, (SELECT unnest(range({PASSES})) AS p) WHERE size > 0
), run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, p, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS r FROM entries
), took AS (
  SELECT doc_id, source, size, h, count(*) AS copies FROM run WHERE r - size / 2.0 <= budget GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.copies, 0)::BIGINT * p.size AS taken, coalesce(t.copies, 0)::BIGINT AS copies
FROM placed p LEFT JOIN took t ON p.doc_id = t.doc_id AND p.source IS NOT DISTINCT FROM t.source AND p.size = t.size AND p.h = t.h
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and at what target; these columns replace any of their names."""
    added = ("size", "source_size", "target", "copies", "taken")
    rows = materialise(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mix-docs")
    taken = mix(rows.select("_doc.doc_id", "_doc.source", "_doc.text", "_row"), keep=("_row",)).filter("copies > 0").select("_row", *added)
    return rows.join(taken, "_row").select(*(f"_doc.`{c}`" for c in docs.columns if c not in added), *added)

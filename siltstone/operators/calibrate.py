"""Threshold calibration and evaluation over labelled distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: beta of the profiles: deduplication weighs precision, search weighs recall.
BETA = {"dedup": 0.5, "search": 2.0}


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp > 0, tp / (tp + fn)).otherwise(F.lit(0.0))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    p, r, b2 = precision(tp, fp), recall(tp, fn), beta * beta
    return F.when(tp > 0, (1.0 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


def calibrate(pairs: DataFrame, profile: str) -> DataFrame:
    """One row (threshold, score, tp, fp, fn, tn, precision, recall) for rows (distance, same).

    Every observed distance is a candidate threshold, and so is "match nothing" (a null
    threshold). Equal scores: the fewer predicted pairs win for dedup, the more for search. Without
    any positive pair the answer is "match nothing"; without any pair there is no row.
    """
    per = pairs.groupBy("distance").agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("n"))
    # Distinct distances are few; their table is summed by one ordered window.
    upto = Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    table = per.select("distance", F.sum("p").over(upto).alias("tp"), F.sum("n").over(upto).alias("fp"), F.sum("p").over(every).alias("P"), F.sum("n").over(every).alias("N"))
    nothing = per.agg(F.sum("p").alias("P"), F.sum("n").alias("N")).filter("P IS NOT NULL").select(F.lit(None).cast("long").alias("distance"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "P", "N")
    rows = table.withColumn("distance", F.col("distance").cast("long")).unionByName(nothing)
    fn, tn = F.col("P") - F.col("tp"), F.col("N") - F.col("fp")
    scored = rows.withColumn("score", F.when(F.col("P") > 0, f_beta(F.col("tp"), F.col("fp"), fn, BETA[profile])).otherwise(F.lit(0.0)))
    predicted = F.col("tp") + F.col("fp")
    best = scored.orderBy(F.desc("score"), F.when(F.col("P") == 0, predicted).otherwise(predicted if profile == "dedup" else -predicted)).limit(1)
    return best.select(
        F.col("distance").alias("threshold"), "score", F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"),
        fn.alias("false_negatives"), tn.alias("true_negatives"), precision(F.col("tp"), F.col("fp")).alias("precision"), recall(F.col("tp"), fn).alias("recall"),
    )


def evaluate(pairs: DataFrame, threshold: int) -> DataFrame:
    """Confusion counts, precision, recall and F1 at a threshold; null distances count as skipped."""
    hit = F.col("distance") <= threshold
    counts = pairs.agg(
        F.count_if(hit & F.col("same")).alias("tp"), F.count_if(hit & ~F.col("same")).alias("fp"),
        F.count_if(~hit & F.col("same")).alias("fn"), F.count_if(~hit & ~F.col("same")).alias("tn"), F.count_if(F.col("distance").isNull()).alias("skipped"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f_beta(tp, fp, fn, 1.0)})


def parse_pairs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(a, b, same) of lines ``a,b,label``; blank lines and # comments are skipped, a bad label fails."""
    text = F.trim(column)
    cells = F.transform(F.split(text, ","), lambda x: F.trim(x))
    label = F.lower(cells[2])
    known = F.when(label.isin("1", "true", "yes"), True).when(label.isin("0", "false", "no"), False)
    bad = F.raise_error(F.concat(F.lit("label is none of 1 0 true false yes no: "), text)).cast("boolean")
    return lines.filter((text != "") & ~text.startswith("#")).select(cells[0].alias("a"), cells[1].alias("b"), F.coalesce(known, bad).alias("same"))

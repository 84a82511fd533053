"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, jaccard_join, mixing, quality_classifier, substring_dedup
from siltstone.runtime import materialise, ship, table

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("jaccard_dedup", jaccard_join.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: A trained classifier and seeded hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The training-data pipeline over ``documents``: each stage reads what its predecessor wrote.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a frame that is written
as Parquet and reread as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import stages
from quarry.llm.shared import Scratch

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", stages.quality_rules),
    ("line dedup", stages.line_dedup),
    ("near-duplicates", stages.near_duplicates),
    ("source mix", stages.source_mix),
    ("packing", stages.packing),
]

#: MinHash signatures cannot be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
    return docs

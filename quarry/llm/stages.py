"""Stages of the pipeline. Each takes (spark, docs, sf_dir); all but ``packing`` return the columns of ``docs``.

Rows with a null id pass the stages that decide by id unless a rule on their own text rejects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import queries
from quarry.llm.dart_minhash import near_duplicates as _near
from quarry.llm.line_dedup import remove_repeated_lines
from quarry.llm.quality_rules import quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality(docs, "text", "lang", "source").where("quality_rules.kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted from the texts; a text that loses all of them goes."""
    out = remove_repeated_lines(docs, "doc_id", "text", min_lines=2, min_words=20)
    d = F.col("line_dedup")
    out = out.where((d["n_removed"] == 0) | (d["n_removed"] < d["n_lines"]))
    changed = d["n_removed"] > 0
    fresh = {"text": F.when(changed, d["kept_text"]).otherwise(F.col("text")),
             "n_chars": F.when(changed, F.length(d["kept_text"]).cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(fresh.get(c, F.col(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    kept = _near(docs, "doc_id", "text").where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: its row is repeated, or left out."""
    copies = queries.mixed(docs).groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    both = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("mixed_id")))
    return both.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return queries.packed_digest(docs)

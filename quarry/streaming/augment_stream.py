"""STR-1: the stateless corpus path (SRC-1 -> FLT-2 -> FLT-3/4 -> AU-6) as a Structured Streaming query with accounts.

Lines of JSONL files are read as text and parsed strictly by the same function as in the batch path, so a line that is
skipped, a row that lacks a key and a row that fails validation are told apart in the stream too. ``foreachBatch`` writes three
things for each micro-batch, in folders named by the batch's number: the variants of passing rows, the
lines that did not pass with their outcome and reason (the quarantine), and one row of accounts observed
while the batch was written. A batch that is run again after a failure overwrites its own folders, so
every output holds each batch once.

``trigger(availableNow=True)`` processes everything present and stops; run it on a schedule (or with a
processing-time trigger) for a live feed. Keep-best dedup (AG-1) is deliberately not streamed: a later, better row would
replace an emitted one, which needs update-mode upserts into a table rather than an append-only sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.operators import augment as AU
from quarry.operators import dedup as D
from quarry.sources import jsonl as J

AUG_SCHEMA = Ty.StructType([
    Ty.StructField("example_id", Ty.LongType()),
    Ty.StructField("question", Ty.StringType()),
    Ty.StructField("sql", Ty.StringType()),
    Ty.StructField("db_id", Ty.StringType()),
    Ty.StructField("schema", Ty.StructType([
        Ty.StructField("table_names", Ty.ArrayType(Ty.StringType())),
        Ty.StructField("columns", Ty.ArrayType(Ty.StringType())),
    ])),
])
# Outcomes of a line, in the order in which they are decided.
SKIPPED, ABSENT, REJECTED, PASSED = "skipped", "absent", "rejected", "passed"
ACCOUNTS = [SKIPPED, ABSENT, REJECTED, PASSED]


def outcomes(lines: DataFrame) -> DataFrame:
    """Shared by batch and stream, over text lines (``value``): the parsed fields, ``outcome``, ``reason`` and the ``line``."""
    rows = J.parse_json_lines(lines.withColumn("line", F.col("value")), AUG_SCHEMA, keep_skipped=True)
    c = D.classify(rows)
    invalid = F.col("status") == D.INVALID
    outcome = F.when(F.col("skipped"), SKIPPED).when(F.col("missing_field"), ABSENT).when(invalid, REJECTED).otherwise(PASSED)
    reason = F.when(outcome == REJECTED, F.col("reject_reason"))
    return c.select(*AUG_SCHEMA.names, outcome.alias("outcome"), reason.alias("reason"), "line")


def counts() -> list:
    """Aggregates of the accounts: lines, and how many had each outcome."""
    return [F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ACCOUNTS]]


def passing(rows: DataFrame, n_variations: int = 3) -> DataFrame:
    """Variants of the rows that passed (AU-6)."""
    return AU.variations(rows.filter(F.col("outcome") == PASSED).select(*AUG_SCHEMA.names), n_variations)


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("outcome") != PASSED).select("outcome", "reason", "line")


def _batch_path(sink_dir: str, kind: str, batch: int) -> str:
    return f"{sink_dir.rstrip('/')}/{kind}/batch={batch}"


def write_batch(sink_dir: str, n_variations: int = 3):
    """Function for ``foreachBatch``: parsed once into the batch's own folder, from which the outputs are written."""

    def write(batch_df: DataFrame, batch: int) -> None:
        spark, seen = batch_df.sparkSession, Observation(f"batch_{batch}")
        staged = _batch_path(sink_dir, "rows", batch)
        outcomes(batch_df).observe(seen, *counts()).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        passing(rows, n_variations).write.mode("overwrite").parquet(_batch_path(sink_dir, "variants", batch))
        quarantined(rows).write.mode("overwrite").parquet(_batch_path(sink_dir, "quarantine", batch))
        account = spark.createDataFrame([tuple(int(seen.get[c]) for c in ["lines", *ACCOUNTS])],
                                        ", ".join(f"{c} long" for c in ["lines", *ACCOUNTS]))
        account.coalesce(1).write.mode("overwrite").parquet(_batch_path(sink_dir, "accounts", batch))

    return write


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
          n_variations: int = 3, available_now: bool = True, max_files: int | None = None):
    """Start the streaming query; returns the ``StreamingQuery``. ``max_files`` bounds the files of a micro-batch."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    w = reader.load(source_dir).select("value").writeStream.foreachBatch(write_batch(sink_dir, n_variations)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_sink(spark: SparkSession, sink_dir: str, kind: str) -> DataFrame:
    """``variants``, ``quarantine`` or ``accounts`` of all batches, with the batch's number."""
    return spark.read.option("basePath", f"{sink_dir.rstrip('/')}/{kind}").parquet(f"{sink_dir.rstrip('/')}/{kind}/batch=*")


def totals(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The accounts of all batches in one row."""
    return read_sink(spark, sink_dir, "accounts").agg(*[F.sum(c).alias(c) for c in ["lines", *ACCOUNTS]])


def run_available(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                  n_variations: int = 3, max_files: int | None = None) -> DataFrame:
    """Process every file present, wait for completion, and return the variants in the sink."""
    q = start(spark, source_dir, sink_dir, checkpoint, n_variations, available_now=True, max_files=max_files)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_sink(spark, sink_dir, "variants").drop("batch")

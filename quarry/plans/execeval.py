"""Execution-based evaluation (EX-1, EX-2, EX-3).

EX-1 runs each *distinct* SQL text once as an ordinary distributed Spark query over registered views.
The driver only coordinates: it pulls the distinct texts (one per evaluated query — the set being
evaluated, not data rows) in batches, starts a bounded number of concurrent jobs, and records each
outcome. Every result is written to its own folder under the shared checkpoint directory (forcing
execution: a query is valid only once it ran), so the comparison afterwards is one Spark plan over all
results (ST-2), with no result ever collected.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.functions import text as T
from quarry.operators import compare as CMP
from quarry.sources.jsonl import scratch_path

STATUS_SCHEMA = Ty.StructType([
    Ty.StructField("qid", Ty.StringType()),
    Ty.StructField("ok", Ty.BooleanType()),
    Ty.StructField("error_condition", Ty.StringType()),
    Ty.StructField("error", Ty.StringType()),
])
ROWS_SCHEMA = Ty.StructType([Ty.StructField("row_values", Ty.ArrayType(Ty.StringType())),
                             Ty.StructField("qid", Ty.StringType())])

_COND = re.compile(r"\[([A-Z][A-Z0-9_]+(?:\.[A-Z0-9_]+)*)\]")


def query_id(sql) -> F.Column:
    return F.md5(F.coalesce(sql if not isinstance(sql, str) else F.col(sql), F.lit("")))


def register_views(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _condition(e: Exception) -> tuple[str, str]:
    cond = None
    get = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    if get is not None:
        try:
            cond = get()
        except Exception:  # noqa: BLE001
            cond = None
    msg = str(e)
    if not cond:
        m = _COND.search(msg)
        cond = m.group(1) if m else "UNKNOWN"
    return cond, msg.strip().splitlines()[0][:500] if msg.strip() else cond


def _analyze(spark: SparkSession, qid: str, sql: str):
    """Parse and analyze on the driver (no job). Returns (result DataFrame or None, status or None)."""
    try:
        df = spark.sql(sql)
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        vals = df.select(F.lit(qid).alias("qid"),
                         F.array(*[F.col(c).cast("string") for c in df.columns]).alias("row_values"))
        return vals, None
    except Exception as e:  # noqa: BLE001 — an error on one query is an outcome, not a failure of the run
        cond, msg = _condition(e)
        return None, (qid, False, cond, msg)


class QueryTimeout(Exception):
    pass


def _write(spark: SparkSession, frames: list[DataFrame], out: str, timeout_s: float | None = None,
           keep_rows: bool = True) -> None:
    """Write the union of ``frames``; with ``timeout_s`` the job runs in its own job group and is
    cancelled when the time is up (``QueryTimeout``)."""
    import threading
    import uuid
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    def run():
        if keep_rows:
            u.write.mode("overwrite").partitionBy("qid").parquet(out)
        else:  # executed for validity only: every row is produced, none is stored
            u.write.format("noop").mode("overwrite").save()

    if timeout_s is None:
        run()
        return
    sc = spark.sparkContext
    group = f"quarry-exec-{uuid.uuid4().hex[:12]}"
    fired = threading.Event()

    def cancel():
        fired.set()
        sc.cancelJobGroup(group)

    sc.setJobGroup(group, "quarry query execution", interruptOnCancel=True)
    timer = threading.Timer(timeout_s, cancel)
    timer.start()
    try:
        run()
    except Exception as e:  # noqa: BLE001
        if fired.is_set():
            raise QueryTimeout(f"[QUERY_TIMEOUT] no result within {timeout_s} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def _run_batch(spark: SparkSession, batch: list[tuple[str, DataFrame]], out: str,
               timeout_s: float | None = None, keep_rows: bool = True) -> list[tuple]:
    """Execute analyzed queries as one union job; if it fails (or times out), isolate per query.

    Every job commits into its own folder (``out`` is unique per batch and per retry), so concurrent
    jobs never share a commit directory.
    """
    try:
        _write(spark, [df for _, df in batch], f"{out}/try=all",
               None if timeout_s is None else timeout_s * len(batch), keep_rows)
        return [(qid, True, None, None) for qid, _ in batch]
    except Exception:  # noqa: BLE001
        pass
    status = []
    for i, (qid, df) in enumerate(batch):
        try:
            _write(spark, [df], f"{out}/try={i}", timeout_s, keep_rows)
            status.append((qid, True, None, None))
        except QueryTimeout as e:
            status.append((qid, False, "QUERY_TIMEOUT", str(e)))
        except Exception as e:  # noqa: BLE001
            cond, msg = _condition(e)
            status.append((qid, False, cond, msg))
    return status


def run_texts(spark: SparkSession, texts: list[tuple[str, str, str]], parallelism: int = 4,
              batch: int = 64, timeout_s: float | None = None,
              keep_rows: bool = True, out: str | None = None) -> tuple[list[tuple], DataFrame]:
    """Run ``(qid, sql, statement_type)`` texts (distinct) once each; returns (status list, rows).

    Only SELECT statements are run (T14); anything else is refused with condition ``NOT_A_SELECT``.
    Texts are parsed and analyzed on the driver; the analyzable ones run as union jobs of at most
    ``batch`` queries, each job writing ``qid``-partitioned results into its own folder under the shared
    directory (a batch that fails at run time is re-run query by query to pin the failure);
    ``parallelism`` jobs run concurrently. With ``timeout_s`` a query that has not finished in time is
    cancelled and reported with condition ``QUERY_TIMEOUT`` (the reference had no limit). With
    ``keep_rows=False`` the queries run for validity only (all rows produced, none stored).
    """
    out = out or scratch_path(spark, "results")
    status: list[tuple] = []
    ready: list[tuple[str, DataFrame]] = []
    to_analyze = []
    for qid, sql, stype in texts:
        if stype != "SELECT":
            status.append((qid, False, "NOT_A_SELECT", f"Refused statement type: {stype}"))
        else:
            to_analyze.append((qid, sql))
    # Parsing and analysis are driver work per text; run them concurrently as well.
    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        for (qid, _), (vals, err) in zip(to_analyze, pool.map(lambda qs: _analyze(spark, *qs), to_analyze)):
            if err is not None:
                status.append(err)
            else:
                ready.append((qid, vals))
    # Enough batches to keep ``parallelism`` jobs busy, none larger than ``batch`` queries.
    size = max(1, min(batch, -(-len(ready) // max(parallelism, 1))))
    batches = [ready[i:i + size] for i in range(0, len(ready), size)]
    if batches:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for st in pool.map(lambda ib: _run_batch(spark, ib[1], f"{out}/batch={ib[0]}", timeout_s, keep_rows),
                               enumerate(batches)):
                status.extend(st)
    if keep_rows and any(s[1] for s in status):
        rows = spark.read.parquet(out).select("qid", "row_values")
    else:
        rows = spark.createDataFrame([], ROWS_SCHEMA).select("qid", "row_values")
    return status, rows


CHUNK_TEXTS = 512


def run_stream(spark: SparkSession, texts: DataFrame, parallelism: int = 4, timeout_s: float | None = None,
               keep_rows: bool = True, chunk: int = CHUNK_TEXTS) -> tuple[DataFrame, DataFrame]:
    """Run distinct texts given as a DataFrame ``(sql, _qid_sql, _st_sql[, _keep])`` in chunks.

    The driver holds one chunk of texts at a time; each chunk's outcomes are appended to a status table
    in the shared folder, and results go to per-chunk folders there. A ``_keep`` column chooses per text
    whether its rows are stored (else it runs for validity only). Returns (status, rows) read back.
    """
    base = scratch_path(spark, "exec")
    status_path, rows_path = f"{base}/status", f"{base}/rows"
    state = {"rows": False, "status": False}
    has_keep = "_keep" in texts.columns
    buf: list[tuple[tuple[str, str, str], bool]] = []

    def flush(i: int):
        if not buf:
            return
        st: list[tuple] = []
        for flag in (True, False):
            part = [t for t, k in buf if k == flag]
            if part:
                got, _ = run_texts(spark, part, parallelism, timeout_s=timeout_s, keep_rows=flag,
                                   out=f"{rows_path}/chunk={i}-{int(flag)}")
                st += got
                state["rows"] = state["rows"] or (flag and any(x[1] for x in got))
        spark.createDataFrame(st, STATUS_SCHEMA).write.mode("append").parquet(status_path)
        state["status"] = True
        buf.clear()

    n = 0
    for r in texts.toLocalIterator():
        if r["sql"] is None:
            continue
        keep = bool(r["_keep"]) if has_keep else keep_rows
        buf.append(((r["_qid_sql"], r["sql"], r["_st_sql"]), keep))
        if len(buf) >= chunk:
            flush(n)
            n += 1
    flush(n)
    status = spark.read.schema(STATUS_SCHEMA).parquet(status_path) if state["status"] \
        else spark.createDataFrame([], STATUS_SCHEMA)
    rows = spark.read.parquet(rows_path).select("qid", "row_values") if state["rows"] \
        else spark.createDataFrame([], ROWS_SCHEMA).select("qid", "row_values")
    return status, rows


def _typed(d: DataFrame, col: str) -> DataFrame:
    return d.withColumn("_qid_" + col, query_id(col)).withColumn("_st_" + col, T.statement_type(F.col(col)))


def run_queries(spark: SparkSession, texts: DataFrame, sql: str = "sql", parallelism: int = 4,
                batch: int = 64, timeout_s: float | None = None) -> tuple[DataFrame, DataFrame]:
    """EX-1: run every distinct SQL text once. Returns (status, rows):
    status ``(qid, ok, error_condition, error)`` and rows ``(qid, row_values array<string>)``.

    Distinct texts — each one query to plan, the driver's unit of work — stream to the driver in
    chunks; nothing else does. No filter precedes the distinct (a pushed-down predicate would inline
    the text expression into the scan); null texts are skipped on arrival.
    """
    d = _typed(texts.select(F.col(sql).alias("sql")).distinct(), "sql")
    return run_stream(spark, d, parallelism, timeout_s)


def evaluate(spark: SparkSession, predictions: DataFrame, key: str = "example_id",
             generated: str = "generated_sql", gold: str = "gold_sql", mode: str = "reference",
             parallelism: int = 4, timeout_s: float | None = None) -> DataFrame:
    """EX-3: run → compare → tag per example. Output: key, generated_sql, gold_sql, is_valid, gold_valid,
    results_match, feedback, error, error_class, complexity.

    Gold texts run first (rows kept); a generated text keeps its rows only when some pair with it has a
    gold that ran, otherwise it runs for validity alone. Texts stream through the driver in chunks; the
    pair bookkeeping (which texts need rows, per-pair outcomes) is done with joins, and the results of
    all pairs are compared in one plan.
    """
    p = predictions.select(key, F.col(generated).alias("generated_sql"), F.col(gold).alias("gold_sql")) \
        .withColumn("gen_qid", query_id("generated_sql")).withColumn("gold_qid", query_id("gold_sql"))
    # Lineage cut: the predictions (extraction included) are written once to the shared folder and every
    # step below reads that table instead of recomputing it.
    p_path = scratch_path(spark, "predictions")
    p.write.mode("overwrite").parquet(p_path)
    p = spark.read.parquet(p_path)
    gold_texts = _typed(p.select(F.col("gold_sql").alias("sql")).distinct(), "sql")
    gold_status, gold_rows = run_stream(spark, gold_texts, parallelism, timeout_s)
    g_ok = gold_status.select(F.col("qid").alias("gold_qid"), F.col("ok").alias("g_ok"))
    need = p.filter(F.col("gold_sql").isNotNull()).select("gen_qid", "gold_qid").distinct() \
        .join(g_ok, "gold_qid").groupBy("gen_qid").agg(F.max("g_ok").alias("need"))
    gen = _typed(p.select(F.col("generated_sql").alias("sql")).distinct(), "sql") \
        .join(gold_status.select(F.col("qid").alias("_qid_sql")), "_qid_sql", "left_anti") \
        .join(need.withColumnRenamed("gen_qid", "_qid_sql"), "_qid_sql", "left")
    gen = gen.withColumn("_keep", F.coalesce(F.col("need"), F.lit(False)))
    st_gen, gen_rows = run_stream(spark, gen, parallelism, timeout_s)
    status = gold_status.unionByName(st_gen)
    rows = gold_rows.unionByName(gen_rows)
    s_gen = status.select(F.col("qid").alias("gen_qid"), F.col("ok").alias("gen_ok"),
                          F.col("error_condition").alias("gen_condition"), F.col("error").alias("gen_error"))
    s_gold = status.select(F.col("qid").alias("gold_qid"), F.col("ok").alias("gold_ok"))
    pairs = p.select("gen_qid", "gold_qid").distinct() \
        .join(s_gen, "gen_qid", "left").join(s_gold, "gold_qid", "left") \
        .withColumn("pair_id", F.concat_ws("|", "gen_qid", "gold_qid"))
    ok = pairs.filter(F.col("gen_ok") & F.col("gold_ok")).select("pair_id", "gen_qid", "gold_qid")
    long = rows.join(ok.select("pair_id", F.col("gen_qid").alias("qid")), "qid") \
        .select("pair_id", F.lit(CMP.GEN).alias("side"), "row_values") \
        .unionByName(rows.join(ok.select("pair_id", F.col("gold_qid").alias("qid")), "qid")
                     .select("pair_id", F.lit(CMP.GOLD).alias("side"), "row_values"))
    cmp = CMP.compare_results(long, ok.select("pair_id"), mode=mode).select("pair_id", "results_match", "feedback")
    info = pairs.join(cmp, "pair_id", "left")
    out = p.join(info, ["gen_qid", "gold_qid"], "left")
    both = F.coalesce(F.col("gen_ok"), F.lit(False)) & F.coalesce(F.col("gold_ok"), F.lit(False))
    return out.select(
        key, "generated_sql", "gold_sql",
        F.coalesce(F.col("gen_ok"), F.lit(False)).alias("is_valid"),
        F.coalesce(F.col("gold_ok"), F.lit(False)).alias("gold_valid"),
        (both & F.coalesce(F.col("results_match"), F.lit(False))).alias("results_match"),
        F.when(both, F.col("feedback")).otherwise(F.lit(CMP.MSG_FAILED)).alias("feedback"),
        F.col("gen_error").alias("error"),
        F.when(~F.coalesce(F.col("gen_ok"), F.lit(False)), T.spark_error_class(F.col("gen_condition")))
         .alias("error_class"),
        T.complexity_tags(F.col("gold_sql")).alias("complexity"))

"""Evaluation analytics: metrics (AG-4/5/6/15, JN-7), attempts (AG-7, AG-14), running windows (WN-1..4).

Running totals and positions are prefix sums by rank, whatever the order key's values: rows lie in written, sorted ranges;
a block is a fixed number of consecutive rows of a range. Rows are summed inside their block, blocks inside
their range, ranges inside their method, so no window holds a whole method or the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Rows of a block of a prefix sum.
DEFAULT_BLOCK = 1 << 14
MAX_ATTEMPTS = 3


def _pct(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num * 100.0, den), F.lit(0.0))


def _exact_sum(c: Column) -> Column:
    """Sum of a double column through decimal (exact, so independent of partitioning), as double."""
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def metric_columns(valid="is_valid", match="results_match", time="inference_time",
                   attempts: str | None = "num_attempts", exact: str | None = None) -> list[Column]:
    """AG-4 aggregate expressions (T7): missing flags count as false, missing time as 0.0 but still in
    the denominator, missing attempts as 1; percentages 0-100; empty input gives zeros."""
    n = F.count(F.lit(1))
    v = F.count_if(F.coalesce(F.col(valid), F.lit(False)))
    m = F.count_if(F.coalesce(F.col(match), F.lit(False)))
    cols = [
        v.alias("valid_sql_count"), _pct(v, n).alias("valid_sql_pct"),
        m.alias("result_match_count"), _pct(m, n).alias("result_match_pct"),
        F.coalesce(F.try_divide(_exact_sum(F.coalesce(F.col(time), F.lit(0.0))), n), F.lit(0.0))
         .alias("avg_inference_time"),
        n.alias("total_examples"),
    ]
    if attempts:
        cols.append(F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(attempts), F.lit(1))).cast("double"), n),
                               F.lit(0.0)).alias("avg_attempts"))
    if exact:
        e = F.count_if(F.coalesce(F.col(exact), F.lit(False)))
        cols += [e.alias("exact_match_count"), _pct(e, n).alias("exact_match_pct")]
    return cols


def metrics(results: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    """AG-4: evaluation metrics per group (default: per method)."""
    by = ["method"] if by is None else by
    return results.groupBy(*by).agg(*metric_columns(**kw))


def metrics_by_complexity(results: DataFrame, tags: str = "complexity", by: str = "method", exact: str | None = None) -> DataFrame:
    """AG-5: per (method x complexity tag), with exact matches if their column is named; tags overlap, so totals must
    come from ``metrics``, not here."""
    e = results.select(by, F.explode(tags).alias("complexity_tag"), "is_valid", "results_match", *([exact] if exact else []))
    n = F.count(F.lit(1))
    v = F.count_if(F.coalesce(F.col("is_valid"), F.lit(False)))
    m = F.count_if(F.coalesce(F.col("results_match"), F.lit(False)))
    cols = [n.alias("total"), v.alias("valid"), m.alias("matched"), _pct(v, n).alias("valid_pct"), _pct(m, n).alias("match_pct")]
    if exact:
        x = F.count_if(F.coalesce(F.col(exact), F.lit(False)))
        cols += [x.alias("exact"), _pct(x, n).alias("exact_pct")]
    return e.groupBy(by, "complexity_tag").agg(*cols)


def error_taxonomy(results: DataFrame, error: str = "error", by: str = "method") -> DataFrame:
    """AG-6: error-class counts per method and their % of *all* evaluated rows of that method."""
    classified = results.withColumn("error_class", F.when(F.col(error).isNotNull(), T.error_class(F.col(error))))
    counts = classified.groupBy(by).agg(
        F.count(F.lit(1)).alias("evaluated"),
        *[F.count_if(F.col("error_class") == c).alias(c) for c in
          ("table_name_error", "column_name_error", "syntax_error", "other_error")])
    stack = "stack(4, 'table_name_error', table_name_error, 'column_name_error', column_name_error, " \
            "'syntax_error', syntax_error, 'other_error', other_error) as (error_class, count)"
    long = counts.selectExpr(by, "evaluated", stack)
    return long.withColumn("pct", _pct(F.col("count"), F.col("evaluated"))) \
               .orderBy(F.desc("count"), "error_class")


def final_attempt(attempts: DataFrame, key: str = "example_id") -> DataFrame:
    """AG-7 (T6): per example the "yes" attempt if any, else the first valid one, else the last one;
    plus ``num_attempts``. One partial + final aggregate with ``min_by``."""
    yes = F.coalesce(F.col("is_valid"), F.lit(False)) & T.judge_says_yes(F.col("llm_validation"))
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    cls = F.when(yes, 0).when(valid, 1).otherwise(2)
    order = F.struct(cls.alias("c"), F.when(cls == 2, -F.col("attempt_number")).otherwise(F.col("attempt_number")))
    payload = F.struct("attempt_number", "sql", "is_valid", "execution_error", "llm_validation")
    g = attempts.groupBy(key).agg(F.min_by(payload, order).alias("final"),
                                  F.count(F.lit(1)).alias("num_attempts"))
    return g.select(key, F.col("final.attempt_number").alias("final_attempt"), F.col("final.sql").alias("sql"),
                    F.col("final.is_valid").alias("is_valid"), F.col("final.llm_validation").alias("llm_validation"),
                    "num_attempts")


# --- fixed values: the sentences of the feedback blocks below must equal the reference's ---------------

def attempt_feedback(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """The feedback block an attempt adds to the next prompt (empty SQL / execution error / judge feedback)."""
    n = F.col("attempt_number").cast("string")
    head = F.concat(F.lit("\n\n-- Previous attempt "), n, F.lit(":"))
    sql = F.col("sql")
    empty = sql.isNull() | (T.py_strip(sql) == "")
    yes = T.judge_says_yes(F.col("llm_validation"))
    return (F.when(empty, F.concat(head, F.lit("\n-- Error: Generated empty SQL"
                                               "\n-- Please generate a valid SQL query:\n-- SQL:\n")))
            .when(~F.coalesce(F.col("is_valid"), F.lit(False)),
                  F.concat(head, F.lit("\n-- SQL: "), sql, F.lit("\n-- Execution error: "),
                           F.coalesce(F.col("execution_error"), F.lit("None")),
                           F.lit("\n-- Fix the error and try again:\n")))
            .when(yes | (F.col("attempt_number") >= max_attempts), F.lit(""))
            .otherwise(F.concat(head, F.lit("\n-- SQL: "), sql, F.lit("\n-- LLM Feedback: "),
                                F.substring(F.coalesce(F.col("llm_validation"), F.lit("")), 1, 200),
                                F.lit("...\n\n-- Generate improved SQL:\n-- SQL:"))))


def attempt_history(attempts: DataFrame, key: str = "example_id") -> DataFrame:
    """AG-14: ordered concatenation of the feedback blocks per example (at most MAX_ATTEMPTS per group)."""
    a = attempts.withColumn("_block", attempt_feedback(attempts))
    g = a.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("attempt_number", "_block"))).alias("_b"))
    return g.select(key, F.array_join(F.transform("_b", lambda x: x["_block"]), "").alias("history"))


def best_candidate(scored: DataFrame, candidate: str = "candidate", match: str = "results_match",
                   metric: Column | None = None) -> DataFrame:
    """AG-15: mean match per candidate, and the best (highest mean; ties to the smallest candidate id).

    ``metric`` is a user's own score of a row, any numeric or boolean column expression (a null scores 0).
    """
    value = F.col(match) if metric is None else metric
    s = scored.groupBy(candidate).agg(
        F.avg(F.coalesce(value.cast("double"), F.lit(0.0))).alias("mean_score"),
        F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("mean_score"), F.asc(candidate))
    return s.withColumn("is_best", F.row_number().over(w) == 1)


def before_after(metrics_df: DataFrame, baseline: str, by: str = "method",
                 value: str = "result_match_pct") -> DataFrame:
    """JN-7: each method's value minus the baseline method's value. The metrics table has one row per
    method, so the baseline is taken with a window over that small table (no join needed)."""
    base = F.max(F.when(F.col(by) == baseline, F.col(value))).over(Window.partitionBy())
    return metrics_df.select(by, value, base.alias("baseline_value")) \
        .withColumn("delta", F.col(value) - F.col("baseline_value"))


# --- windows ------------------------------------------------------------------------------------------

def running_stats(df: DataFrame, order: str, part: list[str] | None = None, flags: list[str] | None = None,
                  block: int = DEFAULT_BLOCK, out: str = "pos") -> DataFrame:
    """WN-3 + running counts in one pass: 0-based position of each row in ``order`` (any sortable, unique key) within
    ``part`` and ``cum_<flag>`` = true values of each flag up to and including the row.

    Rows are range-partitioned by (part, order) and written as they lie, since the ranges come from a sample. A block is
    ``block`` consecutive places of a range, whatever the keys' values and gaps. Windows give each row's
    running values inside its block; the totals of the blocks are summed inside their range, those of the ranges
    inside their part (a table of one row for each range and part), and both join back as the block's offset. No window
    over rows spans more than one block, and no window over totals more than the blocks of a range or the ranges of a part.
    """
    from quarry.sources.jsonl import scratch_path
    part, flags = part or [], flags or []
    keys = [F.col(c).asc_nulls_first() for c in [*part, order]]
    ints = [F.coalesce(F.col(f), F.lit(False)).cast("long").alias("_f_" + f) for f in flags]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", *ints, F.monotonically_increasing_id().alias("_at"))
    path = scratch_path(df.sparkSession, "ranges")
    laid.write.parquet(path)
    d = df.sparkSession.read.schema(laid.schema).parquet(path)
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    d = d.withColumn("_range", F.shiftright("_at", 33)).withColumn("_blk", F.floor(place / block))
    totals = [F.count(F.lit(1)).alias("_n"), *[F.sum("_f_" + f).alias("_n_" + f) for f in flags]]
    sums = ["_n", *["_n_" + f for f in flags]]
    blocks = d.groupBy(*part, "_range", "_blk").agg(*totals)
    ranges = blocks.groupBy(*part, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    in_range = Window.partitionBy(*part, "_range").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def before(t: DataFrame, own: list[str], w, name: str) -> DataFrame:
        return t.select(*[F.col(k).alias(f"{name}{k}") for k in own],
                        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name + c) for c in sums])

    # null-safe keys: rows with a null part keep their own positions
    def met(left: DataFrame, right: DataFrame, own: list[str], name: str) -> DataFrame:
        cond = [left[k].eqNullSafe(right[f"{name}{k}"]) for k in own]
        return left.join(right, cond).drop(*[f"{name}{k}" for k in own])

    blk, rng = [*part, "_range", "_blk"], [*part, "_range"]
    offsets = met(before(blocks, blk, in_range, "b").withColumnsRenamed({"b" + k: k for k in blk}), before(ranges, rng, in_part, "r"), rng, "r")
    offsets = offsets.select(*[F.col(k).alias("o" + k) for k in blk], *[(F.col("b" + c) + F.col("r" + c)).alias("o" + c) for c in sums])
    w_in = Window.partitionBy(*blk).orderBy("_at")
    w_run = w_in.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_rn", F.row_number().over(w_in)).withColumns({"_r_" + f: F.sum("_f_" + f).over(w_run) for f in flags})
    j = met(d, offsets, blk, "o")
    return j.select(*df.columns, (F.col("o_n") + F.col("_rn") - 1).cast("long").alias(out),
                    *[(F.col("o_n_" + f) + F.col("_r_" + f)).alias("cum_" + f) for f in flags])


def positions(df: DataFrame, order: str, part: list[str] | None = None, block: int = DEFAULT_BLOCK,
              out: str = "pos") -> DataFrame:
    """WN-3: 0-based position of each row in ``order`` within ``part`` (see ``running_stats``)."""
    return running_stats(df, order, part, None, block, out)


def running_metrics(results: DataFrame, every: int = 10, by: str = "method", order: str = "example_id",
                    exact: str | None = None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """WN-1: running valid / match (/ exact) % after each example per method, emitted every ``every``-th."""
    flags = ["is_valid", "results_match"] + ([exact] if exact else [])
    r = running_stats(results.select(by, order, *flags), order, [by], flags, block)
    seen = F.col("pos") + 1
    r = r.filter(F.col("pos") % every == every - 1)
    cols = [by, "pos", seen.alias("seen"),
            (F.col("cum_is_valid") * 100.0 / seen).alias("valid_pct"),
            (F.col("cum_results_match") * 100.0 / seen).alias("match_pct")]
    if exact:
        cols.append((F.col("cum_" + exact) * 100.0 / seen).alias("exact_pct"))
    return r.select(*cols)


def accept_revert(log: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "score",
                  prompt: str = "prompt", initial_prompt: str = "initial") -> DataFrame:
    """WN-2: an epoch is accepted iff its score >= the best score so far (start 0.0); the current prompt is
    the last accepted one (else the initial prompt). Windows are per run, ordered by epoch."""
    w_prev = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    w_cur = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    prev = F.coalesce(F.max(score).over(w_prev), F.lit(0.0))
    d = log.withColumn("best_before", prev).withColumn("accepted", F.col(score) >= F.col("best_before"))
    cur = F.last(F.when(F.col("accepted"), F.col(prompt)), ignorenulls=True).over(w_cur)
    return d.withColumn("current_prompt", F.coalesce(cur, F.lit(initial_prompt)))


def global_positions(df: DataFrame, order: str, num_partitions: int | None = None,
                     out: str = "pos") -> DataFrame:
    """WN-3 for one global order over any sortable, unique key: range-partitioned sort + per-partition
    offsets (no single-partition window, no assumption about the key's distribution).

    ``repartitionByRange`` samples the key to cut balanced ranges (one shuffle); inside each sorted
    range a row's index is its position in the partition. The range bounds depend on the sample, so the ranges
    are written to the shared folder once, and counts and rows both read that table. The per-partition
    counts — one row per partition — get running offsets and are broadcast back.
    """
    from quarry.sources.jsonl import scratch_path
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    n = num_partitions or (int(conf) if str(conf).isdigit() else 200)
    d = df.repartitionByRange(n, order).sortWithinPartitions(order) \
        .withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_li", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = scratch_path(df.sparkSession, "positions")
    d.write.parquet(path)
    d = df.sparkSession.read.schema(d.schema).parquet(path)
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return d.join(F.broadcast(offsets), "_pid") \
        .withColumn(out, (F.col("_off") + F.col("_li")).cast("long")).drop("_pid", "_li", "_off")


def mini_batches(df: DataFrame, batch_size: int, order: str = "example_id") -> DataFrame:
    """WN-4: batch number of consecutive rows (global order); the last batch may be short."""
    p = global_positions(df, order)
    return p.withColumn("batch", F.floor(F.col("pos") / batch_size))

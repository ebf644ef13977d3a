"""Validation, keep-best deduplication and the per-source ledger (FLT-2/3/4, AG-1, AG-2, AG-3, AG-8).

Plan shape: narrow validation projection -> one hash shuffle on ``q_hash`` with partial (map-side)
aggregation of fixed-width values for the winners -> a join on the winners' arrivals that fetches only the columns
that are wanted (late materialisation: no text in the aggregation). The ledger comes from a pre-aggregated candidate
table joined back to the winners on the same key. A hot question key is absorbed by the partial aggregation; the ledger's join back is
from pre-aggregated groups (one row per key x source x SQL text) and AQE's skew join splits what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarry.functions import text as T

INVALID = "invalid"
MISSING = "Missing required field"
EMPTY = "empty"
CANDIDATE = "candidate"


def classify(df: DataFrame, question: str = "question", sql: str = "sql",
             word_boundary: bool = False, check_dialect: bool = True) -> DataFrame:
    """FLT-2/3/4: add ``reject_reason`` and ``status`` (invalid / empty / candidate).

    A row lacking the question or SQL field (column ``missing_field`` true, or a null SQL) is invalid.
    A present but null/empty question or empty SQL is "empty" and later counted as a duplicate, as the
    reference does. Dialect and statement-type reasons follow T2.
    """
    missing = F.col(sql).isNull()
    if "missing_field" in df.columns:
        missing = missing | F.coalesce(F.col("missing_field"), F.lit(False))
    df = T.with_statement_type(df, sql, "_stype")
    df = df.withColumn("_dialect", T.dialect_reason(F.col(sql), word_boundary) if check_dialect
                       else F.lit(None).cast("string"))
    type_reason = F.when(F.col("_stype").isin(*T.VALID_STATEMENT_TYPES), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("Invalid statement type: "), F.col("_stype")))
    reason = F.when(missing, F.lit(MISSING)).otherwise(F.coalesce(F.col("_dialect"), type_reason))
    empty = F.col(question).isNull() | (F.col(question) == "") | (F.col(sql) == "")
    df = df.withColumn("reject_reason", reason)
    status = F.when(F.col("reject_reason").isNotNull(), F.lit(INVALID)) \
        .when(empty, F.lit(EMPTY)).otherwise(F.lit(CANDIDATE))
    return df.withColumn("status", status).drop("_stype", "_dialect")


def with_keys(df: DataFrame, question: str = "question", sql: str = "sql") -> DataFrame:
    """SC-2/SC-3 keys: question fingerprint and normalized SQL."""
    return df.withColumn("q_hash", T.question_hash(F.col(question))) \
             .withColumn("sql_norm", T.normalize_sql(F.col(sql)))


# Parts of a packed decimal(38,0): priority (from the top, so that less is better), length, arrival moved to be positive.
_ARRIVAL, _LENGTH, _TOP = 10 ** 20, 10 ** 30, 10 ** 6
_OFFSET = 1 << 63


def _dec(v: int) -> Column:
    return F.lit(str(v)).cast("decimal(38,0)")


def _packed(length: Column, arrival: Column) -> Column:
    return length.cast("decimal(38,0)") * _dec(_ARRIVAL) + arrival.cast("decimal(38,0)") + _dec(_OFFSET)


def _arrival_of(packed: Column, arrival_type) -> Column:
    return (packed % _dec(_ARRIVAL) - _dec(_OFFSET)).cast(arrival_type)


def _min_len_arrival(length: Column, arrival: Column, arrival_type) -> Column:
    """min over rows of (length, arrival) as ``struct<len, arr>``.

    For an integral arrival both parts are packed into one decimal(38,0) (length * 10^20 +
    arrival + 2^63), whose min is a fixed-width buffer: Spark then plans a hash aggregate instead of
    the sort aggregate a struct buffer needs. Other arrival types use ``min(struct)``.
    """
    if not isinstance(arrival_type, IntegralType):
        return F.min(F.struct(length.alias("len"), arrival.alias("arr")))
    packed = F.min(_packed(length, arrival)).cast("decimal(38,0)")
    return F.struct(F.floor(packed / _dec(_ARRIVAL)).cast("int").alias("len"), _arrival_of(packed, arrival_type).alias("arr"))


def winners(candidates: DataFrame, key: str = "q_hash", where: Column | None = None) -> DataFrame:
    """One row per key: ``first_arrival`` and the ``arrival`` of its winner (highest priority, shortest SQL, earliest arrival).

    For an integral arrival the three parts are one packed decimal (priorities within a million of 0), so the
    aggregate is a partial + final hash aggregate over fixed-width values; other arrivals take ``min(struct)``
    over the three parts. ``where`` selects the rows that compete *inside* the aggregate (other rows fold into one
    null-key group that is dropped afterwards by a test on the aggregate's result). A row filter before the
    aggregate would be pushed into the scan by the optimizer and evaluate every derived column twice.
    """
    cand = F.lit(True) if where is None else where
    kind = candidates.schema["arrival"].dataType
    if isinstance(kind, IntegralType):
        rank = (_dec(_TOP) - F.col("priority").cast("decimal(38,0)")) * _dec(_LENGTH)
        best = F.min(F.when(cand, rank + _packed(F.length("sql"), F.col("arrival"))))
    else:
        best = F.min(F.when(cand, F.struct((-F.col("priority")).alias("p"), F.length("sql").alias("len"), F.col("arrival").alias("arr"))))
    k = F.col(key) if where is None else F.when(cand, F.col(key))
    g = candidates.groupBy(k.alias(key)).agg(best.alias("best"), F.min(F.when(cand, F.col("arrival"))).alias("first_arrival"))
    if where is not None:
        g = g.filter(F.col("best").isNotNull())
    won = _arrival_of(F.col("best"), kind) if isinstance(kind, IntegralType) else F.col("best.arr")
    return g.select(key, "first_arrival", won.alias("arrival"))


def keep_best(candidates: DataFrame, key: str = "q_hash", payload: list[str | Column] | None = None,
              where: Column | None = None, rows: DataFrame | None = None) -> DataFrame:
    """AG-1: one winner per key — highest priority, then shortest SQL, then earliest arrival.

    The winners' arrivals come from ``winners``; a join on the arrival, which is unique, then fetches the
    ``payload`` (column names or expressions) of the winners from ``rows`` (default: the candidates themselves).
    Unused payload columns are pruned from that join. Also returns the key's first arrival (the reference's output order).
    """
    rows = candidates if rows is None else rows
    payload = payload if payload is not None else [c for c in rows.columns if c not in {key, "priority", "arrival", "status", "reject_reason"}]
    taken = rows.select(F.col("arrival").alias("_arrival"), *payload, "priority")
    won = winners(candidates, key, where)
    out = won.join(taken, F.col("arrival") == F.col("_arrival"))
    return out.select(key, "first_arrival", *[c for c in taken.columns if c != "_arrival"], "arrival")


def dedup(df: DataFrame, question: str = "question", sql: str = "sql", word_boundary: bool = False,
          payload: list[str | Column] | None = None) -> DataFrame:
    """Validated, keep-best deduplicated examples (classify -> keys -> winners over the candidates -> their columns)."""
    c = with_keys(classify(df, question, sql, word_boundary), question, sql)
    return best_of(c, payload, df)


def best_of(classified: DataFrame, payload: list[str | Column] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """AG-1 over rows that already have their status and keys (for example a written table of them)."""
    return keep_best(classified, payload=payload, where=F.col("status") == CANDIDATE, rows=rows)


def ledger(df: DataFrame, source: str = "source_dataset", question: str = "question", sql: str = "sql",
           word_boundary: bool = False) -> DataFrame:
    """AG-2 + AG-3: per source loaded / invalid / duplicate / conflicts / kept (+ rows_in_repeated_keys).

    duplicate = empty rows + candidate rows that were not the first arrival of their key (T4);
    conflict = candidate rows whose priority is strictly below the key's top priority and whose
    normalized SQL differs from the winner's; kept = winners from that source.

    Plan: the raw rows are scanned once into ``groups`` — one partial+final aggregate per
    (status, source, priority, key, 128-bit digest of the normalized SQL, which is only compared for
    equality; texts never enter a shuffle). Both consumers (the per-key winners and the join
    back) read every column of ``groups``, so Spark reuses that one exchange instead of rescanning.
    The join back is keyed by question hash; AQE's skew join splits a hot key's groups.
    """
    return ledger_of(with_keys(classify(df, question, sql, word_boundary), question, sql), source, sql)


def ledger_of(c: DataFrame, source: str = "source_dataset", sql: str = "sql") -> DataFrame:
    """The ledger of rows that already have their status and keys."""
    cand = F.col("status") == CANDIDATE
    groups = c.groupBy(
        "status", source, "priority",
        (F.col("reject_reason") == MISSING).alias("missing"),
        F.when(cand, F.col("q_hash")).alias("q_hash"),
        F.when(cand, F.unhex(F.md5("sql_norm"))).alias("sql_norm"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min("arrival").alias("min_arrival"),
          _min_len_arrival(F.length(sql), F.col("arrival"), c.schema["arrival"].dataType).alias("best"))
    # Non-candidates carry a null key: they form one extra (partially aggregated) group that joins nothing.
    # No filter here — a filter on a grouping column would be pushed below ``groups`` and break the reuse.
    # The join key is never null, so no not-null filter is inferred and pushed into one branch only.
    key = F.coalesce(F.col("q_hash"), F.lit(""))
    winners = groups.groupBy(key.alias("_k")).agg(
        F.min(F.struct((-F.col("priority")).alias("neg_priority"), F.col("best.len").alias("len"),
                       F.col("best.arr").alias("arr"), F.col(source).alias("src"),
                       F.col("sql_norm").alias("sql_norm"))).alias("w"),
        F.min("min_arrival").alias("first_arrival"),
        F.sum("n").alias("key_rows"))
    j = groups.withColumn("_k", key).join(winners, "_k", "left")
    is_cand = F.col("status") == CANDIDATE
    n = F.col("n")
    first = F.col("min_arrival") == F.col("first_arrival")
    wins = (F.col("w.arr") == F.col("best.arr")) & (F.col("w.len") == F.col("best.len"))
    conflict = (F.col("priority") < -F.col("w.neg_priority")) & (F.col("sql_norm") != F.col("w.sql_norm"))
    out = j.groupBy(source).agg(
        F.sum(n).alias("loaded"),
        F.sum(F.when(F.col("status") == INVALID, n).otherwise(0)).alias("invalid"),
        F.sum(F.when((F.col("status") == INVALID) & F.col("missing"), n).otherwise(0)).alias("missing_field"),
        F.sum(F.when(F.col("status") == EMPTY, n)
              .when(is_cand, n - F.when(first, 1).otherwise(0)).otherwise(0)).alias("duplicate"),
        F.sum(F.when(is_cand & conflict, n).otherwise(0)).alias("conflicts"),
        F.sum(F.when(is_cand & wins, 1).otherwise(0)).alias("kept"),
        F.sum(F.when(is_cand & (F.col("key_rows") > 1), n).otherwise(0)).alias("rows_in_repeated_keys"))
    return out.select(source, *[F.col(x).cast("long").alias(x) for x in
                                ("loaded", "invalid", "missing_field", "duplicate", "conflicts", "kept",
                                 "rows_in_repeated_keys")])


def with_ratios(ledger_df: DataFrame) -> DataFrame:
    """Retention % per source and share % of all kept rows (scalar over a tiny per-source table)."""
    from pyspark.sql import Window as W
    total = F.sum("kept").over(W.partitionBy())
    return ledger_df.withColumn("retention_pct", F.try_divide(F.col("kept") * 100.0, F.col("loaded"))) \
                    .withColumn("share_pct", F.try_divide(F.col("kept") * 100.0, total))


def totals(df: DataFrame, source: str = "source_dataset", enriched: Column | None = None) -> DataFrame:
    """AG-8: whole-run totals from the per-source ledger (single-row aggregate over a tiny table).

    invalid_sql excludes rows missing a field (the per-source ``invalid`` includes them).
    """
    led = ledger(df, source)
    t = led.agg(
        F.sum("loaded").cast("long").alias("total_loaded"),
        F.sum("invalid").cast("long").alias("invalid"),
        (F.sum("invalid") - F.sum("missing_field")).cast("long").alias("invalid_sql"),
        F.sum("duplicate").cast("long").alias("duplicates"),
        F.sum("conflicts").cast("long").alias("conflicts"),
        F.sum("kept").cast("long").alias("valid_unique"))
    t = t.withColumn("reduction_pct",
                     F.coalesce(F.try_divide(100.0 * (F.col("total_loaded") - F.col("valid_unique")),
                                             F.col("total_loaded")), F.lit(0.0)))
    return t

"""Result-set comparison (ST-2, JN-6, SC-6, SC-7).

Results are a long table ``(pair_id, side, row_values array<string>)`` with side ``gen`` or ``gold``.
All pairs are compared in one plan: rows are normalized, grouped by ``(pair_id, row_key)`` (spreads a
pair with a huge result over many tasks), then grouped by ``pair_id`` from at most one row per distinct
row per pair — both aggregations are partial + final, so no pair is ever collected into one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

GEN, GOLD = "gen", "gold"

# --- fixed values: feedback texts ---------------------------------------------------------------
MSG_FAILED = "Cannot compare - one or both queries failed to execute"
MSG_MATCH = "Results match gold standard"
MSG_DIFFER = "Results differ from gold standard (same row count, different values)"
MSG_NORMALIZE = "Error normalizing results: NULL among several values in a row cannot be sorted"


# Stored feedback of predictions that were not compared, by method.
MSG_NOT_RUN = "Query failed to execute"
MSG_GOLD_FAILED = "Cannot compare - gold query failed"
MSG_GENERATED = "Generated SQL failed: "


def count_message(n_gen: Column, n_gold: Column) -> Column:
    return F.concat(F.lit("Result count mismatch: generated "), n_gen.cast("string"),
                    F.lit(" rows, expected "), n_gold.cast("string"), F.lit(" rows"))


# A text that denotes a number (JSON's grammar: no leading zeros, so ``007`` is a text).
NUMBER = r"-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?"
TYPED = "struct<kind: string, value: string>"


def typed_values(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a result as ``array<struct<kind, value>>``: kind number, text or the type's own name, null values kept."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        t = kinds[c]
        numeric = t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")
        return F.struct(F.lit("number" if numeric else "text" if t == "string" else t).alias("kind"), F.col(c).cast("string").alias("value"))
    return F.array(*[one(c) for c in columns or df.columns])


def canonical_number(x: Column) -> Column:
    """One text for each value of a number text: nine decimals where 38 digits hold it, else its exact digits and exponent."""
    t = T.py_strip(x)
    fixed = t.try_cast("decimal(38,9)")
    whole = F.regexp_extract(t, r"^-?([0-9]+)", 1)
    digits = F.concat(whole, F.regexp_extract(t, r"[.]([0-9]+)", 1))
    shown = F.ltrim(digits, F.lit("0"))
    power = F.coalesce(F.regexp_extract(t, r"[eE]([+-]?[0-9]+)$", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) \
        + F.length(whole) - (F.length(digits) - F.length(shown))
    exact = F.concat(F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.rtrim(shown, F.lit("0")), F.lit("e"), power.cast("string"))
    tiny = (F.length(shown) == 0) | (power < -9)  # nothing in nine decimals
    return F.when(tiny, F.lit("0.000000000")).when(fixed.isNotNull(), F.when(fixed == 0, F.lit("0.000000000")).otherwise(fixed.cast("string"))) \
        .otherwise(exact)


def strict_values(values: Column, typed: bool) -> Column:
    """Sorted canonical texts of a row's values, each with its kind, so that values of different kinds never meet.

    Typed values keep their kind; of plain texts those that denote a number are numbers, others texts. Numbers are
    equal by value (``1`` = ``1.0``, to nine decimals), texts after trimming and lower-casing, null only with null.
    """
    def of(kind: Column, v: Column) -> Column:
        number = F.concat(F.lit("n:"), canonical_number(v))
        text = F.concat(F.when(kind == "text", F.lit("s")).otherwise(kind), F.lit(":"), T.normalize_value(v))
        # a number text that is none (nan, infinity) is its own text
        return F.when(v.isNull(), F.lit("\u0000null")).when((kind == "number") & T.py_strip(v).rlike(f"^{NUMBER}$"), number).otherwise(text)

    def plain(x: Column) -> Column:
        return of(F.when(T.py_strip(x).rlike(f"^{NUMBER}$"), F.lit("number")).otherwise(F.lit("text")), x)
    return F.array_sort(F.transform(values, (lambda x: of(x["kind"], x["value"])) if typed else plain))


def row_keys(rows: DataFrame, values: str = "row_values", mode: str = "reference") -> DataFrame:
    """SC-6/SC-7: ``row_key`` = sorted normalized values. In reference mode a row with two or more values
    and a NULL among them is flagged (the reference cannot sort it and reports an error for the pair).
    Strict mode compares typed values (``strict_values``) and never errors; ``values`` may be ``array<string>`` or
    the ``array<struct<kind, value>>`` of ``typed_values``."""
    v = F.col(values)
    typed = dict(rows.dtypes)[values].startswith("array<struct")
    if mode == "strict":
        keyed, bad = strict_values(v, typed), F.lit(False)
    else:
        v = F.transform(v, lambda x: x["value"]) if typed else v
        keyed = F.array_sort(F.transform(v, lambda x: T.normalize_value(x)))
        bad = (F.size(v) >= 2) & F.exists(v, lambda x: x.isNull())
    return rows.withColumn("row_key", keyed).withColumn("bad_row", bad)


def compare_results(rows: DataFrame, pairs: DataFrame | None = None, mode: str = "reference",
                    values: str = "row_values") -> DataFrame:
    """ST-2: per pair ``n_gen, n_gold`` (distinct rows in reference mode, all rows in strict mode),
    ``only_gen, only_gold``, ``results_match`` and the reference's feedback text.

    ``pairs`` (column ``pair_id``) lists every compared pair, so pairs whose two results are both empty
    are reported (and match); without it only pairs that have rows appear. Columns ``gen_ok`` and ``gold_ok`` of ``pairs``
    say whether the queries ran; a pair of which one did not has no comparison (all counts 0) and the feedback says so.
    """
    k = row_keys(rows, values, mode)
    is_gen = F.col("side") == GEN
    if mode == "strict":
        per_row = k.groupBy("pair_id", "row_key").agg(
            F.count_if(is_gen).alias("c_gen"), F.count_if(~is_gen).alias("c_gold"))
        per_pair = per_row.groupBy("pair_id").agg(
            F.sum("c_gen").alias("n_gen"), F.sum("c_gold").alias("n_gold"),
            F.sum(F.greatest(F.col("c_gen") - F.col("c_gold"), F.lit(0))).alias("only_gen"),
            F.sum(F.greatest(F.col("c_gold") - F.col("c_gen"), F.lit(0))).alias("only_gold"),
            F.lit(False).alias("error"))
    else:
        per_row = k.groupBy("pair_id", "row_key").agg(
            F.max(is_gen).alias("in_gen"), F.max(~is_gen).alias("in_gold"), F.max("bad_row").alias("bad"))
        per_pair = per_row.groupBy("pair_id").agg(
            F.count_if("in_gen").alias("n_gen"), F.count_if("in_gold").alias("n_gold"),
            F.count_if(F.col("in_gen") & ~F.col("in_gold")).alias("only_gen"),
            F.count_if(F.col("in_gold") & ~F.col("in_gen")).alias("only_gold"),
            F.max("bad").alias("error"))
    ran = F.lit(True)
    if pairs is not None:
        flags = [c for c in ("gen_ok", "gold_ok") if c in pairs.columns]
        for c in flags:
            ran = ran & F.coalesce(F.col(c), F.lit(False))
        per_pair = pairs.select("pair_id", ran.alias("_ran")).join(per_pair, "pair_id", "left")
    else:
        per_pair = per_pair.withColumn("_ran", ran)
    z = F.lit(0).cast("long")
    counted = [F.when(F.col("_ran"), F.coalesce(F.col(c).cast("long"), z)).otherwise(z).alias(c) for c in ("n_gen", "n_gold", "only_gen", "only_gold")]
    out = per_pair.select("pair_id", *counted, (F.col("_ran") & F.coalesce(F.col("error"), F.lit(False))).alias("error"), "_ran")
    match = F.col("_ran") & ~F.col("error") & (F.col("only_gen") == 0) & (F.col("only_gold") == 0)
    feedback = (F.when(~F.col("_ran"), F.lit(MSG_FAILED)).when(F.col("error"), F.lit(MSG_NORMALIZE))
                .when(match, F.lit(MSG_MATCH))
                .when(F.col("n_gen") != F.col("n_gold"), count_message(F.col("n_gen"), F.col("n_gold")))
                .otherwise(F.lit(MSG_DIFFER)))
    return out.withColumn("results_match", match).withColumn("feedback", feedback).drop("_ran")


def pair_sides(rows: DataFrame) -> DataFrame:
    """JN-6: generated and gold result sizes side by side per pair (full outer join of the two sides)."""
    g = rows.filter(F.col("side") == GEN).groupBy("pair_id").agg(F.count(F.lit(1)).alias("gen_rows"))
    d = rows.filter(F.col("side") == GOLD).groupBy("pair_id").agg(F.count(F.lit(1)).alias("gold_rows"))
    z = F.lit(0).cast("long")
    return g.join(d, "pair_id", "full_outer").select(
        "pair_id", F.coalesce("gen_rows", z).alias("gen_rows"), F.coalesce("gold_rows", z).alias("gold_rows"))


def score(results: DataFrame, generated: str = "generated_sql") -> DataFrame:
    """EX-2: 0/1 score — 0 if the prediction is empty, either query failed, or the results differ."""
    empty = F.col(generated).isNull() | (T.py_strip(F.col(generated)) == "")
    ok = ~empty & F.coalesce(F.col("gen_ok"), F.lit(False)) & F.coalesce(F.col("gold_ok"), F.lit(False)) \
        & F.coalesce(F.col("results_match"), F.lit(False))
    return results.withColumn("score", F.when(ok, F.lit(1)).otherwise(F.lit(0)))


def feedback_by_method(method: Column, feedback: Column, gen_ok: Column, gold_ok: Column, error: Column) -> Column:
    """The feedback that a method stores for a prediction, failed ones included.

    Self-correction names the side that failed; fine-tuned inference quotes the error of a failed prediction and says
    nothing where only the gold query failed; zero-shot and few-shot store none; others keep the comparison's own.
    """
    ran, gold = F.coalesce(gen_ok, F.lit(False)), F.coalesce(gold_ok, F.lit(False))
    corrected = F.when(~ran, F.lit(MSG_NOT_RUN)).when(~gold, F.lit(MSG_GOLD_FAILED)).otherwise(feedback)
    tuned = F.when(~ran, F.concat(F.lit(MSG_GENERATED), F.coalesce(error, F.lit("None")))).when(~gold, F.lit("")).otherwise(feedback)
    return (F.when(method == "self_correction", corrected).when(method == "fine_tuned", tuned)
            .when(method.isin("zero_shot", "few_shot"), F.lit(None).cast("string")).otherwise(feedback))

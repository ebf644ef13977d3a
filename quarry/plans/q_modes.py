"""Registered queries of further modes: exact match, lookup policies, the anti side, strict comparison, exact quotas and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import oracle as O
from quarry.functions import prompts as P
from quarry.functions import text as T
from quarry.operators import catalog as C
from quarry.operators import compare as CMP
from quarry.operators import evaluation as E
from quarry.operators import mixing as M
from quarry.plans import q_corpus, q_eval, q_mix
from quarry.plans.registry import ORACLES, register
from quarry.sources import adapters as A
from quarry.sources import jsonl as J

EX, CL, ER, q = O.EXAMPLES, O.CLASSIFIED, O.EVAL_RESULTS, O.q

# --- exact match in the metrics ------------------------------------------------------------------------

EXACT = (EX, ER, q_eval.MODEL_TEXT, q_eval.EXTRACT, f"""matched AS (SELECT r.*,
  lower({O.strip('x.generated_sql')}) = lower({O.strip('x.gold_sql')}) AS exact_match
  FROM eval_results r JOIN extracted x USING (example_id))""")


def exact_results(spark, sf) -> DataFrame:
    """Evaluation results with the exact-match flag of the extracted SQL against the gold SQL."""
    r = A.eval_results(spark, sf)
    wrapped = T.extract_sql(A.wrapped_sql(F.col("example_id"), F.col("gold_sql")))
    return r.withColumn("exact_match", T.exact_match(wrapped, F.col("gold_sql")))


@register("AG-4-EXACT", O.with_(*EXACT) + """SELECT method, count(*) AS total_examples,
  count(*) FILTER (WHERE exact_match) AS exact_match_count,
  CAST(count(*) FILTER (WHERE exact_match) AS DOUBLE) * 100.0 / count(*) AS exact_match_pct FROM matched GROUP BY method""")
def ag4_exact(spark, sf):
    m = E.metrics(exact_results(spark, sf), exact="exact_match")
    return m.select("method", "total_examples", "exact_match_count", "exact_match_pct")


@register("AG-5-EXACT", O.with_(*EXACT) + """SELECT method, complexity_tag, count(*) AS total, count(*) FILTER (WHERE exact_match) AS exact,
  CAST(count(*) FILTER (WHERE exact_match) AS DOUBLE) * 100.0 / count(*) AS exact_pct
FROM (SELECT method, unnest(complexity) AS complexity_tag, exact_match FROM matched) GROUP BY 1, 2""")
def ag5_exact(spark, sf):
    m = E.metrics_by_complexity(exact_results(spark, sf), exact="exact_match")
    return m.select("method", "complexity_tag", "total", "exact", "exact_pct")


@register("WN-1-EXACT", O.with_(*EXACT, """run AS (SELECT method, row_number() OVER w - 1 AS pos,
  sum(CAST(exact_match AS BIGINT)) OVER w AS ce FROM matched
  WINDOW w AS (PARTITION BY method ORDER BY example_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
    + "SELECT method, pos, CAST(ce AS DOUBLE) * 100.0 / (pos + 1) AS exact_pct FROM run WHERE pos % 10 = 9")
def wn1_exact(spark, sf):
    return E.running_metrics(exact_results(spark, sf), every=10, exact="exact_match").select("method", "pos", "exact_pct")


# --- lookups ---------------------------------------------------------------------------------------------

ST = q_corpus.SCHEMA_TEXT


@register("JN-2-DB", O.with_(EX, ST) + """SELECT e.example_id, coalesce(s.schema, 'Database: ' || e.db_id) AS schema
FROM examples e LEFT JOIN schema_text s USING (db_id)""")
def jn2_db(spark, sf):
    return C.lookup_schema(A.examples(spark, sf), q_corpus.schema_text(spark, sf), "db").select("example_id", "schema")


@register("JN-2-NONE", O.with_(EX, ST) + """SELECT e.example_id, coalesce(s.schema, 'No Schema') AS schema
FROM examples e LEFT JOIN schema_text s USING (db_id)""")
def jn2_none(spark, sf):
    return C.lookup_schema(A.examples(spark, sf), q_corpus.schema_text(spark, sf), "none").select("example_id", "schema")


@register("JN-3-ANTI", O.with_(EX, ST) + """SELECT example_id, db_id FROM examples e
WHERE NOT EXISTS (SELECT 1 FROM schema_text s WHERE s.db_id = e.db_id)""")
def jn3_anti(spark, sf):
    return C.unavailable(A.examples(spark, sf), q_corpus.schema_text(spark, sf)).select("example_id", "db_id")


@register("SRC-3-ARRAY", O.with_(ST) + "SELECT db_id, schema FROM schema_text")
def src3_array(spark, sf):
    """Catalog as files that each hold one JSON array (of the databases of one range of numbers), read back and rendered."""
    cat = A.catalog(spark, sf)
    pairs = F.transform("column_names_original", lambda c: F.array(c["table_idx"].cast("string"), c["name"]))
    one = F.to_json(F.struct("db_id", "table_names_original", pairs.alias("column_names_original"), "column_types"))
    group = F.floor(F.substring("db_id", 6, 20).cast("long") / 500)
    path = J.scratch_path(spark, "catalog-arrays")
    arrays = cat.select(group.alias("g"), one.alias("o")).groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("g").text(path)
    return C.render_schema(J.read_catalog(spark, f"{path}/g=*"))


@register("FLT-5-COUNT", O.with_(EX) + """SELECT count(*) AS formatted, count(*) FILTER (WHERE length(t) > 10) AS kept,
  count(*) FILTER (WHERE length(t) <= 10) AS dropped FROM (SELECT substr(question, 1, example_id % 40) AS t FROM examples)""")
def flt5_count(spark, sf):
    """The filter's accounts over texts cut to between none and 39 characters."""
    ex = A.examples(spark, sf)
    return P.long_text_counts(ex.select(F.expr("substring(question, 1, cast(example_id % 40 as int))").alias("text")))


# --- result comparison: strict mode, NULL rows, failed queries --------------------------------------------

TYPED_ROWS = """o AS (SELECT o_custkey AS pair_id, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  o_orderpriority AS p, CASE WHEN o_orderkey % 5 <> 0 OR o_custkey % 3 = 0 THEN o_orderstatus END AS s FROM orders),
rrows AS (
  SELECT pair_id, 'gold' AS side, [CASE WHEN pair_id % 4 = 3 THEN k || 'e400' ELSE CAST(k AS VARCHAR) END, CAST(cents AS VARCHAR), p, s] AS row_values FROM o
  UNION ALL
  SELECT pair_id, 'gen', [s, upper(p) || ' ', CASE WHEN pair_id % 4 = 0 THEN cents || '.0' ELSE CAST(cents AS VARCHAR) END,
    CASE pair_id % 4 WHEN 1 THEN '0' || k WHEN 3 THEN k || CASE WHEN pair_id % 8 = 3 THEN '0e399' ELSE '1e399' END ELSE CAST(k AS VARCHAR) END]
  FROM o, range(2) r WHERE r.range = 0 OR (pair_id % 4 = 2 AND k % 2 = 0)),
pairs AS (SELECT DISTINCT o_custkey AS pair_id, o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 AS ran FROM orders)"""


def typed_rows(spark, sf) -> DataFrame:
    """Stored results per customer: numbers written in two ways, padded numbers, repeated rows, numbers beyond doubles, NULLs."""
    o = A.table(spark, sf, "orders")
    pair, k = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    s = F.when((F.col("o_orderkey") % 5 != 0) | (pair % 3 == 0), F.col("o_orderstatus"))
    gold = F.array(F.when(pair % 4 == 3, F.concat(k, F.lit("e400"))).otherwise(k), cents, F.col("o_orderpriority"), s)
    big = F.concat(k, F.when(pair % 8 == 3, F.lit("0e399")).otherwise(F.lit("1e399")))
    gen = F.array(s, F.concat(F.upper("o_orderpriority"), F.lit(" ")), F.when(pair % 4 == 0, F.concat(cents, F.lit(".0"))).otherwise(cents),
                  F.when(pair % 4 == 1, F.concat(F.lit("0"), k)).when(pair % 4 == 3, big).otherwise(k))
    times = F.when((pair % 4 == 2) & (F.col("o_orderkey") % 2 == 0), 2).otherwise(1)
    generated = o.select(pair.alias("pair_id"), gen.alias("row_values"), F.explode(F.array_repeat(F.lit("gen"), times)).alias("side"))
    return o.select(pair.alias("pair_id"), gold.alias("row_values"), F.lit("gold").alias("side")).unionByName(generated)


def typed_pairs(spark, sf) -> DataFrame:
    """Every pair and which of its queries ran."""
    p = A.result_pairs(spark, sf)
    return p.withColumns({"gen_ok": F.col("pair_id") % 7 != 0, "gold_ok": F.col("pair_id") % 11 != 0})


def _canonical_sql(x: str) -> str:
    t = O.strip(x)
    whole, frac = f"regexp_extract({t}, '^-?([0-9]+)', 1)", f"regexp_extract({t}, '[.]([0-9]+)', 1)"
    shown = f"ltrim({whole} || {frac}, '0')"
    power = (f"(coalesce(TRY_CAST(regexp_extract({t}, '[eE]([+-]?[0-9]+)$', 1) AS BIGINT), 0) + length({whole}) "
             f"- (length({whole} || {frac}) - length({shown})))")
    number = (f"'n:' || CASE WHEN {shown} = '' OR {power} < -9 THEN '0.000000000' WHEN {power} <= 29 THEN CAST(CAST({t} AS DECIMAL(38,9)) AS VARCHAR) "
              f"ELSE CASE WHEN starts_with({t}, '-') THEN '-' ELSE '' END || rtrim({shown}, '0') || 'e' || {power} END")
    return (f"CASE WHEN {x} IS NULL THEN 'null' WHEN regexp_matches({t}, '^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$') "
            f"THEN {number} ELSE 's:' || lower({t}) END")


_FEEDBACK = """CASE WHEN NOT ran THEN 'Cannot compare - one or both queries failed to execute'
       WHEN error THEN 'Error normalizing results: NULL among several values in a row cannot be sorted'
       WHEN only_gen = 0 AND only_gold = 0 THEN 'Results match gold standard'
       WHEN n_gen <> n_gold THEN 'Result count mismatch: generated ' || n_gen || ' rows, expected ' || n_gold || ' rows'
       ELSE 'Results differ from gold standard (same row count, different values)' END AS feedback"""
_COUNTED = ", ".join(f"CASE WHEN ran THEN CAST(coalesce({c}, 0) AS BIGINT) ELSE 0 END AS {c}" for c in ("n_gen", "n_gold", "only_gen", "only_gold"))


@register("ST-2-STRICT", O.with_(TYPED_ROWS, f"""keyed AS (SELECT pair_id, side, list_sort(list_transform(row_values, lambda x: {_canonical_sql('x')})) AS row_key FROM rrows)""",
                                 """per_row AS (SELECT pair_id, row_key, count(*) FILTER (WHERE side = 'gen') AS g, count(*) FILTER (WHERE side = 'gold') AS d FROM keyed GROUP BY 1, 2)""",
                                 """per_pair AS (SELECT pair_id, sum(g) AS n_gen, sum(d) AS n_gold, sum(greatest(g - d, 0)) AS only_gen,
  sum(greatest(d - g, 0)) AS only_gold FROM per_row GROUP BY 1)""",
                                 f"pp AS (SELECT p.pair_id, ran, {_COUNTED}, false AS error FROM pairs p LEFT JOIN per_pair USING (pair_id))")
          + f"SELECT pair_id, n_gen, n_gold, only_gen, only_gold, error, ran AND only_gen = 0 AND only_gold = 0 AS results_match, {_FEEDBACK} FROM pp")
def st2_strict(spark, sf):
    return CMP.compare_results(typed_rows(spark, sf), typed_pairs(spark, sf), "strict")


@register("ST-2-OUTCOMES", O.with_(TYPED_ROWS, f"""keyed AS (SELECT pair_id, side, list_sort(list_transform(row_values, lambda x: lower({O.strip('x')}))) AS row_key,
  len(list_filter(row_values, lambda x: x IS NULL)) > 0 AS bad FROM rrows)""",
                                   """per_row AS (SELECT pair_id, row_key, bool_or(side = 'gen') AS g, bool_or(side = 'gold') AS d, bool_or(bad) AS bad FROM keyed GROUP BY 1, 2)""",
                                   """per_pair AS (SELECT pair_id, count(*) FILTER (WHERE g) AS n_gen, count(*) FILTER (WHERE d) AS n_gold,
  count(*) FILTER (WHERE g AND NOT d) AS only_gen, count(*) FILTER (WHERE d AND NOT g) AS only_gold, bool_or(bad) AS bad FROM per_row GROUP BY 1)""",
                                   f"pp AS (SELECT p.pair_id, ran, {_COUNTED}, ran AND coalesce(bad, false) AS error FROM pairs p LEFT JOIN per_pair USING (pair_id))")
          + f"SELECT pair_id, n_gen, n_gold, only_gen, only_gold, error, ran AND NOT error AND only_gen = 0 AND only_gold = 0 AS results_match, {_FEEDBACK} FROM pp")
def st2_outcomes(spark, sf):
    """All five outcomes of the reference's comparison: failed, NULL among several values, match, count, values."""
    return CMP.compare_results(typed_rows(spark, sf), typed_pairs(spark, sf))


_OUTCOMES = ORACLES["ST-2-OUTCOMES"]


@register("ST-2-FEEDBACK", f"""SELECT pair_id, method, CASE method WHEN 'zero_shot' THEN NULL
  WHEN 'self_correction' THEN CASE WHEN pair_id % 7 = 0 THEN 'Query failed to execute' WHEN pair_id % 11 = 0 THEN 'Cannot compare - gold query failed' ELSE feedback END
  WHEN 'fine_tuned' THEN CASE WHEN pair_id % 7 = 0 THEN 'Generated SQL failed: ' || CASE WHEN pair_id % 2 = 0 THEN 'no such table: x' ELSE 'None' END
                              WHEN pair_id % 11 = 0 THEN '' ELSE feedback END
  ELSE feedback END AS feedback
FROM (SELECT *, ['zero_shot', 'self_correction', 'fine_tuned', 'optimized'][pair_id % 4 + 1] AS method FROM ({_OUTCOMES}))""")
def st2_feedback(spark, sf):
    """What each method stores about its prediction, over all outcomes of the comparison."""
    pair = F.col("pair_id")
    r = CMP.compare_results(typed_rows(spark, sf), typed_pairs(spark, sf))
    method = F.element_at(F.array(*[F.lit(m) for m in ("zero_shot", "self_correction", "fine_tuned", "optimized")]), (pair % 4 + 1).cast("int"))
    error = F.when(pair % 2 == 0, F.lit("no such table: x"))
    return r.select("pair_id", method.alias("method"), CMP.feedback_by_method(method, F.col("feedback"), pair % 7 != 0, pair % 11 != 0, error).alias("feedback"))


# --- exact quotas and split --------------------------------------------------------------------------------

_H = q_mix._hash_sql(42, "example_id") + " || ':' || CAST(example_id AS VARCHAR)"


@register("ST-3-EXACT", O.with_(EX, CL, f"""cnt AS (SELECT source_dataset, count(*) AS n, CAST(CASE source_dataset {q_mix._w} END AS DOUBLE) AS w
  FROM winners GROUP BY 1)""", "pr AS (SELECT *, w / sum(w) OVER () AS p FROM cnt)",
                                "tot AS (SELECT *, CAST(ceil(max(round(n / p, 6)) OVER ()) AS DOUBLE) AS total FROM pr)",
                                "sh AS (SELECT *, round(p * total, 6) AS share, floor(round(p * total, 6)) AS base FROM tot)",
                                """quota AS (SELECT source_dataset, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY round(share - base, 6) DESC, source_dataset)
    <= total - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM sh)""",
                                f"""ranked_rows AS (SELECT example_id, source_dataset, quota // n + CASE WHEN row_number() OVER (PARTITION BY source_dataset ORDER BY {_H})
    <= quota % n THEN 1 ELSE 0 END AS c FROM winners JOIN quota USING (source_dataset))""")
          + "SELECT source_dataset, example_id, unnest(range(c)) AS copy FROM ranked_rows")
def st3_exact(spark, sf):
    kept = q_mix._kept(spark, sf).select("example_id", "source_dataset")
    return M.interleave_exact(kept, "source_dataset", "example_id", q_mix.TRAIN_WEIGHTS) \
        .select("source_dataset", "example_id", F.col("copy").cast("long").alias("copy"))


@register("ST-4-EXACT", O.with_(EX) + f"""SELECT example_id, CASE WHEN row_number() OVER (ORDER BY {_H}) <= ceil(0.02 * (SELECT count(*) FROM examples))
  THEN 'validation' ELSE 'train' END AS split FROM examples""")
def st4_exact(spark, sf):
    return M.split_exact(A.examples(spark, sf).select("example_id"), "example_id", 0.02, 42)

"""Registered evaluation queries: metrics, attempts, windows, result comparison, execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import oracle as O
from quarry.functions import text as T
from quarry.operators import compare as CMP
from quarry.operators import evaluation as E
from quarry.plans.registry import ORACLES, register
from quarry.sources import adapters as A

EX, ER = O.EXAMPLES, O.EVAL_RESULTS
q = O.q


def _pct(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) * 100.0 / {den}, 0.0)"


METRICS_SQL = f"""SELECT method,
  count(*) FILTER (WHERE coalesce(is_valid, false)) AS valid_sql_count,
  {_pct("count(*) FILTER (WHERE coalesce(is_valid, false))", "count(*)")} AS valid_sql_pct,
  count(*) FILTER (WHERE coalesce(results_match, false)) AS result_match_count,
  {_pct("count(*) FILTER (WHERE coalesce(results_match, false))", "count(*)")} AS result_match_pct,
  CAST(sum(CAST(coalesce(inference_time, 0.0) AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS avg_inference_time,
  count(*) AS total_examples,
  CAST(sum(coalesce(num_attempts, 1)) AS DOUBLE) / count(*) AS avg_attempts
FROM eval_results GROUP BY method"""


@register("AG-4", O.with_(EX, ER) + METRICS_SQL)
def ag4(spark, sf):
    return E.metrics(A.eval_results(spark, sf))


@register("AG-5", O.with_(EX, ER) + f"""SELECT method, complexity_tag, count(*) AS total,
  count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE results_match) AS matched,
  {_pct("count(*) FILTER (WHERE is_valid)", "count(*)")} AS valid_pct,
  {_pct("count(*) FILTER (WHERE results_match)", "count(*)")} AS match_pct
FROM (SELECT method, unnest(complexity) AS complexity_tag, is_valid, results_match FROM eval_results)
GROUP BY 1, 2""")
def ag5(spark, sf):
    return E.metrics_by_complexity(A.eval_results(spark, sf))


def _error_class_sql(x: str) -> str:
    parts = " ".join(f"WHEN strpos(lower({x}), {q(n)}) > 0 THEN {q(c)}" for n, c in O.ERROR_CLASSES)
    return f"CASE {parts} ELSE 'other_error' END"


@register("AG-6", O.with_(EX, ER, f"""cls AS (SELECT method, CASE WHEN error IS NOT NULL THEN {_error_class_sql('error')} END AS error_class
  FROM eval_results)""", """per AS (SELECT method, count(*) AS evaluated,
  count(*) FILTER (WHERE error_class = 'table_name_error') AS table_name_error,
  count(*) FILTER (WHERE error_class = 'column_name_error') AS column_name_error,
  count(*) FILTER (WHERE error_class = 'syntax_error') AS syntax_error,
  count(*) FILTER (WHERE error_class = 'other_error') AS other_error FROM cls GROUP BY 1)""") + f"""
SELECT method, evaluated, error_class, count, {_pct('count', 'evaluated')} AS pct FROM (
  SELECT method, evaluated, 'table_name_error' AS error_class, table_name_error AS count FROM per
  UNION ALL SELECT method, evaluated, 'column_name_error', column_name_error FROM per
  UNION ALL SELECT method, evaluated, 'syntax_error', syntax_error FROM per
  UNION ALL SELECT method, evaluated, 'other_error', other_error FROM per)""")
def ag6(spark, sf):
    return E.error_taxonomy(A.eval_results(spark, sf))


@register("SO-1", O.with_(EX, ER) + """SELECT complexity_tag, count(*) AS n
FROM (SELECT unnest(complexity) AS complexity_tag FROM eval_results) GROUP BY 1 ORDER BY 1""")
def so1(spark, sf):
    r = A.eval_results(spark, sf)
    return r.select(F.explode("complexity").alias("complexity_tag")).groupBy("complexity_tag") \
        .agg(F.count(F.lit(1)).alias("n")).orderBy("complexity_tag")


# The assistant's turns of a conversation in groups of three: every turn belongs to one example.
ATTEMPTS = """a00 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations WHERE role = 'assistant'),
a0 AS (SELECT conv_id * 1000000 + nth // 3 AS example_id, CAST(nth % 3 + 1 AS INTEGER) AS attempt_number,
    text AS sql, length(text) % 3 <> 0 AS is_valid,
    CASE WHEN length(text) % 3 = 0 THEN 'no such column: y' END AS execution_error,
    CASE WHEN length(text) % 3 <> 0 THEN CASE WHEN length(text) % 5 = 0 THEN 'Yes, correct' ELSE 'No, wrong' END END AS llm_validation
  FROM a00),
fy AS (SELECT example_id, min(attempt_number) AS first_yes FROM a0
  WHERE is_valid AND starts_with(lower(llm_validation), 'yes') GROUP BY 1),
attempts AS (SELECT a0.* FROM a0 LEFT JOIN fy USING (example_id) WHERE fy.first_yes IS NULL OR a0.attempt_number <= fy.first_yes)"""


@register("AG-7", O.with_(ATTEMPTS, """ranked_att AS (SELECT *,
  row_number() OVER (PARTITION BY example_id ORDER BY
    CASE WHEN coalesce(is_valid, false) AND coalesce(starts_with(lower(llm_validation), 'yes'), false) THEN 0
         WHEN coalesce(is_valid, false) THEN 1 ELSE 2 END,
    CASE WHEN coalesce(is_valid, false) THEN attempt_number ELSE -attempt_number END) AS rk,
  count(*) OVER (PARTITION BY example_id) AS num_attempts FROM attempts)""") + """
SELECT example_id, attempt_number AS final_attempt, sql, is_valid, llm_validation, num_attempts
FROM ranked_att WHERE rk = 1""")
def ag7(spark, sf):
    return E.final_attempt(A.attempts(spark, sf))


@register("AG-14", O.with_(ATTEMPTS, """blocks AS (SELECT example_id, attempt_number,
  CASE WHEN sql IS NULL OR trim(sql) = '' THEN chr(10) || chr(10) || '-- Previous attempt ' || attempt_number || ':' || chr(10) || '-- Error: Generated empty SQL' || chr(10) || '-- Please generate a valid SQL query:' || chr(10) || '-- SQL:' || chr(10)
       WHEN NOT coalesce(is_valid, false) THEN chr(10) || chr(10) || '-- Previous attempt ' || attempt_number || ':' || chr(10) || '-- SQL: ' || sql || chr(10) || '-- Execution error: ' || coalesce(execution_error, 'None') || chr(10) || '-- Fix the error and try again:' || chr(10)
       WHEN coalesce(starts_with(lower(llm_validation), 'yes'), false) OR attempt_number >= 3 THEN ''
       ELSE chr(10) || chr(10) || '-- Previous attempt ' || attempt_number || ':' || chr(10) || '-- SQL: ' || sql || chr(10) || '-- LLM Feedback: ' || substr(coalesce(llm_validation, ''), 1, 200) || '...' || chr(10) || chr(10) || '-- Generate improved SQL:' || chr(10) || '-- SQL:' END AS block
  FROM attempts)""") + "SELECT example_id, string_agg(block, '' ORDER BY attempt_number) AS history FROM blocks GROUP BY 1")
def ag14(spark, sf):
    return E.attempt_history(A.attempts(spark, sf))


@register("SC-15", O.with_(ATTEMPTS) + """SELECT example_id, attempt_number,
  coalesce(starts_with(lower(llm_validation), 'yes'), false) AS says_yes FROM attempts""")
def sc15(spark, sf):
    return A.attempts(spark, sf).select("example_id", "attempt_number",
                                        T.judge_says_yes(F.col("llm_validation")).alias("says_yes"))


@register("AG-15", O.with_(EX, ER) + """SELECT method AS candidate, avg(CAST(coalesce(results_match, false) AS INTEGER)) AS mean_score,
  count(*) AS n, row_number() OVER (ORDER BY avg(CAST(coalesce(results_match, false) AS INTEGER)) DESC, method) = 1 AS is_best
FROM eval_results GROUP BY method""")
def ag15(spark, sf):
    r = A.eval_results(spark, sf).withColumnRenamed("method", "candidate")
    return E.best_candidate(r)


@register("JN-7", O.with_(EX, ER, f"m AS ({METRICS_SQL})") + """SELECT m.method, m.result_match_pct,
  b.result_match_pct AS baseline_value, m.result_match_pct - b.result_match_pct AS delta
FROM m, (SELECT result_match_pct FROM m WHERE method = 'zero_shot') b""")
def jn7(spark, sf):
    return E.before_after(E.metrics(A.eval_results(spark, sf)), "zero_shot")


@register("WN-1", O.with_(EX, ER, """run AS (SELECT method, row_number() OVER w - 1 AS pos,
  sum(CAST(is_valid AS BIGINT)) OVER w AS cv, sum(CAST(results_match AS BIGINT)) OVER w AS cm
  FROM eval_results WINDOW w AS (PARTITION BY method ORDER BY example_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
    + """SELECT method, pos, pos + 1 AS seen, CAST(cv AS DOUBLE) * 100.0 / (pos + 1) AS valid_pct,
  CAST(cm AS DOUBLE) * 100.0 / (pos + 1) AS match_pct
FROM run WHERE pos % 10 = 9""")
def wn1(spark, sf):
    return E.running_metrics(A.eval_results(spark, sf), every=10)


EPOCH_LOG = """epoch_log AS (SELECT run, epoch, cents / n / 100.0 AS score, 'prompt-' || run || '-' || epoch AS prompt FROM (
  SELECT user_id AS run, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS epoch,
         sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(*) AS n FROM events GROUP BY 1, 2))"""


@register("WN-2", O.with_(EPOCH_LOG, """acc AS (SELECT *, coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best_before FROM epoch_log)""")
    + """SELECT run, epoch, score, prompt, best_before, score >= best_before AS accepted,
  coalesce(last_value(CASE WHEN score >= best_before THEN prompt END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'initial') AS current_prompt FROM acc""")
def wn2(spark, sf):
    return E.accept_revert(A.epoch_log(spark, sf))


@register("WN-3", O.with_(EX) + """SELECT example_id, source_dataset,
  row_number() OVER (PARTITION BY source_dataset ORDER BY example_id) - 1 AS pos FROM examples""")
def wn3(spark, sf):
    ex = A.examples(spark, sf).select("example_id", "source_dataset")
    return E.positions(ex, "example_id", ["source_dataset"], block=64)


@register("WN-4", O.with_(EX) + """SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS pos,
  (row_number() OVER (ORDER BY example_id) - 1) // 8 AS batch FROM examples""")
def wn4(spark, sf):
    ex = A.examples(spark, sf).select("example_id")
    return E.mini_batches(ex, 8).select("example_id", "pos", F.col("batch").cast("long").alias("batch"))


@register("SO-3", O.with_(EX) + "SELECT example_id, question FROM examples ORDER BY example_id LIMIT 100")
def so3(spark, sf):
    return A.examples(spark, sf).select("example_id", "question").orderBy("example_id").limit(100)


# --- result comparison --------------------------------------------------------------------------------

RESULT_ROWS = """rrows AS (
  SELECT o_custkey AS pair_id, 'gold' AS side, [o_orderstatus, o_orderpriority] AS row_values FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL
  SELECT o_custkey, 'gen', [' ' || upper(o_orderpriority) || ' ', ' ' || upper(o_orderstatus)] FROM orders
  WHERE o_orderkey % 2 = 0 OR o_custkey % 3 <> 0)"""

KEYED = f"""keyed AS (SELECT pair_id, side,
  list_sort(list_transform(row_values, lambda x: lower({O.strip('x')}))) AS row_key,
  len(row_values) >= 2 AND len(list_filter(row_values, lambda x: x IS NULL)) > 0 AS bad_row FROM rrows)"""


@register("ST-2", O.with_(RESULT_ROWS, KEYED, """per_row AS (SELECT pair_id, row_key, bool_or(side = 'gen') AS in_gen,
  bool_or(side = 'gold') AS in_gold, bool_or(bad_row) AS bad FROM keyed GROUP BY 1, 2)""",
                          """per_pair AS (SELECT pair_id, count(*) FILTER (WHERE in_gen) AS n_gen,
  count(*) FILTER (WHERE in_gold) AS n_gold, count(*) FILTER (WHERE in_gen AND NOT in_gold) AS only_gen,
  count(*) FILTER (WHERE in_gold AND NOT in_gen) AS only_gold, bool_or(bad) AS error FROM per_row GROUP BY 1)""",
                          """pp AS (SELECT p.pair_id, coalesce(n_gen, 0) AS n_gen, coalesce(n_gold, 0) AS n_gold,
  coalesce(only_gen, 0) AS only_gen, coalesce(only_gold, 0) AS only_gold, coalesce(error, false) AS error
  FROM (SELECT DISTINCT o_custkey AS pair_id FROM orders) p LEFT JOIN per_pair USING (pair_id))""")
    + f"""SELECT *, NOT error AND only_gen = 0 AND only_gold = 0 AS results_match,
  CASE WHEN error THEN {q(O.MSG_NORMALIZE)} WHEN only_gen = 0 AND only_gold = 0 THEN {q(O.MSG_MATCH)}
       WHEN n_gen <> n_gold THEN 'Result count mismatch: generated ' || n_gen || ' rows, expected ' || n_gold || ' rows'
       ELSE {q(O.MSG_DIFFER)} END AS feedback FROM pp""")
def st2(spark, sf):
    return CMP.compare_results(A.result_rows(spark, sf), A.result_pairs(spark, sf))


@register("SC-7", O.with_(RESULT_ROWS, KEYED) + "SELECT pair_id, side, array_to_string(row_key, '|') AS row_key FROM keyed")
def sc7(spark, sf):
    k = CMP.row_keys(A.result_rows(spark, sf))
    return k.select("pair_id", "side", F.array_join("row_key", "|").alias("row_key"))


@register("SC-6", f"""SELECT o_orderkey, lower({O.strip("CAST(o_custkey AS VARCHAR)")}) AS v_cust,
  lower({O.strip("' ' || o_orderpriority || ' '")}) AS v_priority, lower({O.strip("CAST(NULL AS VARCHAR)")}) AS v_null FROM orders""")
def sc6(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.select("o_orderkey", T.normalize_value(F.col("o_custkey")).alias("v_cust"),
                    T.normalize_value(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).alias("v_priority"),
                    T.normalize_value(F.lit(None).cast("string")).alias("v_null"))


@register("JN-6", O.with_(RESULT_ROWS) + """SELECT coalesce(g.pair_id, d.pair_id) AS pair_id,
  coalesce(g.n, 0) AS gen_rows, coalesce(d.n, 0) AS gold_rows
FROM (SELECT pair_id, count(*) AS n FROM rrows WHERE side = 'gen' GROUP BY 1) g
FULL OUTER JOIN (SELECT pair_id, count(*) AS n FROM rrows WHERE side = 'gold' GROUP BY 1) d USING (pair_id)""")
def jn6(spark, sf):
    return CMP.pair_sides(A.result_rows(spark, sf))


# --- scalar functions over evaluation rows ---------------------------------------------------------------

MODEL_TEXT = """model_text AS (SELECT example_id, sql AS gold_sql,
  CASE example_id % 6 WHEN 0 THEN sql WHEN 1 THEN '```sql' || chr(10) || sql || chr(10) || '```'
    WHEN 2 THEN ']] ' || sql WHEN 3 THEN 'Here is the query you asked for: ' || sql
    WHEN 4 THEN sql || chr(10) || chr(10) || 'This query answers the question.' ELSE sql || '; ' END AS model_text
  FROM examples)"""


def extract_sql_sql(x: str) -> str:
    t0 = O.strip(f"replace(replace({x}, '```sql', ''), '```', '')")
    t1 = O.strip(f"(CASE WHEN starts_with({t0}, ']]') THEN {O.strip(f'substr({t0}, 3)')} ELSE {t0} END)")
    return t1


EXTRACT = f"""ext0 AS (SELECT example_id, gold_sql, {extract_sql_sql('model_text')} AS t FROM model_text),
ext1 AS (SELECT *, strpos(upper(replace(t, 'ß', 'ss')), 'SELECT') AS pos FROM ext0),
ext2 AS (SELECT *, substr(t, pos) AS s FROM ext1),
ext3 AS (SELECT *, least({", ".join(f"CASE WHEN strpos(s, {q(d)}) > 1 THEN strpos(s, {q(d)}) END" for d in O.SQL_ENDS)}) AS cut FROM ext2),
extracted AS (SELECT example_id, gold_sql,
  CASE WHEN pos > 0 THEN {O.strip("regexp_replace(CASE WHEN cut IS NULL THEN s ELSE substr(s, 1, cut - 1) END, ';+$', '')")} ELSE t END AS generated_sql
  FROM ext3)"""


@register("SC-4", O.with_(EX, MODEL_TEXT, EXTRACT) + "SELECT example_id, generated_sql FROM extracted")
def sc4(spark, sf):
    m = A.model_text(spark, sf)
    return m.select("example_id", T.extract_sql(F.col("model_text")).alias("generated_sql"))


@register("SC-8", O.with_(EX, MODEL_TEXT, EXTRACT) + f"""SELECT example_id,
  lower({O.strip('generated_sql')}) = lower({O.strip('gold_sql')}) AS exact_match FROM extracted""")
def sc8(spark, sf):
    m = A.model_text(spark, sf)
    return m.select("example_id", T.exact_match(T.extract_sql(F.col("model_text")), F.col("gold_sql"))
                    .alias("exact_match"))


@register("SC-5", O.with_(EX) + f"SELECT example_id, array_to_string({O.complexity_tags('sql')}, ',') AS tags FROM examples")
def sc5(spark, sf):
    return A.examples(spark, sf).select("example_id", F.array_join(T.complexity_tags("sql"), ",").alias("tags"))


@register("SC-9", O.with_(EX, ER) + f"""SELECT example_id, CASE WHEN error IS NOT NULL THEN {_error_class_sql('error')} END AS error_class
FROM eval_results""")
def sc9(spark, sf):
    r = A.eval_results(spark, sf)
    return r.select("example_id", F.when(F.col("error").isNotNull(), T.error_class("error")).alias("error_class"))


def _py_bool_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'None' WHEN {x} THEN 'True' ELSE 'False' END"


@register("SC-16", O.with_(EX, ER) + f"""SELECT example_id, 'Pred: ' || coalesce(generated_sql, 'None') || chr(10) || 'Gold: ' ||
  coalesce(gold_sql, 'None') || chr(10) || 'Match: ' || {_py_bool_sql('results_match')} || chr(10) || 'Error: ' ||
  coalesce(error, 'None') AS evidence FROM eval_results""")
def sc16(spark, sf):
    r = A.eval_results(spark, sf)
    return r.select("example_id", T.evidence_text(F.col("generated_sql"), F.col("gold_sql"),
                                                  F.col("results_match"), F.col("error")).alias("evidence"))


@register("SC-19", O.with_(EX, ER) + """SELECT DISTINCT method, array_to_string(list_transform(string_split(replace(method, '_', ' '), ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM eval_results""")
def sc19(spark, sf):
    r = A.eval_results(spark, sf)
    return r.select("method", T.method_label("method").alias("label")).distinct()


@register("SC-11", O.with_(EX) + f"""SELECT example_id, CASE WHEN regexp_matches(t, '(?i)question:[{O.WS}]*([^\\n]+)')
  THEN regexp_extract(t, '(?i)question:[{O.WS}]*([^\\n]+)', 1) ELSE t END AS question FROM (
  SELECT example_id, CASE WHEN example_id % 2 = 0 THEN 'Schema: ' || context || chr(10) || 'QUESTION: ' || question || chr(10) || 'SQL:'
    ELSE question END AS t FROM examples)""")
def sc11(spark, sf):
    ex = A.examples(spark, sf)
    t = F.when(F.col("example_id") % 2 == 0,
               F.concat(F.lit("Schema: "), F.col("context"), F.lit("\nQUESTION: "), F.col("question"), F.lit("\nSQL:"))) \
        .otherwise(F.col("question"))
    return ex.select("example_id", T.question_after_marker(t).alias("question"))


@register("SC-14", O.with_(EX) + f"""SELECT example_id, {O.strip("regexp_replace(" + O.strip("string_split(t, '### Response:')[-1]") + ", ';+$', '')")} AS sql
FROM (SELECT example_id, ' ### Instruction: ' || question || chr(10) || chr(10) || ' ### Response:' || chr(10) || sql AS t FROM examples)""")
def sc14(spark, sf):
    ex = A.examples(spark, sf)
    t = F.concat(F.lit(" ### Instruction: "), F.col("question"), F.lit("\n\n ### Response:\n"), F.col("sql"))
    return ex.select("example_id", T.response_tail(t).alias("sql"))


@register("SC-17", O.with_(EX) + f"SELECT example_id, {O.from_tables('sql')} AS tables FROM examples")
def sc17(spark, sf):
    return A.examples(spark, sf).select("example_id", F.array_join(T.from_tables("sql"), "|").alias("tables"))


# --- scoring of stored result tables ------------------------------------------------------------------

# Pairs whose prediction is blank, whose prediction failed, and whose gold query failed.
BLANK, FAILED, GOLD_FAILED = 13, 7, 11


def scored_pairs(spark, sf) -> DataFrame:
    """Stored outcomes of each pair: compared rows, which side ran, the generated text, and the score."""
    c = F.col("pair_id")
    text = F.when(c % BLANK == 0, F.lit(" \n")).otherwise(A.sql_template(c))
    r = CMP.compare_results(A.result_rows(spark, sf), A.result_pairs(spark, sf))
    return CMP.score(r.withColumns({"generated_sql": text, "gen_ok": c % FAILED != 0, "gold_ok": c % GOLD_FAILED != 0}))


_ST2 = ORACLES["ST-2"]
_PAIRS = f"""SELECT pair_id, CASE WHEN pair_id % 13 = 0 THEN ' ' || chr(10) ELSE {O.sql_template('pair_id')} END AS generated_sql,
  pair_id % 7 <> 0 AS is_valid, pair_id % 11 <> 0 AS gold_valid,
  pair_id % 7 <> 0 AND pair_id % 11 <> 0 AND results_match AS results_match,
  CAST(pair_id % 13 <> 0 AND pair_id % 7 <> 0 AND pair_id % 11 <> 0 AND results_match AS INTEGER) AS score FROM ({_ST2})"""


@register("EX-2", f"SELECT pair_id, score FROM ({_PAIRS})")
def ex2(spark, sf):
    return scored_pairs(spark, sf).select("pair_id", "score")


@register("EX-3", f"""SELECT pair_id, is_valid, gold_valid, results_match, score,
  array_to_string({O.complexity_tags('generated_sql')}, ',') AS complexity FROM ({_PAIRS})""")
def ex3(spark, sf):
    r = scored_pairs(spark, sf)
    return r.select("pair_id", F.col("gen_ok").alias("is_valid"), F.col("gold_ok").alias("gold_valid"),
                    (F.col("gen_ok") & F.col("gold_ok") & F.col("results_match")).alias("results_match"), "score",
                    F.array_join(T.complexity_tags("generated_sql"), ",").alias("complexity"))

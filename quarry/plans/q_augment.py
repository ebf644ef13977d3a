"""Registered augmentation, few-shot and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import oracle as O
from quarry.operators import augment as AU
from quarry.operators import fewshot as FS
from quarry.plans.registry import register
from quarry.sources import adapters as A
from quarry.sources import jsonl as J
from quarry.streaming import augment_stream as STR

q = O.q

QA = """qa AS (SELECT p_partkey AS example_id,
  CASE p_partkey % 5 WHEN 0 THEN 'What is the price of ' || p_name || '?' WHEN 1 THEN 'How many ' || p_name || ' are there?'
    WHEN 2 THEN 'Find ' || p_name || '.' WHEN 3 THEN 'List all ' || p_name || '.' ELSE 'Which ' || p_brand || '?' END AS question,
  CASE p_partkey % 4 WHEN 0 THEN 'SELECT price FROM product WHERE name = ''' || p_name || ''''
    WHEN 1 THEN 'SELECT COUNT(*) FROM order WHERE product_id = ' || p_partkey
    WHEN 2 THEN 'SELECT name FROM customer ORDER BY name LIMIT ' || p_size
    ELSE 'SELECT p.name, o.qty FROM product p JOIN order o ON p.id = o.product_id ORDER BY o.qty DESC;' END AS sql,
  'shop' AS db_id,
  CASE p_partkey % 3 WHEN 0 THEN ['product', 'Order'] WHEN 1 THEN ['customer'] END AS table_names,
  CASE p_partkey % 3 WHEN 0 THEN ['name', 'price', 'qty'] WHEN 1 THEN []::VARCHAR[] END AS columns,
  p_partkey % 3 <> 2 AS has_schema
  FROM part)"""


def _draw_sql(purpose: str, *extra: str) -> str:
    parts = ", ".join([q("42"), "CAST(example_id AS VARCHAR)", q(purpose)] + [f"CAST({e} AS VARCHAR)" for e in extra])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8)) AS UBIGINT)"


def _para_sql() -> str:
    cands = [f"regexp_replace(question, {q('(?i)' + p)}, {q(r)}, 'g')" for p, r in O.PARAPHRASES]
    kept = []
    for i, c in enumerate(cands):
        prev = f" AND {c} NOT IN ({', '.join(cands[:i])})" if i else ""
        kept.append(f"CASE WHEN {c} <> question{prev} THEN {c} END")
    return f"list_filter([{', '.join(kept)}], lambda x: x IS NOT NULL)[1:2]"


_syn = " ".join(f"WHEN {q(k)} THEN [{', '.join(q(s) for s in v)}]" for k, v in O.SYNONYMS.items())


def _options(t: str) -> str:
    return f"(CASE lower({t}) {_syn} ELSE [lower({t})] END)"


def _rename_sql() -> str:
    s = "sql"
    for i in (1, 2):
        t = f"table_names[{i}]"
        opts = _options(t)
        new = f"{opts}[CAST({_draw_sql('rename', str(i - 1))} % len({opts}) + 1 AS BIGINT)]"
        s = f"(CASE WHEN {t} IS NULL THEN {s} ELSE regexp_replace({s}, '(?i)\\b\\Q' || {t} || '\\E\\b', {new}, 'g') END)"
    return s


AUG = O.with_(QA, f"""qa2 AS (SELECT *, {_para_sql()} AS para, {_rename_sql()} AS renamed,
  CASE WHEN strpos(upper(sql), 'LIMIT') > 0 THEN sql ELSE regexp_replace(sql, '[;]+$', '') || ' LIMIT ' ||
    [5, 10, 20, 50, 100][CAST({_draw_sql('limit')} % 5 + 1 AS BIGINT)] END AS limited,
  CASE WHEN strpos(upper(sql), 'ORDER BY') > 0 THEN sql ELSE regexp_replace(sql, '[;]+$', '') || ' ORDER BY ' ||
    columns[CAST({_draw_sql('order_col')} % greatest(len(columns), 1) + 1 AS BIGINT)] || ' ' ||
    ['ASC', 'DESC'][CAST({_draw_sql('order_dir')} % 2 + 1 AS BIGINT)] END AS ordered,
  regexp_replace(regexp_replace(sql, {q('(?i)' + O.ORDER_BY_CLAUSE)}, '', 'g'), {q('(?i)' + O.LIMIT_CLAUSE)}, '', 'g') AS simple
  FROM qa)""", """cands AS (
  SELECT example_id, 1 AS ord, 'original' AS augmentation, question, sql, db_id, false AS checked, true AS present FROM qa2
  UNION ALL SELECT example_id, 2, 'paraphrase', para[1], sql, db_id, false, len(para) >= 1 FROM qa2
  UNION ALL SELECT example_id, 3, 'paraphrase', para[2], sql, db_id, false, len(para) >= 2 FROM qa2
  UNION ALL SELECT example_id, 4, 'schema_shuffle', question, renamed, db_id || '_shuffled', true, true FROM qa2
  UNION ALL SELECT example_id, 5, 'add_limit', question || ' (top results)', limited, db_id, true, has_schema FROM qa2
  UNION ALL SELECT example_id, 6, 'add_order', question || ' (sorted)', ordered, db_id, true,
    has_schema AND coalesce(len(columns), 0) > 0 FROM qa2
  UNION ALL SELECT example_id, 7, 'simplify', question, simple, db_id, true, simple <> sql FROM qa2)""",
               f"""typed AS (SELECT *, {O.statement_type('sql')} = 'SELECT' AS ok FROM cands WHERE present)""",
               """kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY example_id ORDER BY ord) - 1 AS INTEGER) AS variant
  FROM typed WHERE NOT checked OR ok)""",
               "variants AS (SELECT example_id, variant, augmentation, question, sql, db_id FROM kept WHERE variant < 4 AND ok)")


def _aug(spark, sf):
    return AU.variations(A.questions_aug(spark, sf), 3)


@register("AU-6", AUG + "SELECT * FROM variants")
def au6(spark, sf):
    return _aug(spark, sf)


@register("FLT-7", AUG + "SELECT augmentation, CAST(count(*) AS BIGINT) AS n FROM variants GROUP BY 1")
def flt7(spark, sf):
    return _aug(spark, sf).groupBy("augmentation").agg(F.count(F.lit(1)).alias("n"))


@register("AU-1", O.with_(QA) + f"SELECT example_id, array_to_string({_para_sql()}, '|') AS paraphrases FROM qa")
def au1(spark, sf):
    d = A.questions_aug(spark, sf)
    return d.select("example_id", F.array_join(AU.paraphrases(F.col("question"), 2), "|").alias("paraphrases"))


@register("AU-2", O.with_(QA) + f"SELECT example_id, {_rename_sql()} AS sql, db_id || '_shuffled' AS db_id FROM qa")
def au2(spark, sf):
    d = A.questions_aug(spark, sf)
    return d.select("example_id", AU.rename_tables(F.col("sql"), F.col("schema.table_names"), "example_id").alias("sql"),
                    F.concat(F.col("db_id"), F.lit("_shuffled")).alias("db_id"))


@register("AU-3", AUG + "SELECT example_id, question || ' (top results)' AS question, limited AS sql FROM qa2 WHERE has_schema")
def au3(spark, sf):
    d = A.questions_aug(spark, sf).filter(F.col("schema").isNotNull())
    return d.select("example_id", F.concat("question", F.lit(" (top results)")).alias("question"),
                    AU.add_limit(F.col("sql"), "example_id").alias("sql"))


@register("AU-4", AUG + """SELECT example_id, question || ' (sorted)' AS question, ordered AS sql FROM qa2
WHERE has_schema AND coalesce(len(columns), 0) > 0""")
def au4(spark, sf):
    d = A.questions_aug(spark, sf).filter(F.coalesce(F.size("schema.columns"), F.lit(0)) > 0)
    return d.select("example_id", F.concat("question", F.lit(" (sorted)")).alias("question"),
                    AU.add_order_by(F.col("sql"), F.col("schema.columns"), "example_id").alias("sql"))


@register("AU-5", O.with_(QA) + f"""SELECT example_id, regexp_replace(regexp_replace(sql, {q('(?i)' + O.ORDER_BY_CLAUSE)}, '', 'g'),
  {q('(?i)' + O.LIMIT_CLAUSE)}, '', 'g') AS simplified FROM qa""")
def au5(spark, sf):
    d = A.questions_aug(spark, sf)
    return d.select("example_id", AU.simplify(F.col("sql")).alias("simplified"))


@register("AG-13", AUG + """SELECT (SELECT count(*) FROM qa) AS n_original, (SELECT count(*) FROM variants) AS n_generated,
  CAST((SELECT count(*) FROM variants) AS DOUBLE) / (SELECT count(*) FROM qa) AS expansion_rate""")
def ag13(spark, sf):
    d = A.questions_aug(spark, sf)
    return AU.expansion(d, AU.variations(d, 3))


def feed_lines(spark, sf, damaged: bool) -> str:
    """The augmentable rows as JSON Lines in a feed folder; damaged: every 11th line is cut short, every 7th lacks its SQL."""
    d, i = A.questions_aug(spark, sf), F.col("example_id")
    keep = {"ignoreNullFields": "false"}
    line = F.to_json(F.struct(*d.columns), keep)
    if damaged:
        line = F.when(i % 7 == 0, F.to_json(F.struct(*[c for c in d.columns if c != "sql"]), keep)).otherwise(line)
        line = F.when(i % 11 == 0, F.concat(line, F.lit("}"))).otherwise(line)
    feed = J.scratch_path(spark, "feed")
    d.select(line.alias("value")).write.text(feed)
    return feed


@register("STR-1", AUG + "SELECT * FROM variants")
def str1(spark, sf):
    """Write the augmentable rows as JSONL files into a feed folder, stream them through, read the sink."""
    out = STR.run_available(spark, feed_lines(spark, sf, False), J.scratch_path(spark, "sink"), J.scratch_path(spark, "stream-ckpt"))
    return out.select("example_id", "variant", "augmentation", "question", "sql", "db_id")


@register("STR-1-ACCOUNTS", O.with_(QA) + f"""SELECT count(*) AS lines, count(*) FILTER (WHERE example_id % 11 = 0) AS skipped,
  count(*) FILTER (WHERE example_id % 11 <> 0 AND example_id % 7 = 0) AS absent,
  count(*) FILTER (WHERE example_id % 11 <> 0 AND example_id % 7 <> 0 AND {O.validity_reason('sql')} IS NOT NULL) AS rejected,
  count(*) FILTER (WHERE example_id % 11 <> 0 AND example_id % 7 <> 0 AND {O.validity_reason('sql')} IS NULL) AS passed FROM qa""")
def str1_accounts(spark, sf):
    """The stream's accounts over a feed with unparsable lines and absent keys."""
    sink = J.scratch_path(spark, "sink")
    STR.run_available(spark, feed_lines(spark, sf, True), sink, J.scratch_path(spark, "stream-ckpt"))
    return STR.totals(spark, sink)


# --- few-shot ------------------------------------------------------------------------------------------

@register("JN-4", O.with_(O.EXAMPLES, """pos AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS i FROM examples)""",
                          """want AS (SELECT example_id, i, unnest(CASE WHEN i = 0 THEN [1, 2] WHEN i = 1 THEN [0]
    WHEN i <= 5 THEN [0, 1] ELSE [i - 5, i - 4] END) AS shot_pos,
    unnest(CASE WHEN i = 0 THEN [1, 2] WHEN i = 1 THEN [1] WHEN i <= 5 THEN [1, 2] ELSE [1, 2] END) AS shot_rank FROM pos)""")
    + """SELECT w.example_id, CAST(w.shot_rank AS INTEGER) AS shot_rank, p.example_id AS shot_example_id
FROM want w JOIN pos p ON p.i = w.shot_pos""")
def jn4(spark, sf):
    return FS.positional_shots(A.examples(spark, sf).select("example_id"))


@register("JN-5", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_dot_product(a.v, b.v) AS sim
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbour_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id FROM r WHERE rank <= 2""")
def jn5(spark, sf):
    e = A.embeddings(spark, sf)
    return FS.knn(e, e, k=2, exclude_self=True)


@register("JN-5-INDEX", "SELECT 2 * count(*) AS n_neighbours, true AS recall_reached FROM embeddings WHERE (SELECT count(*) FROM embeddings) > 2")
def jn5_index(spark, sf):
    """JN-5 among the candidates of a random-projection index, held against the exact answer: recall of at least 0.9."""
    e = A.embeddings(spark, sf)
    found = FS.knn(e, e, k=2, exclude_self=True, index=FS.fit_index(e, k=2))
    return FS.recall(FS.knn(e, e, k=2, exclude_self=True), found).select("n_neighbours", (F.col("recall") >= 0.9).alias("recall_reached"))


@register("SC-12-FEWSHOT", O.with_(O.EXAMPLES, """pos AS (SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS i FROM examples)""",
                                   """want AS (SELECT example_id, i, unnest(CASE WHEN i = 0 THEN [1, 2] WHEN i = 1 THEN [0]
    WHEN i <= 5 THEN [0, 1] ELSE [i - 5, i - 4] END) AS shot_pos,
    unnest(CASE WHEN i = 1 THEN [1] ELSE [1, 2] END) AS shot_rank FROM pos)""",
                                   """blocks AS (SELECT w.example_id, string_agg('**Example ' || w.shot_rank || ':**' || chr(10) ||
    'Schema: ' || coalesce(s.context, 'N/A') || chr(10) || 'Question: ' || s.question || chr(10) || 'SQL: ' ||
    coalesce(s.sql, '') || chr(10) || chr(10), '' ORDER BY w.shot_rank) AS body
  FROM want w JOIN pos p ON p.i = w.shot_pos JOIN examples s ON s.example_id = p.example_id GROUP BY 1)""")
    + f"""SELECT e.example_id, {q(O.FEW_SHOT_HEAD)} || coalesce(b.body, '') ||
  '### Now convert this question:' || chr(10) || 'Schema:' || chr(10) || e.context || chr(10) || chr(10) ||
  'Question: ' || e.question || chr(10) || chr(10) || 'SQL Query:' || chr(10) AS prompt
FROM examples e LEFT JOIN blocks b USING (example_id)""")
def sc12_fewshot(spark, sf):
    """SC-12 few-shot prompt with the positional shots of JN-4 (at most two per row)."""
    from quarry.functions import prompts as P
    ex = A.examples(spark, sf).select("example_id", "question", "sql", "context")
    shots = FS.positional_shots(ex.select("example_id"))
    sx = ex.select(F.col("example_id").alias("shot_example_id"),
                   F.struct("context", "question", "sql").alias("shot"))
    g = shots.join(sx, "shot_example_id").groupBy("example_id").agg(
        F.array_sort(F.collect_list(F.struct("shot_rank", "shot"))).alias("_s"))
    g = g.select("example_id", F.transform("_s", lambda x: x["shot"]).alias("shots"))
    j = ex.join(g, "example_id", "left").withColumn("shots", F.coalesce("shots", F.array().cast(
        "array<struct<context:string,question:string,sql:string>>")))
    return j.select("example_id", P.few_shot_prompt(F.col("shots")).alias("prompt"))

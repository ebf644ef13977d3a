"""Registered training-set assembly queries: union, mixing, split, sampling, templates, chat, sinks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry import oracle as O
from quarry.functions import prompts as P
from quarry.operators import dedup as D
from quarry.operators import evaluation as E
from quarry.operators import mixing as M
from quarry.plans.q_corpus import raw_sources
from quarry.plans.registry import register
from quarry.sources import adapters as A
from quarry.sources import jsonl as J

EX, CL, ER = O.EXAMPLES, O.CLASSIFIED, O.EVAL_RESULTS
q = O.q

# --- fixed values: training mix weights (the training configuration's, not the recommended table's) ----
TRAIN_WEIGHTS = {"spider": 0.4, "sqale": 0.3, "sql_context": 0.15, "gretel": 0.1, "know_sql": 0.05}


def _kept(spark, sf):
    return D.dedup(A.examples(spark, sf))


@register("ST-1", O.with_(EX) + """SELECT example_id, question, sql AS query, db_id, NULL::VARCHAR AS schema,
  NULL::VARCHAR AS sql_prompt, NULL::VARCHAR AS sql, NULL::VARCHAR AS sql_context, NULL::VARCHAR AS answer, NULL::VARCHAR AS context
  FROM examples WHERE source_dataset = 'spider'
UNION ALL SELECT example_id, question, sql, NULL, context || chr(10) || question, NULL, NULL, NULL, NULL, NULL
  FROM examples WHERE source_dataset = 'sqale'
UNION ALL SELECT example_id, NULL, NULL, NULL, NULL, question, sql, context, NULL, NULL FROM examples WHERE source_dataset = 'gretel'
UNION ALL SELECT example_id, question, NULL, NULL, NULL, NULL, NULL, NULL, sql, context FROM examples WHERE source_dataset = 'sql_context'
UNION ALL SELECT example_id, question, NULL, NULL, NULL, NULL, NULL, NULL, sql, NULL FROM examples WHERE source_dataset = 'know_sql'""")
def st1(spark, sf):
    return M.union_all(list(raw_sources(spark, sf).values()))


def _hash_sql(seed, *cols: str) -> str:
    return "md5(concat_ws(':', " + ", ".join([q(str(seed))] + [f"CAST({c} AS VARCHAR)" for c in cols]) + "))"


def _u_sql(seed, *cols: str) -> str:
    return f"CAST(('0x' || substr({_hash_sql(seed, *cols)}, 1, 8)) AS UBIGINT) / 4294967296.0"


# The oracle states the weights by itself.
_w = "WHEN 'spider' THEN 0.4 WHEN 'sqale' THEN 0.3 WHEN 'sql_context' THEN 0.15 WHEN 'gretel' THEN 0.1 WHEN 'know_sql' THEN 0.05"

MIX_SQL = O.with_(EX, CL, f"""cnt AS (SELECT source_dataset, count(*) AS n, CAST(CASE source_dataset {_w} END AS DOUBLE) AS w
  FROM winners GROUP BY 1)""", """pr AS (SELECT *, w / sum(w) OVER () AS p FROM cnt WHERE n > 0 AND w > 0)""",
                  """quota AS (SELECT source_dataset, round(p * (SELECT max(n / p) FROM pr) / n, 12) AS qq FROM pr)""",
                  f"""copies AS (SELECT w.example_id, w.source_dataset,
    CAST(floor(qq) + CASE WHEN {_u_sql(42, 'w.example_id')} < qq - floor(qq) THEN 1 ELSE 0 END AS INTEGER) AS c
  FROM winners w JOIN quota USING (source_dataset))""") + f"""
SELECT example_id, source_dataset, copy, {_hash_sql(42, 'example_id', 'copy')} AS mix_key
FROM (SELECT example_id, source_dataset, unnest(range(c)) AS copy FROM copies WHERE c > 0)"""


@register("ST-3", MIX_SQL)
def st3(spark, sf):
    kept = _kept(spark, sf).select("example_id", "source_dataset")
    return M.interleave(kept, "source_dataset", "example_id", TRAIN_WEIGHTS, "all_exhausted") \
        .select("example_id", "source_dataset", F.col("copy").cast("long").alias("copy"), "mix_key")


@register("ST-4", O.with_(EX) + f"""SELECT example_id, CASE WHEN substr({_hash_sql(42, 'example_id')}, 1, 8) < '051eb851'
  THEN 'validation' ELSE 'train' END AS split FROM examples""")
def st4(spark, sf):
    return M.split_train_val(A.examples(spark, sf).select("example_id"), "example_id", 0.02, 42)


@register("SO-4", O.with_(EX) + f"""SELECT example_id, question FROM examples
ORDER BY {_hash_sql(7, 'example_id')}, example_id LIMIT 100""")
def so4(spark, sf):
    return M.sample_n(A.examples(spark, sf).select("example_id", "question"), 100, "example_id", seed=7)


@register("SO-5", O.with_(EX) + f"""SELECT example_id, rank, CASE WHEN rank < 800 THEN 'train' ELSE 'val' END AS slice FROM (
  SELECT example_id, row_number() OVER (ORDER BY {_hash_sql(42, 'example_id')}, example_id) - 1 AS rank FROM examples)
WHERE rank < 900""")
def so5(spark, sf):
    s = M.seeded_slices(A.examples(spark, sf).select("example_id"), [800, 100], "example_id", 42, ["train", "val"])
    return s.select("example_id", F.col("rank").cast("long").alias("rank"), "slice")


# --- templates ------------------------------------------------------------------------------------------

def _template_sql(tid: str, schema="context", question="question", sql="sql", db_id="db_id") -> str:
    def val(c):
        v = f"coalesce({c}, '')"
        return O.strip(v) if tid in O.TRIMMED else v
    slots = {"schema": val(schema), "question": val(question), "sql": val(sql), "db_id": val(db_id),
             "eos": q(O.EOS)}

    def fill(t):
        parts, pos = [], 0
        for m in re.finditer(r"\{(\w+)\}", t):
            if m.start() > pos:
                parts.append(q(t[pos:m.start()]))
            parts.append(slots[m.group(1)])
            pos = m.end()
        if pos < len(t):
            parts.append(q(t[pos:]))
        return "(" + " || ".join(parts) + ")"
    slots["instruction"] = fill(O.INSTRUCTION)
    return fill(O.TEMPLATES[tid])


@register("SC-12", O.with_(EX) + "\nUNION ALL\n".join(
    f"SELECT example_id, {q(t)} AS template, {_template_sql(t)} AS text FROM examples" for t in O.TEMPLATES))
def sc12(spark, sf):
    ex = A.examples(spark, sf)
    frames = [ex.select("example_id", F.lit(t).alias("template"), P.render(t).alias("text")) for t in P.TEMPLATES]
    return M.union_all(frames)


@register("FLT-5", O.with_(EX) + f"""SELECT example_id, text FROM (SELECT example_id, {_template_sql('published', sql="''", schema="''", db_id="''")} AS text FROM examples)
WHERE length(text) > 10""")
def flt5(spark, sf):
    ex = A.examples(spark, sf)
    t = P.render("published", schema=F.lit(""), question=F.col("question"), sql=F.lit(""),
                 db_id=F.lit(""))
    return P.keep_long_texts(ex.select("example_id", t.alias("text")))


@register("FLT-6", O.with_(EX) + """SELECT example_id, context AS schema FROM examples
WHERE coalesce(context, '') <> '' AND NOT starts_with(context, 'Database:')""")
def flt6(spark, sf):
    ex = A.examples(spark, sf).select("example_id", F.col("context").alias("schema"))
    return P.usable_schema(ex)


@register("SC-13", O.with_(EX, f"""t AS (SELECT example_id, CASE WHEN example_id % 9 = 0 THEN {_template_sql('published')}
  ELSE {_template_sql('train_response_only')} END AS text FROM examples)""") + """SELECT example_id,
  strpos(text, '### Response:') > 0 AS has_response_marker,
  CASE WHEN strpos(text, '### Response:') > 0 THEN substr(text, 1, strpos(text, '### Response:') - 1) END AS prompt_part,
  CASE WHEN strpos(text, '### Response:') > 0 THEN substr(text, strpos(text, '### Response:') + 13) END AS response_part
FROM t""")
def sc13(spark, sf):
    ex = A.examples(spark, sf)
    t = F.when(F.col("example_id") % 9 == 0, P.render("published")).otherwise(P.render("train_response_only"))
    return ex.select("example_id", t.alias("text")).select("example_id", *P.response_mask("text"))


CHAT_SQL = f"""WITH m AS (SELECT conv_id, turn, role, text,
    max(CASE WHEN turn = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_sys,
    max(CASE WHEN turn = 0 AND role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys
  FROM conversations),
loop AS (SELECT *, turn - has_sys AS pos FROM m WHERE NOT (has_sys = 1 AND turn = 0)),
pieces AS (SELECT conv_id, pos, role = 'user' AND pos % 2 = 0 OR role <> 'user' AND pos % 2 = 1 AS ok,
  {O.strip("CASE WHEN pos = 0 AND has_sys = 1 THEN '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) || text ELSE text END")} AS c, role
  FROM loop),
agg AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '<s>[INST] ' || c || ' [/INST]'
    WHEN role = 'assistant' THEN ' ' || c || ' </s>' ELSE '' END, '' ORDER BY pos) AS text,
  bool_and(ok) AS is_valid, count(*) AS n_messages FROM pieces GROUP BY 1)
SELECT c.conv_id, coalesce(a.text, '') AS text, coalesce(a.is_valid, true) AS is_valid,
  CAST(coalesce(a.n_messages, 0) AS INTEGER) AS n_messages
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN agg a USING (conv_id)"""


@register("SC-18", CHAT_SQL)
def sc18(spark, sf):
    return P.render_chats(A.table(spark, sf, "conversations"))


# --- sinks: write to the shared folder, read back -------------------------------------------------------

WINNERS_SQL = O.with_(EX, CL) + "SELECT example_id, source_dataset, question, sql FROM winners"


@register("SNK-1", WINNERS_SQL)
def snk1(spark, sf):
    path = J.scratch_path(spark, "kept")
    J.write_jsonl(_kept(spark, sf).select("example_id", "source_dataset", "question", "sql"), path)
    return spark.read.schema("example_id long, source_dataset string, question string, sql string").json(path)


@register("SNK-2", WINNERS_SQL)
def snk2(spark, sf):
    path = J.scratch_path(spark, "by_source")
    J.write_jsonl(_kept(spark, sf).select("example_id", "source_dataset", "question", "sql"), path,
                  partition_by=["source_dataset"])
    return spark.read.schema("example_id long, question string, sql string, source_dataset string").json(path)


@register("SNK-3", O.with_(EX, ER) + "SELECT example_id, method, is_valid, results_match, error FROM eval_results")
def snk3(spark, sf):
    path = J.scratch_path(spark, "eval")
    J.write_jsonl(A.eval_results(spark, sf).select("example_id", "method", "is_valid", "results_match", "error"),
                  path, partition_by=["method"])
    return spark.read.schema("example_id long, is_valid boolean, results_match boolean, error string, method string") \
        .json(path)


@register("SNK-4", O.with_(EX, ER, "m AS (" + __import__("quarry.plans.q_eval", fromlist=["x"]).METRICS_SQL + ")")
          + "SELECT method, total_examples, valid_sql_count, result_match_count FROM m")
def snk4(spark, sf):
    path = J.scratch_path(spark, "summary")
    m = E.metrics(A.eval_results(spark, sf))
    summary = m.select("method", F.struct("total_examples", "valid_sql_count", "result_match_count",
                                          "valid_sql_pct", "result_match_pct").alias("metrics"))
    J.write_jsonl(summary.coalesce(1), path)
    back = spark.read.schema("method string, metrics struct<total_examples:long, valid_sql_count:long, "
                             "result_match_count:long, valid_sql_pct:double, result_match_pct:double>").json(path)
    return back.select("method", "metrics.total_examples", "metrics.valid_sql_count", "metrics.result_match_count")


@register("ST-3-FE", MIX_SQL.replace("(SELECT max(n / p) FROM pr)", "(SELECT min(n / p) FROM pr)"))
def st3_fe(spark, sf):
    """ST-3 with the first-exhausted strategy (every source under-sampled to the scarcest one's pace)."""
    kept = _kept(spark, sf).select("example_id", "source_dataset")
    return M.interleave(kept, "source_dataset", "example_id", TRAIN_WEIGHTS, "first_exhausted") \
        .select("example_id", "source_dataset", F.col("copy").cast("long").alias("copy"), "mix_key")

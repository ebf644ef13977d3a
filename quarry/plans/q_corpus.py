"""Registered corpus-preparation queries: sources, validation, keys, dedup, ledger, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry import oracle as O
from quarry.functions import text as T
from quarry.operators import catalog as C
from quarry.operators import dedup as D
from quarry.operators import stats as S
from quarry.plans.registry import register
from quarry.sources import adapters as A
from quarry.sources import jsonl as J

EX = O.EXAMPLES
CL = O.CLASSIFIED


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    return A.examples(spark, sf)


# --- scalar keys and checks ---------------------------------------------------------------------

@register("SC-1", O.with_(EX) + f"SELECT example_id, {O.norm_question('question')} AS question_norm FROM examples")
def sc1(spark, sf):
    return _examples(spark, sf).select("example_id", T.normalize_question("question").alias("question_norm"))


@register("SC-2", O.with_(EX) + f"SELECT example_id, md5({O.norm_question('question')}) AS q_hash FROM examples")
def sc2(spark, sf):
    return _examples(spark, sf).select("example_id", T.question_hash("question").alias("q_hash"))


@register("SC-3", O.with_(EX) + f"SELECT example_id, {O.norm_sql('sql')} AS sql_norm FROM examples")
def sc3(spark, sf):
    return _examples(spark, sf).select("example_id", T.normalize_sql("sql").alias("sql_norm"))


@register("SC-10", O.with_(EX) + f"SELECT example_id, {O.statement_type('sql')} AS statement_type FROM examples")
def sc10(spark, sf):
    return _examples(spark, sf).select("example_id", T.statement_type("sql").alias("statement_type"))


@register("FLT-3", O.with_(EX) + f"SELECT example_id, {O.dialect_reason('sql')} AS reason FROM examples")
def flt3(spark, sf):
    return _examples(spark, sf).select("example_id", T.dialect_reason("sql").alias("reason"))


@register("FLT-4", O.with_(EX) + f"""SELECT example_id, {O.statement_type('sql')} AS statement_type FROM examples
WHERE {O.dialect_reason('sql')} IS NULL AND {O.statement_type('sql')} IN ('SELECT','INSERT','UPDATE','DELETE','CREATE','ALTER','DROP')""")
def flt4(spark, sf):
    df = _examples(spark, sf).withColumn("statement_type", T.statement_type("sql"))
    return df.filter(T.validity_reason("sql", stype=F.col("statement_type")).isNull()) \
             .select("example_id", "statement_type")


@register("FLT-1", O.with_(EX) + "SELECT example_id FROM examples WHERE length(question) > 0 AND length(sql) > 0")
def flt1(spark, sf):
    return _examples(spark, sf).filter((F.length("question") > 0) & (F.length("sql") > 0)).select("example_id")


# --- JSON lines: SRC-1 / FLT-2 over lines derived from documents ----------------------------------
# Lines are the examples serialized as JSON. Every 17th lacks its question key, every 23rd has a null question, every 29th
# holds a bare NaN; a cut end (every 13th), trailing text (19th), a raw tab in a string (31st) or single
# quotes (37th) make a line unparsable.

LINE_SCHEMA = Ty.StructType([Ty.StructField(n, Ty.StringType()) for n in ("question", "sql", "db_id", "context")]
                            + [Ty.StructField("example_id", Ty.LongType())])


def example_lines(spark, sf) -> DataFrame:
    i = F.col("example_id")
    question = F.when(i % 23 != 0, F.col("question")).alias("question")
    keep = {"ignoreNullFields": "false"}
    ex = _examples(spark, sf).withColumn(
        "_l", F.when(i % 17 == 0, F.to_json(F.struct("example_id", "sql", "db_id", "context"), keep))
        .otherwise(F.to_json(F.struct("example_id", question, "sql", "db_id", "context"), keep)))
    line = F.col("_l")
    line = F.when(i % 29 == 0, F.concat(F.lit('{"score": NaN, '), F.substring(line, 2, 1 << 30))).otherwise(line)
    line = F.when(i % 31 == 0, F.replace(line, F.lit('"db_id":"'), F.lit('"db_id":"\t'))).otherwise(line)
    line = F.when(i % 37 == 0, F.replace(line, F.lit('"'), F.lit("'"))).otherwise(line)
    line = F.when(i % 19 == 0, F.concat(line, F.lit(' {"more": 1}'))).otherwise(line)
    line = F.when(i % 13 == 0, F.expr("substring(_l, 1, length(_l) - 1)")).otherwise(line)
    return ex.select(line.alias("value"), "arrival")


_PARSES = "example_id % 13 <> 0 AND example_id % 19 <> 0 AND example_id % 31 <> 0 AND example_id % 37 <> 0"


@register("SRC-1", O.with_(EX) + f"""SELECT example_id, CASE WHEN example_id % 17 <> 0 AND example_id % 23 <> 0 THEN question END AS question,
  sql, example_id % 17 = 0 AS missing_field FROM examples WHERE {_PARSES}""")
def src1(spark, sf):
    p = J.parse_json_lines(example_lines(spark, sf), LINE_SCHEMA)
    return p.select("example_id", "question", "sql", "missing_field")


@register("FLT-2", O.with_(EX) + f"""SELECT count(*) FILTER (WHERE NOT ({_PARSES})) AS skipped,
  count(*) FILTER (WHERE {_PARSES} AND example_id % 17 = 0) AS missing,
  count(*) FILTER (WHERE {_PARSES} AND example_id % 17 <> 0 AND (example_id % 23 = 0 OR question IS NULL)) AS null_field,
  count(*) FILTER (WHERE {_PARSES} AND example_id % 17 <> 0 AND example_id % 23 <> 0 AND question IS NOT NULL) AS complete FROM examples""")
def flt2(spark, sf):
    return J.line_counts(example_lines(spark, sf))


# --- SRC-2: five source shapes unified ------------------------------------------------------------

def raw_sources(spark, sf) -> dict[str, DataFrame]:
    """Differently named source frames (the five public shapes), derived from the examples."""
    ex = _examples(spark, sf)
    by = {s: ex.filter(F.col("source_dataset") == s) for s in A.SOURCE_NAMES}
    return {
        "spider": by["spider"].select("example_id", "question", F.col("sql").alias("query"), "db_id"),
        "sqale": by["sqale"].select("example_id", "question", F.col("sql").alias("query"),
                                    F.concat_ws("\n", "context", "question").alias("schema")),
        "gretel": by["gretel"].select("example_id", F.col("question").alias("sql_prompt"), "sql",
                                      F.col("context").alias("sql_context")),
        "sql_context": by["sql_context"].select("example_id", "question", F.col("sql").alias("answer"), "context"),
        "know_sql": by["know_sql"].select("example_id", "question", F.col("sql").alias("answer")),
    }


def unified(spark, sf) -> DataFrame:
    frames = [J.unify_source(df, name) for name, df in raw_sources(spark, sf).items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@register("SRC-2", O.with_(EX) + """SELECT CASE source_dataset WHEN 'spider' THEN 'spider' WHEN 'sqale' THEN 'sqale'
  WHEN 'gretel' THEN 'gretel-synthetic' WHEN 'sql_context' THEN 'sql-context' ELSE 'know-sql' END AS dataset,
  source_dataset, example_id, question, sql,
  CASE WHEN source_dataset = 'spider' THEN db_id ELSE '' END AS db_id,
  CASE source_dataset WHEN 'spider' THEN 'Database: ' || db_id
       WHEN 'sqale' THEN substr(context || chr(10) || question, 1, 1000)
       WHEN 'know_sql' THEN '' ELSE context END AS context
FROM examples WHERE NOT (source_dataset = 'sqale' AND (length(question) = 0 OR length(sql) = 0))""")
def src2(spark, sf):
    return unified(spark, sf)


@register("PRJ-1", "SELECT doc_id, substr(text, 1, 1000) AS context, length(text) AS n_chars FROM documents")
def prj1(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", F.substring("text", 1, J.CONTEXT_MAX_CHARS).alias("context"),
                    F.length("text").cast("long").alias("n_chars"))


@register("PRJ-3", O.with_(EX) + """SELECT example_id, coalesce(question, '') AS question, coalesce(sql, '') AS query,
  coalesce(db_id, '') AS db_id, coalesce(context, '') AS context FROM examples""")
def prj3(spark, sf):
    ex = _examples(spark, sf)
    return ex.select("example_id", *[F.coalesce(F.col(a), F.lit("")).alias(b) for a, b in
                                     (("question", "question"), ("sql", "query"), ("db_id", "db_id"),
                                      ("context", "context"))])


@register("SRC-5", O.with_(EX, CL) + """SELECT example_id, question, sql, 'spider_dev' AS source_dataset
FROM statused WHERE status <> 'invalid'""")
def src5(spark, sf):
    c = D.classify(_examples(spark, sf))
    return c.filter(F.col("status") != D.INVALID).select(
        "example_id", "question", "sql", F.lit("spider_dev").alias("source_dataset"))


# --- dedup and ledger ---------------------------------------------------------------------------------

@register("AG-1", O.with_(EX, CL) + """SELECT example_id, source_dataset, question, sql, first_arrival FROM winners""")
def ag1(spark, sf):
    return D.dedup(_examples(spark, sf)).select("example_id", "source_dataset", "question", "sql", "first_arrival")


LEDGER_SQL = O.with_(EX, CL, """loaded AS (SELECT source_dataset, count(*) AS loaded,
    count(*) FILTER (WHERE status = 'invalid') AS invalid, count(*) FILTER (WHERE status = 'empty') AS empty,
    count(*) FILTER (WHERE status = 'invalid' AND reject_reason = 'Missing required field') AS missing_field
  FROM statused GROUP BY 1)""", """dups AS (SELECT r.source_dataset,
    count(*) FILTER (WHERE r.arrival <> r.first_arrival) AS dup_candidates,
    count(*) FILTER (WHERE r.priority < w.priority AND r.sql_norm <> w.sql_norm) AS conflicts,
    count(*) FILTER (WHERE r.key_rows > 1) AS rows_in_repeated_keys
  FROM (SELECT *, count(*) OVER (PARTITION BY q_hash) AS key_rows FROM ranked) r JOIN winners w USING (q_hash) GROUP BY 1)""",
                     "kept AS (SELECT source_dataset, count(*) AS kept FROM winners GROUP BY 1)",
                     """ledger AS (SELECT l.source_dataset, CAST(l.loaded AS BIGINT) AS loaded,
    CAST(l.invalid AS BIGINT) AS invalid, CAST(l.missing_field AS BIGINT) AS missing_field,
    CAST(l.empty + coalesce(d.dup_candidates, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(d.conflicts, 0) AS BIGINT) AS conflicts, CAST(coalesce(k.kept, 0) AS BIGINT) AS kept,
    CAST(coalesce(d.rows_in_repeated_keys, 0) AS BIGINT) AS rows_in_repeated_keys
  FROM loaded l LEFT JOIN dups d USING (source_dataset) LEFT JOIN kept k USING (source_dataset))""")


@register("AG-2", LEDGER_SQL + "SELECT * FROM ledger")
def ag2(spark, sf):
    return D.ledger(_examples(spark, sf))


@register("AG-3", LEDGER_SQL + """SELECT *, CAST(kept AS DOUBLE) * 100.0 / loaded AS retention_pct,
  CAST(kept AS DOUBLE) * 100.0 / CAST(sum(kept) OVER () AS DOUBLE) AS share_pct FROM ledger""")
def ag3(spark, sf):
    return D.with_ratios(D.ledger(_examples(spark, sf)))


@register("AG-8", LEDGER_SQL + """SELECT CAST(sum(loaded) AS BIGINT) AS total_loaded, CAST(sum(invalid) AS BIGINT) AS invalid,
  CAST(sum(invalid) - sum(missing_field) AS BIGINT) AS invalid_sql,
  CAST(sum(duplicate) AS BIGINT) AS duplicates, CAST(sum(conflicts) AS BIGINT) AS conflicts,
  CAST(sum(kept) AS BIGINT) AS valid_unique,
  coalesce(100.0 * CAST(sum(loaded) - sum(kept) AS DOUBLE) / CAST(sum(loaded) AS DOUBLE), 0.0) AS reduction_pct
FROM ledger""")
def ag8(spark, sf):
    return D.totals(_examples(spark, sf))


# --- corpus statistics over the kept rows --------------------------------------------------------------

def _kept(spark, sf, *payload):
    """Winners with only the given columns."""
    return D.dedup(_examples(spark, sf), payload=list(payload))


WORDS = f"list_filter(regexp_split_to_array(sql, '[{O.WS}]+'), lambda x: x <> '')"


@register("AG-9", O.with_(EX, CL) + f"""SELECT CAST(sum(len({WORDS})) AS DOUBLE) / count(*) AS avg_tokens,
  min(len({WORDS})) AS min_tokens, max(len({WORDS})) AS max_tokens FROM winners""")
def ag9(spark, sf):
    return S.sql_length_stats(_kept(spark, sf, S.token_count("sql").alias("n_tokens")), n_tokens="n_tokens")


@register("AG-10", O.with_(EX, CL) + f"""SELECT upper({WORDS}[1]) AS head, count(*) AS n FROM winners
GROUP BY 1 ORDER BY n DESC, head LIMIT 5""")
def ag10(spark, sf):
    return S.head_word_top(_kept(spark, sf, S.head_word("sql").alias("head")), k=5, head="head")


@register("SO-2", O.with_(EX, CL) + """SELECT source_dataset, count(*) AS n,
  CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE) AS pct FROM winners GROUP BY 1 ORDER BY n DESC, source_dataset LIMIT 3""")
def so2(spark, sf):
    return S.top_k_share(_kept(spark, sf, "source_dataset"), "source_dataset", k=3)


# Fixed values of the oracle: recommended weights and reasons.
@register("AG-11", O.with_(EX, CL) + """SELECT source_dataset, CAST(count(*) AS BIGINT) AS count,
  CAST(CASE source_dataset WHEN 'spider' THEN 0.5 WHEN 'sqale' THEN 0.3 WHEN 'gretel' THEN 0.15
       WHEN 'sql_context' THEN 0.03 WHEN 'know_sql' THEN 0.02 ELSE 0.1 END AS DOUBLE) AS weight,
  CASE source_dataset WHEN 'spider' THEN 'Benchmark quality, complex queries'
       WHEN 'sqale' THEN 'Real-world schema diversity' WHEN 'gretel' THEN 'High-quality synthetic data'
       WHEN 'sql_context' THEN 'Schema-aware supplementary data'
       WHEN 'know_sql' THEN 'Educational variety, lower complexity' ELSE 'General purpose' END AS reason,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total_examples, CAST(count(*) OVER () AS BIGINT) AS num_datasets
FROM winners GROUP BY 1""")
def ag11(spark, sf):
    from quarry.operators.mixing import weight_table
    return weight_table(_kept(spark, sf, "source_dataset"))


# --- catalog ------------------------------------------------------------------------------------------

SCHEMA_TEXT = """turns AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
firsts AS (SELECT conv_id, role, min(turn) AS ft FROM turns GROUP BY 1, 2),
tabs AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY ft) - 1 AS tidx FROM firsts),
render_lines AS (SELECT t.conv_id, tb.tidx,
    'CREATE TABLE ' || t.role || ' (' || string_agg('turn_' || t.turn || ' varchar(' || t.n || ')', ', ' ORDER BY t.turn) || ')' AS line
  FROM turns t JOIN tabs tb USING (conv_id, role) GROUP BY t.conv_id, tb.tidx, t.role),
schema_text AS (SELECT 'conv_' || conv_id AS db_id, string_agg(line, chr(10) ORDER BY tidx) AS schema
  FROM render_lines GROUP BY conv_id)"""


def schema_text(spark, sf) -> DataFrame:
    return C.render_schema(A.catalog(spark, sf))


@register("AG-12", O.with_(SCHEMA_TEXT) + "SELECT db_id, schema FROM schema_text")
def ag12(spark, sf):
    return schema_text(spark, sf)


@register("SRC-3", O.with_(SCHEMA_TEXT) + "SELECT db_id, schema FROM schema_text")
def src3(spark, sf):
    """Catalog written as JSON Lines to the shared folder, loaded back by the catalog reader, rendered."""
    cat = A.catalog(spark, sf).withColumn(
        "column_names_original",
        F.transform("column_names_original", lambda c: F.array(c["table_idx"].cast("string"), c["name"])))
    path = J.scratch_path(spark, "catalog")
    J.write_jsonl(cat, path)
    return C.render_schema(J.read_catalog(spark, path, multi_line=False))


@register("JN-1", O.with_(EX, SCHEMA_TEXT) + """SELECT e.example_id,
  CASE WHEN e.source_dataset = 'spider' AND e.db_id <> '' AND strpos(e.context, 'CREATE TABLE') = 0
            AND s.schema IS NOT NULL THEN s.schema ELSE e.context END AS context,
  coalesce(e.source_dataset = 'spider' AND e.db_id <> '' AND strpos(e.context, 'CREATE TABLE') = 0
            AND s.schema IS NOT NULL, false) AS enriched
FROM examples e LEFT JOIN schema_text s USING (db_id)""")
def jn1(spark, sf):
    return C.enrich_context(_examples(spark, sf), schema_text(spark, sf)).select("example_id", "context", "enriched")


@register("JN-2", O.with_(EX, SCHEMA_TEXT) + """SELECT e.example_id,
  coalesce(s.schema, e.context, 'Database: ' || e.db_id) AS schema
FROM examples e LEFT JOIN schema_text s USING (db_id)""")
def jn2(spark, sf):
    return C.lookup_schema(_examples(spark, sf), schema_text(spark, sf)).select("example_id", "schema")


@register("JN-3", O.with_(EX, SCHEMA_TEXT) + """SELECT example_id, db_id FROM examples
WHERE db_id IN (SELECT db_id FROM schema_text)""")
def jn3(spark, sf):
    return C.available(_examples(spark, sf), schema_text(spark, sf)).select("example_id", "db_id")


@register("SPIDER-ENRICHED", O.with_(EX, SCHEMA_TEXT) + """SELECT CAST(count(*) AS BIGINT) AS spider_enriched
FROM examples e JOIN schema_text s USING (db_id)
WHERE e.source_dataset = 'spider' AND e.db_id <> '' AND strpos(e.context, 'CREATE TABLE') = 0""")
def spider_enriched(spark, sf):
    e = C.enrich_context(_examples(spark, sf), schema_text(spark, sf))
    return e.agg(F.count_if("enriched").alias("spider_enriched"))


# --- SRC-4 / PRJ-2 / SO-6: per-source files, one missing, read in priority order ---------------------

def source_files(spark, sf) -> dict[str, str]:
    """Write each source's examples as JSONL under the shared folder; a sixth source has a path that does
    not exist, as happens when a source was never published."""
    ex = _examples(spark, sf).select("example_id", "question", "sql", "db_id", "context", "source_dataset")
    base = J.scratch_path(spark, "sources")
    J.write_jsonl(ex, base, partition_by=["source_dataset"])
    return {s: f"{base}/source_dataset={s}/*.json" for s in [*A.SOURCE_NAMES, "unpublished"]}


def read_written_sources(spark, sf):
    return J.read_sources(spark, source_files(spark, sf), LINE_SCHEMA, priority=A.SOURCE_PRIORITY)


@register("SRC-4", O.with_(EX) + """SELECT example_id, question, sql, source_dataset FROM examples""")
def src4(spark, sf):
    return read_written_sources(spark, sf).select("example_id", "question", "sql", "source_dataset")


@register("PRJ-2", O.with_(EX) + "SELECT example_id, source_dataset FROM examples")
def prj2(spark, sf):
    return read_written_sources(spark, sf).select("example_id", "source_dataset")


@register("SO-6", O.with_(EX) + """SELECT source_dataset, CAST(row_number() OVER (ORDER BY max(priority) DESC) - 1 AS INTEGER) AS rank
FROM examples GROUP BY 1""")
def so6(spark, sf):
    r = read_written_sources(spark, sf)
    return r.groupBy("source_dataset").agg(F.min("arrival.rank").cast("int").alias("rank"))


def _dialect_wb_sql(x: str) -> str:
    parts = []
    for label, kws in (("Contains DuckDB keyword: ", O.DUCKDB_WORDS),
                       ("Contains PostgreSQL-specific: ", O.POSTGRES_WORDS)):
        for k in kws:
            if k[0].isalpha():
                pat = "\\b" + k.replace(" ", "\\s+") + "\\b"
                parts.append(f"WHEN regexp_matches(upper({x}), {O.q(pat)}) THEN {O.q(label + k)}")
            else:
                parts.append(f"WHEN strpos(upper({x}), {O.q(k)}) > 0 THEN {O.q(label + k)}")
    return "CASE " + " ".join(parts) + " END"


@register("FLT-3-WB", O.with_(EX) + f"SELECT example_id, {_dialect_wb_sql('sql')} AS reason FROM examples")
def flt3_wb(spark, sf):
    """FLT-3 with whole-word keyword matching (``LOAD`` no longer rejects ``downloads``)."""
    return _examples(spark, sf).select("example_id", T.dialect_reason("sql", word_boundary=True).alias("reason"))

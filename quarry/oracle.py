"""DuckDB SQL for the adapters, used by ``oracle_sql()`` in ``__spark_entry__``.

These strings re-state the adapter rules of ``quarry.sources.adapters`` and the functions under test in DuckDB SQL over the
pre-registered driver views, so every oracle reads the same parquet tables as the Spark query. Nothing is
imported from the code under test: lists, patterns and weights are written out here. Regexes use RE2 syntax.
"""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------------------

# Python's white space, as a regex class body.
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SOURCES = ["spider", "sqale", "gretel", "sql_context", "know_sql"]
PRIORITIES = [5, 4, 3, 2, 1]
METHODS = ["zero_shot", "few_shot", "self_correction"]
ERRORS = ["no such table: x", "no such column: y", 'near "z": syntax error', "out of memory"]
ERROR_CLASSES = [("no such table", "table_name_error"), ("no such column", "column_name_error"), ("syntax", "syntax_error")]
DUCKDB_WORDS = ["PRAGMA", "ATTACH", "DETACH", "INSTALL", "LOAD", "DESCRIBE", "SUMMARIZE", "UNNEST", "STRUCT_PACK"]
POSTGRES_WORDS = ["RETURNING", "ILIKE", "SIMILAR TO", "::", "LATERAL", "GENERATE_SERIES"]
VALID_TYPES = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]
KNOWN_TYPES = VALID_TYPES + ["REPLACE", "MERGE"]
COMPLEXITY = [("simple_select", r"^\s*SELECT\s+.*\s+FROM\s+\w+\s*;?\s*$"), ("with_where", "WHERE"), ("with_join", "JOIN"),
              ("with_aggregation", "(COUNT|SUM|AVG|MIN|MAX|GROUP BY)"), ("with_subquery", "SELECT.*SELECT"),
              ("with_union", "UNION"), ("with_order_limit", "(ORDER BY|LIMIT)")]
SQL_ENDS = ["\n\n", "###", "Question:", "Schema:", "--"]
FROM_ENDS = ["WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "GROUP", "ORDER", "LIMIT", "HAVING",
             "UNION", "INTERSECT", "EXCEPT", "ON", "USING", "WINDOW"]
SQL_WORDS = """
ADD ALL ALTER AND ANY AS ASC BEGIN BETWEEN BY CASE CAST CHECK COLLATE COLUMN COMMIT CONSTRAINT CREATE CROSS
CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP DATABASE DEFAULT DELETE DESC DISTINCT DROP ELSE END ESCAPE EXCEPT EXISTS
EXPLAIN FETCH FIRST FOLLOWING FOR FOREIGN FROM FULL GLOB GROUP HAVING IF ILIKE IN INDEX INNER INSERT INTERSECT INTERVAL
INTO IS JOIN KEY LAST LATERAL LEFT LIKE LIMIT MERGE NATURAL NOT NULL NULLS OFFSET ON OR ORDER OUTER OVER PARTITION
PRAGMA PRECEDING PRIMARY RANGE RECURSIVE REFERENCES RENAME REPLACE RETURNING RIGHT ROLLBACK ROW ROWS SELECT SET SIMILAR
TABLE TEMPORARY THEN TO TRUNCATE UNBOUNDED UNION UNIQUE UPDATE USING VALUES VIEW WHEN WHERE WINDOW WITH
""".split()
# Feedback of a comparison.
MSG_NORMALIZE = "Error normalizing results: NULL among several values in a row cannot be sorted"
MSG_MATCH = "Results match gold standard"
MSG_DIFFER = "Results differ from gold standard (same row count, different values)"
# Paraphrase rules, in order; synonyms of table names; what simplification deletes.
PARAPHRASES = [
    (r"What (is|are) the (.+)\?", r"Show me the \2."),
    (r"What (.+)\?", r"List the \1."),
    (r"How many (.+)\?", r"Count the \1."),
    (r"How many (.+) are there\?", r"What is the total number of \1?"),
    (r"Find (.+)\.", r"Get \1."),
    (r"Find (.+)\.", r"Retrieve \1."),
    (r"List (.+)\.", r"Show \1."),
    (r"List all (.+)\.", r"Display all \1."),
    (r"Give me (.+)\.", r"Show me \1."),
    (r"Which (.+)\?", r"What \1?"),
]
SYNONYMS = {
    "student": ["pupil", "learner", "scholar"],
    "teacher": ["instructor", "professor", "educator"],
    "course": ["class", "subject", "lesson"],
    "department": ["division", "unit", "section"],
    "employee": ["worker", "staff", "personnel"],
    "customer": ["client", "buyer", "patron"],
    "order": ["purchase", "transaction", "sale"],
    "product": ["item", "goods", "merchandise"],
}
ORDER_BY_CLAUSE, LIMIT_CLAUSE = r"\s+ORDER BY\s+[^;]+", r"\s+LIMIT\s+\d+"
# Prompt templates; those whose inputs are trimmed first.
INSTRUCTION = "Database Schema:\n{schema}\n\nQuestion: {question}"
TEMPLATES = {
    "train_response_only":
        " ### Instruction: Generate a SQL query to answer the given question based on the provided database schema\n"
        "{instruction}\n\n ### Response:\n{sql}{eos}",
    "train_complete":
        " ### Instruction:\nGenerate a SQL query to answer the given question based on the provided database schema.\n\n"
        "Database Schema:\n{schema}\n\nQuestion: {question}\n\n ### Response:\n{sql}{eos}",
    "published":
        "### Task: Convert natural language question to SQL query\nDatabase: {db_id}\nDatabase Schema: {schema}\n"
        "### Question: {question}\n### SQL: {sql}",
    "zero_shot":
        "### Task: Convert the following natural language question to a SQL query.  Give only SQL Query as Output\n\n"
        "### Database Schema:\n{schema}\n\n### Question: {question}\n\n### SQL Query:\n",
    "self_correction":
        "### Task: Convert the following natural language question to a SQL query. Give only SQL Query as Output\n\n"
        "### Database Schema:\n{schema}\n\n### Question: {question}\n\n### SQL Query:\n",
    "judge":
        "-- Database Schema\n{schema}\n\n-- Question: {question}\n-- SQL Query: {sql}\n\n"
        "Does this SQL query correctly answer the question? Answer with 'Yes' or 'No' followed by a brief explanation.\n"
        "Answer:",
    "sft_inference":
        " ### Instruction: Generate a SQL query to answer the given question based on the provided database schema\n"
        "    {instruction}\n    \n     ### Response:\n    ",
    "optimizer_eval":
        "Schema:\n{schema}\n\nQuestion: {question}\nSQL:",
    "optimizer_train":
        "Schema:\n{schema}\nQuestion: {question}",
}
TRIMMED = ["train_complete", "train_response_only"]
EOS = "</s>"
FEW_SHOT_HEAD = ("### Task: Convert natural language questions to SQL queries.  Give only SQL Query as Output \n\n### Examples:\n\n")
# Literal, quoted name, comment, member name, word, number, white space, anything else.
SQL_TOKEN = (r"'[^']*'?" r'|"[^"]*"?' r"|`[^`]*`?|--[^\r\n]*|/\*(?s:.*?)(?:\*/|\z)|\.[\p{L}_][\p{L}\p{M}\p{N}_$]*"
             r"|[\p{L}_][\p{L}\p{M}\p{N}_$]*|[0-9][0-9A-Za-z_]*" rf"|[{WS}]+|(?s:.)")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"


def norm_question(x: str) -> str:
    return f"regexp_replace({collapse(strip(f'lower({x})'))}, '[^\\p{{L}}\\p{{N}}_{WS}]', '', 'g')"


def words_in(words: list[str]) -> str:
    return ", ".join(q(w) for w in words)


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(SQL_TOKEN)})"


def norm_sql(x: str) -> str:
    one = f"CASE WHEN regexp_matches(t, '^[{WS}]') THEN ' ' WHEN upper(t) IN ({words_in(SQL_WORDS)}) THEN upper(t) ELSE t END"
    return strip(f"array_to_string(list_transform({sql_tokens(x)}, lambda t: {one}), '')")


def code_tokens(x: str) -> str:
    return f"list_filter({sql_tokens(x)}, lambda t: NOT regexp_matches(t, '^([{WS}]|--|/\\*)'))"


def outside_groups(x: str, passes: int = 4) -> str:
    for _ in range(passes):
        x = f"regexp_replace({x}, '\\([^()]*\\)', ' ', 'g')"
    return x


def dialect_reason(x: str) -> str:
    parts = [f"WHEN strpos(upper({x}), {q(k)}) > 0 THEN {q('Contains DuckDB keyword: ' + k)}" for k in DUCKDB_WORDS]
    parts += [f"WHEN strpos(upper({x}), {q(k)}) > 0 THEN {q('Contains PostgreSQL-specific: ' + k)}" for k in POSTGRES_WORDS]
    return "CASE " + " ".join(parts) + " END"


def statement_type(x: str) -> str:
    code = code_tokens(x)
    lead = f"upper(list_filter({code}, lambda t: t <> '(')[1])"
    # literals and quoted names masked, then the first main word of what is left outside parentheses
    masked = f"array_to_string(list_transform({code}, lambda t: CASE WHEN t[1] IN ('''', '\"', '`') THEN 'x' ELSE t END), ' ')"
    main = f"upper(regexp_extract({outside_groups(masked)}, '(?i)(?:^| )(SELECT|INSERT|UPDATE|DELETE)(?: |$)', 1))"
    return (f"CASE WHEN {lead} = 'WITH' THEN (CASE WHEN {main} <> '' THEN {main} ELSE 'UNKNOWN' END) "
            f"WHEN {lead} IN ({words_in(KNOWN_TYPES)}) THEN {lead} ELSE 'UNKNOWN' END")


def validity_reason(x: str) -> str:
    st = statement_type(x)
    return (f"coalesce({dialect_reason(x)}, CASE WHEN {st} IN ({words_in(VALID_TYPES)}) THEN NULL "
            f"ELSE 'Invalid statement type: ' || {st} END)")


def from_tables(x: str) -> str:
    """Items of the FROM lists outside parentheses, joined by a bar."""
    one = (f"CASE WHEN regexp_matches(t, '^([{WS}]|--|/\\*)') THEN ' ' WHEN upper(t) = 'FROM' THEN chr(2) "
           f"WHEN upper(t) IN ({words_in(FROM_ENDS)}) OR t = ';' THEN chr(1) WHEN t = ',' THEN chr(3) "
           f"WHEN t IN ('(', ')') THEN t ELSE translate(t, '()', chr(4) || chr(5)) END")
    top = outside_groups(f"array_to_string(list_transform({sql_tokens(x)}, lambda t: {one}), '')")
    items = f"flatten(list_transform(string_split({top}, chr(2))[2:], lambda s: string_split(string_split(s, chr(1))[1], chr(3))))"
    clean = f"list_transform({items}, lambda s: translate({strip('s')}, chr(4) || chr(5), '()'))"
    return f"array_to_string(list_filter({clean}, lambda s: s <> ''), '|')"


def complexity_tags(x: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches(upper({x}), {q('(?is)' + p)}) THEN {q(name)} END"
                      for name, p in COMPLEXITY)
    tags = f"list_filter([{items}], lambda t: t IS NOT NULL)"
    return f"(CASE WHEN len({tags}) = 0 THEN ['simple_select'] ELSE {tags} END)"


def sql_template(d: str = "doc_id") -> str:
    return f"""CASE {d} % 10
      WHEN 0 THEN 'SELECT n_name FROM nation WHERE n_regionkey = ' || ({d} % 5)
      WHEN 1 THEN 'SELECT COUNT(*) FROM orders WHERE o_orderstatus = ''F'' AND o_custkey % 7 = ' || ({d} % 7)
      WHEN 2 THEN 'select c.c_name, n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey where n.n_regionkey = ' || ({d} % 5)
      WHEN 3 THEN 'SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_name LIMIT ' || ({d} % 10 + 1)
      WHEN 4 THEN 'SELECT s_name FROM supplier WHERE s_nationkey = ' || ({d} % 25) || ' UNION SELECT c_name FROM customer WHERE c_nationkey = ' || ({d} % 25)
      WHEN 5 THEN 'WITH t AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT COUNT(*) FROM t WHERE total > ' || (({d} % 10) * 1000)
      WHEN 6 THEN 'PRAGMA table_info(orders)'
      WHEN 7 THEN 'SELECT o_totalprice::INTEGER FROM orders'
      WHEN 8 THEN 'EXPLAIN SELECT * FROM lineitem'
      ELSE 'SELECT c_name FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer);' END"""


def sql_of_text(d: str = "doc_id", text: str = "text") -> str:
    """The template with the document's text inside: as literal, as comment, in a WITH list, or in a line before it."""
    t, base = f"coalesce({text}, '')", sql_template(d)
    literal = f"replace({t}, '''', '''''')"
    return f"""CASE {d} % 10 WHEN 0 THEN ({base}) || ' AND n_comment <> ''' || {literal} || ''''
      WHEN 2 THEN ({base}) || ' /* ' || replace({t}, '*/', '* /') || ' */'
      WHEN 5 THEN 'WITH n AS (SELECT ''' || {literal} || ''' AS note),' || substr({base}, 5)
      WHEN 9 THEN '-- ' || regexp_replace({t}, '[\\r\\n]', ' ', 'g') || chr(10) || ({base}) ELSE {base} END"""


_names = "[" + ", ".join(q(s) for s in SOURCES) + "]"
_prio = "CASE source_dataset " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in zip(SOURCES, PRIORITIES)) + " ELSE 0 END"

EXAMPLES = f"""examples0 AS (
  SELECT doc_id AS example_id,
         text AS question,
         {sql_of_text()} AS sql,
         CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'conv_' || (doc_id // 4) END AS db_id,
         {_names}[CAST(substr(source, 4) AS INTEGER) % 5 + 1] AS source_dataset
  FROM documents),
examples AS (
  SELECT *,
         CASE WHEN example_id % 3 = 0 THEN 'CREATE TABLE t' || (example_id % 10) || ' (id INTEGER, name TEXT)'
              ELSE 'Database: ' || db_id END AS context,
         {_prio} AS priority,
         (5 - {_prio}) * 10000000000000 + example_id AS arrival
  FROM examples0)"""

CLASSIFIED = f"""classified AS (
  SELECT *,
         CASE WHEN sql IS NULL THEN 'Missing required field' ELSE {validity_reason('sql')} END AS reject_reason,
         md5({norm_question('question')}) AS q_hash,
         {norm_sql('sql')} AS sql_norm
  FROM examples),
statused AS (
  SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'invalid'
                 WHEN question IS NULL OR question = '' OR sql = '' THEN 'empty'
                 ELSE 'candidate' END AS status
  FROM classified),
cand AS (SELECT * FROM statused WHERE status = 'candidate'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q_hash ORDER BY priority DESC, length(sql), arrival) AS rk,
            min(arrival) OVER (PARTITION BY q_hash) AS first_arrival
  FROM cand),
winners AS (SELECT * FROM ranked WHERE rk = 1)"""

_methods = "[" + ", ".join(q(m) for m in METHODS) + "]"
_errors = "[" + ", ".join(q(e) for e in ERRORS) + "]"

EVAL_RESULTS = f"""eval_results AS (
  SELECT example_id, question, db_id,
         {_methods}[example_id % 3 + 1] AS method,
         sql AS gold_sql, sql AS generated_sql,
         example_id % 5 <> 0 AS is_valid,
         example_id % 5 <> 0 AND example_id % 2 = 0 AS results_match,
         CASE WHEN example_id % 11 = 0 THEN NULL ELSE CAST(example_id % 100 AS DOUBLE) / 10.0 END AS inference_time,
         CASE WHEN example_id % 3 = 2 THEN CAST(example_id % 3 + 1 AS INTEGER) END AS num_attempts,
         CASE WHEN example_id % 5 = 0 THEN {_errors}[(example_id // 5) % 4 + 1] END AS error,
         {complexity_tags('sql')} AS complexity
  FROM examples)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

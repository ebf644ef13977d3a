"""Augmentation: one row in, up to n+1 rows out (AU-1..AU-6, FLT-7, AG-13).

Each example's candidate variants are flat columns built with built-in expressions; their statement
types are staged projections; keep / rank / truncate is arithmetic over flags; ``explode`` emits the
rows — one narrow, code-generated stage, no shuffle.
Random choices of the reference are replaced by md5(seed:id:purpose) draws, portable to any engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.mixing import hash_key

# --- fixed values ----------------------------------------------------------------------------------
# Paraphrase rules (Python regex syntax, applied in order, case-insensitive).
PARAPHRASE_RULES = [
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
# Table-name synonyms.
TABLE_SYNONYMS = {
    "student": ["pupil", "learner", "scholar"],
    "teacher": ["instructor", "professor", "educator"],
    "course": ["class", "subject", "lesson"],
    "department": ["division", "unit", "section"],
    "employee": ["worker", "staff", "personnel"],
    "customer": ["client", "buyer", "patron"],
    "order": ["purchase", "transaction", "sale"],
    "product": ["item", "goods", "merchandise"],
}
LIMIT_CHOICES = [5, 10, 20, 50, 100]
ORDER_DIRECTIONS = ["ASC", "DESC"]
SIMPLIFY_ORDER_BY = r"\s+ORDER BY\s+[^;]+"
SIMPLIFY_LIMIT = r"\s+LIMIT\s+\d+"


def java_pattern(p: str) -> str:
    """Python pattern -> Java with the same meaning here: ``.`` does not match only ``\\n`` in Python."""
    return "(?i)" + re.sub(r"(?<!\\)\.", r"[^\\n]", p)


def java_replacement(r: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", r)


def paraphrases(question: Column, n: int = 2) -> Column:
    """AU-1: up to n new distinct paraphrases, in rule order (rule results equal to the input are skipped)."""
    cands = F.array(*[F.regexp_replace(question, java_pattern(p), java_replacement(r)) for p, r in PARAPHRASE_RULES])
    return F.slice(F.array_distinct(F.filter(cands, lambda x: x != question)), 1, n)


def _draw(seed, id_col: str, purpose: str, *extra) -> Column:
    return F.conv(F.substring(hash_key(seed, id_col, F.lit(purpose), *extra), 1, 8), 16, 10).cast("long")


def rename_tables(sql: Column, table_names: Column, id_col: str, seed: int = 42) -> Column:
    """AU-2: rename each schema table by a synonym (whole word, case-insensitive), sequentially."""
    syn = F.create_map(*[x for k, v in TABLE_SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])

    def pick(t, i):
        options = F.coalesce(F.element_at(syn, F.lower(t)), F.array(F.lower(t)))
        idx = F.pmod(_draw(seed, id_col, "rename", i), F.size(options)) + 1
        return F.struct(t.alias("old"), F.element_at(options, idx.cast("int")).alias("new"))

    mapping = F.transform(F.coalesce(table_names, F.array().cast("array<string>")), pick)
    # \\Q..\\E quotes a name (one that holds \\E is quoted in parts); a replacement escapes \\ and $
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = lambda x: F.regexp_replace(x, "([\\\\$])", "\\\\$1")
    return F.aggregate(mapping, sql, lambda acc, m: F.regexp_replace(
        acc, F.concat(F.lit("(?iuU)\\b"), quoted(m["old"]), F.lit("\\b")), plain(m["new"])))


def add_limit(sql: Column, id_col: str, seed: int = 42) -> Column:
    """AU-3: append ``LIMIT k`` unless the text already contains LIMIT."""
    k = F.element_at(F.array(*[F.lit(x) for x in LIMIT_CHOICES]),
                     (F.pmod(_draw(seed, id_col, "limit"), F.lit(len(LIMIT_CHOICES))) + 1).cast("int"))
    return F.when(F.instr(F.upper(sql), "LIMIT") > 0, sql) \
        .otherwise(F.concat(T.rstrip_chars(sql, ";"), F.lit(" LIMIT "), k.cast("string")))


def add_order_by(sql: Column, columns: Column, id_col: str, seed: int = 42) -> Column:
    """AU-4: append ``ORDER BY col ASC|DESC`` unless the text already contains ORDER BY."""
    col = F.element_at(columns, (F.pmod(_draw(seed, id_col, "order_col"), F.size(columns)) + 1).cast("int"))
    d = F.element_at(F.array(*[F.lit(x) for x in ORDER_DIRECTIONS]),
                     (F.pmod(_draw(seed, id_col, "order_dir"), F.lit(2)) + 1).cast("int"))
    return F.when(F.instr(F.upper(sql), "ORDER BY") > 0, sql) \
        .otherwise(F.concat(T.rstrip_chars(sql, ";"), F.lit(" ORDER BY "), col, F.lit(" "), d))


def simplify(sql: Column) -> Column:
    """AU-5: delete ``ORDER BY …`` up to ``;`` or the end, then ``LIMIT n``."""
    s = F.regexp_replace(sql, "(?i)" + SIMPLIFY_ORDER_BY, "")
    return F.regexp_replace(s, "(?i)" + SIMPLIFY_LIMIT, "")


def variations(df: DataFrame, n_variations: int = 3, id_col: str = "example_id", seed: int = 42) -> DataFrame:
    """AU-6 + FLT-7: original, paraphrases, rename, limit, order, simplify — in that order, each checked
    variant kept only if its SQL is a SELECT, truncated to the first n+1, then non-SELECT rows dropped.

    Input columns: id, question, sql, db_id, schema struct<table_names, columns> (null = no schema).
    Output: id, variant (0-based), augmentation, question, sql, db_id.

    All candidates are flat columns; statement types are staged projections; the keep / rank /
    truncate logic is plain arithmetic over flags; ``explode`` + a null filter emit the rows — the whole
    stage is generated code (no per-element lambda evaluation).
    """
    q, sql, db = F.col("question"), F.col("sql"), F.col("db_id")
    has_schema = F.col("schema").isNotNull()
    cols = F.col("schema.columns")
    para = paraphrases(q, 2)
    d = df.withColumn("_para", para) \
        .withColumn("_s_rename", rename_tables(sql, F.col("schema.table_names"), id_col, seed)) \
        .withColumn("_s_limit", add_limit(sql, id_col, seed)) \
        .withColumn("_s_order", F.when(F.coalesce(F.size(cols), F.lit(0)) > 0, add_order_by(sql, cols, id_col, seed))) \
        .withColumn("_s_simple", simplify(sql))
    d = T.with_statement_type(d, "sql", "_tsql")
    # An unchanged text keeps its type, and an appended LIMIT changes none; an appended ORDER BY could only give an unknown text
    # a main word (its column's name), so few texts are cut into tokens again.
    again = {"_s_rename": ~F.col("_s_rename").eqNullSafe(sql), "_s_simple": ~F.col("_s_simple").eqNullSafe(sql),
             "_s_order": F.col("_s_order").isNotNull() & (F.col("_tsql") == "UNKNOWN")}
    for c, changed in again.items():
        d = d.withColumn("_t" + c, F.when(changed, T.statement_type(c)).otherwise(F.col("_tsql")))
    d = d.withColumn("_t_s_limit", F.col("_tsql"))
    ok = {c: F.coalesce(F.col("_t" + c) == "SELECT", F.lit(False))
          for c in ("sql", "_s_rename", "_s_limit", "_s_order", "_s_simple")}
    # (augmentation, question, sql, db_id, present, checked, ok)
    cands = [
        ("original", q, sql, db, F.lit(True), False, ok["sql"]),
        ("paraphrase", F.element_at(F.col("_para"), 1), sql, db, F.size("_para") >= 1, False, ok["sql"]),
        ("paraphrase", F.element_at(F.col("_para"), 2), sql, db, F.size("_para") >= 2, False, ok["sql"]),
        ("schema_shuffle", q, F.col("_s_rename"), F.concat(db, F.lit("_shuffled")), F.lit(True), True,
         ok["_s_rename"]),
        ("add_limit", F.concat(q, F.lit(" (top results)")), F.col("_s_limit"), db, has_schema, True, ok["_s_limit"]),
        ("add_order", F.concat(q, F.lit(" (sorted)")), F.col("_s_order"), db,
         has_schema & (F.coalesce(F.size(cols), F.lit(0)) > 0), True, ok["_s_order"]),
        ("simplify", q, F.col("_s_simple"), db, F.col("_s_simple") != sql, True, ok["_s_simple"]),
    ]
    kept = [(present & (F.lit(True) if not checked else okc)).cast("int") for _, _, _, _, present, checked, okc in cands]
    items, rank = [], F.lit(0)
    for (kind, cq, cs, cd, present, checked, okc), k in zip(cands, kept):
        emit = (k == 1) & (rank < n_variations + 1) & okc
        items.append(F.when(emit, F.struct(rank.alias("variant"), F.lit(kind).alias("augmentation"),
                                            cq.alias("question"), cs.alias("sql"), cd.alias("db_id"))))
        rank = rank + k
    out = d.select(id_col, F.explode(F.array(*items)).alias("v")).filter(F.col("v").isNotNull())
    return out.select(id_col, "v.variant", "v.augmentation", "v.question", "v.sql", "v.db_id")


def expansion(original: DataFrame, generated: DataFrame) -> DataFrame:
    """AG-13: generated / original row counts (one row; null rate for an empty input)."""
    tagged = original.select(F.lit(True).alias("_orig")).unionByName(generated.select(F.lit(False).alias("_orig")))
    c = tagged.agg(F.count_if("_orig").alias("n_original"), F.count_if(~F.col("_orig")).alias("n_generated"))
    return c.withColumn("expansion_rate", F.try_divide(F.col("n_generated").cast("double"), F.col("n_original")))

"""Scalar text functions over SQL and question columns (built-in expressions only).

Every helper takes and returns a ``Column`` so it stays inside whole-stage codegen.
Regexes are written to behave the same under Java regex (Spark) and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import sqltokens as K
from quarry.functions.sqltokens import WS, WS_CHARS

# --- fixed values (must equal the reference's for equal results) -----------------------------

# Dialect filter keywords, in the reference's order (first hit names the reason).
DUCKDB_KEYWORDS = ["PRAGMA", "ATTACH", "DETACH", "INSTALL", "LOAD",
                   "DESCRIBE", "SUMMARIZE", "UNNEST", "STRUCT_PACK"]
POSTGRES_SPECIFIC = ["RETURNING", "ILIKE", "SIMILAR TO", "::", "LATERAL", "GENERATE_SERIES"]

# Statement types accepted by the corpus gate.
VALID_STATEMENT_TYPES = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]
# Leading words that name a statement type at all; anything else types as UNKNOWN.
KNOWN_STATEMENT_WORDS = VALID_STATEMENT_TYPES + ["REPLACE", "MERGE"]

# Complexity tags, in order, matched on upper-cased SQL with DOTALL + IGNORECASE.
SQL_PATTERNS = [
    ("simple_select", r"^\s*SELECT\s+.*\s+FROM\s+\w+\s*;?\s*$"),
    ("with_where", r"WHERE"),
    ("with_join", r"JOIN"),
    ("with_aggregation", r"(COUNT|SUM|AVG|MIN|MAX|GROUP BY)"),
    ("with_subquery", r"SELECT.*SELECT"),
    ("with_union", r"UNION"),
    ("with_order_limit", r"(ORDER BY|LIMIT)"),
]

# Delimiters that end an extracted SQL statement, in the reference's order.
SQL_END_DELIMITERS = ["\n\n", "###", "Question:", "Schema:", "--"]

# Error-message classes: first substring hit wins.
ERROR_CLASSES = [("no such table", "table_name_error"),
                 ("no such column", "column_name_error"),
                 ("syntax", "syntax_error")]

# Spark error conditions mapped onto the same classes.
SPARK_ERROR_CLASSES = [("TABLE_OR_VIEW_NOT_FOUND", "table_name_error"),
                       ("UNRESOLVED_COLUMN", "column_name_error"),
                       ("PARSE_SYNTAX_ERROR", "syntax_error")]

RESPONSE_MARKER = "### Response:"

# --- basic string helpers --------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes all Unicode whitespace at both ends. Spark's one-argument ``trim``
    removes only spaces, so the character set is given explicitly (a scan from both ends, no regex)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    return F.regexp_replace(_c(c), f"[{WS}]+", " ")


def rstrip_chars(c, chars: str) -> Column:
    """Python ``str.rstrip(chars)``. ``\\z`` is the very end; Java's ``$`` would also match before a final
    newline and strip characters Python keeps."""
    cls = "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars)
    return F.regexp_replace(_c(c), f"[{cls}]+\\z", "")


# --- SC-1 / SC-2 / SC-3: dedup keys ------------------------------------------------------------


# The white space set as a Java class body that tests common characters first: single characters below 256 are one lookup, and
# one range test excludes nearly all others.
_JAVA_WS = (r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0"
            r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]")
# A run of white space other than one blank alone; removed characters in runs. ``\w`` (ASCII) settles most characters at once.
_WS_RUN = f"[{_JAVA_WS}](?<! (?![{_JAVA_WS}]))[{_JAVA_WS}]*"
_PUNCTUATION = f"[\\W&&[^{_JAVA_WS}\\p{{L}}\\p{{N}}]]+"


def normalize_question(c) -> Column:
    """SC-1: lower -> strip -> collapse whitespace -> drop punctuation (keeps letters, numbers, ``_``).

    Collapsing first turns any leading/trailing whitespace run into one space, so a space-only ``trim``
    afterwards equals strip-then-collapse with one regex pass less. Neither regex matches where nothing changes.
    """
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(_c(c)), _WS_RUN, " ")), _PUNCTUATION, "")


def question_hash(c) -> Column:
    """SC-2: md5 hex of the UTF-8 normalized question."""
    return F.md5(normalize_question(c))


def normalize_sql(c) -> Column:
    """SC-3: keywords upper-cased, whitespace between tokens collapsed, stripped; literals, names and comments stay."""
    return K.normalized(c)


# --- FLT-3 / FLT-4 / SC-10: dialect and statement type ------------------------------------------


def dialect_reason(sql, word_boundary: bool = False) -> Column:
    """FLT-3: reason string for the first dialect keyword found (reference: plain substring), else null."""
    up = F.upper(_c(sql))
    out = None
    for kw, label in ([(k, "Contains DuckDB keyword: ") for k in DUCKDB_KEYWORDS]
                      + [(k, "Contains PostgreSQL-specific: ") for k in POSTGRES_SPECIFIC]):
        hit = F.contains(up, F.lit(kw))
        if word_boundary and kw[0].isalpha():  # the plain search is cheap and rules most texts out
            hit = F.contains(up, F.lit(kw.split()[0])) & up.rlike("\\b" + kw.replace(" ", "\\s+") + "\\b")
        out = F.when(hit, F.lit(label + kw)) if out is None else out.when(hit, F.lit(label + kw))
    return out.otherwise(F.lit(None).cast("string"))


def strip_sql_comments(sql) -> Column:
    """Each comment replaced by a space; comment marks inside literals and quoted names are text."""
    return K.without_comments(sql)


def _type_of(code: Column) -> Column:
    """Statement type from an array of code tokens."""
    known = F.create_map(*[x for k in KNOWN_STATEMENT_WORDS for x in (F.lit(k), F.lit(k))])
    lead = K.lead_word(code)
    return F.coalesce(F.when(lead == "WITH", K.main_word(code)).otherwise(F.element_at(known, lead)), F.lit("UNKNOWN"))


def statement_type(sql) -> Column:
    """SC-10: statement type from the tokens of a text.

    The first word that is no comment or opening parenthesis decides. For ``WITH`` it is the first SELECT/INSERT/UPDATE/DELETE
    outside all parentheses. Words inside literals, quoted names and comments are text. Unknown words type as UNKNOWN, as does null.
    """
    return F.when(_c(sql).isNull(), F.lit("UNKNOWN")).otherwise(K.let(K.code(K.tokens(sql)), _type_of))


def with_statement_type(df, sql: str = "sql", out: str = "statement_type"):
    """``statement_type`` as staged projections: a text is cut into tokens once per row."""
    df = df.withColumn("_st_code", K.code(K.tokens(sql)))
    return df.withColumn(out, F.when(F.col(sql).isNull(), F.lit("UNKNOWN")).otherwise(_type_of(F.col("_st_code")))).drop("_st_code")


def validity_reason(sql, word_boundary: bool = False, check_dialect: bool = True,
                    stype: Column | None = None) -> Column:
    """FLT-3 then FLT-4: null when the SQL passes, else the reason text.

    Pass ``stype`` (an already projected statement-type column) to keep generated code small.
    """
    st = statement_type(sql) if stype is None else stype
    type_reason = F.when(st.isin(*VALID_STATEMENT_TYPES), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("Invalid statement type: "), st))
    if not check_dialect:
        return type_reason
    return F.coalesce(dialect_reason(sql, word_boundary), type_reason)


# --- SC-4: extraction from model text ---------------------------------------------------------


def extract_sql(text) -> Column:
    """SC-4 (T10): pull the SQL statement out of generated text."""
    t = F.replace(F.replace(_c(text), F.lit("```sql"), F.lit("")), F.lit("```"), F.lit(""))
    t = py_strip(t)
    t = F.when(t.startswith("]]"), py_strip(F.substring(t, 3, 1 << 30))).otherwise(t)
    t = py_strip(t)
    pos = F.instr(F.upper(t), "SELECT")
    s = F.substring(t, pos, 1 << 30)
    cut = F.least(*[F.when(F.instr(s, d) > 1, F.instr(s, d)) for d in SQL_END_DELIMITERS])
    s = F.when(cut.isNull(), s).otherwise(s.substr(F.lit(1), cut - 1))
    s = py_strip(rstrip_chars(s, ";"))
    return F.when(pos > 0, s).otherwise(t)


# --- SC-5: complexity tags ------------------------------------------------------------------


def complexity_tags(sql) -> Column:
    """SC-5 (T11): array of complexity labels, overlapping; none -> ['simple_select']."""
    up = F.upper(_c(sql))
    tags = F.array_compact(F.array(*[F.when(up.rlike("(?is)" + p), F.lit(name)) for name, p in SQL_PATTERNS]))
    return F.when(F.size(tags) == 0, F.array(F.lit("simple_select"))).otherwise(tags)


# --- SC-6 / SC-7 / SC-8: value normalization -----------------------------------------------


def normalize_value(v) -> Column:
    """SC-6: null stays null; else string, stripped, lower-cased."""
    return F.lower(py_strip(_c(v).cast("string")))


def normalize_row(values) -> Column:
    """SC-7: sort normalized values inside the row (``values`` is an array<string> column)."""
    return F.array_sort(F.transform(_c(values), lambda x: F.lower(py_strip(x))))


def exact_match(generated, gold) -> Column:
    """SC-8: trimmed, lower-cased equality."""
    return F.lower(py_strip(_c(generated))) == F.lower(py_strip(_c(gold)))


# --- SC-9: error classes ------------------------------------------------------------------


def error_class(error) -> Column:
    """SC-9: first-match error taxonomy over the message text."""
    e = F.lower(_c(error))
    out = None
    for needle, label in ERROR_CLASSES:
        hit = F.instr(e, needle) > 0
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("other_error"))


def spark_error_class(condition) -> Column:
    """SC-9 for Spark error conditions (EX-1)."""
    c = _c(condition)
    out = None
    for prefix, label in SPARK_ERROR_CLASSES:
        hit = c.startswith(prefix)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("other_error"))


# --- SC-11 / SC-14 / SC-15 / SC-16 / SC-17 / SC-19 -------------------------------------------


def question_after_marker(text) -> Column:
    """SC-11: the text after the first ``question:`` (case-insensitive, whitespace after it skipped, to the
    end of that line); the whole text when there is no such marker."""
    t = _c(text)
    pat = f"(?i)question:[{WS}]*([^\n]+)"
    return F.when(t.rlike(pat), F.regexp_extract(t, pat, 1)).otherwise(t)


def response_tail(text, prompt=None) -> Column:
    """SC-14: text after the last ``### Response:``, else after the prompt; trailing ``;`` removed."""
    t = _c(text)
    after = F.substring_index(t, RESPONSE_MARKER, -1)
    if prompt is not None:
        fallback = F.substring(t, F.length(_c(prompt)) + 1, 1 << 30)
    else:
        fallback = t
    s = F.when(F.instr(t, RESPONSE_MARKER) > 0, after).otherwise(fallback)
    return py_strip(rstrip_chars(py_strip(s), ";"))


def judge_says_yes(verdict) -> Column:
    """SC-15: the judge's verdict starts with "yes" (case-insensitive); null verdict -> false."""
    return F.coalesce(F.lower(_c(verdict)).startswith("yes"), F.lit(False))


def _py_bool(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("None")).when(c, F.lit("True")).otherwise(F.lit("False"))


def evidence_text(pred, gold, match, error) -> Column:
    """SC-16: Pred/Gold/Match/Error feedback lines (Python prints True/False/None)."""
    return F.concat(F.lit("Pred: "), F.coalesce(_c(pred), F.lit("None")),
                    F.lit("\nGold: "), F.coalesce(_c(gold), F.lit("None")),
                    F.lit("\nMatch: "), _py_bool(_c(match)),
                    F.lit("\nError: "), F.coalesce(_c(error), F.lit("None")))


def from_tables(sql) -> Column:
    """SC-17: the items of each top-level FROM list, alias attached (``customer c``); JOINed tables are
    not collected."""
    return K.from_items(sql)


def method_label(method) -> Column:
    """SC-19: underscores to spaces, title case."""
    return F.initcap(F.replace(_c(method), F.lit("_"), F.lit(" ")))

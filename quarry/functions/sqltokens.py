"""SQL text as a stream of tokens, by one native regular expression and higher-order functions over its matches.

A token is a string literal, a quoted name, a comment, a member name (a dot and the name after it), a word, a number, a
run of white space, or one other character. Joined, the tokens give back the text. A quote that is never closed reaches to the end, as does a
block comment; a doubled quote inside a literal parts it into two tokens side by side, which no rule here tells
from one. All helpers are ``Column -> Column``; none needs a parser or leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/\s whitespace set, written as a regex class body usable by Java and RE2.
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# No group is repeated, so no match recurses: literals and names of any length take no stack.
TOKEN = (r"'[^']*'?" r'|"[^"]*"?' r"|`[^`]*`?" r"|--[^\r\n]*" r"|/\*(?s:.*?)(?:\*/|\z)"
         r"|\.[\p{L}_][\p{L}\p{M}\p{N}_$]*" r"|[\p{L}_][\p{L}\p{M}\p{N}_$]*" r"|[0-9][0-9A-Za-z_]*"
         rf"|[{WS}]+" r"|(?s:.)")

# Words that are upper-cased in normalized SQL (reserved words of the common dialects).
KEYWORDS = """
ADD ALL ALTER AND ANY AS ASC BEGIN BETWEEN BY CASE CAST CHECK COLLATE COLUMN COMMIT CONSTRAINT CREATE CROSS
CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP DATABASE DEFAULT DELETE DESC DISTINCT DROP ELSE END ESCAPE EXCEPT EXISTS
EXPLAIN FETCH FIRST FOLLOWING FOR FOREIGN FROM FULL GLOB GROUP HAVING IF ILIKE IN INDEX INNER INSERT INTERSECT INTERVAL
INTO IS JOIN KEY LAST LATERAL LEFT LIKE LIMIT MERGE NATURAL NOT NULL NULLS OFFSET ON OR ORDER OUTER OVER PARTITION
PRAGMA PRECEDING PRIMARY RANGE RECURSIVE REFERENCES RENAME REPLACE RETURNING RIGHT ROLLBACK ROW ROWS SELECT SET SIMILAR
TABLE TEMPORARY THEN TO TRUNCATE UNBOUNDED UNION UNIQUE UPDATE USING VALUES VIEW WHEN WHERE WINDOW WITH
""".split()
# Words that begin the main statement after a WITH list.
MAIN_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE"]
# Words that end a FROM list (its comma-separated items stop before them).
FROM_LIST_END = ["WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "GROUP", "ORDER",
                 "LIMIT", "HAVING", "UNION", "INTERSECT", "EXCEPT", "ON", "USING", "WINDOW"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def tokens(sql) -> Column:
    """Array of the tokens of a text, in order; null for null."""
    return F.regexp_extract_all(_c(sql), F.lit(TOKEN), F.lit(0))


def is_comment(t: Column) -> Column:
    return t.startswith("--") | t.startswith("/*")


def is_space(t: Column) -> Column:
    return F.trim(t, F.lit(WS_CHARS)) == ""


# The same whitespace set as characters (Python's own definition, generated by rule).
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def without_comments(sql) -> Column:
    """Each comment replaced by a space; marks inside literals and quoted names are text."""
    return F.array_join(F.transform(tokens(sql), lambda t: F.when(is_comment(t), F.lit(" ")).otherwise(t)), "")


def code(toks: Column) -> Column:
    """Tokens that are neither white space nor comments."""
    return F.filter(toks, lambda t: ~(is_space(t) | is_comment(t)))


def normalized(sql) -> Column:
    """White space between tokens collapsed, keywords upper-cased; literals, names and comments as they are."""
    def one(t: Column) -> Column:
        up = F.upper(t)
        # no keyword is longer than 24 bytes; long literals are not upper-cased
        return F.when(is_space(t), F.lit(" ")).when((F.octet_length(t) <= 24) & up.isin(*KEYWORDS), up).otherwise(t)
    return F.trim(F.array_join(F.transform(tokens(sql), one), ""), F.lit(WS_CHARS))


def lead_word(toks: Column) -> Column:
    """First code token that is no opening parenthesis, upper-cased; null if there is none."""
    return F.upper(F.get(F.filter(toks, lambda t: t != "("), 0))


def _deeper(t: Column) -> Column:
    return F.when(t == "(", 1).when(t == ")", -1).otherwise(0)


def main_word(toks: Column) -> Column:
    """First of MAIN_WORDS outside all parentheses, in code tokens; null if there is none."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("found"))
    return F.aggregate(toks, start, lambda s, t: F.struct(
        F.greatest(F.lit(0), s["depth"] + _deeper(t)).alias("depth"),
        F.when(s["found"].isNull() & (s["depth"] == 0) & F.upper(t).isin(*MAIN_WORDS), F.upper(t)).otherwise(s["found"]).alias("found")),
        lambda s: s["found"])


# An innermost parenthesized group. A class repeated by itself does not recurse in Java's matcher, so its
# length is not limited by the stack; nesting is removed from the inside, one level at a time.
PAREN_GROUP = r"\([^()]*\)"


def without_groups(text: Column) -> Column:
    """Parenthesized groups replaced by a space, as many levels as the text has."""
    marks = F.split(F.regexp_replace(text, r"[^()]+", ""), "")
    depth = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
                        lambda s, m: F.struct(F.greatest(F.lit(0), s["now"] + _deeper(m)).alias("now"),
                                              F.greatest(s["most"], s["now"] + F.when(m == "(", 1).otherwise(0)).alias("most")),
                        lambda s: s["most"])
    levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, text, lambda w, _: F.regexp_replace(w, PAREN_GROUP, " "))


# Marks in a text: end of a FROM list, FROM itself, comma between items, parentheses inside literals and names.
# These control characters are dropped from the text first.
_END, _FROM, _COMMA, _OPEN, _CLOSE = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"


def from_items(sql) -> Column:
    """Items of every FROM list outside parentheses, with their aliases, in order; joined tables are not collected."""
    def mark(t: Column) -> Column:
        up = F.upper(t)
        return (F.when(is_space(t) | is_comment(t), F.lit(" ")).when(up == "FROM", F.lit(_FROM))
                .when(up.isin(*FROM_LIST_END) | (t == ";"), F.lit(_END)).when(t == ",", F.lit(_COMMA))
                .when(t.isin("(", ")"), t).otherwise(F.translate(t, "()", _OPEN + _CLOSE)))
    clean = F.translate(_c(sql), _END + _FROM + _COMMA + _OPEN + _CLOSE, "")
    top = without_groups(F.array_join(F.transform(tokens(clean), mark), ""))
    lists = F.transform(F.slice(F.split(top, _FROM), 2, 1 << 30), lambda x: F.substring_index(x, _END, 1))
    items = F.flatten(F.transform(lists, lambda x: F.split(x, _COMMA)))
    named = F.transform(items, lambda x: F.translate(F.trim(x, F.lit(WS_CHARS)), _OPEN + _CLOSE, "()"))
    return F.filter(named, lambda x: x != "")

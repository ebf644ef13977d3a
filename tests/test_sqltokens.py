"""SC-3, SC-10, SC-17, FLT-4 on the token stream: marks and words inside literals, names and comments are text."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import sqltokens as K
from quarry.functions import text as T

TYPES = {"WITH t AS (SELECT '/*' AS a) DELETE FROM x WHERE b = '*/'": "DELETE", "SELECT '-- not a comment' FROM t": "SELECT",
         "/* SELECT */ UPDATE t SET a = 1": "UPDATE", "-- INSERT\r\nDELETE FROM t": "DELETE", "((SELECT 1))": "SELECT", "'SELECT' x": "UNKNOWN",
         'WITH "select" AS (SELECT 1), `delete` AS (SELECT 2) INSERT INTO t SELECT 1': "INSERT", "WITH a AS (SELECT ')' FROM b) UPDATE a SET x = 1": "UPDATE",
         "WITH a AS (SELECT 1)": "UNKNOWN", "/* never closed SELECT 1": "UNKNOWN", "": "UNKNOWN", " \n": "UNKNOWN", "selector": "UNKNOWN",
         "with a as (select 'it''s (' from b) select 1": "SELECT", "WITH a AS (SELECT 1) -- DELETE\nSELECT 2": "SELECT", "replace into t values (1)": "REPLACE"}

NORMAL = {"select  a ,b from\tt where x = 'a  b' and y=\"Order  By\"": "SELECT a ,b FROM t WHERE x = 'a  b' AND y=\"Order  By\"",
          " select t.select, `from` from t -- keep  this\n limit 1 ;": "SELECT t.select, `from` FROM t -- keep  this LIMIT 1 ;",
          "SELECT 'select from'": "SELECT 'select from'", "select Name from Users": "SELECT Name FROM Users", "a = 'it''s  in'": "a = 'it''s  in'",
          "select" + " \n" * 40 + "a": "SELECT a"}

FROMS = {"SELECT a FROM customer c, (select x from y) n WHERE x = 'from z, w'": ["customer c", "n"], "SELECT 1 FROM \"a,b\" x, `c (d`, e": ['"a,b" x', "`c (d`", "e"],
         "select x from a /* from b */ join c on 1=1 union select y from d -- from e\n;": ["a", "d"], "SELECT ')' FROM t WHERE a IN (SELECT b FROM u)": ["t"],
         "SELECT 1": [], "select a.from from t": ["t"]}


def apply(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("s"))).collect())]


def test_statement_types(spark):
    assert apply(spark, TYPES, T.statement_type) == list(TYPES.values())
    df = spark.createDataFrame([(t,) for t in [*TYPES, None]], "sql string")
    rows = T.with_statement_type(df).collect()
    assert {r.sql: r.statement_type for r in rows} == {**TYPES, None: "UNKNOWN"}


def test_normalized_sql(spark):
    assert apply(spark, NORMAL, T.normalize_sql) == list(NORMAL.values())
    assert apply(spark, [None], T.normalize_sql) == [None]


def test_from_lists(spark):
    assert apply(spark, FROMS, T.from_tables) == list(FROMS.values())


def test_comments(spark):
    texts = ["a /* b */ c -- d\ne", "'/* no */' \"-- no\" `--`", "x--", "/* open"]
    assert apply(spark, texts, T.strip_sql_comments) == ["a   c  \ne", texts[1], "x ", " "]


@pytest.mark.parametrize("n", [200_000])
def test_long_texts(spark, n):
    texts = ["SELECT '" + "it''s (--/* " * (n // 12) + "' FROM t", "/* " + "x'" * n + "*/ DELETE FROM t", "SELECT " + "a, " * (n // 20) + "b FROM t",
             "SELECT " + "(" * 500 + "1" + ")" * 500 + " FROM t"]
    assert apply(spark, texts, T.statement_type) == ["SELECT", "DELETE", "SELECT", "SELECT"]
    assert apply(spark, texts, lambda c: F.array_join(T.from_tables(c), "|")) == ["t", "t", "t", "t"]


def test_tokens_give_back_the_text(spark):
    texts = [*TYPES, *NORMAL, *FROMS, "é_1 ünï$x 12.5e-3 a.b.c \x00\x1f　 '", '"', "`", "/", "-", "🙂 '🙂'"]
    assert apply(spark, texts, lambda c: F.array_join(K.tokens(c), "")) == texts

"""Corpus statistics (AG-9, AG-10, SO-1, SO-2, SO-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def token_count(sql) -> F.Column:
    """Number of whitespace tokens, by counting them in place."""
    return F.regexp_count(F.col(sql) if isinstance(sql, str) else sql, F.lit(f"[^{T.WS}]+"))


def head_word(sql) -> F.Column:
    """First whitespace token, upper-cased; null if there is none."""
    return F.upper(F.nullif(F.regexp_extract(F.col(sql) if isinstance(sql, str) else sql, f"[^{T.WS}]+", 0), F.lit("")))


def sql_length_stats(df: DataFrame, sql: str = "sql", n_tokens: str | None = None) -> DataFrame:
    """AG-9: average / min / max whitespace-token count of the SQL (one partial+final aggregate), or of counts at hand."""
    n = F.col(n_tokens) if n_tokens else token_count(sql)
    return df.agg((F.sum(n).cast("double") / F.count(F.lit(1))).alias("avg_tokens"),
                  F.min(n).cast("long").alias("min_tokens"), F.max(n).cast("long").alias("max_tokens"))


def top_k(df: DataFrame, key, k: int, count_name: str = "n") -> DataFrame:
    """SO-2: the k most common keys, ties broken by key. ``orderBy().limit()`` plans as TakeOrdered
    over the (small) grouped table — no global sort."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    name = key if isinstance(key, str) else g.columns[0]
    return g.orderBy(F.desc(count_name), F.asc(name)).limit(k)


def head_word_top(df: DataFrame, k: int = 5, sql: str = "sql", head: str | None = None) -> DataFrame:
    """AG-10: statement head-word frequency, top k (of the SQL's heads, or of a column that holds them)."""
    return top_k(df.select((F.col(head) if head else head_word(sql)).alias("head")), "head", k)


def top_k_share(df: DataFrame, key: str, k: int) -> DataFrame:
    """SO-2 with the share of the whole: count and percent of all rows for the k most common keys."""
    from pyspark.sql import Window as W
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))
    return g.orderBy(F.desc("n"), F.asc(key)).limit(k)


def first_n(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """SO-3: first n rows of an ordered set (TakeOrdered, no full sort)."""
    return df.orderBy(order).limit(n)

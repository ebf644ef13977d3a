"""URL filter: listed rules first, then association rules mined from labelled pages by FP-growth.

A url becomes a small set of tokens (``tokens``). Transactions are the token sets of labelled pages, with one more item
for the bad ones. FP-growth gives the frequent sets; a set of url tokens is a rule if it is frequent enough and
enough of its pages are bad (support and confidence), and only minimal sets stay, as a larger one matches nothing
that its part does not. Each rule is indexed under its rarest token only, so a common token finds few rules.

Nulls: a null url, or one without ``://``, has an empty host and path and no tokens; no rule fits it. A page with
several label rows is bad if one of them says so. Repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

#: The item of a bad page; no url token has this form.
BAD = "!"
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str | Column) -> Column:
    """Struct of host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.struct(F.translate(host, _UPPER, _LOWER).alias("host"), path.alias("path"))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest of ``rules`` (verdict, host, path) that fits, else null.

    A rule fits its host and all subdomains if the path begins with the rule's.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: str, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url, at most eight: scheme, host, the host without its first name, the first name,
    directory (digit runs as 0), extension, names of the query's parameters, and whether there is a fragment."""
    u = F.coalesce(F.col(url), F.lit(""))
    scheme = F.lower(F.substring_index(u, "://", 1))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)))), "&")
    folder = F.regexp_replace(F.regexp_extract(path, r"(?s)^.*/", 0), r"[0-9]+", "0")
    values = {"scheme": scheme, "host": host, "domain": F.regexp_extract(host, r"(?s)^[^.]*\.(.+)\z", 1),
              "name": F.regexp_extract(host, r"^([^.]*)\.", 1), "dir": folder, "ext": F.regexp_extract(path, r"\.([^./]*)\z", 1),
              "query": names, "fragment": F.when(F.contains(u, F.lit("#")), F.lit("yes")).otherwise(F.lit(""))}
    found = F.array(*[F.when(v != "", F.concat(F.lit(f"{k}:"), v)) for k, v in values.items()])
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(found)))


def mine(labelled: DataFrame, scratch: Scratch, min_rows: int, min_support: float, min_confidence: float) -> DataFrame:
    """Rules (items, rows, n_bad) from ``labelled(items, bad)``: sets that at least ``min_rows`` bad rows and a share of
    ``min_support`` of all rows hold, of whose rows at least ``min_confidence`` are bad."""
    rows = labelled.count()
    if rows < max(min_rows, 1):  # no set can hold min_rows
        return labelled.select("items", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_bad")).where(F.lit(False))
    known = labelled.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    # a little less, so that the count that FP-growth rounds up to is never above the exact bound applied below
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / rows) * (1 - 1e-9), minConfidence=1.0).fit(known)
    sets = scratch.write(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", BAD).alias("items"), F.col("freq").alias("n_bad"))
    both = bad.join(sets, "items").select("items", F.col("freq").alias("rows"), "n_bad")
    good = both.where((F.col("n_bad") >= min_rows) & (F.col("n_bad") >= min_support * rows) & (F.col("n_bad") >= min_confidence * F.col("rows")))
    return scratch.write(good, "passing")


def minimal(rules: DataFrame) -> DataFrame:
    """Rules of which no proper part is a rule: every proper part of each is looked up among the rules."""
    part = F.expr("transform(sequence(1, shiftleft(1, size(items)) - 2), m -> filter(items, (x, i) -> (shiftright(m, i) & 1) = 1))")
    proper = rules.where(F.size("items") > 1).select("items", F.explode(part).alias("part"))
    larger = proper.join(rules.select(F.col("items").alias("part")), "part", "left_semi").select("items").distinct()
    return rules.join(larger, "items", "left_anti")


def matching(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Token sets ``sets(items)`` (distinct) that hold all tokens of a rule. Each rule is posted under its rarest token."""
    seen = sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = (rules.select("items", F.explode("items").alias("token")).join(seen, "token", "left")
              .groupBy("items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token")))
    found = sets.select("items", F.explode("items").alias("token")).join(posted.withColumnRenamed("items", "rule"), "token")
    return found.where(F.size(F.array_except("rule", "items")) == 0).select("items").distinct()


def judge(pages: DataFrame, id_col: str, url_col: str, labels: DataFrame, rules: list[tuple[str, str, str]], *,
          min_rows: int = 25, min_support: float = 0.001, min_confidence: float = 0.5) -> DataFrame:
    """Every row of ``pages``: id, host, path, rule (of the list, else null) and verdict.

    ``labels(id, bad)`` names labelled pages; all of them are mined. A page that no listed rule fits is blocked if its
    url holds all tokens of a mined rule, else allowed.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    p = parts(url_col)
    seen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), p.alias("p"))
    seen = seen.select("id", "url", "p.host", "p.path")
    seen = seen.select("id", "host", "path", listed(F.col("host"), F.col("path"), rules).alias("listed"),
                       tokens("url", F.col("host"), F.col("path")).alias("items"))
    seen = scratch.write(seen, "pages")
    bad = labels.groupBy("id").agg(F.bool_or("bad").alias("bad")).where("id is not null")
    labelled = scratch.write(seen.join(bad, "id").where(F.size("items") > 0).select("items", "bad"), "labelled")
    mined = minimal(mine(labelled, scratch, min_rows, min_support, min_confidence))
    sets = scratch.write(seen.where("listed is null").select("items").distinct(), "sets")
    blocked = scratch.write(matching(sets, mined), "blocked").withColumnRenamed("items", "hit")
    out = seen.join(blocked, F.when(F.col("listed").isNull(), F.col("items")) == F.col("hit"), "left")
    verdict = F.coalesce("listed.verdict", F.when(F.col("hit").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))

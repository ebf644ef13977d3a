"""Quality rules whose cut-offs adapt to each language and source. DataFrame functions only.

The distribution of every measure is kept as a logarithmic-bucket quantile sketch (bucket -> count): a table that
any number of partitions pre-aggregate and that merges by addition, here also from sources into languages and the whole
corpus, for groups that are too small to speak for themselves. The quartiles of a group give its fences (Tukey's
rule), and documents outside them go. Sketches merge in any order to the same counts, so reruns agree.

Defined results: a null text has no words and fails the base rule, as has an empty one; null languages and sources are
groups of their own; an empty table gives no rows; equal rows get equal verdicts. Everything is returned in one
struct column, which replaces a column of that name, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import Scratch

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """``fence``: quartile distances beyond the quartiles that are still accepted. ``spread``: the least quartile
    distance assumed for each measure; a document of n words gets sqrt(short_words / n) of it in addition, for
    short texts scatter more. ``min_docs``: a group with fewer uses its language, then the whole corpus.
    ``gamma``: ratio of neighbouring sketch buckets, ``unit``: resolution near zero.
    ``broadcast_rows``: a table of fences up to this length is broadcast, a longer one joined by shuffle."""

    fence: float = 4.0
    spread: tuple[tuple[str, float], ...] = (
        ("symbol_share", 0.01), ("nonletter_share", 0.03), ("upper_share", 0.02), ("dup_line_share", 0.05),
        ("repeat_share", 0.04), ("word_length", 0.4))
    short_words: float = 40.0
    min_docs: int = 50
    gamma: float = 1.02
    unit: float = 1e-3
    broadcast_rows: int = 50_000


#: Measures where only high values are bad.
_HIGH_ONLY = {"symbol_share", "nonletter_share", "upper_share", "dup_line_share", "repeat_share"}


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the array."""
    n = F.size(words)
    hashes = F.transform(F.slice(words, 1, n - 4), lambda w, i: F.xxhash64(
        w, words[i + 1], words[i + 2], words[i + 3], words[i + 4]))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(order, lambda o: F.filter(o, lambda s, j: (
            s["h"].eqNullSafe(F.get(o, j - 1)["h"]) | s["h"].eqNullSafe(F.get(o, j + 1)["h"]))))
        places = F.sort_array(F.transform(again, lambda s: s["i"]))
        return _let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))),
            F.lit(0), lambda a, x: a + x))

    many = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(n >= 6, many).otherwise(F.lit(0)).cast("long")


def measure(df: DataFrame, text_col: str = "text", out: str = "quality_rules") -> DataFrame:
    """``df`` with a struct ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed
    and the measures that have adaptive fences."""
    tmp, nums = f"__{out}_parts", f"__{out}_counts"
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    solid = F.translate(text, " \t\n\x0b\f\r", "")
    # One-element arrays are exploded where an expensive value is used several times: what stands below a generator is
    # evaluated once for each row, while the optimizer would copy it into every filter and field above it.
    first = df.select("*", F.explode(F.array(F.struct(words.alias("words"), lines.alias("lines"), solid.alias("solid")))).alias(tmp))
    p = F.col(tmp)
    counted = first.select(*(c for c in df.columns if c != out), F.explode(F.array(F.struct(
        F.size(p["words"]).cast("long").alias("n_words"),
        F.length(p["solid"]).cast("long").alias("word_chars"),
        (F.length(p["solid"]) - F.length(F.translate(p["solid"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(p["lines"]).cast("long").alias("n_lines"),
        (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long").alias("n_dup_lines"),
        _repeat_words(p["words"]).alias("n_repeat_words"),
        F.length(F.regexp_replace(p["solid"], "[^\\p{L}\\p{M}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count(p["solid"], F.lit("\\p{Lu}")).cast("long").alias("n_upper")))).alias(nums))
    p = F.col(nums)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return counted.withColumn(out, F.struct(
        *(p[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ((p["n_words"] < 10) | (100 * p["n_repeat_words"] > 20 * p["n_words"])).alias("base_failed"),
        share(p["n_symbols"], p["word_chars"]).alias("symbol_share"),
        share(p["word_chars"] - p["n_letters"], p["word_chars"]).alias("nonletter_share"),
        share(p["n_upper"], p["n_letters"]).alias("upper_share"),
        share(p["n_dup_lines"], p["n_lines"]).alias("dup_line_share"),
        share(p["n_repeat_words"], p["n_words"]).alias("repeat_share"),
        share(p["word_chars"], p["n_words"]).alias("word_length"))).drop(nums)


def sketches(measured: DataFrame, lang_col: str, source_col: str, rules: Rules, out: str = "quality_rules") -> DataFrame:
    """(lang, source, measure, bucket, n) over the documents that pass the base rule."""
    q = F.col(out)
    names = [m for m, _ in rules.spread]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), q[m].alias("x")) for m in names)))
    rows = measured.where(~q["base_failed"]).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                                                    each.alias("m"))
    bucket = F.round(F.log1p(F.col("m.x") / rules.unit) / F.log(F.lit(rules.gamma))).cast("int")
    return (rows.groupBy("lang", "source", "m.measure", bucket.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def fences(sketch: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, fences map measure -> struct(low, high, spread)) for every language and source."""
    value = (F.exp(F.col("bucket") * F.log(F.lit(rules.gamma))) - 1) * rules.unit

    def quartiles(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*keys, "measure")
        cum = merged.select("*", F.sum("n").over(part.orderBy("bucket")).alias("cum"), F.sum("n").over(part).alias("all"))
        at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("all"), value))
        return cum.groupBy(*keys, "measure").agg(F.max("all").alias("all"), at(0.25).alias("q1"), at(0.75).alias("q3"))

    own, by_lang, whole = quartiles(["lang", "source"]), quartiles(["lang"]), quartiles([])
    j = (own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & F.expr("o.measure = l.measure"))
         .join(whole.alias("w"), F.expr("o.measure = w.measure")))
    pick = lambda c: (F.when(F.col("o.all") >= rules.min_docs, F.col(f"o.{c}"))
                      .when(F.col("l.all") >= rules.min_docs, F.col(f"l.{c}")).otherwise(F.col(f"w.{c}")))
    least = F.create_map(*(F.lit(x) for pair in rules.spread for x in pair))[F.col("o.measure")]
    high_only = F.col("o.measure").isin(*sorted(_HIGH_ONLY))
    s = j.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.measure").alias("measure"),
                 pick("q1").alias("q1"), pick("q3").alias("q3"), least.alias("least"), high_only.alias("high_only"))
    wide = rules.fence * F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    low = F.when(F.col("high_only"), F.lit(float("-inf"))).otherwise(F.col("q1") - wide)
    return s.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct(
        "measure", F.struct(low.alias("low"), (F.col("q3") + wide).alias("high"))))).alias("fences"))


def judge(measured: DataFrame, limits: DataFrame, lang_col: str, source_col: str, rules: Rules,
          out: str = "quality_rules") -> DataFrame:
    """``measured`` with ``kept`` added to its struct. ``limits`` must be a written table: its length is counted."""
    few = limits.count() <= rules.broadcast_rows
    lim = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "fences")
    lim = lim.withColumnRenamed("fences", "__fences")
    j = measured.join(F.broadcast(lim) if few else lim, F.col(lang_col).eqNullSafe(F.col("__lang"))
                      & F.col(source_col).eqNullSafe(F.col("__source")), "left")
    q = F.col(out)
    loose = F.sqrt(F.lit(rules.short_words) / F.greatest(q["n_words"], F.lit(1)))
    inside = F.lit(True)
    for m, least in rules.spread:
        f = F.col("__fences")[m]
        inside = inside & F.coalesce(q[m].between(f["low"] - least * loose, f["high"] + least * loose), F.lit(True))
    return j.withColumn(out, q.withField("kept", ~q["base_failed"] & inside)).drop("__lang", "__source", "__fences")


def quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            rules: Rules = Rules(), out: str = "quality_rules") -> DataFrame:
    """All rows and columns of ``df`` with the struct ``out`` (measures, base_failed, kept). Every text is measured once, and the
    rows are written with their measures; shuffles nothing but sketches, unless there are more than ``broadcast_rows``
    languages and sources."""
    scratch = Scratch(df.sparkSession, "quality")
    measured = scratch.write(measure(df, text_col, out), "measured")
    sketch = scratch.write(sketches(measured, lang_col, source_col, rules, out), "sketches")
    limits = scratch.write(fences(sketch, rules), "fences")
    return judge(measured, limits, lang_col, source_col, rules, out)

"""Mixing, splitting and sampling (AG-11, ST-1, ST-3, ST-4, SO-4, SO-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: recommended mix weights and reasons per source -----------------------------------
RECOMMENDED_WEIGHTS = {
    "spider": (0.5, "Benchmark quality, complex queries"),
    "sqale": (0.3, "Real-world schema diversity"),
    "gretel": (0.15, "High-quality synthetic data"),
    "sql_context": (0.03, "Schema-aware supplementary data"),
    "know_sql": (0.02, "Educational variety, lower complexity"),
}
DEFAULT_WEIGHT = (0.1, "General purpose")


def weight_table(kept: DataFrame, source: str = "source_dataset") -> DataFrame:
    """AG-11: per source count, recommended weight (default 0.1), reason, and the totals."""
    from pyspark.sql import Window as W
    wmap = F.create_map(*[x for k, (w, _) in RECOMMENDED_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    rmap = F.create_map(*[x for k, (_, r) in RECOMMENDED_WEIGHTS.items() for x in (F.lit(k), F.lit(r))])
    g = kept.groupBy(source).agg(F.count(F.lit(1)).alias("count"))
    allw = W.partitionBy()
    return g.select(
        source, "count",
        F.coalesce(F.element_at(wmap, F.col(source)), F.lit(DEFAULT_WEIGHT[0])).alias("weight"),
        F.coalesce(F.element_at(rmap, F.col(source)), F.lit(DEFAULT_WEIGHT[1])).alias("reason"),
        F.sum("count").over(allw).alias("total_examples"),
        F.count(F.lit(1)).over(allw).alias("num_datasets"))


# --- hashing helpers ------------------------------------------------------------------------------------

def hash_key(seed, *cols) -> F.Column:
    """md5 hex of ``seed:col1:col2...`` — a reproducible per-row draw, the same in any partitioning."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def unit_draw(seed, *cols) -> F.Column:
    """u in [0, 1): the first 8 hex digits of ``hash_key`` over 2^32."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("double") / float(1 << 32)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """ST-1: concatenate sources with different columns (missing columns become null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_train_val(df: DataFrame, id_col: str, fraction: float = 0.02, seed: int = 42) -> DataFrame:
    """ST-4: ``split`` = 'validation' when the row's hash prefix is below ``fraction`` of the hash space,
    else 'train'. Stable under repartitioning (unlike randomSplit) and decided on the original id, so
    copies made later by mixing never straddle the split."""
    threshold = format(int(fraction * (1 << 32)), "08x")
    h = F.substring(hash_key(seed, id_col), 1, 8)
    return df.withColumn("split", F.when(h < F.lit(threshold), F.lit("validation")).otherwise(F.lit("train")))


# Hex digits of the md5 whose fixed ranges number the rows: 65,536 ranges of equal expected size.
RANGE_DIGITS = 4


def ranked_by_hash(df: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """The ``n`` rows with the smallest md5(seed:id) with their 0-based ``rank`` (ties: id).

    The hash is uniform, so fixed ranges of its first digits need no sampling: a row's rank is the number of
    rows in lower ranges (a count per range, at most 16^RANGE_DIGITS rows, broadcast) plus its place in its own
    range. Both are functions of the data alone; no branch depends on another's partitioning, and ranges
    above the n-th row are dropped before the sort.
    """
    from pyspark.sql import Window as W
    h = df.withColumn("_h", F.concat(hash_key(seed, id_col), F.lit(":"), F.col(id_col).cast("string"))) \
        .withColumn("_range", F.substring("_h", 1, RANGE_DIGITS))
    counts = h.groupBy("_range").agg(F.count(F.lit(1)).alias("_cnt"))
    below = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    lower = counts.select("_range", F.coalesce(F.sum("_cnt").over(below), F.lit(0)).alias("_lower")) \
        .filter(F.col("_lower") < n)
    place = F.row_number().over(W.partitionBy("_range").orderBy("_h")) - 1
    return h.join(F.broadcast(lower), "_range").withColumn("rank", (F.col("_lower") + place).cast("long")) \
        .filter(F.col("rank") < n).drop("_h", "_range", "_lower")


def hash_limits(df: DataFrame, id_col: str, seed: int, wanted: DataFrame, group: str | None = None) -> DataFrame:
    """The hash of the k-th row in order of md5(seed:id) for each group: ``_limit``; rows up to it are the k smallest.

    ``wanted`` has the group column (none without ``group``) and ``_k`` >= 1, at most the group's size; one row each. A histogram over
    the hash's first digits (at most 16^RANGE_DIGITS rows a group) finds the range that holds the k-th row; only
    the rows of that range are ranked. Row ids are unique in their group.
    """
    from pyspark.sql import Window as W
    keys = [group] if group else []
    h = df.select(*keys, F.concat(hash_key(seed, id_col), F.lit(":"), F.col(id_col).cast("string")).alias("_h")) \
        .withColumn("_range", F.substring("_h", 1, RANGE_DIGITS))
    counts = h.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_cnt"))
    upto = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    c = counts.withColumn("_upto", F.sum("_cnt").over(upto))
    c = c.join(F.broadcast(wanted), keys) if keys else c.withColumn("_k", F.lit(int(wanted.first()["_k"])))
    at = c.filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_cnt") < F.col("_k"))) \
        .select(*keys, "_range", (F.col("_k") - F.col("_upto") + F.col("_cnt")).alias("_place"))  # one row a group
    near = h.join(F.broadcast(at), [*keys, "_range"])
    place = F.row_number().over(W.partitionBy(*keys, "_range").orderBy("_h"))
    return near.withColumn("_rn", place).filter(F.col("_rn") == F.col("_place")).select(*keys, F.col("_h").alias("_limit"))


def split_exact(df: DataFrame, id_col: str, fraction: float = 0.02, seed: int = 42) -> DataFrame:
    """ST-4 with an exact count: the ceil(fraction * rows) rows of least md5(seed:id) are 'validation', the others 'train'.

    The threshold is one order statistic of the hash, so the split is the same under any partitioning.
    """
    import math
    n = df.count()
    k = math.ceil(round(fraction * n, 9))
    if k == 0:
        return df.withColumn("split", F.lit("train"))
    limit = hash_limits(df, id_col, seed, df.sparkSession.createDataFrame([(k,)], "_k long")).first()["_limit"]
    h = F.concat(hash_key(seed, id_col), F.lit(":"), F.col(id_col).cast("string"))
    return df.withColumn("split", F.when(h <= F.lit(limit), F.lit("validation")).otherwise(F.lit("train")))


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """SO-4: n rows without replacement (all rows when there are at most n): the n smallest hashes."""
    return ranked_by_hash(df, id_col, seed, n).drop("rank")


def seeded_slices(df: DataFrame, sizes: list[int], id_col: str, seed: int = 42,
                  names: list[str] | None = None) -> DataFrame:
    """SO-5: seeded shuffle then contiguous, disjoint slices of exact sizes (e.g. 800 train / 100 val)."""
    names = names or [f"slice{i}" for i in range(len(sizes))]
    ranked = ranked_by_hash(df, id_col, seed, sum(sizes))
    which, acc = None, 0
    for name, size in zip(names, sizes):
        cond = (F.col("rank") >= acc) & (F.col("rank") < acc + size)
        which = F.when(cond, F.lit(name)) if which is None else which.when(cond, F.lit(name))
        acc += size
    return ranked.withColumn("slice", which)


def mix_quotas(counts: dict[str, int], weights: dict[str, float], strategy: str = "all_exhausted") -> dict[str, float]:
    """ST-3 (T9) expected copies per row of each loaded source.

    p_i = w_i / sum(w) over loaded sources (count > 0). ``all_exhausted``: N = max_i(n_i / p_i);
    ``first_exhausted``: N = min_i(n_i / p_i); q_i = p_i * N / n_i, rounded to 12 decimals.
    """
    loaded = {s: n for s, n in counts.items() if n > 0 and weights.get(s, 0) > 0}
    if not loaded:
        raise ValueError("no loaded source has a positive weight")
    tw = sum(weights[s] for s in sorted(loaded))
    p = {s: weights[s] / tw for s in loaded}
    ratios = [loaded[s] / p[s] for s in loaded]
    big_n = max(ratios) if strategy == "all_exhausted" else min(ratios)
    return {s: round(p[s] * big_n / loaded[s], 12) for s in loaded}


def quota_table(df: DataFrame, source: str, weights: dict[str, float],
                strategy: str = "all_exhausted") -> DataFrame:
    """ST-3 quotas as a DataFrame ``(source, q)`` — at most ``len(weights)`` rows (the weights dimension
    bounds it), computed from one grouped count over the data; see ``mix_quotas`` for the formula."""
    from pyspark.sql import Window as W
    spark = df.sparkSession
    wdf = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], f"{source} string, _w double")
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    pr = counts.join(F.broadcast(wdf), source).filter((F.col("_n") > 0) & (F.col("_w") > 0))
    allw = W.partitionBy()
    pr = pr.withColumn("_p", F.col("_w") / F.sum("_w").over(allw))
    ratio = F.col("_n") / F.col("_p")
    big_n = F.max(ratio).over(allw) if strategy == "all_exhausted" else F.min(ratio).over(allw)
    return pr.select(source, F.round(F.col("_p") * big_n / F.col("_n"), 12).alias("_q"))


def interleave(df: DataFrame, source: str, id_col: str, weights: dict[str, float],
               strategy: str = "all_exhausted", seed: int = 42) -> DataFrame:
    """ST-3: weighted interleave without a global sort, as one plan.

    Quotas come from a grouped count joined to the weights (a table of at most ``len(weights)`` rows,
    broadcast); the count and the rows read the same upstream exchange, which Spark reuses. Each row is
    emitted floor(q) times plus once more when its draw u < frac(q); a source without a weight is an error; ``copy`` numbers the copies and
    ``mix_key`` = md5(seed:id:copy) gives the interleaved order (sort on it only if wanted).
    """
    q = F.col("_q")
    copies = (F.floor(q) + F.when(unit_draw(seed, id_col) < q - F.floor(q), 1).otherwise(0)).cast("int")
    quotas = quota_table(df, source, weights, strategy)
    d = df.join(F.broadcast(quotas), source, "left")
    d = d.withColumn("_q", F.when(F.col(source).isin(*weights), F.col("_q")).otherwise(
        F.raise_error(F.concat(F.lit("no mix weight for source "), F.coalesce(F.col(source), F.lit("null"))))))
    d = d.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies", "_q")
    return d.withColumn("mix_key", hash_key(seed, id_col, "copy"))


def exact_quotas(df: DataFrame, source: str, weights: dict[str, float], strategy: str = "all_exhausted") -> DataFrame:
    """Rows to emit of each loaded source, ``(source, n, quota)``: largest remainders of the weights' shares of a whole total.

    The total is the least (``all_exhausted``) or greatest (``first_exhausted``) whole number at which every source is
    emitted at least, or at most, once. At most ``len(weights)`` rows; ties of remainders go to the name that sorts first.
    """
    from pyspark.sql import Window as W
    wdf = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"{source} string, _w double")
    pr = df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(wdf), source).filter(F.col("_w") > 0)
    allw = W.partitionBy()
    pr = pr.withColumn("_p", F.col("_w") / F.sum("_w").over(allw))
    ratio = F.round(F.col("n") / F.col("_p"), 6)
    total = F.ceil(F.max(ratio).over(allw)) if strategy == "all_exhausted" else F.floor(F.min(ratio).over(allw))
    pr = pr.withColumn("_total", total).withColumn("_share", F.round(F.col("_p") * F.col("_total"), 6))
    pr = pr.withColumn("_base", F.floor("_share"))
    left = F.col("_total") - F.sum("_base").over(allw)
    turn = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_share") - F.col("_base"), 6)), F.asc(source)))
    return pr.select(source, "n", (F.col("_base") + F.when(turn <= left, 1).otherwise(0)).cast("long").alias("quota"))


def interleave_exact(df: DataFrame, source: str, id_col: str, weights: dict[str, float],
                     strategy: str = "all_exhausted", seed: int = 42) -> DataFrame:
    """ST-3 with exact quotas: each source is emitted exactly ``quota`` times (``exact_quotas``).

    Every row gets quota // n copies; the quota % n rows of least md5(seed:id) in their source get one more. The
    rows' order and their ``copy`` and ``mix_key`` are as in ``interleave``. A source without a weight is an error.
    """
    quotas = exact_quotas(df, source, weights, strategy)
    more = quotas.select(source, (F.col("quota") % F.col("n")).alias("_k")).filter(F.col("_k") > 0)
    limits = hash_limits(df, id_col, seed, more, source)
    per = quotas.select(source, F.floor(F.col("quota") / F.col("n")).alias("_full")).join(limits, source, "left")
    d = df.join(F.broadcast(per), source, "left")
    full = F.when(F.col(source).isin(*weights), F.col("_full")).otherwise(
        F.raise_error(F.concat(F.lit("no mix weight for source "), F.coalesce(F.col(source), F.lit("null")))))
    h = F.concat(hash_key(seed, id_col), F.lit(":"), F.col(id_col).cast("string"))
    copies = (F.coalesce(full, F.lit(0)) + F.coalesce((h <= F.col("_limit")).cast("int"), F.lit(0))).cast("int")
    d = d.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies", "_full", "_limit")
    return d.withColumn("mix_key", hash_key(seed, id_col, "copy"))

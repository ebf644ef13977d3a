"""Sharding by a k-d tree over metadata, split at distributed weighted medians.

Groups of rows that belong together (equal texts) are one point each, with the sum of their sizes. A node with
several shards is split across its widest dimension where the weight below equals its part of the shards; the place is
found by repeated histograms, all nodes of a level at once, so a node of any size is a few thousand counters. Heavy groups (over
``heavy`` of a shard) are placed whole before, the largest first, and the tree fills up the rest of each shard; a
group that fits in no shard is cut into its rows. There are at most shards / heavy heavy groups, so they may be
collected.

Defined results: a null size counts 0, null coordinates lie before all others, null groups are one group; rows with
equal group, id and metadata stay together; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

COORD_BITS, TIE_BITS, STEP_BITS = 20, 30, 12
KEY_BITS = COORD_BITS + TIE_BITS


@dataclass
class _Node:
    shards: list[int]
    weight: float = 0.0
    dim: int = 0
    goal: float = 0.0  # weight that goes to the left
    prefix: int = 0
    before: float = 0.0
    cut: int | None = None
    parts: tuple = field(default_factory=tuple)


def assign(df: DataFrame, group: Column, size: Column, dims: dict[str, Column], n_shards: int, *, id_col: str = "doc_id",
           heavy: float = 0.02, tolerance: float = 2e-4) -> DataFrame:
    """Returns id, size, ``unit`` (what is placed together), shard and ``slot`` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "kd")
    names = list(dims)
    rows = scratch.write(df.select(
        F.col(id_col).alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(group.cast("binary"), F.lit("null group").cast("binary"))).alias("grp"),
        *(dims[d].cast("double").alias(f"x{k}") for k, d in enumerate(names))), "rows")

    total = rows.agg(F.sum("size")).first()[0] or 0
    goal = total / n_shards
    big = sorted(((r["w"], r["grp"]) for r in rows.groupBy("grp").agg(F.sum("size").alias("w"))
                  .where(F.col("w") > heavy * goal).collect()), reverse=True)
    load, whole, cut_up = [0.0] * n_shards, {}, []
    for w, g in big:
        s = min(range(n_shards), key=lambda k: (load[k], k))
        if load[s] + w <= goal * (1 + tolerance):
            load[s] += w
            whole[g] = s
        else:
            cut_up.append(g)

    marks = spark.createDataFrame([(g, s) for g, s in whole.items()] + [(g, -1) for g in cut_up], "grp string, placed int")
    tagged = rows.join(F.broadcast(marks), "grp", "left")
    unit = F.when(F.col("placed") == -1, F.md5(F.concat_ws(":", "grp", F.coalesce(F.col("id").cast("string"), F.lit("-")))))
    tagged = scratch.write(tagged.withColumn("unit", F.coalesce(unit, F.col("grp"))), "tagged")
    scratch.drop("rows")

    light = tagged.where(F.col("placed").isNull() | (F.col("placed") == -1))
    xs = [f"x{k}" for k in range(len(names))]
    points = light.groupBy("unit").agg(F.sum("size").alias("w"), *(F.min(x).alias(x) for x in xs))
    points = scratch.write(points, "points")
    span = points.agg(*(F.min(x).alias(f"lo{x}") for x in xs), *(F.max(x).alias(f"hi{x}") for x in xs)).first()

    def scaled(x: str) -> Column:
        lo, hi = span[f"lo{x}"], span[f"hi{x}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        steps = (1 << COORD_BITS) - 2
        return F.coalesce(F.floor((F.col(x) - lo) * (steps / (hi - lo))) + 1, F.lit(0)).cast("long")

    # The tie-breaking hash makes every key its unit's own; all dimensions use it.
    tie = F.shiftrightunsigned(F.xxhash64("unit"), 64 - TIE_BITS)
    keyed = points.select("unit", "w", F.array(*(F.shiftleft(scaled(x), TIE_BITS).bitwiseOR(tie) for x in xs)).alias("key"),
                          F.lit(0).alias("node"))
    cur = scratch.write(keyed, "level-0")
    nodes = {0: _Node(list(range(n_shards)))}
    leaf: dict[int, int] = {}
    room = [max(0.0, goal - x) for x in load]
    level, next_id = 0, 1
    while any(len(n.shards) > 1 for n in nodes.values()):
        widths = cur.groupBy("node").agg(F.sum("w").alias("w"), *(
            (F.max(F.shiftright(F.col("key")[k], TIE_BITS)) - F.min(F.shiftright(F.col("key")[k], TIE_BITS))).alias(f"d{k}")
            for k in range(len(xs)))).collect()
        info = {r["node"]: r for r in widths}
        for i, n in nodes.items():
            r = info.get(i)
            n.weight = float(r["w"] or 0) if r else 0.0
            n.dim = max(range(len(xs)), key=lambda k: (r[f"d{k}"], -k)) if r else 0
            half = (len(n.shards) + 1) // 2
            n.parts = (n.shards[:half], n.shards[half:])
            need = sum(room[s] for s in n.shards)
            n.goal = n.weight * (sum(room[s] for s in n.parts[0]) / need if need else half / len(n.shards))
            n.prefix, n.before, n.cut = 0, 0.0, None if len(n.shards) > 1 else -1
        _find_cuts(cur, nodes, tolerance * goal)
        moves, after = [], {}
        for i, n in nodes.items():
            if len(n.shards) == 1:
                after[i] = n
                continue
            left, right = next_id, next_id + 1
            next_id += 2
            after[left], after[right] = _Node(n.parts[0]), _Node(n.parts[1])
            moves.append((i, n.dim, n.cut, left, right))
        step = spark.createDataFrame(moves, "node int, dim int, cut long, below int, above int")
        moved = cur.join(F.broadcast(step), "node", "left").withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).when(
            F.col("key")[F.col("dim")] < F.col("cut"), F.col("below")).otherwise(F.col("above")))
        cur = scratch.write(moved.select("unit", "w", "key", "node"), f"level-{level + 1}")
        scratch.drop(f"level-{level}")
        level, nodes = level + 1, after
    leaf = {i: n.shards[0] for i, n in nodes.items()}

    shard_of = F.broadcast(spark.createDataFrame(list(leaf.items()), "node int, leaf int"))
    tree = cur.join(shard_of, "node").select("unit", "leaf")
    placed = tagged.join(tree, "unit", "left").withColumn(
        "shard", F.when(F.col("placed") >= 0, F.col("placed")).otherwise(F.col("leaf")))
    return number(scratch, placed.select("id", "size", "unit", "shard")).withColumnRenamed("id", id_col)


def _find_cuts(cur: DataFrame, nodes: dict[int, _Node], near: float) -> None:
    """Sets each open node's ``cut``: the key below which its goal weight lies (within ``near``, or one point)."""
    spark = cur.sparkSession
    low = KEY_BITS
    while low > 0 and any(n.cut is None for n in nodes.values()):
        high, low = low, max(0, low - STEP_BITS)
        todo = spark.createDataFrame([(i, n.dim, n.prefix) for i, n in nodes.items() if n.cut is None],
                                     "node int, dim int, prefix long")
        key = F.col("key")[F.col("dim")]
        hist = (cur.join(F.broadcast(todo), "node").where(F.shiftright(key, high) == F.col("prefix"))
                .groupBy("node", F.shiftright(key, low).alias("bin"))
                .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect())
        bins: dict[int, list] = {}
        for r in hist:
            bins.setdefault(r["node"], []).append((r["bin"], r["w"], r["n"]))
        for i, n in nodes.items():
            if n.cut is not None:
                continue
            for b, w, count in sorted(bins.get(i, [])):
                if n.before + w <= n.goal:
                    n.before += w
                    continue
                if n.goal - n.before <= near:
                    n.cut = b << low
                elif count == 1 or low == 0 or n.before + w - n.goal <= near:
                    n.cut = (b + 1 if n.before + w - n.goal <= n.goal - n.before else b) << low
                else:
                    n.prefix = b
                break
            else:
                n.cut = (n.prefix + 1) << high


def number(scratch: Scratch, placed: DataFrame) -> DataFrame:
    """Adds ``slot``: positions by unit and id within each shard, counted over range partitions."""
    dealt = placed.repartitionByRange("shard", "unit", "id").sortWithinPartitions("shard", "unit", "id")
    dealt = scratch.write(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
                          "dealt")
    from pyspark.sql.window import Window
    runs = dealt.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # one row for each partition and shard that meet: at most partitions + shards
    runs = runs.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n"))
    return (dealt.join(F.broadcast(runs.select("shard", "part", "first", "before")), ["shard", "part"])
            .select("id", "size", "unit", "shard", (F.col("at") - F.col("first") + F.col("before")).alias("slot")))

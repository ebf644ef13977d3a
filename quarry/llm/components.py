"""Connected components of a distributed graph by alternating star contractions.

Every round hangs the larger neighbours of each vertex on its smallest neighbour, then the smaller ones, until
the edges are stars. Nothing is collected; each round is a written table, and a vertex with very many neighbours is
pre-aggregated before its shuffle and joined back with splitting of skewed partitions left to AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch


def components(scratch: Scratch, edges: DataFrame, part: str = "cc") -> DataFrame:
    """``edges(u, v)`` of longs -> ``(v, c)`` for every vertex that is not the smallest of its component."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("c")).distinct()
    cur, k = scratch.write(e, f"{part}-0"), 0
    while not _stars(cur):
        both = cur.unionByName(cur.select(F.col("c").alias("v"), F.col("v").alias("c")))
        low = both.groupBy("v").agg(F.min("c").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = (both.join(low, "v").where("c > v").select(F.col("c").alias("v"), F.col("m").alias("c"))
                 .where("v <> c").distinct())
        large = scratch.write(large, f"{part}-{k}-large")
        small_low = large.groupBy("v").agg(F.min("c").alias("m"))
        moved = large.join(small_low, "v")
        small = (moved.where("c <> m").select(F.col("c").alias("v"), F.col("m").alias("c"))
                 .unionByName(small_low.select("v", F.col("m").alias("c"))).where("v <> c").distinct())
        nxt = scratch.write(small, f"{part}-{k + 1}")
        scratch.drop(f"{part}-{k}-large")
        scratch.drop(f"{part}-{k}")
        cur, k = nxt, k + 1
    return cur


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex has one parent and no parent has one."""
    several = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v")
    inner = edges.select(F.col("c").alias("v")).distinct().join(edges.select("v"), "v", "left_semi")
    return several.unionByName(inner).isEmpty()

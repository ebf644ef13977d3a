"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their sources); each
pattern can supply its tokens once for free and again at costs that rise with every repetition, and every source
demands its quota. The cheapest flow says how many tokens of a pattern go to which source; a seeded order of the
pattern's documents is then cut at these amounts. The flow network has one node per pattern and source, never per
document, and is the only thing that the driver sees; the cuts are found by distributed histograms of the seeded
hash, so a source that holds most documents is one row of each histogram.

Defined results: documents without a source (null or empty membership) are taken zero times, a null source is a
source as any other; sizes that are null count 0; equal documents have their own place in the seeded order, rows with
the same id share one; an empty table gives no rows. Only the named columns are read. Reruns agree.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import Scratch

HASH_BITS, STEP_BITS = 60, 12


def capped_targets(sizes: Sequence[float], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Share the sum of the sizes by weight; no target exceeds ``most`` times its size, the excess is reshared."""
    total, capped = float(sum(sizes)), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        rest = total - sum(most * sizes[k] for k in capped)
        weight = sum(weights[k] for k in free)
        share = {k: rest * weights[k] / weight for k in free} if weight else {}
        over = [k for k in free if share.get(k, 0.0) > most * sizes[k]]
        if not over:
            return [most * sizes[k] if k in capped else share.get(k, 0.0) for k in range(len(sizes))]
        capped.update(over)


def cheapest_flow(capacity: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float],
                  copies: int) -> dict[tuple[int, int], float]:
    """(pattern, source) -> amount. Successive shortest paths; repetition r of a pattern costs r per token."""
    n_p, n_s = len(capacity), len(quota)
    src, sink = n_p + n_s, n_p + n_s + 1
    to: list[int] = []
    cap: list[float] = []
    cost: list[float] = []
    out: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]

    def arc(u: int, v: int, c: float, w: float) -> int:
        for a, b, x, y in ((u, v, c, w), (v, u, 0.0, -w)):
            out[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)
        return len(to) - 2

    for p in range(n_p):
        for r in range(copies):
            arc(src, p, float(capacity[p]), float(r))
    link = {(p, s): arc(p, n_p + s, float("inf"), 0.0) for p in range(n_p) for s in members[p]}
    for s in range(n_s):
        arc(n_p + s, sink, float(quota[s]), 0.0)
    small = 1e-9 * max(1.0, sum(quota))
    while True:
        dist, via, queued = [float("inf")] * len(out), [-1] * len(out), [False] * len(out)
        dist[src], todo = 0.0, deque([src])
        while todo:
            u = todo.popleft()
            queued[u] = False
            for e in out[u]:
                if cap[e] > small and dist[u] + cost[e] < dist[to[e]] - 1e-12:
                    dist[to[e]], via[to[e]] = dist[u] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        todo.append(to[e])
        if via[sink] < 0:
            return {k: cap[e ^ 1] for k, e in link.items() if cap[e ^ 1] > small}
        path, v = [], sink
        while v != src:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def _thresholds(rows: DataFrame, cuts: list[tuple[int, float]]) -> tuple[list[int], dict[int, float]]:
    """For each (pattern, tokens), the hash below which that pattern's documents hold at most the tokens, and the gap."""
    spark = rows.sparkSession
    state = [[p, value, 0, 0.0] for p, value in cuts]  # pattern, tokens, hash prefix, tokens before the prefix
    done: dict[int, int] = {}
    gaps: dict[int, float] = {}
    for depth in range(0, HASH_BITS, STEP_BITS):
        todo = [(k, s[0], s[2]) for k, s in enumerate(state) if k not in done]
        if not todo:
            break
        low = HASH_BITS - depth - STEP_BITS
        at = spark.createDataFrame(todo, "cut int, pattern int, prefix long")
        hist = (rows.join(F.broadcast(at), "pattern").where(F.shiftright("h", HASH_BITS - depth) == F.col("prefix"))
                .groupBy("cut", F.shiftright("h", low).alias("bin")).agg(F.sum("size").alias("size"),
                                                                         F.count(F.lit(1)).alias("n"))).collect()
        bins: dict[int, list] = {}
        for r in hist:
            bins.setdefault(r["cut"], []).append((r["bin"], r["size"], r["n"]))
        for k, _, prefix in todo:
            s = state[k]
            for b, size, n in sorted(bins.get(k, [])):
                if s[3] + size <= s[1]:
                    s[3] += size
                    continue
                if n == 1 or low == 0:  # one document: it is left out, the gap is filled afterwards
                    done[k] = b << low
                    gaps[k] = s[1] - s[3]
                else:
                    s[2] = b
                break
            else:
                done[k] = (prefix + 1) << (HASH_BITS - depth)
    return [done[k] for k in range(len(cuts))], gaps


def _fill(rows: DataFrame, at: list[int], cuts: list[tuple[int, float]], gaps: dict[int, float], rounds: int = 4) -> list[tuple[int, int]]:
    """(pattern, hash) of documents beyond the cut that fill its gap: each round the largest one that fits, and at last
    the smallest that exceeds the gap if that comes nearer."""
    spark, taken = rows.sparkSession, []
    left = dict(gaps)
    for _ in range(rounds):
        todo = [(k, cuts[k][0], at[k], left[k]) for k in left if left[k] >= 1]
        if not todo:
            break
        want = F.broadcast(spark.createDataFrame(todo, "cut int, pattern int, after long, gap double"))
        used = F.broadcast(spark.createDataFrame(taken, "pattern int, h long"))
        fits = F.col("size") <= F.col("gap")
        best = (rows.join(want, "pattern").where("h >= after and size > 0").join(used, ["pattern", "h"], "left_anti")
                .groupBy("cut").agg(F.max(F.when(fits, F.struct("size", "h"))).alias("under"),
                                    F.min(F.when(~fits, F.struct("size", "h"))).alias("over")).collect())
        nxt = {}
        for r in best:
            k, under, over = r["cut"], r["under"], r["over"]
            gap = left[k]
            if over is not None and over["size"] - gap < gap - (under["size"] if under is not None else 0):
                taken.append((cuts[k][0], over["h"]))
            elif under is not None:
                taken.append((cuts[k][0], under["h"]))
                nxt[k] = gap - under["size"]
        left = nxt
    return taken


def mix(df: DataFrame, quotas: dict[str | None, float], id_col: str = "doc_id", size_col: str = "size",
        members_col: str = "sources", *, copies: int = 3, seed: int = 0, max_patterns: int = 20_000) -> DataFrame:
    """Decide how often each document is taken for which source.

    ``members_col`` is an array of source names. Returns the id, size and members with ``copies`` (int, in all) and
    ``per_source`` (array of struct(source, copies)). More than ``max_patterns`` different sets raise an error.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    members = F.array_sort(F.array_distinct(F.coalesce(F.col(members_col), F.array().cast("array<string>"))))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 64 - HASH_BITS)
    base = scratch.write(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
                                   members.alias("members"), h.alias("h")), "sizes")
    found = base.groupBy("members").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; merge small sources first")
    found.sort(key=lambda r: [(m is None, m or "") for m in r["members"]])
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    index = {s: k for k, s in enumerate(names)}
    of = [[index[m] for m in r["members"] if m in index] for r in found]
    cap = [float(r["size"] or 0) for r in found]
    flow = cheapest_flow(cap, of, [float(quotas[s]) for s in names], copies)

    # Each pattern's documents lie on a line of cap tokens that is walked once per repetition; sources take
    # consecutive stretches of the walk.
    cuts: list[tuple[int, float]] = []
    plans = []
    for p in range(len(found)):
        walk, ends = 0.0, []
        for s in of[p]:
            if (p, s) in flow:
                walk += flow[p, s]
                ends.append((s, walk))
        marks = sorted({e % cap[p] for _, e in ends if 1e-6 < e % cap[p] < cap[p] - 1e-6}) if cap[p] else []
        plans.append((p, ends, marks, len(cuts)))
        cuts += [(p, m) for m in marks]
    schema = T.StructType([T.StructField("members", T.ArrayType(T.StringType())), T.StructField("pattern", T.IntegerType())])
    ids = F.broadcast(spark.createDataFrame([(r["members"], p) for p, r in enumerate(found)], schema))
    rows = base.join(ids, "members")
    slim = rows.select("pattern", "size", "h")
    at, gaps = _thresholds(slim, cuts) if cuts else ([], {})
    # With a single cut there is one next stretch to borrow documents from; it is shorter by what they hold.
    single = {first for _, _, marks, first in plans if len(marks) == 1}
    more = _fill(slim, at, cuts, {k: g for k, g in gaps.items() if k in single})

    spec = []
    for p, ends, marks, first in plans:
        edges = [0.0, *marks, cap[p]]
        stretches = []
        for lo, hi in zip(edges, edges[1:]):
            got: dict[int, int] = {}
            for r in range(copies):
                x = (lo + hi) / 2 + r * cap[p]
                s = next((s for s, e in ends if x < e), None)
                if s is not None:
                    got[s] = got.get(s, 0) + 1
            stretches.append([(names[s], n) for s, n in got.items()])
        spec.append((p, [at[first + k] for k in range(len(marks))], stretches))
    plan = spark.createDataFrame(spec, "pattern int, cuts array<long>, stretches array<array<struct<source:string,copies:int>>>")
    taken = rows.join(F.broadcast(plan), "pattern")
    extra = F.broadcast(spark.createDataFrame(sorted(set(more)), "pattern int, h long").withColumn("extra", F.lit(1)))
    taken = taken.join(extra, ["pattern", "h"], "left")
    place = F.size(F.filter("cuts", lambda c: c <= F.col("h"))) - F.coalesce("extra", F.lit(0))
    return (taken.withColumn("per_source", F.col("stretches")[place])
            .select(F.col("id").alias(id_col), "size", "members",
                    F.aggregate("per_source", F.lit(0), lambda a, x: a + x["copies"]).alias("copies"), "per_source"))

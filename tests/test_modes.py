"""Prefix sums by rank, candidate index, late materialisation, exact quotas and splits, strict comparison."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators import compare as CMP
from quarry.operators import dedup as D
from quarry.operators import evaluation as E
from quarry.operators import fewshot as FS
from quarry.operators import mixing as M
from quarry.sources import adapters as A


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# --- prefix sums -------------------------------------------------------------------------------------------

def test_running_stats_model(spark):
    rng = random.Random(1)
    keys = rng.sample(range(-10 ** 15, 10 ** 15), 400)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([True, False, None]), rng.random() < 0.5, "x") for k in keys]
    df = spark.createDataFrame(rows, "k long, part string, f boolean, g boolean, pos_extra string").repartition(5)
    want, seen = set(), {}
    for k, p, f, g, _ in sorted(rows, key=lambda r: r[0]):
        n, cf, cg = seen.get(p, (0, 0, 0))
        seen[p] = n + 1, cf + bool(f), cg + g
        want.add((k, p, n, cf + bool(f), cg + g))
    for block in (3, 1000):
        out = E.running_stats(df, "k", ["part"], ["f", "g"], block=block)
        assert out.columns == [*df.columns, "pos", "cum_f", "cum_g"]
        assert {(r.k, r.part, r.pos, r.cum_f, r.cum_g) for r in out.collect()} == want
    words = spark.createDataFrame([(w,) for w in "the quick brown fox jumps".split()], "w string")
    assert {r.w: r.pos for r in E.positions(words, "w").collect()} == {w: i for i, w in enumerate(sorted("the quick brown fox jumps".split()))}
    assert E.positions(words.limit(0), "w").collect() == []


def test_sparse_keys_use_windows_of_one_block_only(spark):
    """A million rows whose keys lie 100,000 apart: blocks are full, and no window is over a whole part."""
    df = spark.range(1_000_000).select((F.col("id") * 100_000).alias("k"), F.lit("m").alias("part"), (F.col("id") % 3 == 0).alias("f"))
    out = E.running_stats(df, "k", ["part"], ["f"], block=4096)
    p = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in p.splitlines() if "Window [" in line]
    rows = [w for w in windows if "row_number" in w or "_r_f" in w]
    assert rows and all("_blk" in w.split("specifiedwindowframe")[-1] for w in rows)
    assert all("_range" in w for w in windows)  # totals: blocks of a range, or ranges of a part
    last = out.agg(F.max("pos"), F.max("cum_f"), F.sum(F.col("pos") * 100_000 - F.col("k")), F.countDistinct("pos")).first()
    assert tuple(last) == (999_999, 333_334, 0, 1_000_000)


# --- candidate index ------------------------------------------------------------------------------------------

def vectors(n, dim=16, clusters=None, seed=0):
    rng = np.random.default_rng(seed)
    if clusters:
        v = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.2 * rng.normal(size=(n, dim))
    else:
        v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def as_df(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<float>").repartition(4)


@pytest.mark.parametrize("clusters", [None, 40])
def test_index_recall_and_exact_mode(spark, clusters):
    v = vectors(1500, clusters=clusters).astype(np.float32).astype(float)
    df = as_df(spark, v)
    exact = FS.knn(df, df, k=3, chunk_rows=100)
    sims = v @ v.T
    np.fill_diagonal(sims, -np.inf)
    want = {(i, r + 1, int(j)) for i in range(len(v)) for r, j in enumerate(np.argsort(-sims[i], kind="stable")[:3])}
    assert {(r.query_id, r["rank"], r.neighbour_id) for r in exact.collect()} == want
    index = FS.fit_index(df, k=3, sample=800)
    found = FS.knn(df, df, k=3, chunk_rows=100, index=index)
    r = FS.recall(exact, found).first()
    assert r.n_neighbours == 4500 and r.recall >= 0.9 and index.sample_recall >= 0.95
    if clusters:
        assert index.probes < 32  # clustered vectors need few of the 64 buckets
    for q in range(20):  # ranks follow the exact similarities
        got = sorted((x["rank"], sims[q, x.neighbour_id]) for x in found.filter(F.col("query_id") == q).collect())
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def test_grid_of_blocks_and_small_inputs(spark, monkeypatch):
    monkeypatch.setattr(FS, "EDGE", 2)
    v = vectors(300, dim=4, seed=3).astype(np.float32).astype(float)
    df = as_df(spark, v)
    few = df.filter("id < 37")
    sims = v[:37] @ v.T
    want = {(i, int(j)) for i in range(37) for j in np.argsort(-sims[i], kind="stable")[:2]}
    assert {(r.query_id, r.neighbour_id) for r in FS.knn(few, df, k=2, exclude_self=False, chunk_rows=10).collect()} == want
    one = df.filter("id = 0")
    assert FS.knn(one, one, k=2).collect() == [] and FS.knn(df.limit(0), df, k=2).collect() == []
    assert FS.knn(one, one, k=2, exclude_self=False, index=FS.fit_index(one)).count() == 1


# --- late materialisation --------------------------------------------------------------------------------------

def exchanges(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_dedup_aggregates_fixed_width_values_only(spark):
    ex = A.examples(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        full, slim = final_plan(D.dedup(ex)), final_plan(D.dedup(ex, payload=["source_dataset"]).groupBy("source_dataset").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    for p in (full, slim):
        final = p.split("Initial Plan")[0]
        assert "SortAggregate" not in final and "HashAggregate" in final
    # the rows that meet the winners without their text carry the arrival and the source
    w = D.winners(D.with_keys(D.classify(ex)), where=F.col("status") == D.CANDIDATE)
    assert w.columns == ["q_hash", "first_arrival", "arrival"]
    assert {t for _, t in w.dtypes} == {"string", "bigint"}


def test_dedup_keeps_the_payload_of_the_winner(spark):
    rows = [(1, "Same?", "SELECT aaaa", "a", -3, 10), (2, "same", "SELECT bb", "b", 2, 2 ** 62), (3, "SAME", "SELECT cc", "c", 2, -2 ** 62),
            (4, "same!", "SELECT dddd", "d", 2, 4), (5, "other", "PRAGMA x", "e", 9, 5), (6, "other", "SELECT 1", "f", 0, 6)]
    df = spark.createDataFrame(rows, "example_id long, question string, sql string, source_dataset string, priority int, arrival long")
    got = {r.example_id: (r.first_arrival, r.source_dataset, r.priority, r.arrival) for r in D.dedup(df).collect()}
    assert got == {3: (-2 ** 62, "c", 2, -2 ** 62), 6: (6, "f", 0, 6)}
    named = df.withColumn("arrival", F.struct(F.lit("file").alias("f"), F.col("arrival").alias("i")))
    assert {r.example_id for r in D.dedup(named).collect()} == {3, 6}
    one = D.dedup(df, payload=["source_dataset", F.length("sql").alias("n")])
    assert one.columns == ["q_hash", "first_arrival", "source_dataset", "n", "priority", "arrival"]


# --- exact quotas and split --------------------------------------------------------------------------------------

@pytest.mark.parametrize("strategy", ["all_exhausted", "first_exhausted"])
def test_exact_quotas_are_met(spark, strategy):
    sizes, weights = {"a": 100, "b": 33, "c": 7, "d": 1}, {"a": 0.37, "b": 0.21, "c": 0.3, "d": 0.02, "absent": 0.1}
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)], "id string, src string")
    p = {s: weights[s] / sum(weights[x] for x in sizes) for s in sizes}
    total = math.ceil(max(sizes[s] / p[s] for s in sizes) - 1e-6) if strategy == "all_exhausted" else math.floor(min(sizes[s] / p[s] for s in sizes) + 1e-6)
    share = {s: total * p[s] for s in sizes}
    quota = {s: math.floor(round(share[s], 6)) for s in sizes}
    for s in sorted(sizes, key=lambda s: (-round(share[s] - quota[s], 6), s))[:total - sum(quota.values())]:
        quota[s] += 1
    results = []
    for parts in (1, 8, 64):
        rows = M.interleave_exact(df.repartition(parts), "src", "id", weights, strategy).collect()
        results.append(sorted((r.id, r.copy, r.mix_key) for r in rows))
        assert Counter(r.src for r in rows) == Counter({s: q for s, q in quota.items() if q}) and len(rows) == total
        per = Counter(r.id for r in rows)
        for s, n in sizes.items():
            own = [per[f"{s}{i}"] for i in range(n)]
            assert max(own) - min(own) <= 1
            if strategy == "all_exhausted":
                assert min(own) >= 1
    assert results[0] == results[1] == results[2]
    with pytest.raises(Exception, match="no mix weight"):
        M.interleave_exact(df, "src", "id", {"a": 1.0}, strategy).collect()


def test_exact_split_has_the_stated_count(spark):
    for n, fraction, want in ((1000, 0.02, 20), (999, 0.02, 20), (50, 0.02, 1), (3, 0.0, 0), (1, 0.02, 1), (40, 1.0, 40), (0, 0.02, 0)):
        df = spark.range(n).withColumnRenamed("id", "k")
        sides = [sorted(r.k for r in M.split_exact(df.repartition(p), "k", fraction).filter("split = 'validation'").collect()) for p in (1, 8, 64)]
        assert len(sides[0]) == want and sides[0] == sides[1] == sides[2]


# --- strict comparison ---------------------------------------------------------------------------------------------

def strict(spark, gen, gold, kind="string"):
    df = spark.createDataFrame([(1, "gen", r) for r in gen] + [(1, "gold", r) for r in gold], f"pair_id long, side string, row_values array<{kind}>")
    return CMP.compare_results(df, spark.createDataFrame([(1,)], "pair_id long"), "strict").first()


@pytest.mark.parametrize("a,b,same", [
    ("7", "007", False), ("1", "1.0", True), ("1", "1e0", True), ("1.5e3", "1500", True), ("-0.0", "0", True), ("0.1", "0.1000000001", True),
    ("0.1", "0.100000001", False), ("1e400", "2e400", False), ("1e400", "10e399", True), ("1.20e400", "12e399", True), ("-1e400", "1e400", False),
    ("1e-400", "0", True), ("12345678901234567890", "12345678901234567891", False), ("9" * 40, "9" * 39 + "8", False), ("9" * 40, "9" * 40 + ".0", True),
    ("A ", "a", True), ("nan", "NaN", True), ("nan", "1", False), ("1e99999999999", "1e99999999998", False), ("+1", "1", False), (".5", "0.5", False),
    (None, None, True), (None, "null", False), (None, "", False), ("", " ", True)])
def test_strict_values(spark, a, b, same):
    assert strict(spark, [[a]], [[b]])["results_match"] is same


def test_strict_rows_are_bags_of_typed_rows(spark):
    assert strict(spark, [["1", None], ["1", None]], [[None, "1.0"], ["1", None]])["results_match"]
    r = strict(spark, [["a"], ["a"]], [["a"]])
    assert not r["results_match"] and r["feedback"] == "Result count mismatch: generated 2 rows, expected 1 rows"
    kind = CMP.TYPED
    assert not strict(spark, [[("text", "7")]], [[("number", "7")]], kind)["results_match"]
    assert strict(spark, [[("number", "7.0"), ("date", "2024-01-01")]], [[("date", "2024-01-01"), ("number", "7")]], kind)["results_match"]
    assert not strict(spark, [[("boolean", "true")]], [[("text", "true")]], kind)["results_match"]
    df = spark.createDataFrame([(7, "7", 1.5, None)], "a int, b string, c double, d date")
    assert [tuple(x) for x in df.select(CMP.typed_values(df).alias("v")).first().v] == [("number", "7"), ("text", "7"), ("number", "1.5"), ("date", None)]


def test_failed_queries_have_no_comparison(spark):
    rows = spark.createDataFrame([(i, s, ["x"]) for i in range(4) for s in ("gen", "gold")], "pair_id long, side string, row_values array<string>")
    pairs = spark.createDataFrame([(0, True, True), (1, False, True), (2, True, None), (3, True, True)], "pair_id long, gen_ok boolean, gold_ok boolean")
    for mode in ("reference", "strict"):
        got = {r.pair_id: (r.results_match, r.n_gen, r.feedback) for r in CMP.compare_results(rows, pairs, mode).collect()}
        assert got == {0: (True, 1, CMP.MSG_MATCH), 1: (False, 0, CMP.MSG_FAILED), 2: (False, 0, CMP.MSG_FAILED), 3: (True, 1, CMP.MSG_MATCH)}

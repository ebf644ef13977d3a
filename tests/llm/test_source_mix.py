from collections import defaultdict

import pytest

from quarry.llm import source_mix as M
from quarry.llm.queries import QUERIES
from tests.llm.common import words


def test_targets():
    t = M.capped_targets([100, 10, 1000], [5, 2, 1])
    assert t[0] == 300 and t[1] == 30 and t[2] == pytest.approx(780)
    assert M.capped_targets([], []) == [] and M.capped_targets([0, 0], [1, 1]) == [0, 0]


def test_flow_is_cheapest():
    """Two sources share a pattern; repeating the shared documents is avoided while others are unused."""
    flow = M.cheapest_flow([100, 100, 50], [[0], [0, 1], [1]], [150, 100], 3)
    assert sum(v for (p, s), v in flow.items() if s == 0) == pytest.approx(150)
    assert sum(v for (p, s), v in flow.items() if s == 1) == pytest.approx(100)
    used = [sum(v for (p, _), v in flow.items() if p == k) for k in range(3)]
    assert used == pytest.approx([100, 100, 50])


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a"]) for i in range(200)] + [(1000 + i, 10, ["b", "a"]) for i in range(200)] + [(2000 + i, 10, ["b", None]) for i in range(50)]
    rows += [(3000, None, ["a"]), (3001, 7, None), (3002, 5, [])]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>").repartition(5)
    quotas = {"a": 2500.0, "b": 3000.0, None: 200.0}
    got = M.mix(df, quotas).collect()
    by = defaultdict(int)
    for r in got:
        for x in r.per_source:
            by[x.source] += x.copies * r.size
        assert 0 <= r.copies <= 3 and r.copies == sum(x.copies for x in r.per_source)
        assert {x.source for x in r.per_source} <= set(r.members)
    assert len(got) == len(rows)
    for s, q in quotas.items():
        assert abs(by[s] - q) <= 30
    again = {r.doc_id: r.copies for r in M.mix(df.repartition(2), quotas).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, size long, sources array<string>")
    assert M.mix(df, {"a": 0.0}).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target = defaultdict(int), {}
    rows = QUERIES["op2_source_mix"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = defaultdict(int)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        sizes[s] += r.size
        target[s] = (r.target, r.source_size)
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = M.capped_targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    for s, w in zip(order, want):
        assert target[s] == (pytest.approx(w), sizes[s]) and abs(taken[s] - w) <= 0.05 * w

import numpy as np

from quarry.llm import embedding_join as E
from quarry.llm.queries import QUERIES


def brute(rows, cosine):
    good = {}
    for i, v in rows:
        if v and all(x is not None for x in v):
            a = np.array(v, float)
            if np.isfinite(a).all() and a.any():
                a = a / np.abs(a).max()  # so that squares stay in range
                good[i] = a / np.linalg.norm(a)
    up = {i: i for i, _ in rows}
    n = dict.fromkeys(up, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in {len(a) for a in good.values()}:
        ids = [i for i, a in good.items() if len(a) == d]
        x = np.array([good[i] for i in ids])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            i, j = ids[a], ids[b]
            n[i] += 1
            n[j] += 1
            p, q = sorted((find(i), find(j)))
            up[q] = p
    return {i: (n[i], find(i), find(i) == i) for i in up}


def got(spark, rows, cosine):
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, id int, vec string").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, cosine=cosine).collect()}


ODD = [(9001, None), (9002, [0.0] * 3), (9003, [float("nan"), 1.0, 1.0]), (9004, [1.0, 2.0]), (9005, [1.0, 2.0]), (9006, []),
       (9007, [None, 1.0, 1.0]), (9008, [1e-200, 2e-200, 0.0]), (9009, [1e200, 2e200, 0.0]), (9010, [-0.0, 0.0, 1.0]), (9011, [0.0, 0.0, 3.0])]


def test_clusters_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "PER_PIVOT", 40)
    monkeypatch.setattr(E, "BLOCK", 37)
    monkeypatch.setattr(E, "CHUNK", 60)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 3))
    x = centre[rng.integers(0, 30, 600)] + 0.3 * rng.normal(size=(600, 3))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(600 + i, list(map(float, x[i]))) for i in range(50)] + ODD
    assert got(spark, rows, 0.99) == brute(rows, 0.99)


def test_empty_table(spark):
    assert got(spark, [], 0.9) == {}


def test_slices_keep_components():
    """A path whose links a minimum per vertex would lose."""
    ok = np.zeros((3, 3), bool)
    for a, b in ((0, 1), (1, 1), (1, 2), (2, 2)):
        ok[a, b] = True
    e = E._stars(ok, np.array([1, 5, 2]), np.array([9, 6, 7]))
    assert {int(v): int(c) for v, c in e} == {1: 1, 5: 1, 2: 1, 6: 1, 7: 1}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op3_embedding_join"](spark, sf).collect()}
    assert out == brute(rows, 0.9)


def test_repeated_and_null_ids_keep_their_links(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.999, 0.01, 0.0]
    rows = [(1, a), (1, b), (2, c), (None, a), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0]), (3, b), (3, b), (4, None), (4, a), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=str)
    # links within {a, a, a, c}: 3 each; {b, b, b}: 2; the two null ids: 1
    want = [(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (4, 3, 1, False),
            (1, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (4, 0, 4, True), (None, 0, None, True)]
    assert out == sorted(want, key=str)

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quarry.llm import dart_minhash as D
from quarry.llm.queries import QUERIES
from tests.llm.common import EDGE, documents, words


def shingles(t):
    w = words(t)
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute(docs):
    sh, by = {i: shingles(t) for i, t in docs.items()}, defaultdict(list)
    for i, s in sh.items():
        for k in s:
            by[k].append(i)
    up = {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(min(x, y), max(x, y)) for v in by.values() for x in v for y in v if x != y}:
        both = sum((sh[a] & sh[b]).values())
        if 5 * both >= 4 * sum((sh[a] | sh[b]).values()):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {i: (find(i), find(i) == i) for i in docs}


def got(df):
    return {r.doc_id: (r.component_id, r.kept) for r in D.near_duplicates(df).collect()}


def test_cells_are_the_multiset():
    texts = ["a b c d e a b c d e a b c d e f", "x", "", None, "p q r s t p q r s t"]
    cells, offsets = D.shingles(pa.array(texts))
    assert np.diff(offsets).tolist() == [sum(shingles(t).values()) for t in texts]
    assert len(set(cells.tolist())) == len(cells)


def test_collision_rate_is_the_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    y = x.copy()
    y[:80] = rng.integers(0, 2**63, 80).astype(np.uint64)
    s = D.signatures(np.concatenate([x, y]), np.array([0, 400, 800]), 2000)
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.05
    assert not (s == ~np.uint64(0)).any()


def test_edges_and_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = list(EDGE)
    for i in range(40):  # a hot group of near copies, each with one word of its own
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    for i in range(20):  # a chain: neighbours are near, ends are not
        rows.append((200 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 100))))
    rows += [(300, " ".join(base)), (301, " ".join(base) + "\n"), (302, " ".join(base))]
    assert got(documents(spark, rows)) == brute(dict(rows))


def templated(n, seed):
    """Documents of one template with many words of their own, and at the end two with few, near each other only."""
    rng = random.Random(seed)
    base = [f"t{j}" for j in range(100)]
    rows = [(i, " ".join(base + [f"o{i}x{rng.randrange(10**6)}" for _ in range(60)])) for i in range(n)]
    return rows + [(n + i, " ".join(base + [f"p{i}x{j}" for j in range(8)])) for i in range(2)]


def test_link_of_two_members_that_never_lead(spark, monkeypatch):
    rows = templated(40, 1)
    want = brute(dict(rows))
    assert want[41] == (40, False)
    monkeypatch.setattr(D, "FEW", 0)  # leaders first, whatever the number of pairs
    for full in (64, 1):  # listed pairs, prefix filter
        monkeypatch.setattr(D, "FULL", full)
        out = D.near_duplicates(documents(spark, rows), bands=1, rows=1)
        assert {r.doc_id: (r.component_id, r.kept) for r in out.collect()} == want


def test_prefix_filter_of_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(D, "FEW", 0)
    monkeypatch.setattr(D, "FULL", 1)
    test_edges_and_groups(spark)
    rows = templated(30, 2) + [(100 + i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 100))) for i in range(12)]
    assert got(documents(spark, rows)) == brute(dict(rows))


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    out = [(r.doc_id, r.component_id, r.kept) for r in D.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(out, key=str) == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)
    assert got(documents(spark, [])) == {}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: (r.component_id, r.kept) for r in QUERIES["op9_dart_minhash"](spark, sf).collect()}
    assert out == brute(docs)


def test_rows_are_shingled_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "PIECE_BYTES", 60)
    texts = ["a b c d e f g " * (i % 6) for i in range(30)] + [None, "", "x " * 200, None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    pieces = list(D._pieces(batch, 1))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= 60 for p in pieces) and len(pieces) > 20
    got = pa.Table.from_batches(D._cells(5)([batch]))["cells"].to_pylist()
    cells, offsets = D.shingles(batch["text"])
    assert got == [np.sort(cells[a:b]).tobytes() for a, b in zip(offsets, offsets[1:])]


def test_prefix_pairs_leave_out_what_cannot_be_similar(spark):
    """Equal sizes with 13 % of cells of their own: in each other's prefixes, yet at 0.77 at most."""
    rng = np.random.default_rng(8)
    base, rows = np.arange(1, 88, dtype=np.int64), []
    for i in range(30):
        rows.append((i, np.sort(np.concatenate([base, rng.integers(10**6, 10**12, 13)])).astype(np.int64).tobytes()))
    rows.append((30, np.sort(np.concatenate([base, np.frombuffer(rows[0][1], np.int64)[-13:][:9], [91, 92, 93, 94]])).astype(np.int64).tobytes()))
    cells = spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "id long, cells binary")
    members = spark.createDataFrame([(i, i) for i, _ in rows], "id long, c long")
    from quarry.llm.shared import Scratch
    got = {(r.a, r.b) for r in D._prefix_pairs(Scratch(spark, "test"), members, cells, 4, 5).collect()}
    assert got == {(0, 30)}

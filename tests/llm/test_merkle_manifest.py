"""Proofs of every row against a tree built by plain loops."""
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle_manifest as M
from quarry.llm.queries import ORACLES, QUERIES
from quarry.llm.shared import Scratch
from tests.llm.common import EDGE, EXTRA

HASHED = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = f"doc_id long, source string, lang string, n_chars long, text string, {EXTRA}, path string, tree long, digest string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """Root, and for each leaf its (before, after) siblings from the leaf up."""
    level, paths, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            lo = i // 16 * 16
            path.append(("".join(level[lo:i]), "".join(level[i + 1:lo + 16])))
        level = [h("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for r, path in zip(by[s], trees[s][1]):
            full = path + up
            alt = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                alt = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            d = leaf(alt)
            for before, after in full:
                d = h(before + d + after)
            out.append((r[0], leaf(r), trees[s][0], root, h("".join(b + a for b, a in full)), d, d == root))
    return out


def run(spark, rows, partitions=3):
    full = [(*r, 0, 0, 0, 0, True, "k", 0, "h", 1, "p", 7, "d") for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(partitions)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = M.verified_proofs(df, "doc_id", "source", HASHED, {"text": M.lower_ascii("text")}, chosen)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


def key(r):
    return [(x is not None, x) for x in r]


def corpus(sizes, seed=1):
    rng, rows, i = random.Random(seed), [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += rng.randrange(1, 4)
            rows.append((i, s, rng.choice(["en", None, "É"]), rng.choice([None, 5, -1]), rng.choice([None, "", "Ab ÉC", f"T{i}", "low"])))
    return rows


@pytest.mark.parametrize("sizes,partitions", [({"a": 17}, 1), ({None: 3, "": 1, "z": 257, "É": 33, "Z": 2, "a": 16}, 13),
                                              ({f"s{k}": 1 + k % 3 for k in range(40)}, 3)])
def test_sizes(spark, sizes, partitions):
    rows = corpus(sizes)
    assert sorted(run(spark, rows, partitions), key=key) == sorted(brute(rows), key=key)


def test_edges(spark):
    rows = [(i, "s0", "en", len(t or ""), t) for i, t in EDGE if len(t or "") < 1000]
    rows += [(None, "s0", None, None, "Null Id"), (None, "s0", None, None, "Null Id"), (None, None, None, None, None)]
    rows += [(7, "s0", "en", 3, "one")] * 40 + [(7, "s0", "en", 3, "other")] + [(50, "s1", "en", 9, "Xy " * 20_000)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_empty_table_and_one_row(spark):
    one = [(1, "a", None, None, "T")]
    assert run(spark, []) == [] and run(spark, one) == brute(one)


def test_a_few_requests(spark):
    """Only what is asked for is descended to; a changed digest does not fold to the root."""
    scratch = Scratch(spark, "test-merkle")
    digests = [h(str(i)) for i in range(300)]
    leaves = spark.createDataFrame([(0, i, 300, bytes.fromhex(d)) for i, d in enumerate(digests)], "tree long, idx long, n long, digest binary")
    forest = M.build(scratch, leaves, "t")
    asked = spark.createDataFrame([(0, i, i) for i in (0, 17, 299)], "tree long, idx long, asked long")
    begin = spark.createDataFrame([(0, [])], f"tree long, path {M.PATH}")
    out = M.descend(scratch, forest, begin, asked, "d")
    hexed = F.lower(F.hex("digest"))
    got = {r.asked: (r.d, r.good, r.bad) for r in out.select("asked", hexed.alias("d"), M.fold(F.col("path"), hexed).alias("good"),
                                                             M.fold(F.col("path"), F.lit("00")).alias("bad")).collect()}
    root, _ = tree(digests)
    assert {k: v[:2] for k, v in got.items()} == {i: (digests[i], root) for i in (0, 17, 299)}
    assert all(v[2] != root for v in got.values())


def test_query_against_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLES["op13_merkle_manifest"])
    rows = QUERIES["op13_merkle_manifest"](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall()) and {r.verified for r in rows} == {True, False}

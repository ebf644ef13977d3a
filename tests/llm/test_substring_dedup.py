import hashlib

import pytest

from quarry.llm import substring_dedup as S
from quarry.llm.queries import QUERIES
from tests.llm.common import EDGE, documents, words


def brute(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            if k in seen:
                gone[s:s + width] = [True] * width
            seen.add(k)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("width", [20, 3])
def test_equals_brute_force(spark, width):
    rows = [*EDGE, (None, EDGE[0][1])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.remove_repeated(documents(spark, rows), width=width).collect()}
    assert got == brute(rows, width)


def test_empty_table(spark):
    assert S.remove_repeated(documents(spark, [])).count() == 0


def test_many_blocks_and_query(spark, monkeypatch):
    from quarry.llm import blocks
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in brute(rows, 20).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, sf).collect()}
    assert got == want
    out = S.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(13))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in out.collect()} == {i: v[:2] for i, v in want.items()}
    assert blocks.BLOCK_BYTES > 0

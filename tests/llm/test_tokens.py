"""Packing and token shards against the tokenizers library."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import harmonic_packing as P
from quarry.llm import tokens as T
from quarry.llm import wavelet_tokens as V
from quarry.llm.queries import QUERIES
from tests.llm.common import EDGE, documents

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", "a", " a", "a ", "a  b", "a \n b", "a\nb", "a\n\nb c", "it's we'll 12 345 !? don't", "tab\tx", "nb sp  x", "é ÉΣ ΑΣ Σ​ x",
          "日本 語　x", "<|endoftext|> <|startoftext|>a", "x <|endoftext|> y", "X<|ENDOFTEXT|>", "a<|endoftext|><|endoftext|>\n b", "\x1c x\x85y", "a\x01b \x00c", "!!! ??\n!!!", " \n ", "ﬁ ²³ Ⅷ", "a\r\nb", "x" * 5000]


@pytest.mark.parametrize("path,kind", [(WORDS, "words"), (BYTES, "bytes")])
def test_memo_gives_the_library_s_ids(path, kind):
    lib = Tokenizer.from_file(path)
    texts = [*TRICKY, *(t or "" for _, t in EDGE)]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    enc = T.Encoder(path, kind)
    assert enc.encode(texts) == want and enc.encode(texts[::-1]) == want[::-1]


def reference(path, docs, end):
    lib = Tokenizer.from_file(path)
    return {i: e.ids + [end] for i, e in zip(docs, lib.encode_batch([t or "" for t in docs.values()], add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, ids, most_padding):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"]:r["start"] + r["length"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at and n > 0
            at += n
        assert at == len(ids[i])
    fill = []
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
        fill.append(at)
    assert sum(2048 - f for f in fill) <= most_padding * 2048 * len(fill)


@pytest.mark.parametrize("n", [1, 31, 32, 300, 682, 683, 1000, 1023, 1024, 1025, 2047, 2048, 2049, 100_000])
def test_cut(n):
    parts = P.cut(n)
    assert sum(x for x, _ in parts) == n and all(1 <= x and k * x <= 2048 for x, k in parts)
    assert all(2048 - k * x <= 64 for x, k in parts)


def test_packing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN_IN", 2)
    rows = [(i, t) for i, (_, t) in enumerate(EDGE)] + [(100 + i, f"word{i} " * (i * 7 % 900)) for i in range(200)]
    out = P.pack(documents(spark, rows, 9), tokenizer=WORDS)
    got = [{**r.asDict(), "ids_crc32": zlib.crc32(r.ids)} for r in out.collect()]
    check_packing(got, reference(WORDS, dict(rows), 1), 0.05)


def test_packing_query_and_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packing([r.asDict() for r in QUERIES["op4_harmonic_packing"](spark, sf).collect()], reference(WORDS, docs, 1), 0.03)
    assert P.pack(documents(spark, []), tokenizer=WORDS).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 97, 3000) * 517
    m, docs, offsets = V.from_file(V.to_file(a, [5, None], np.array([0, 1200, 3000]), 16))
    assert (m.all() == a).all() and docs == [5, None] and offsets.tolist() == [0, 1200, 3000]
    assert all(m.access(i) == a[i] for i in range(0, 3000, 37))
    for t in {*a[:40].tolist(), 3, 70000}:
        at = np.flatnonzero(a == t)
        assert m.count(t) == len(at) and m.count(t, 100, 901) == ((at >= 100) & (at < 901)).sum()
        assert [m.find(t, j) for j in range(len(at) + 1)] == [*at.tolist(), -1]
    with pytest.raises(ValueError):
        V.from_file(b"xxxx")


def test_files_round_trip(spark, tmp_path):
    rows = [(i * 3, t) for i, (_, t) in enumerate(EDGE)] + [(-5, "first"), (1000, "last one")]
    path = str(tmp_path / "files")
    V.write_files(documents(spark, rows, 5), path, tokenizer=BYTES, end_id=2, file_tokens=50)
    files = spark.read.parquet(path)
    assert files.count() > 2
    want, at = reference(BYTES, dict(rows), 2), 0
    got = {r["id"]: r for r in V.read_documents(files).collect()}
    for i in sorted(want):
        assert (got[i]["start"], got[i]["n_tokens"], zlib.crc32(got[i]["ids"])) == (at, len(want[i]), crc(want[i]))
        at += len(want[i])


def test_wavelet_query_and_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, at = reference(BYTES, docs, 2), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_wavelet_tokens"](spark, sf).collect()}
    for i in sorted(want):
        assert got[i] == (at, len(want[i]), crc(want[i]))
        at += len(want[i])
    path = str(tmp_path / "none")
    V.write_files(documents(spark, []), path, tokenizer=BYTES, end_id=2)
    assert V.read_documents(spark.read.schema(V.FILE_SCHEMA).parquet(path)).count() == 0


def test_memo_generations(monkeypatch):
    """Ids do not depend on what the memo still holds."""
    monkeypatch.setattr(T, "MEMO_PIECES", 6)
    monkeypatch.setattr(T, "BATCH_CHARS", 20)
    lib = Tokenizer.from_file(BYTES)
    texts = [f"alpha beta w{i % 7} gamma{i % 3}" for i in range(40)]
    enc = T.Encoder(BYTES, "bytes")
    assert enc.encode(texts) == [np.array(lib.encode(t).ids, "<u4").tobytes() for t in texts]
    assert len(enc.memo) <= 6 + 8 and len(enc.old) <= 6 + 8


def test_special_strings_are_tokens_as_in_the_plain_call():
    assert np.frombuffer(T.Encoder(WORDS, "words").encode(["x <|endoftext|> y"])[0], "<u4").tolist() == [343, 49407, 344]
    assert np.frombuffer(T.Encoder(BYTES, "bytes").encode(["x <|endoftext|> y"])[0], "<u4").tolist() == [87, 220, 50256, 331]


def test_ids_beyond_the_planes_are_an_error():
    ids = np.array([70_000, 3], np.uint32)
    with pytest.raises(ValueError, match="70000"):
        V.WaveletMatrix.build(ids, 16)
    assert V.WaveletMatrix.build(ids, 17).all().tolist() == [70_000, 3]

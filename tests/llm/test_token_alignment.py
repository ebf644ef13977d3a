"""Alignment against plain loops over the two libraries' own tokens; merging and counting against dictionaries."""
import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import token_alignment as T
from quarry.llm.queries import QUERIES
from tests.llm.common import EDGE, documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["a", " a", "a ", "a  b", "a\nb", "it's we'll 12 345 !? don't", "tab\tx", "nb sp x", "é é ÉΣ", "日本 語　x", "<|endoftext|> <s></s> <unk> <0x41>",
          "▁x", "a▁b", "\x00 \x1c\x85y", "ﬁ ²³ Ⅷ", "a\r\nb", "x" * 5000, " " * 200 + "z", "\n" * 100, "🙂🙂 👩‍👩‍👧", "﻿x", "𐐀 Ᲊ"]


def brute(rows):
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    with open(A, encoding="utf-8") as f:
        entry = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    docs = []
    for i, t in rows:
        a = lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        ra = [bytes(byte_of[c] for c in entry[x]) for x in a]
        rb = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, sp.id_to_piece(x)) for x in b)]
        if not t or b"".join(ra) != b" " + t.encode() or b"".join(rb) != b" " + t.encode():
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for k, x in enumerate(ra):
            at += len(x)
            ends_a[at] = k
        at = 0
        for k, x in enumerate(rb):
            at += len(x)
            ends_b[at] = k
        groups, links, la, lb = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            groups.append((a[la:ends_a[e] + 1], b[lb:ends_b[e] + 1]))
            la, lb = ends_a[e] + 1, ends_b[e] + 1
            links.append((a[la - 1], b[lb - 1]))
        docs.append((i, a, b, groups, links))
    count = Counter(x for d in docs for x in d[4])
    top = defaultdict(int)
    for (a, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def key(r):
    return [(x is not None, x) for x in r]


def run(spark, rows, partitions=3):
    out = T.align(documents(spark, rows, partitions), "doc_id", "text", A, B)
    return sorted(map(tuple, out.collect()), key=key)


def corpus():
    rng = random.Random(4)
    words = ["the", "Überraschung", "ciónzado", "42", "don't", "étude", "x" * 40, "antidis", "—", "日本語"]
    rows = [*EDGE, *((200 + k, t) for k, t in enumerate(TRICKY)), (None, "a null id"), (6, "one"), (6, "another text")]
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    return rows + [(5000 + i, "hot hot hot pair") for i in range(200)]


def test_edges_and_random_texts(spark):
    rows = corpus()
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_many_lanes_and_chunks(spark, monkeypatch):
    """Small blocks, lanes and chunks: several levels of the tree, chunks that split a pair's records."""
    for name, value in {"BLOCK_BYTES": 500, "TOGETHER_BYTES": 300, "CHUNK": 7, "LANE_BLOCKS": 2, "FAN_IN": 3}.items():
        monkeypatch.setattr(T, name, value)
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(T)  # workers get the small sizes too
    try:
        rows = [r for r in corpus() if len(r[1] or "") < 6000]
        assert run(spark, rows, 5) == sorted(brute(rows), key=key)
    finally:
        cloudpickle.unregister_pickle_by_value(T)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_byte_side_gives_the_library_s_ids():
    side = T.ByteSide(A)
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    texts = [f"a{c}b {c}{c} 1{c} {c}'s" for c in map(chr, [*range(0x530), *range(0x2000, 0x2070)])] + TRICKY
    assert side.encode(texts) == [e.ids for e in lib.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_special_tokens_are_plain_text():
    a, b = T.sides(A, B)
    assert 50256 not in a.encode(["x <|endoftext|> y"])[0] and not {0, 1, 2} & set(b.encode(["<s> x </s> <unk>"])[0])


@pytest.mark.parametrize("seed", range(4))
def test_merge_counts_and_maxima(seed, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 5)
    rng = random.Random(seed)
    runs, want = [], Counter()
    for _ in range(rng.randrange(1, 9)):
        own = Counter((rng.randrange(6) << T.ID_BITS) | rng.randrange(4) for _ in range(rng.randrange(1, 60)))
        want += own
        keys = np.array(sorted(own), np.uint64)
        runs.append(T.write_run([(keys, np.array([own[int(k)] for k in keys], np.int64))]))
    merged = T.write_run(T.merge([T.read_run(r) for r in runs]))
    got = [(int(k), int(n)) for keys, ns in T.read_run(merged) for k, n in zip(keys, ns)]
    assert got == sorted(want.items())
    top = defaultdict(int)
    for k, n in want.items():
        top[k >> T.ID_BITS] = max(top[k >> T.ID_BITS], n)
    answers = T.write_run(T.with_maxima(T.read_run(merged)))
    assert [(int(k), int(n), bool(t)) for c in T.read_run(answers) for k, n, t in zip(*c)] == [(k, n, n == top[k >> T.ID_BITS]) for k, n in sorted(want.items())]
    asked = sorted(rng.choices(list(want), k=40))
    chunks = [np.array(asked[i:i + 3], np.uint64) for i in range(0, 40, 3)]
    assert [int(n) for f in T.look_up(iter(chunks), T.read_run(answers)) for n in f[0]] == [want[k] for k in asked]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(brute(rows))

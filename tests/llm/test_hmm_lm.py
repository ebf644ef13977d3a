import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import blocks as B
from quarry.llm import hmm_lm as H
from quarry.llm.queries import QUERIES
from tests.llm.common import EDGE, documents

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def model(k, c, seed=0):
    rng = np.random.default_rng(seed)
    part = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s))
    return H.Model(part(k), part(k, k), part(k, c))


def test_segments_give_the_plain_recursions(monkeypatch):
    monkeypatch.setattr(H, "SEGMENT", 7)
    m, sizes = model(3, 11), np.array([1, 5, 7, 8, 40, 3, 29, 14])
    tokens = np.random.default_rng(1).integers(0, 11, sizes.sum()).astype(np.uint16)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    start, move, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 11)), []
    for a, b in zip(ends, ends[1:]):
        t = tokens[a:b]
        al = [m.start * m.emit[:, t[0]]]
        for x in t[1:]:
            al.append((al[-1] @ m.move) * m.emit[:, x])
        be = [np.ones(3)]
        for x in t[:0:-1]:
            be.insert(0, m.move @ (m.emit[:, x] * be[0]))
        p = al[-1].sum()
        total.append(math.log10(p))
        for i, x in enumerate(t):
            g = al[i] * be[i] / p
            emit[:, x] += g
            start += g if i == 0 else 0
            if i + 1 < len(t):
                move += al[i][:, None] * m.move * (m.emit[:, t[i + 1]] * be[i + 1])[None, :] / p
    assert np.allclose(H.log10_likelihoods(tokens, sizes, m), total, rtol=1e-12)
    got = H.expected_counts(tokens, sizes, m, np.float64)
    assert np.allclose(got, np.concatenate([start, move.ravel(), emit.ravel(), [sum(total)]]), rtol=1e-9)


def tokens(text):
    return (text or "").encode().translate(LOWER).split() + [b""]


def check_base(rows, docs):
    words = {i: tokens(t) for i, t in docs.items()}
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in docs}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(docs)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)


def test_query_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_hidden_markov_lm"](spark, sf).collect()
    check_base(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.9


def test_query_trains_six_iterations(spark, monkeypatch):
    full, log = H.score, []
    monkeypatch.setattr(H, "score", lambda *a, **k: full(*a, **k, log=log))
    QUERIES["op6_hidden_markov_lm"](spark, "/root/testdata/sf0.001")
    assert len(log) == 6


def dense(rows, states, iterations):
    """Scores by a model in one piece, in which every word seen twice or more is a class."""
    ids, held, sizes, known, _, number = H._read_block(B.to_ipc(pa.table({"id": [i for i, _ in rows], "text": [t for _, t in rows]})))
    count = np.bincount(number[np.repeat(~held, sizes)], minlength=len(known))
    own, once = count > 1, (count == 1).sum()
    c = H.Classes(known[own], 0, np.concatenate([count[own] + 0.5, [1.5 * once, 0.5]]))
    cls = np.where(own, np.cumsum(own) - 1, np.where(count == 1, c.once, c.unseen))
    emit = c.mass * np.concatenate([H.disturbed(np.append(c.top, H.ONCE), states), np.zeros((states, 1))], axis=1)
    m = H.initial(c, states)
    m = H.finished(m.start, m.move, emit, c)
    use = np.repeat(~held, sizes)
    for _ in range(iterations):
        m = H.maximize(H.expected_counts(cls[number][use], sizes[~held], m, np.float64), c, states)
    within = np.where(count == 1, -np.log10(once), 0)[number]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return len(c.top), dict(zip(ids.to_pylist(), H.log10_likelihoods(cls[number], sizes, m) + np.add.reduceat(within, starts)))


def test_every_word_seen_twice_has_emissions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"t{i % 3}w{x}" for x in rng.integers(0, 3000, 200)) + f" only{i}") for i in range(250)]
    classes, want = dense(rows, 3, 3)
    assert classes > 4098  # more than the shared classes of before
    got = {r.doc_id: r.score for r in H.score(documents(spark, rows), states=3, iterations=3).collect()}
    assert got == {i: pytest.approx(x, rel=1e-5) for i, x in want.items()}


def test_training_raises_the_likelihood_and_probabilities_sum_to_one(spark):
    log = []
    rows = [(i, ("der die das und " if i % 2 else "the of and to ") * (i % 9 + 1)) for i in range(80)]
    H.score(documents(spark, rows), states=2, iterations=5, log=log).collect()
    assert all(b > a - 0.01 * abs(a) for a, b in zip(log, log[1:])) and log[-1] > log[0]
    c = H.Classes(np.array([3, 9], np.uint64), 4, np.array([5.5, 2.5, 3.0, 1, 1, 1, 1, 0.5]))
    for m in (H.initial(c, 3), H.maximize(np.random.default_rng(0).random(3 + 9 + 24 + 1), c, 3)):
        assert np.allclose(m.emit.sum(axis=1), 1) and np.allclose(m.move.sum(axis=1), 1) and m.start.sum() == pytest.approx(1)
        assert (m.emit > 0).all()


def test_edges(spark):
    rows = [*EDGE, (None, "a b A")]
    check_base(H.score(documents(spark, rows), iterations=2).collect(), dict(rows))
    assert H.score(documents(spark, [])).count() == 0
    only = next(i for i in range(100) if H.held_out(i))
    out = H.score(documents(spark, [(only, "never seen")])).collect()
    assert out[0].train_tokens == 0 and math.isfinite(out[0].score)


def test_pieces_of_a_block_give_its_words(monkeypatch):
    rows = [*EDGE, (None, "a b A"), *((100 + i, f"É{i} Straße w{i % 7} " * (i % 5)) for i in range(40))]
    data = B.to_ipc(pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
    monkeypatch.setattr(H, "PIECE_BYTES", 50)
    _, _, sizes, known, _, number = H._read_block(data)
    want = [w for _, t in rows for w in tokens(t)]
    assert sizes.tolist() == [len(tokens(t)) for _, t in rows] and len(known) == len(set(want)) and (np.diff(known.astype(object)) > 0).all()
    assert len({(w, n) for w, n in zip(want, number.tolist())}) == len(set(want)) == len(set(number.tolist()))


def test_messages_are_packed_and_hashes_stay_behind():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in (1.0 / rng.random(200)).astype(int) % 5000)) for i in range(300)]
    block = B.to_ipc(pa.table({"id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    sent = next(H._encode(2)([pa.RecordBatch.from_pydict({"block": [0], "data": [block]})]))
    voc, replies = np.zeros(3, np.int64), []
    for _, s, d in zip(*(c.to_pylist() for c in sent.columns)):
        for b, x in H._count(8)(s, [0], [d]) if s >= 0 else ():
            if b < 0:
                voc = voc + B.unpack(x)[0]
            else:
                replies.append((s, x))
    v = H.Vocabulary(*map(int, voc), np.ones(8))
    coded = H._code(v)(pa.Table.from_batches([sent]), pa.table({"shard": [s for s, _ in replies], "data": [x for _, x in replies]}))
    _, ids, stored, words, hashes = (c[0].as_py() for c in coded.columns)
    n = len(B.unpack(words)[0])
    # frequent words have small numbers, so two bytes of every token are nearly all zeros
    assert B.unpack_sorted(hashes)[0].shape == (n,) and np.median(B.unpack(stored)[0]) < 20
    out = H._e_step(H.first(v, 8))(0, ids, stored, words, hashes, None)
    sums = [d for s, d in zip(out["shard"].to_pylist(), out["data"].to_pylist()) if s >= 0]
    assert sum(map(len, sums)) < 0.9 * 36 * n
    assert sum(B.unpack(d)[1].sum() for d in sums) == pytest.approx(sum(
        c for w, c in Counter(w for i, t in rows if not H.held_out(i) for w in tokens(t)).items() if c > 1), rel=1e-4)

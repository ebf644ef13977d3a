"""A hidden Markov language model.

Words are counted exactly over all training documents: every block of documents sends its distinct words to the shards of a hash
range and gets their counts back. Every word seen twice or more has emissions of its own, whatever the vocabulary; words seen
once are one class, in which each has an equal share, and a word that was never seen is one more class, with the probability that
the state gives to words seen once (Good-Turing). The emissions live where the counts do: in every iteration a block sends the
expected counts of its own words by state to their shards and gets the totals back. What all tasks share has a fixed size.

Training is Baum-Welch; the expected starts and moves of the blocks are added up in groups.
Scores are exact: the scaled forward recursion runs over whole documents. Long ones are cut into segments whose transfer
matrices are multiplied first, so that many segments advance together; the result is that of the plain recursion.

Defined results: null and empty texts are the end token alone; equal documents score the same; a null id counts as the
empty text in the choice of training documents; an empty table gives no rows, and without training documents every score is that
of an unseen word per token. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm import words as W
from quarry.llm.shared import Scratch

U = np.uint64
#: Hash of the end token, which is no word.
END = (U(0x51ED270B9F7D4A63), U(0x2545F4914F6CDD1D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of a segment; longer documents are cut.
SEGMENT = 2048
#: Words of documents that are worked on together; a task holds some arrays of states for them.
BATCH = 400_000
FOLD = 32
#: Bytes of text in a block: a larger one has fewer distinct words for its size, so less is exchanged in every iteration.
BLOCK_BYTES = 24 << 20
#: Bytes of a block's text that are hashed together.
PIECE_BYTES = 4 << 20


@dataclass(frozen=True)
class Model:
    """start (states), move (states, states), emit (states, classes)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


@dataclass(frozen=True)
class Classes:
    """Word classes of the dense form: ``top`` (sorted hashes) first, then words seen once, ``hashed`` shared ones, and unseen words.

    ``mass`` is the sum of count + 0.5 in each class, the unseen word's 0.5 included."""

    top: np.ndarray
    hashed: int
    mass: np.ndarray

    @property
    def once(self) -> int:
        return len(self.top)

    @property
    def unseen(self) -> int:
        return len(self.mass) - 1


@dataclass(frozen=True)
class Shared:
    """What all blocks need: a word's emission is (expected count + prior * (count + 0.5)) * scale of the state."""

    start: np.ndarray
    move: np.ndarray
    scale: np.ndarray
    once: np.ndarray
    unseen: np.ndarray
    prior: float


@dataclass(frozen=True)
class Vocabulary:
    """Training tokens, distinct words, words seen once, and the disturbed masses of the others by state."""

    tokens: int
    words: int
    once: int
    begin: np.ndarray


def disturbed(h: np.ndarray, states: int) -> np.ndarray:
    """(states, words): the factors of the first emissions, drawn by the words' hashes."""
    key = W.mix(h)[None, :] + np.arange(1, 2 * states + 1, dtype=U)[:, None] * U(0x9E3779B97F4A7C15)
    u = ((W.mix(key) >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    return np.exp(1.5 * np.sqrt(-2 * np.log(u[:states])) * np.cos(2 * np.pi * u[states:]))


#: Stands for the hash of the class of words seen once.
ONCE = np.array([0x6A09E667F3BCC908], U)


def held_out(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _numbered(first: np.ndarray, second: np.ndarray):
    """Distinct hashes (sorted, with a second hash) and each entry's number among them."""
    known, at, number = np.unique(first, return_index=True, return_inverse=True)
    return known, second[at], number.astype(np.int32)


def _read_block(data: bytes):
    """ids, held-out flags, tokens of each document, their distinct hashes (sorted, with a second hash) and numbers.

    Runs of some documents are hashed and numbered by themselves, then their words are numbered together."""
    t = B.from_ipc(data)
    ids, texts = t["id"].combine_chunks(), t["text"].combine_chunks().cast(pa.large_string())
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    held = np.array([held_out(i) for i in ids.to_pylist()], bool)
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    parts, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PIECE_BYTES, "right")) - 1)
        w = W.split(_lowered(texts.slice(lo, hi - lo)), 2)
        ends = w.offsets[1:]
        parts.append((np.diff(w.offsets) + 1, *_numbered(*(np.insert(h, ends, e) for h, e in zip(w.hashes, END)))))
        lo = hi
    if not parts:
        return ids, held, np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int32)
    known, second, place = _numbered(*(np.concatenate([p[k] for p in parts]) for k in (1, 2)))
    cut = np.cumsum([len(p[1]) for p in parts])[:-1]
    number = np.concatenate([spot[p[3]] for p, spot in zip(parts, np.split(place, cut))])
    return ids, held, np.concatenate([p[0] for p in parts]), known, second, number


def _lowered(texts: pa.Array) -> pa.Array:
    """Large strings with A-Z in lower case."""
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    low = _LOWER[np.frombuffer(raw, np.uint8)[offs[0]:offs[-1]]] if raw is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offs - offs[0]).tobytes()), pa.py_buffer(low.tobytes()))


def _encode(shards: int):
    """Rows of MESSAGE_SCHEMA: shard -1 holds a block's documents, the others its words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, held, sizes, known, second, number = _read_block(data.as_py())
                train = np.bincount(number[np.repeat(~held, sizes)], minlength=len(known)).astype(np.uint32)
                valid = np.array(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
                rows = [(block, -1, B.pack(ids.fill_null(0).to_numpy().astype(np.int64), valid, held.astype(np.uint8), sizes.astype(np.int64), number))]
                cut = B.shard_bounds(known, shards)
                rows += [(block, s, B.pack_sorted(known[a:b], second[a:b], train[a:b])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                yield B.messages(rows)

    return run


def _count(states: int):
    """A shard's total of each word and its number among those seen twice or more, back to the blocks; block -1 gets sums."""

    def reply(shard: int, ids: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
        got = [B.unpack_sorted(d) for d in data]
        a, b, n = (np.concatenate([g[k] for g in got]) for k in range(3))
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        starts = np.flatnonzero(new)
        total = np.add.reduceat(n[order].astype(np.int64), starts)
        own, runs = total > 1, np.diff(np.append(starts, len(a)))
        each, spot = np.empty(len(a), np.int64), np.empty(len(a), np.int32)
        each[order] = np.repeat(total, runs)
        spot[order] = np.repeat(np.where(own, np.cumsum(own) - 1, -1), runs)
        at = 0
        for block, g in zip(ids, got):
            yield block, B.pack(each[at:at + len(g[0])], spot[at:at + len(g[0])])
            at += len(g[0])
        begin = disturbed(a[order][starts][own], states) @ (total[own] + 0.5)
        yield -1, B.pack(np.array([total.sum(), (total > 0).sum(), (total == 1).sum()], np.int64), begin)

    return reply


def _vocabulary(stats: DataFrame, states: int) -> Vocabulary:
    sums, begin = np.zeros(3, np.int64), np.zeros(states)
    for r in stats.orderBy("shard").select("data").collect():  # one small row for each shard
        x, y = B.unpack(bytes(r["data"]))
        sums, begin = sums + x, begin + y
    return Vocabulary(int(sums[0]), int(sums[1]), int(sums[2]), begin)


CODED = "block long, ids binary, tokens binary, words binary, hashes binary"


def _by_count(count: np.ndarray) -> np.ndarray:
    """A block's own words, the most frequent first: tokens are stored as places in this order, which compress better."""
    return np.argsort(-count, kind="stable")


def _tokens(data: bytes, count: np.ndarray) -> np.ndarray:
    """The classes that ``_code`` stored: the block's own words, words seen once, unseen words."""
    order = np.concatenate([_by_count(count), [len(count), len(count) + 1]])
    return order.astype(np.int32)[B.unpack(data)[0]]


def _code(voc: Vocabulary):
    """A block's documents as numbers of its own words, with what does not depend on the states."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            none = pa.array([], pa.binary())
            return pa.Table.from_pydict({"block": pa.array([], pa.int64()), "ids": none, "tokens": none, "words": none, "hashes": none})
        parts = {s: d for s, d in zip(table["shard"].to_pylist(), table["data"].to_pylist())}
        ids, valid, held, sizes, number = B.unpack(parts[-1])
        replies = dict(zip(answers["shard"].to_pylist(), answers["data"].to_pylist()))
        order = sorted(replies)
        h = np.concatenate([B.unpack_sorted(parts[s])[0] for s in order])
        got = [B.unpack(replies[s]) for s in order]
        count, spot = (np.concatenate([g[k] for g in got]) for k in range(2))
        own = spot >= 0
        m = int(own.sum())
        cls = np.where(count == 1, m, m + 1).astype(np.uint32)
        place = np.empty(m, np.uint32)
        place[_by_count(count[own])] = np.arange(m)
        cls[own] = place
        base = np.log10((count + 0.5) / (voc.tokens + 0.5 * (voc.words + 1)))
        within = np.where(count == 1, -np.log10(max(1, voc.once)), 0.0)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        sums = [np.add.reduceat(x[number], starts) for x in (base, within, (count > 0).astype(np.int64))]
        head = B.pack(ids, valid, held, sizes, sums[0], sums[1], sums[2])
        words = B.pack(count[own], spot[own], np.array(order, np.int32), np.array([(g[1] >= 0).sum() for g in got], np.int64))
        return pa.Table.from_pydict({"block": pa.array([table["block"][0].as_py()], pa.int64()), "ids": pa.array([head], pa.binary()),
                                     "tokens": pa.array([B.pack(cls[number])], pa.binary()),
                                     "words": pa.array([words], pa.binary()), "hashes": pa.array([B.pack_sorted(h[own])], pa.binary())})

    return run


class Lattice:
    """Documents as segments, time-major: step t holds the t-th word of each segment that has one, longest first."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        n_seg = -(-sizes // SEGMENT)
        self.doc = np.repeat(np.arange(len(sizes)), n_seg)
        first = np.concatenate([[0], np.cumsum(n_seg)])[:-1]
        self.nth = np.arange(len(self.doc)) - np.repeat(first, n_seg)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][self.doc] + SEGMENT * self.nth
        length = np.minimum(SEGMENT, sizes[self.doc] - SEGMENT * self.nth)
        self.order = np.argsort(-length, kind="stable")
        length, starts = length[self.order], starts[self.order]
        steps = int(length[0]) if len(length) else 0
        self.width = np.searchsorted(-length, -np.arange(steps), "left")  # segments longer than t
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        self.index = np.concatenate([starts[:b] + t for t, b in enumerate(self.width)]) if steps else np.zeros(0, np.int64)
        self.cls = tokens[self.index]
        self.length = length
        self.last = self.at[length - 1] + np.arange(len(length)) if steps else np.zeros(0, np.int64)
        self.place = np.empty(len(self.order), np.int64)
        self.place[self.order] = np.arange(len(self.order))
        self.long = np.flatnonzero(n_seg > 1)  # documents of several segments
        self.first, self.n_seg = first, n_seg

    def ends(self, model: Model, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's distribution before its first word, and what follows after its last one (up to a factor), by state."""
        k, dt = len(model.start), seen.dtype
        before = np.tile(model.start.astype(dt)[:, None], (1, len(self.order)))
        after = np.ones((k, len(self.order)), dt)
        if len(self.long):
            many = np.flatnonzero(np.isin(self.doc[self.order], self.long))
            move = model.move.astype(dt)
            m = np.tile(np.eye(k, dtype=dt), (len(many), 1, 1))  # words of the segment: states before -> states before the next
            for t in range(int(self.length[many].max())):
                b = int(np.searchsorted(many, self.width[t], "left"))
                x = m[:b] * seen[:, self.at[t] + many[:b]].T[:, None, :]
                np.matmul(x.reshape(-1, k), move, out=m[:b].reshape(-1, k))
                if t % 2:  # two steps stay within a float's range
                    m[:b] /= m[:b].sum(axis=(1, 2), keepdims=True)
            spot = {int(s): i for i, s in enumerate(many)}
            for d in self.long:
                segs = [int(self.place[s]) for s in range(self.first[d], self.first[d] + self.n_seg[d])]
                for a, b in zip(segs, segs[1:]):
                    x = before[:, a] @ m[spot[a]]
                    before[:, b] = x / x.sum()
                tail = np.ones(k, dt)  # probability of what follows, by the state before the next segment's first word
                for a, b in zip(segs[-2::-1], segs[:0:-1]):
                    tail = m[spot[b]] @ tail
                    tail /= tail.sum()
                    after[:, a] = move @ tail
        return before, after


def forward(lat: Lattice, model: Model, dtype=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphas, scales, emissions of the words, what follows each segment); a row for each state, so that a step's words lie together."""
    seen = np.take(np.ascontiguousarray(model.emit, dtype), lat.cls, axis=1)
    before, after = lat.ends(model, seen)
    alpha, scale = np.empty_like(seen), np.empty(seen.shape[1], dtype)
    back, a = np.ascontiguousarray(model.move.T, dtype), before
    for t, b in enumerate(lat.width):
        lo, hi = lat.at[t], lat.at[t + 1]
        x, s = alpha[:, lo:hi], scale[lo:hi]
        if t:
            np.matmul(back, a[:, :b], out=x)
            x *= seen[:, lo:hi]
        else:
            np.multiply(a, seen[:, lo:hi], out=x)
        np.add.reduce(x, axis=0, out=s)
        x /= s
        a = x
    return alpha, scale, seen, after


def _parts(tokens: np.ndarray, sizes: np.ndarray):
    """Documents of about the same length, at most BATCH words (or one document): which they are, their tokens and sizes.

    Among such documents every step has about as many words as there are documents."""
    order = np.argsort(sizes, kind="stable")
    starts, ends, lo = (np.cumsum(sizes) - sizes)[order], np.concatenate([[0], np.cumsum(sizes[order])]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BATCH, "right")) - 1)
        n = sizes[order[lo:hi]]
        at = np.repeat(starts[lo:hi] - ends[lo:hi], n) + np.arange(ends[lo], ends[hi])
        yield order[lo:hi], tokens[at], n
        lo = hi


def log10_likelihoods(tokens: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each document's classes."""
    out = np.zeros(len(sizes))
    for docs, part, n in _parts(tokens, sizes):
        lat = Lattice(part, n)
        _, scale, _, _ = forward(lat, model)
        flat = np.empty(len(part))
        flat[lat.index] = np.log10(scale)
        out[docs] = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(n)])[:-1])
    return out


def expected_counts(tokens: np.ndarray, sizes: np.ndarray, model: Model, dtype=np.float32) -> np.ndarray:
    """Expected starts, moves and emissions as one vector, and the log likelihood at its end."""
    k, c = model.emit.shape
    total = np.zeros(k + k * k + k * c + 1)
    for _, part, n in _parts(tokens, sizes):
        _counts(Lattice(part, n), model, dtype, total)
    return total


def _counts(lat: Lattice, model: Model, dtype, total: np.ndarray) -> None:
    """Add these documents' expected counts to ``total``."""
    k, c = model.emit.shape
    alpha, scale, seen, after = forward(lat, model, dtype)
    # beta is scaled so that alpha * beta sums to one at every word
    finish = alpha[:, lat.last]
    after /= (finish * after).sum(axis=0)
    move, pairs = np.ascontiguousarray(model.move, dtype), np.zeros((k, k))
    nxt = seen[:, :0]  # of the words one step on: emission * beta / scale
    for t in range(len(lat.width) - 1, -1, -1):
        lo, hi, n = lat.at[t], lat.at[t + 1], nxt.shape[1]
        beta = after[:, :lat.width[t]].copy()
        if n:
            pairs += alpha[:, lo:lo + n] @ nxt.T
            np.matmul(move, nxt, out=beta[:, :n])
        nxt = seen[:, lo:hi]
        nxt *= beta
        nxt /= scale[lo:hi]
        alpha[:, lo:hi] *= beta  # now the posterior of the state
    # moves from the last word of a segment to the first of the document's next one
    if len(lat.long):
        more = np.flatnonzero(lat.nth > 0)
        a, n = finish[:, lat.place[more - 1]], seen[:, lat.place[more]]
        weight = ((model.move.T.astype(dtype) @ a) * n).sum(axis=0)
        pairs += a @ (n / weight).T
    total[:k] += alpha[:, lat.place[lat.first]].sum(axis=1, dtype=np.float64)
    total[k:k + k * k] += (model.move * pairs).ravel()
    emit = total[k + k * k:-1].reshape(k, c)
    for s in range(k):
        emit[s] += np.bincount(lat.cls, weights=alpha[s], minlength=c)
    total[-1] += np.log10(scale.astype(np.float64)).sum()


def initial(classes: Classes, states: int, seed: int = 7) -> Model:
    """Dense form: states that stay, with the corpus' class frequencies disturbed at random."""
    rng = np.random.default_rng(seed)
    emit = classes.mass[None, :] * np.exp(1.5 * rng.standard_normal((states, len(classes.mass))))
    emit[:, classes.unseen] = 0
    move = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
    return finished(np.full(states, 1 / states), move, emit, classes)


def finished(start: np.ndarray, move: np.ndarray, emit: np.ndarray, classes: Classes, prior: float = 20.0) -> Model:
    """Smooth the emissions towards the corpus and give unseen words the place of those seen once."""
    whole = classes.mass.copy()
    whole[classes.unseen] = 0
    emit = emit + prior * whole / max(whole.sum(), 1e-9)
    emit = emit / np.maximum(emit.sum(axis=1, keepdims=True), 1e-300)
    least = classes.mass[classes.unseen] / classes.mass.sum()
    unseen = np.maximum(emit[:, classes.once], least)
    emit = emit * (1 - unseen[:, None])
    emit[:, classes.unseen] = unseen
    return Model(start, move, emit)


def maximize(counts: np.ndarray, classes: Classes, states: int) -> Model:
    start, move = counts[:states] + 0.1, counts[states:states + states * states].reshape(states, states) + 0.1
    emit = counts[states + states * states:-1].reshape(states, -1).copy()
    emit[:, classes.unseen] = 0
    return finished(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit, classes)


def _fold(scratch: Scratch, counts: DataFrame, name: str) -> np.ndarray | None:
    """Add up vectors in groups of tasks until a few are left."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("data", "ascending")])
        total = np.sum([np.frombuffer(x.as_buffer(), "<f8") for x in table["data"]], axis=0)
        return pa.Table.from_pydict({"part": pa.array([table["up"][0].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    counts, level = scratch.write(counts, f"{name}-0"), 0
    while (counts.agg(F.max("part")).first()[0] or 0) >= FOLD:
        level += 1
        counts = scratch.write(counts.withColumn("up", F.floor(F.col("part") / FOLD)).groupBy("up").applyInArrow(add, "part long, data binary"),
                               f"{name}-{level}")
    rows = counts.orderBy("part", "data").collect()
    return np.sum([np.frombuffer(r["data"], "<f8") for r in rows], axis=0) if rows else None


def shared(start: np.ndarray, move: np.ndarray, own: np.ndarray, once: np.ndarray, voc: Vocabulary, prior: float = 20.0) -> Shared:
    """As ``finished``, from the sums by state: ``own`` of the words with emissions of their own, ``once`` of those seen once."""
    whole = voc.tokens + 0.5 * voc.words
    each = prior / max(whole, 1e-9)
    total = np.maximum(own + once + each * whole, 1e-300)
    single = (once + each * 1.5 * voc.once) / total
    unseen = np.maximum(single, 0.5 / (whole + 0.5))
    return Shared(start, move, (1 - unseen) / total, single * (1 - unseen), unseen, each)


def first(voc: Vocabulary, states: int) -> Shared:
    """States that stay, with the corpus' word frequencies disturbed."""
    move = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
    return shared(np.full(states, 1 / states), move, voc.begin, 1.5 * voc.once * disturbed(ONCE, states)[:, 0], voc)


def _next(counts: np.ndarray, voc: Vocabulary, k: int) -> Shared:
    start, move = counts[:k] + 0.1, counts[k:k + k * k].reshape(k, k) + 0.1
    own, once = counts[k + k * k:2 * k + k * k], counts[2 * k + k * k:-1]
    return shared(start / start.sum(), move / move.sum(axis=1, keepdims=True), own, once, voc)


def _local(sh: Shared, words: list[np.ndarray], hashes: bytes | None, expected: list[bytes] | None) -> Model:
    """The model over a block's own words, words seen once and unseen words."""
    count, k = words[0] + 0.5, len(sh.start)
    if expected is None:
        e = count * disturbed(B.unpack_sorted(hashes)[0], k)
    else:
        e = np.concatenate([np.zeros((k, 0), "<f4"), *(B.unpack(d)[0].reshape(k, -1) for d in expected)], axis=1)
    emit = np.empty((k, len(count) + 2))
    emit[:, :-2] = e
    emit[:, :-2] += sh.prior * count
    emit[:, :-2] *= sh.scale[:, None]
    emit[:, -2], emit[:, -1] = sh.once, sh.unseen
    return Model(sh.start, sh.move, emit)


def _over_blocks(coded: DataFrame, totals: DataFrame | None, run, schema: str) -> DataFrame:
    """``run(block, ids, tokens, words, hashes, expected counts by shard)`` for each block, which gives a record batch.

    Only the first emissions are drawn by the words' hashes: with ``totals`` these stay behind."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield run(*row, None)

    def met(table: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("shard")
        return pa.Table.from_batches([run(*(c[0].as_py() for c in table.columns), None, answers["data"].to_pylist())])

    if totals is None:
        return coded.mapInArrow(plain, schema)
    return coded.drop("hashes").groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(met, schema)


def _e_step(sh: Shared):
    """Rows of MESSAGE_SCHEMA: shard -1 gets a block's starts, moves, emissions by state and likelihood, the others its words'."""

    def run(block: int, ids: bytes, tokens: bytes, words: bytes, hashes: bytes | None, expected: list[bytes] | None) -> pa.RecordBatch:
        _, _, held, sizes, *_ = B.unpack(ids)
        words = B.unpack(words)
        model, use = _local(sh, words, hashes, expected), held == 0
        k, c = model.emit.shape
        got = expected_counts(_tokens(tokens, words[0])[np.repeat(use, sizes)], sizes[use], model)
        emit = got[k + k * k:-1].reshape(k, c)
        rows = [(block, -1, np.concatenate([got[:k + k * k], emit[:, :c - 2].sum(axis=1), emit[:, c - 2], got[-1:]]).astype("<f8").tobytes())]
        _, spot, shards, n = words
        ends = np.concatenate([[0], np.cumsum(n)])
        rows += [(block, int(s), B.pack(np.diff(spot[a:b], prepend=np.int32(0)), emit[:, a:b].astype(np.float32).ravel()))
                 for s, a, b in zip(shards, ends, ends[1:]) if b > a]
        return B.messages(rows)

    return run


def _total(states: int):
    """A shard's expected counts of its words by state, back to the blocks."""

    def reply(shard: int, ids: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
        got = []
        for d in data:
            steps, e = B.unpack(d)  # a block's words are in the order of their hashes, so the spots ascend
            got.append((np.cumsum(steps, dtype=np.int32), e.reshape(states, -1)))
        total = np.zeros((states, 1 + max(int(spot[-1]) for spot, _ in got)))
        for spot, e in got:
            total[:, spot] += e
        for block, (spot, _) in zip(ids, got):
            yield block, B.pack(total[:, spot].astype(np.float32).ravel())

    return reply


RESULT = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(sh: Shared):
    def run(block: int, ids: bytes, tokens: bytes, words: bytes, hashes: bytes | None, expected: list[bytes] | None) -> pa.RecordBatch:
        ids, valid, held, sizes, base, within, known = B.unpack(ids)
        words = B.unpack(words)
        own = log10_likelihoods(_tokens(tokens, words[0]), sizes, _local(sh, words, hashes, expected))
        return pa.RecordBatch.from_pydict({
            "id": pa.array(ids, pa.int64(), mask=valid == 0), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "base_score": base, "score": own + within})

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, states: int = 8, iterations: int = 6,
          log: list | None = None) -> DataFrame:
    """Train on the documents that are not held out and score all: id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10). ``log`` gets the training log likelihood before each iteration."""
    scratch = Scratch(df.sparkSession, "hmm")
    stored = scratch.write(B.to_blocks(df, id_col, text_col, BLOCK_BYTES), "blocks", codec="uncompressed")
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    shards = 1 << max(5, (total // (64 << 20)).bit_length())
    sent = scratch.write(stored.select("block", "data").mapInArrow(_encode(shards), B.MESSAGE_SCHEMA), "encoded", codec="uncompressed")
    scratch.drop("blocks")
    replies = scratch.write(B.answer(sent.where("shard >= 0"), _count(states)), "counts", codec="uncompressed")
    voc = _vocabulary(replies.where("block < 0"), states)
    coded = sent.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(_code(voc), CODED)
    coded = scratch.write(coded, "coded", codec="uncompressed")
    scratch.drop("encoded")
    scratch.drop("counts")
    sh, totals = first(voc, states), None
    for k in range(iterations if voc.tokens else 0):
        out = scratch.write(_over_blocks(coded, totals, _e_step(sh), B.MESSAGE_SCHEMA), f"expected-{k}", codec="uncompressed")
        parts = out.where("shard < 0").select(F.shiftright("block", 32).alias("part"), "data")
        counts = _fold(scratch, parts, f"em-{k}")
        if log is not None:
            log.append(float(counts[-1]))
        if totals is not None:
            scratch.drop(f"totals-{k - 1}")
        totals = scratch.write(B.answer(out.where("shard >= 0"), _total(states)), f"totals-{k}", codec="uncompressed")
        scratch.drop(f"expected-{k}")
        sh = _next(counts, voc, states)
    out = _over_blocks(coded, totals, _score(sh), RESULT)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(voc.tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")

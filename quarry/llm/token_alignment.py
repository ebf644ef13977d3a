"""Alignment of two tokenizers over a corpus, with external counting of the linked id pairs.

Tokens of both sides are byte ranges of the same text; where ranges of both end, a group ends and the two tokens are
linked. A task turns a block of documents into sorted runs of (B id, A id, document, times) records, one zstd run for
each radix of the B id. Runs of a radix are merged by a heap over their chunks, in lanes of a bounded number of
blocks and then in a tree of lanes, so a pair that a third of all documents hold is never in one task. The merged counts
are in order of the B side, which gives each B id's maximum in passing; counts and maxima go back down the same tree,
each node asking for its own pairs, and the runs are streamed once more against them into sums for each document.

Texts that are null or empty, or that a side does not give back byte for byte, have no tokens. Rows are told apart by
their place in a block, so null and repeated ids are rows of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import from_ipc, pack_sorted, pack, to_ipc, unpack, unpack_sorted
from quarry.llm.shared import Scratch

#: Bytes of text in a block, and of text that is tokenized together.
BLOCK_BYTES, TOGETHER_BYTES = 8 << 20, 1 << 20
#: Bits of an id and of a document's place in its block; a record's key is (B id, A id, place).
ID_BITS, DOC_BITS = 20, 24
#: Radix bits of the B id, records in a chunk of a run, blocks in a lane (on average), and lanes below a node of the tree.
RADIX_BITS, CHUNK, LANE_BLOCKS, FAN_IN = 5, 1 << 16, 16, 32

DOC_SCHEMA = pa.schema([("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())])
#: Rows of part -1 hold the documents of a block, others its run of that radix.
RUN_SCHEMA = "block long, part int, data binary"
OUT_SCHEMA = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# --- the two tokenizers ----------------------------------------------------------------------------

class ByteSide:
    """Byte-level tokenizer of a JSON file; a text gets a space in front."""

    #: Characters that Unicode versions of the two libraries may class differently, and long runs, which only one of them handles well.
    _NEW = re.compile("[^\x00-ԯ‐-‧‰-⁞]")
    _BLANK = re.compile(r"\s{64}")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.entry = _table({i: b for b, i in ranks.items()})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(" " + t) if self._usual(t) else self.whole.encode(" " + t, add_special_tokens=False).ids for t in texts]

    def _usual(self, t: str) -> bool:
        if not t.isascii() and self._NEW.search(t):
            return False
        return len(t) < 64 or not (self._BLANK.search(t) or max(map(len, t.split()), default=0) > 2048)


class PieceSide:
    """Sentencepiece model, which puts a space in front itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.entry = _table({i: bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode()
                             for i, p in ((i, self.sp.id_to_piece(i)) for i in range(n))})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


def _table(entries: dict[int, bytes]) -> list[bytes]:
    out = [b""] * (max(entries) + 1)
    if len(out) > 1 << ID_BITS:
        raise ValueError(f"ids beyond {1 << ID_BITS}")
    for i, b in entries.items():
        out[i] = b
    return out


_sides: dict[tuple, tuple] = {}


def sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = ByteSide(a_path), PieceSide(b_path)
    return _sides[a_path, b_path]


# --- alignment of some texts -----------------------------------------------------------------------

class Aligner:
    def __init__(self, a: ByteSide, b: PieceSide):
        self.a, self.b = a, b
        self.a_len, self.b_len = (np.array([len(x) for x in s.entry], np.int64) for s in (a, b))
        ids = [str(i) for i in range(max(len(a.entry), len(b.entry)))]
        self.comma, self.bar, self.semi = (np.array([i + c for i in ids], object) for c in ",|;")

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups and digest of every text, and the links: place of the text, A id, B id."""
        n_a, n_b, n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
        digests = [""] * len(texts)
        full = [k for k, t in enumerate(texts) if t]
        own = [texts[k] for k in full]
        ids_a, ids_b = self.a.encode(own), self.b.encode(own)
        good = [k for k, (t, x, y) in enumerate(zip(own, ids_a, ids_b)) if self._same(t, x, y)]
        if not good:
            none = np.zeros(0, np.int64)
            return n_a, n_b, n_groups, digests, none, none, none
        at = np.array([full[k] for k in good])
        a, b = (np.concatenate([np.array(ids[k], np.int64) for k in good]) for ids in (ids_a, ids_b))
        n_a[at], n_b[at] = ([len(ids[k]) for k in good] for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        link_b = np.searchsorted(end_b, end_a)
        is_end_a = end_b[link_b] == end_a  # the last ends of both are equal, so every place is in range
        link_a, link_b = np.flatnonzero(is_end_a), link_b[is_end_a]
        is_end_b = np.zeros(len(b), bool)
        is_end_b[link_b] = True
        offs_a, offs_b = (np.concatenate([[0], np.cumsum(n[at])]) for n in (n_a, n_b))
        doc = np.searchsorted(offs_a, link_a, "right") - 1
        n_groups[at] = np.bincount(doc, minlength=len(at))
        # written groups: each group's A ids, then its B ids
        out = np.empty(len(a) + len(b), object)
        group_a, group_b = np.cumsum(is_end_a) - is_end_a, np.cumsum(is_end_b) - is_end_b
        out[np.arange(len(a)) + np.concatenate([[0], link_b + 1])[group_a]] = np.where(is_end_a, self.bar[a], self.comma[a])
        out[np.arange(len(b)) + link_a[group_b] + 1] = np.where(is_end_b, self.semi[b], self.comma[b])
        bounds = (offs_a + offs_b).tolist()
        for k, lo, hi in zip(at.tolist(), bounds, bounds[1:]):
            digests[k] = hashlib.sha256("".join(out[lo:hi].tolist())[:-1].encode()).hexdigest()
        return n_a, n_b, n_groups, digests, at[doc], a[link_a], b[link_b]

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + text.encode()
        return b"".join(map(self.a.entry.__getitem__, a)) == raw and b"".join(map(self.b.entry.__getitem__, b)) == raw


# --- runs ------------------------------------------------------------------------------------------

def write_run(chunks: Iterable[tuple[np.ndarray, ...]]) -> bytes:
    """Frames of a sorted key array and its values, each compressed by itself."""
    out = []
    for arrays in chunks:
        for lo in range(0, len(arrays[0]), CHUNK):
            frame = pack_sorted(*(x[lo:lo + CHUNK] for x in arrays))
            out += [len(frame).to_bytes(4, "little"), frame]
    return b"".join(out)


def read_run(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 4], "little")
        yield tuple(unpack_sorted(data[at + 4:at + 4 + n]))
        at += 4 + n


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the sums of ``n`` over each."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def pairs_of(run: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for keys, n in run:
        yield added(keys >> np.uint64(DOC_BITS), n.astype(np.int64))


def merge(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of runs of (sorted keys, numbers); equal keys are added up. A run has one chunk in memory.

    The heap orders the runs by the last key of their chunk: everything up to the smallest of these is complete.
    """
    held: list[tuple[np.ndarray, np.ndarray] | None] = [next(r, None) for r in runs]
    heap = [(int(c[0][-1]), k) for k, c in enumerate(held) if c is not None]
    heapq.heapify(heap)
    while heap:
        last, parts = heap[0][0], []
        upto = np.uint64(last)
        while heap and heap[0][0] <= last:  # these chunks are used up
            k = heapq.heappop(heap)[1]
            parts.append(held[k])
            held[k] = next(runs[k], None)
            if held[k] is not None:
                heapq.heappush(heap, (int(held[k][0][-1]), k))
        for _, k in heap:
            keys, n = held[k]
            at = int(np.searchsorted(keys, upto, "right"))
            if at:
                parts.append((keys[:at], n[:at]))
                held[k] = keys[at:], n[at:]
        keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        yield added(keys[order], n[order])


def with_maxima(run: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs, counts, and whether a count is its B id's highest; B ids are complete as soon as the next one begins."""
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def judged(keys, n):
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys >> np.uint64(ID_BITS)) != 0]))
        top = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(keys))))
        return keys, n, (n == top).astype(np.uint8)

    for more, m in run:
        keys, n = np.concatenate([keys, more]), np.concatenate([n, m])
        side = keys >> np.uint64(ID_BITS)
        cut = int(np.searchsorted(side, side[-1]))
        if cut:
            yield judged(keys[:cut], n[:cut])
            keys, n = keys[cut:], n[cut:]
    if len(keys):
        yield judged(keys, n)


def look_up(wanted: Iterator[np.ndarray], answers: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """For sorted chunks of pairs (repeated ones allowed) the answers' values; both are streamed side by side."""
    held: tuple[np.ndarray, ...] | None = None
    for keys in wanted:
        while held is None or held[0][-1] < keys[-1]:
            more = next(answers)
            held = more if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, more))
            lo = int(np.searchsorted(held[0], keys[0]))
            if lo:
                held = tuple(x[min(lo, len(x) - 1):] for x in held)
        at = np.searchsorted(held[0], keys)
        yield tuple(x[at] for x in held[1:])


# --- the job ---------------------------------------------------------------------------------------

def _to_runs(a_path: str, b_path: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, seq = Aligner(*sides(a_path, b_path)), TaskContext.get().partitionId(), 0
        held, links, size, n_docs = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(links))
            keys, n = added(keys, np.ones(len(keys), np.uint32)) if len(keys) else (keys, np.zeros(0, np.uint32))
            radix = (keys >> np.uint64(ID_BITS + DOC_BITS)) & np.uint64((1 << RADIX_BITS) - 1)
            order = np.argsort(radix, kind="stable")
            ends = np.searchsorted(radix[order], np.arange((1 << RADIX_BITS) + 1, dtype=np.uint64))
            rows = [(-1, to_ipc(pa.Table.from_batches(held)))]
            rows += [(r, write_run([(keys[order[lo:hi]], n[order[lo:hi]])])) for r, (lo, hi) in enumerate(zip(ends, ends[1:])) if lo < hi]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq] * len(rows), pa.int64()), pa.array([r for r, _ in rows], pa.int32()),
                                               pa.array([d for _, d in rows], pa.binary())], names=["block", "part", "data"])

        for batch in batches:
            step = max(1, int(batch.num_rows * TOGETHER_BYTES / max(1, batch.column(1).nbytes)))
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                n_a, n_b, n_groups, digests, doc, a, b = aligner.align(piece.column(1).to_pylist())
                held.append(pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, (n_a, n_b, n_groups)), pa.array(digests, pa.string())],
                                                       schema=DOC_SCHEMA))
                pair = (b << ID_BITS | a).astype(np.uint64) << np.uint64(DOC_BITS)
                links.append(pair | (doc + n_docs).astype(np.uint64))
                n_docs += piece.num_rows
                size += piece.column(1).nbytes
                if size >= BLOCK_BYTES or n_docs >= 1 << (DOC_BITS - 1):
                    yield flush()
                    seq, held, links, size, n_docs = seq + 1, [], [], 0, 0
        if held:
            yield flush()

    return make


def _node(part, lane, data: bytes) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int32()), "lane": pa.array([lane], pa.int64()), "data": pa.array([data], pa.binary())})


def _count_runs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return _node(key[0].as_py(), key[1].as_py(), write_run(merge([pairs_of(read_run(d.as_py())) for d in table["data"]])))


def _merge_lanes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return _node(key[0].as_py(), key[1].as_py(), write_run(merge([read_run(d.as_py()) for d in table["data"]])))


def _maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, lane, data in zip(*(batch.column(k) for k in range(3))):
            yield from _node(part.as_py(), lane.as_py(), write_run(with_maxima(read_run(data.as_py())))).to_batches()


def _answer_lanes(key: tuple[pa.Scalar, ...], answers: pa.Table, below: pa.Table) -> pa.Table:
    """The parent's answers, for each child's own pairs."""
    out = []
    for lane, data in zip(below["lane"].to_pylist(), below["data"]):
        own = [keys for keys, _ in read_run(data.as_py())]
        found = look_up(iter(own), read_run(answers["data"][0].as_py()))
        out.append(_node(key[0].as_py(), lane, write_run((keys, *f) for keys, f in zip(own, found))))
    return pa.concat_tables(out) if out else _node(0, 0, b"").slice(0, 0)


def _contribute(key: tuple[pa.Scalar, ...], answers: pa.Table, runs: pa.Table) -> pa.Table:
    """Sums of a lane's runs over their documents: n_best and count_sum of one radix."""
    blocks, out = [], []
    for block, data in zip(runs["block"].to_pylist(), runs["data"]):
        best, total = {}, {}
        chunks = list(read_run(data.as_py()))
        found = look_up((keys >> np.uint64(DOC_BITS) for keys, _ in chunks), read_run(answers["data"][0].as_py()))
        n_docs = 1 + max(int((keys & np.uint64((1 << DOC_BITS) - 1)).max()) for keys, _ in chunks)
        best, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for (keys, n), (count, top) in zip(chunks, found):
            doc, n = (keys & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64), n.astype(np.int64)
            np.add.at(best, doc, n * top)
            np.add.at(total, doc, n * count)
        blocks.append(block)
        out.append(pack(best, total))
    return pa.table({"block": pa.array(blocks, pa.int64()), "data": pa.array(out, pa.binary())})


def _finish(key: tuple[pa.Scalar, ...], docs: pa.Table, sums: pa.Table) -> pa.Table:
    table = from_ipc(docs["data"][0].as_py())
    best, total = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
    for data in sums["data"]:
        b, t = unpack(data.as_py())
        best[:len(b)] += b
        total[:len(t)] += t
    cols = {c: table[c] for c in ("id", "n_a", "n_b", "n_groups")} | {"n_links": table["n_groups"], "n_best": pa.array(best), "count_sum": pa.array(total)}
    return pa.table(cols | {"groups_sha256": table["groups_sha256"]})


def align(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """One row of OUT_SCHEMA for each row of ``df``."""
    scratch = Scratch(df.sparkSession, "alignment")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    runs = scratch.write(rows.mapInArrow(_to_runs(a_path, b_path), RUN_SCHEMA), "runs", "uncompressed")
    docs = runs.where("part = -1").select("block", "data")
    n_lanes = max(1, -(-docs.count() // LANE_BLOCKS))
    schema = "part int, lane long, data binary"
    records = runs.where("part >= 0").withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(n_lanes)))
    levels = [scratch.write(records.groupBy("part", "lane").applyInArrow(_count_runs, schema), "count-0", "uncompressed")]
    while n_lanes > 1:
        n_lanes = -(-n_lanes // FAN_IN)
        up = levels[-1].withColumn("lane", F.floor(F.col("lane") / FAN_IN))
        levels.append(scratch.write(up.groupBy("part", "lane").applyInArrow(_merge_lanes, schema), f"count-{len(levels)}", "uncompressed"))
    answers = scratch.write(levels[-1].mapInArrow(_maxima, schema), f"answer-{len(levels) - 1}", "uncompressed")
    for k in range(len(levels) - 2, -1, -1):
        below = levels[k].withColumn("up", F.floor(F.col("lane") / FAN_IN))
        step = answers.groupBy("part", "lane").cogroup(below.groupBy("part", "up")).applyInArrow(_answer_lanes, schema)
        answers = scratch.write(step, f"answer-{k}", "uncompressed")
        scratch.drop(f"answer-{k + 1}")
    sums = answers.groupBy("part", "lane").cogroup(records.groupBy("part", "lane")).applyInArrow(_contribute, "block long, data binary")
    sums = scratch.write(sums, "sums", "uncompressed")
    return docs.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_finish, OUT_SCHEMA)

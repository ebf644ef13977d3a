"""Harmonic packing of token sequences.

A piece of length at most capacity / k belongs to class k, and k pieces of class k fill a sequence. A document is cut into
full sequences and then, greedily, at the reciprocal lengths capacity / k until the rest is near enough to one of
them, so the fixed number of pieces leaves little padding. Every task fills the sequences of each class by itself; what is
left over in a task (fewer than k pieces of each class, so never much) is filled up in groups of tasks, then in groups of
groups, and the last remainder is packed first-fit by decreasing length.

Defined results: a null or empty text is the end token alone; equal documents are packed separately; a null id stays null;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch
from quarry.llm.tokens import encoder

CAPACITY = 2048
#: Tasks (or groups) whose left-over pieces are packed together.
FAN_IN = 16
#: Pieces in a batch that a task returns.
BATCH = 1024

SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, grp long"
_FIELDS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("grp", pa.int64())])


def cut(length: int, capacity: int = CAPACITY, loss: float = 1 / 64) -> list[tuple[int, int]]:
    """(piece length, class) of a document; a sequence of a class pads at most ``loss``, or less than one piece."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= max(loss * capacity, rest if rest < 32 else 0):
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        rest -= piece
    return out


class Filler:
    """Open sequences by class; yields the pieces of each sequence that has its count."""

    def __init__(self, level: int, group: int):
        self.base, self.n, self.open = (level << 58) + (group << 28), 0, {}

    def place(self, pieces: list[tuple]) -> list[tuple]:
        """Consecutive places in a new sequence; a piece is (id, start, length, ids, doc_tokens)."""
        at, out, seq = 0, [], self.base + self.n
        self.n += 1
        for p in pieces:
            out.append((*p, seq, at))
            at += p[2]
        return out

    def add(self, k: int, piece: tuple) -> list[tuple]:
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self.place(held)

    def left(self) -> list[tuple]:
        return [(*p, None, None) for held in self.open.values() for p in held]

    def first_fit(self, capacity: int) -> list[tuple]:
        bins: list[list] = []
        room: list[int] = []
        pieces = sorted((p for held in self.open.values() for p in held), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
        for p in pieces:
            spot = next((b for b, r in enumerate(room) if r >= p[2]), None)
            if spot is None:
                bins.append([])
                room.append(capacity)
                spot = len(bins) - 1
            bins[spot].append(p)
            room[spot] -= p[2]
        return [x for b in bins for x in self.place(b)]


def _batch(rows: list[tuple], group: int) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, _FIELDS)),
                                       pa.array([group] * len(rows), pa.int64())], schema=_FIELDS)


def _refill(level: int, last: bool, capacity: int):
    """Packs what a group of tasks has left over."""

    def again(table: pa.Table) -> pa.Table:
        group = table["up"][0].as_py()
        filler, rows = Filler(level, group), []
        cols = [table[c].to_pylist() for c in ("id", "start", "length", "ids", "doc_tokens")]
        for p in sorted(zip(*cols), key=lambda p: (p[2], p[0] is None, p[0] or 0, p[1])):
            rows += filler.add(capacity // p[2], p)
        rows += filler.first_fit(capacity) if last else filler.left()
        return pa.Table.from_batches([_batch(rows, group)])

    return again


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str, end_id: int = 1,
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, start (in its document), length, ids (little-endian unsigned 32-bit), doc_tokens (with the end
    id), sequence_id and offset in the sequence. ``tokenizer``: path of a word tokenizer's file on the executors."""
    scratch = Scratch(df.sparkSession, "packing")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, group = encoder(tokenizer, "words"), TaskContext.get().partitionId()
        filler, rows = Filler(0, group), []
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                    ids += end
                    n, at = len(ids) // 4, 0
                    for length, k in cut(n, capacity):
                        rows += filler.add(k, (doc, at, length, ids[4 * at:4 * (at + length)], n))
                        at += length
                    if len(rows) >= BATCH:
                        yield _batch(rows, group)
                        rows = []
        yield _batch(rows + filler.left(), group)

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = scratch.write(docs.mapInArrow(fill, SCHEMA), "pieces")
    done, left, level = first.where("sequence_id is not null"), first.where("sequence_id is null"), 1
    while True:
        groups = left.agg(F.max("grp")).first()[0]
        last = groups is None or groups < FAN_IN

        more = left.withColumn("up", F.floor(F.col("grp") / FAN_IN)).groupBy("up").applyInArrow(_refill(level, last, capacity), SCHEMA)
        more = scratch.write(more, f"left-{level}")
        done = done.unionByName(more.where("sequence_id is not null"))
        if last:
            return done.drop("grp").withColumnRenamed("id", id_col)
        left, level = more.where("sequence_id is null"), level + 1

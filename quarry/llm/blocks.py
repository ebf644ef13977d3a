"""Blocks of documents in the shared folder, and the exchange of sorted packed arrays between blocks and shards.

A block is one row with some megabytes of documents as compressed Arrow. It is written once, so every later pass
sees the same block, however often a task is repeated. Blocks send packed arrays to shards of a hash range; a
shard answers each of them. All groups have a bounded size: a block by its bytes, a shard by the number of
shards, which grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20

BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, data binary"
MESSAGE_SCHEMA = "block long, shard int, data binary"


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.compress(sink.getvalue(), 3)


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all().combine_chunks()


def to_blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of BLOCK_SCHEMA; each block holds ``id`` and ``text`` ordered by id. No shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            t = pa.Table.from_batches(held)
            t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")], null_placement="at_start"))
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + seq], "n_docs": [t.num_rows],
                                               "n_bytes": [size], "data": [to_ipc(t)]})

        for batch in batches:
            texts = batch.column(1)
            step = max(1, int(batch.num_rows * block_bytes / max(1, 4 * texts.nbytes)))
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                held.append(piece)
                size += piece.column(1).nbytes
                if size >= block_bytes:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, BLOCK_SCHEMA)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as bytes, planes of equal significance together, which compress well."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
        head = f"{a.dtype.str}:{len(a)};".encode()
        out.append(head + np.ascontiguousarray(planes).tobytes())
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        stop = raw.index(b";", at)
        kind, n = raw[at:stop].decode().rsplit(":", 1)
        dt, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * dt.itemsize, stop + 1).reshape(dt.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dt))
        at = stop + 1 + n * dt.itemsize
    return out


def pack_sorted(a: np.ndarray, *more: np.ndarray) -> bytes:
    """A sorted array of unsigned 64-bit integers as differences, and others as they are."""
    return pack(np.diff(a, prepend=a.dtype.type(0)), *more)


def unpack_sorted(data: bytes) -> list[np.ndarray]:
    first, *more = unpack(data)
    return [np.cumsum(first, dtype=first.dtype), *more]


def messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                       pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.binary())],
                                      names=["block", "shard", "data"])


def answer(sent: DataFrame, reply: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Per shard, ``reply(shard, blocks, payloads)`` yields (block, payload) pairs; rows of MESSAGE_SCHEMA."""

    def of_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        shard = table["shard"][0].as_py()
        rows = [(b, shard, d) for b, d in reply(shard, table["block"].to_pylist(), table["data"].to_pylist())]
        return pa.Table.from_batches([messages(rows)])

    return sent.groupBy("shard").applyInArrow(of_shard, MESSAGE_SCHEMA)


def shard_bounds(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each of the equal ranges of 64-bit hashes begins in a sorted array; shards is a power of two."""
    bits = shards.bit_length() - 1
    edges = np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])

"""Token ids as a wavelet matrix per shard.

A shard's ids are stored as bit-planes, the most significant first; below each plane the ids with a 0 come before those with a
1, in order. With a directory of counts every 512 bits, a plane answers rank in constant time, so one file gives the
token at a place, the number of times that a token occurs, and where. Files are rows of a binary column: each is one
compressed image of its own, in any store that Spark can write.

Documents are ordered by id over range partitions; a partition's files follow each other. Defined results: a null or
empty text is the end id alone; equal ids follow each other in any order; null ids come first; an empty table gives no
files. Extra columns are not read.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import ship
from quarry.llm.tokens import encoder

MAGIC = b"WVM1"
BLOCK = 512
#: Ids in a file; one document is never split.
FILE_TOKENS = 1 << 21
FILE_SCHEMA = "part int, seq int, start long, n_tokens long, data binary"


class WaveletMatrix:
    """Rank and select over the bit-planes of a sequence of unsigned integers."""

    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.counts, self.zeros = n, planes, counts, zeros

    @classmethod
    def build(cls, a: np.ndarray, bits: int) -> "WaveletMatrix":
        planes, counts, zeros = [], [], []
        if len(a) and int(a.max()) >> bits:
            raise ValueError(f"id {int(a.max())} needs more than {bits} bits")
        a = a.astype(np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << k)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            pad = np.zeros(-len(one) % BLOCK, bool)
            per = np.concatenate([one, pad]).reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32)
            counts.append(np.concatenate([[0], np.cumsum(per)]).astype(np.uint32))
            low = a[~one]
            zeros.append(len(low))
            a = np.concatenate([low, a[one]])
        return cls(len(a), planes, counts, zeros)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        lo, hi = block * BLOCK // 8, (i + 7) // 8
        return int(self.counts[level][block]) + int(np.unpackbits(self.planes[level][lo:hi], bitorder="little")[:i - 8 * lo].sum())

    def access(self, i: int) -> int:
        v = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i >> 3] >> (i & 7)) & 1
            ones = self._rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            v = 2 * v + bit
        return v

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(len(self.planes)):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            if token >> (len(self.planes) - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, j: int) -> int:
        """Place of the ``j``-th (from 0) 0 or 1 of a plane."""
        counts = self.counts[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, j, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(counts[block])])

    def find(self, token: int, j: int) -> int:
        """Place of the ``j``-th (from 0) occurrence of a token; -1 if there are fewer."""
        lo, hi = self._range(token, 0, self.n) if not token >> len(self.planes) else (0, 0)
        if not 0 <= j < hi - lo:
            return -1
        at = lo + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        bits = len(self.planes)
        a = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(a)
            up[~one] = a[:self.zeros[k]]
            up[one] = a[self.zeros[k]:] | a.dtype.type(1 << (bits - 1 - k))
            a = up
        return a.astype(np.uint32)


def to_file(ids: np.ndarray, doc_ids: list, offsets: np.ndarray, bits: int) -> bytes:
    """Magic, header length, header (JSON), then the compressed document table, planes and directories."""
    m = WaveletMatrix.build(ids, bits)
    parts = [zstandard.compress(x.tobytes(), 1) for x in (offsets.astype("<i8"), *m.planes, *m.counts)]
    head = json.dumps({"n": m.n, "bits": bits, "zeros": m.zeros, "docs": doc_ids, "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def from_file(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, document ids, offsets of the documents)."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    size = struct.unpack("<I", data[4:8])[0]
    head, at, parts = json.loads(data[8:8 + size]), 8 + size, []
    for n in head["sizes"]:
        parts.append(zstandard.decompress(data[at:at + n]))
        at += n
    b = head["bits"]
    planes = [np.frombuffer(p, np.uint8) for p in parts[1:1 + b]]
    counts = [np.frombuffer(p, "<u4") for p in parts[1 + b:]]
    return WaveletMatrix(head["n"], planes, counts, head["zeros"]), head["docs"], np.frombuffer(parts[0], "<i8")


def write_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str, end_id: int,
                bits: int | None = None, file_tokens: int = FILE_TOKENS) -> None:
    """Encode every text with the end id appended, in ascending order of id, and write the shards' files to ``path``.

    ``bits`` is how many planes an id has (None: as many as the vocabulary needs); an id that needs more is an error.
    """
    ship(df.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, "bytes"), TaskContext.get().partitionId()
        planes = bits or max(end_id, enc.tok.get_vocab_size() - 1).bit_length()
        end = np.array([end_id], "<u4").tobytes()
        docs, held, sizes, seq, start, total = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            data = to_file(np.frombuffer(b"".join(held), "<u4"), docs, offsets, planes)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                                               "start": [start], "n_tokens": [int(offsets[-1])], "data": [data]})

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                coded = enc.encode([t or "" for t in piece.column(1).to_pylist()])
                for doc, ids in zip(piece.column(0).to_pylist(), coded):
                    docs.append(doc)
                    held.append(ids + end)
                    sizes.append(len(ids) // 4 + 1)
                    total += sizes[-1]
                    if total >= file_tokens:
                        yield flush()
                        start, seq, docs, held, sizes, total = start + total, seq + 1, [], [], [], 0
        if docs:
            yield flush()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    rows.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document: id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit)."""
    ship(files.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                m, docs, offsets = from_file(data.as_py())
                ids = m.all()
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(docs, pa.int64()), "part": pa.array([part] * len(docs), pa.int32()),
                    "local": pa.array(first + offsets[:-1], pa.int64()), "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())})

    # one row for each range partition
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    docs = files.select("part", "start", "data").mapInArrow(decode, "id long, part int, local long, n_tokens long, ids binary")
    return docs.join(F.broadcast(base), "part").select("id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")

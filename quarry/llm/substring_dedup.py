"""Substring dedup: a Count-min prefilter over word windows, then exact grouping of what may repeat.

1. Every block of documents sends, for each of two hash rows, the cells that its windows fall into (and whether a cell
   was hit twice in the block) to the shard that owns the cell range. A shard merges these partial sketches by adding
   counters that saturate at two, and answers each block with its cells of count two or more. Counts are never too low, so
   a window whose count is below two in either row occurs once in the corpus.
2. For windows that are estimated to repeat, each block sends the 128-bit hash and its own first position to the shard of the
   hash range; the shard finds the first occurrence in the corpus and tells the other blocks that theirs is later.
3. Every block removes the words that a later occurrence covers.

A window that occurs very often is one entry per block, whatever its count, so no key is hot. Sketch width and number
of shards follow the number of windows.

Defined results: null and empty texts have no words and lose none; documents shorter than a window lose none; equal
documents are judged by position, the one of smaller id stays (equal ids: any one of them is first); an empty table
gives no rows; other columns are not read, so their names cannot clash. A null id is ordered before all others and
comes back as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import blocks as B
from quarry.llm import words as W
from quarry.llm.shared import Scratch

U = np.uint64
ROWS = 2
#: Bits of the table in which a block looks its windows' cells up; a false hit only sends a window on to the exact pass.
LOOK_BITS = 24
_FIRST_ID = -(1 << 63)


def _load(data: bytes, width: int):
    t = B.from_ipc(data)
    ids, texts = t["id"].combine_chunks(), t["text"].combine_chunks()
    w = W.split(texts, 2)
    begins = W.window_starts(w.offsets, width)
    at = np.flatnonzero(begins)
    return ids, w, at, [W.windows(h, width, k)[at] for k, h in enumerate(w.hashes)]


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of a window in the top bits, so that shards are ranges of cells."""
    return hashes >> U(64 - bits)


def sketch(data: bytes, block: int, width: int, bits: int, shards: int) -> list[tuple[int, int, bytes]]:
    """A block's part of the sketch: for each shard, the cells of both rows and which were hit twice."""
    _, _, _, rows = _load(data, width)
    out: list[list[np.ndarray]] = [[] for _ in range(shards)]
    for h in rows:
        c = np.sort(_cells(h, bits))
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        cells = c[new]
        twice = np.diff(np.append(np.flatnonzero(new), len(c))) > 1
        cut = np.searchsorted(cells, np.arange(shards + 1, dtype=U) << U(bits - (shards.bit_length() - 1)))
        for s in range(shards):
            lo, hi = cut[s], cut[s + 1]
            first = cells[lo:hi] - (U(s) << U(bits - (shards.bit_length() - 1)))
            out[s] += [np.diff(first, prepend=U(0)).astype(np.uint32), np.packbits(twice[lo:hi])]
    return [(block, s, B.pack(*a)) for s, a in enumerate(out) if any(len(x) for x in a)]


def merge(bits: int, shards: int):
    """A shard adds the partial sketches of all blocks and returns to each the cells with a count of two or more."""

    def reply(shard: int, ids: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
        size = 1 << (bits - (shards.bit_length() - 1))
        counts = np.zeros((ROWS, size), np.uint8)

        def parts(d: bytes):
            a = B.unpack(d)
            for r in range(ROWS):
                cells = np.cumsum(a[2 * r], dtype=np.int64)
                yield r, cells, np.unpackbits(a[2 * r + 1], count=len(cells))

        for d in data:
            for r, cells, twice in parts(d):
                counts[r][cells] = np.minimum(counts[r][cells] + 1 + twice, 2)
        for b, d in zip(ids, data):
            keep = [cells[counts[r][cells] >= 2] for r, cells, _ in parts(d)]
            yield b, B.pack(*(np.diff(c, prepend=0).astype(np.uint32) for c in keep))

    return reply


def _estimated(rows: list[np.ndarray], bits: int, shards: int, table: pa.Table) -> np.ndarray:
    """Which windows have a count of two or more in both rows (and a few more)."""
    low = bits - (shards.bit_length() - 1)
    look = [np.zeros(1 << LOOK_BITS, bool) for _ in range(ROWS)]
    mask = U((1 << LOOK_BITS) - 1)
    for s, d in zip(table["shard"].to_pylist(), table["data"].to_pylist()):
        for r, a in enumerate(B.unpack(d)):
            cells = np.cumsum(a, dtype=U) + (U(s) << U(low))
            look[r][cells & mask] = True
    ok = np.ones(len(rows[0]), bool)
    for r in range(ROWS):
        ok &= look[r][_cells(rows[r], bits) & mask]
    return ok


def _first_of_each(a: np.ndarray, b: np.ndarray):
    """Stable order by (a, b); which entries of the order begin a new pair."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, a, b, new


def earliest(shards: int):
    """A shard finds each window's first occurrence; a block learns which of its own first ones come later."""

    def reply(shard: int, ids: list[int], data: list[bytes]) -> Iterator[tuple[int, bytes]]:
        got = [B.unpack_sorted(d) for d in data]
        if not got:
            return
        a, b, doc, pos = (np.concatenate([g[k] for g in got]) for k in range(4))
        src = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        order = np.lexsort((pos, doc, b, a))
        ao, bo = a[order], b[order]
        new = np.ones(len(ao), bool)
        new[1:] = (ao[1:] != ao[:-1]) | (bo[1:] != bo[:-1])
        late = np.zeros(len(a), bool)
        late[order] = ~new
        for k, block in enumerate(ids):
            yield block, np.packbits(late[src == k]).tobytes()

    return reply


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 20) -> DataFrame:
    """Remove every word that lies in a window of ``width`` words whose sequence also starts earlier.

    Returns ``id_col``, n_words, n_removed and kept_text (the words that are left, joined by one space) for each row.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "substring")
    stored = scratch.write(B.to_blocks(df, id_col, text_col), "blocks", codec="uncompressed")
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    # words are taken to be six bytes long; eight cells for each window
    bits = max(20, int(total // 6).bit_length() + 3)
    shards = 1 << max(5, bits - 24)
    slim = stored.select("block", "data")

    def send_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield B.messages(sketch(data.as_py(), block, width, bits, shards))

    heavy = scratch.write(B.answer(slim.mapInArrow(send_cells, B.MESSAGE_SCHEMA), merge(bits, shards)), "cells",
                          codec="uncompressed")

    def repeated(table: pa.Table, answers: pa.Table):
        """Everything that a block knows after the first pass; the same in both later passes."""
        ids, w, at, rows = _load(table["data"][0].as_py(), width)
        sel = np.flatnonzero(_estimated(rows, bits, shards, answers))
        order, a, b, new = _first_of_each(rows[0][sel], rows[1][sel])
        return ids, w, at, sel, order, a, b, new

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([B.messages([])])
        ids, w, at, sel, order, a, b, new = repeated(table, answers)
        first = at[sel[order[new]]]
        doc = np.searchsorted(w.offsets, first, "right") - 1
        key = ids.fill_null(_FIRST_ID).to_numpy()[doc]
        ua, ub = a[new], b[new]
        cut = B.shard_bounds(ua, shards)
        block = table["block"][0].as_py()
        return pa.Table.from_batches([B.messages(
            [(block, s, B.pack_sorted(ua[lo:hi], ub[lo:hi], key[lo:hi], (first - w.offsets[doc])[lo:hi].astype(np.uint32)))
             for s, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo])])

    def strip(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pydict({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                                         "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        cells = answers.filter(pa.compute.equal(answers["kind"], 0))
        lates = answers.filter(pa.compute.equal(answers["kind"], 1))
        ids, w, at, sel, order, a, b, new = repeated(table, cells)
        late_first = np.zeros(int(new.sum()), bool)
        cut = B.shard_bounds(a[new], shards)
        for s, d in zip(lates["shard"].to_pylist(), lates["data"].to_pylist()):
            n = int(cut[s + 1] - cut[s])
            late_first[cut[s]:cut[s + 1]] = np.unpackbits(np.frombuffer(d, np.uint8), count=n).astype(bool)
        late = ~new
        late[new] = late_first
        starts = at[sel[order[late]]]
        n = int(w.offsets[-1])
        cover = np.zeros(n + 1, np.int64)
        cover[:n] += np.bincount(starts, minlength=n)[:n]
        cover[:n] -= np.bincount(np.minimum(starts + width, n), minlength=n + 1)[:n]
        kept = np.cumsum(cover[:n]) == 0
        return _result(table, ids, w, kept)

    later = B.answer(slim.groupBy("block").cogroup(heavy.groupBy("block"))
                     .applyInArrow(send_windows, B.MESSAGE_SCHEMA), earliest(shards))
    told = (heavy.withColumn("kind", F.lit(0))
            .unionByName(scratch.write(later, "later", codec="uncompressed").withColumn("kind", F.lit(1))))
    out = slim.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        strip, "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)


def _result(table: pa.Table, ids: pa.Array, w: W.Words, kept: np.ndarray) -> pa.Table:
    """Words that are kept, each followed by a space but for a document's last one."""
    n_words = np.diff(w.offsets)
    kept_cum = np.concatenate([[0], np.cumsum(kept)])
    n_kept = kept_cum[w.offsets[1:]] - kept_cum[w.offsets[:-1]]
    start, end = w.start[kept], w.end[kept]
    bounds = np.concatenate([[0], np.cumsum(n_kept)])
    texts, raw = [], w.data.tobytes()
    whole = n_kept == n_words
    for k in range(len(ids)):
        lo, hi = bounds[k], bounds[k + 1]
        if whole[k]:
            s, e = (start[lo], end[hi - 1]) if hi > lo else (0, 0)
            texts.append(b" ".join(raw[s:e].split()))
        else:
            s, e = start[lo:hi], end[lo:hi]
            # one slice for each run of words that touch
            cut = np.flatnonzero(np.diff(np.flatnonzero(kept[w.offsets[k]:w.offsets[k + 1]])) > 1) + 1
            runs = zip(np.append(s[:1], s[cut]).tolist(), np.append(e[cut - 1], e[-1:]).tolist())
            texts.append(b" ".join(b" ".join(raw[x:y].split()) for x, y in runs))
    return pa.Table.from_pydict({"id": ids, "n_words": pa.array(n_words, pa.int64()),
                                 "n_removed": pa.array(n_words - n_kept, pa.int64()),
                                 "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

"""MinHash near-dedup with DartMinHash signatures.

A document is a weighted set: its shingles of five words, each with its number of occurrences. Every unit of an
element's weight is a region into which hashed darts fall as a Poisson process along the rank axis; two documents see the
same darts where their weights overlap. Ranks below t / (total weight) bring about t darts, whatever the size of the
document; each dart belongs to one of the signature's coordinates by its hash, and a coordinate keeps the earliest.
The probability that two documents keep the same dart is their weighted Jaccard similarity.

Bands of coordinates are joined by key, and every pair of a bucket is decided: compared, exactly, on the shingle counts, or
found to be in one component already. While the buckets hold many undecided pairs, all members are compared with their bucket's
leaders, the members with the fullest buckets; then components are built, and members outside the component of their
bucket's first leader meet the next leaders, of that component and of the others, until a round finds no further link. These
rounds only save work: the pairs that are left, of members in different components, are all compared in the end. Buckets of up
to FULL members are expanded for that. The members of fuller ones meet by an exact prefix filter: of two documents at similarity s
or more, each has one of the common cells among its (1 - s) * size + 1 rarest ones, and the first of these leaves
enough cells after it in both. Equal texts are one member.

Shingles are 64-bit hashes. A pair at similarity s is missed with probability (1 - s**rows)**bands: 4e-7 at 0.8.

Defined results: documents of one to four words are one shingle; documents without words (null, empty) equal
nothing, not even each other; equal ids are one document; a null id gets a null class and is kept; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import words as W
from quarry.llm.components import components
from quarry.llm.shared import Scratch

U = np.uint64
BANDS, BAND_ROWS = 28, 4
SHINGLE = 5
#: Cells that are thrown at together; bounds the temporaries of a task.
STRIDE = 1 << 18
#: Bytes of text that are shingled together; a batch of rows may hold many times as much.
PIECE_BYTES = 1 << 20
#: Leaders of a bucket in the first round; further rounds have as many from its first leader's component and from the others.
LEADERS = 2
#: Undecided pairs for each member of a bucket up to which they are compared without further rounds of leaders.
FEW = 2
#: Members of a bucket whose undecided pairs are listed; those of fuller buckets meet by the prefix filter.
FULL = 64
#: A list of ids up to this length is broadcast, a longer one joined by shuffle.
BROADCAST_IDS = 500_000


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells (element, occurrence) as 64-bit keys, document after document, and the documents' offsets."""
    w = W.split(texts)
    h, n_docs = w.hashes[0], len(w.offsets) - 1
    at = np.flatnonzero(W.window_starts(w.offsets, width))
    key = W.windows(h, width)[at]
    doc = np.searchsorted(w.offsets, at, "right") - 1
    sizes = np.diff(w.offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        one = np.array([W.windows(h[w.offsets[d]:w.offsets[d + 1]], int(sizes[d]))[0] for d in short], U)
        key, doc = np.concatenate([key, one]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
    # number repeated shingles of a document: the few keys that are not alone in it
    own = W.mix(key + W.mix(doc.astype(U)))
    s = np.sort(own)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if len(again):
        spot = np.minimum(np.searchsorted(again, own), len(again) - 1)
        at = np.flatnonzero(again[spot] == own)
        order = at[np.argsort(own[at], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = own[order][1:] != own[order][:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        nth = (np.arange(len(order)) - start).astype(U)
        key = key.copy()
        key[order] = np.where(nth > 0, W.mix(key[order] + nth * U(0x9E3779B97F4A7C15)), key[order])
    return key, np.searchsorted(doc, np.arange(n_docs + 1))


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most PIECE_BYTES of text (or one row)."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def throw(cells: np.ndarray, doc: np.ndarray, limit: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Earliest dart per document and coordinate: rank (float32 bits) and dart hash, all ones where none fell.

    ``limit`` is each document's highest rank. The gaps between the darts of a cell are exponential.
    """
    best = np.full(n_docs * k, ~U(0), U)
    rank = np.zeros(len(cells))
    nth = 0
    while len(cells):
        nth += 1
        dart = W.mix(cells + U(nth * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        rank = rank - np.log(((dart >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
        in_reach = rank < limit[doc]
        cells, doc, rank, dart = cells[in_reach], doc[in_reach], rank[in_reach], dart[in_reach]
        mark = W.mix(dart)
        slot = doc * k + (mark >> U(32)).astype(np.int64) % k
        bits = rank.astype(np.float32).view(np.uint32).astype(U)
        np.minimum.at(best, slot, (bits << U(32)) | (mark & U(0xFFFFFFFF)))
    return best.reshape(n_docs, k)


def signatures(cells: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) signature; documents without cells get all ones."""
    n_docs, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.full((n_docs, k), ~U(0), U)
    t = k * np.log(k) + 2 * k
    lo = 0
    while lo < n_docs:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STRIDE, "right")) - 1)
        todo, reach = np.arange(lo, min(hi, n_docs)), t
        todo = todo[sizes[todo] > 0]
        while len(todo):
            idx = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in todo])
            doc = np.repeat(np.arange(len(todo)), sizes[todo])
            got = throw(cells[idx], doc, reach / sizes[todo], len(todo), k)
            out[todo] = got
            todo, reach = todo[(got == ~U(0)).any(axis=1)], 2 * reach  # a coordinate without a dart: reach further
        lo = hi
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(sig), bands), U) + W.mix(np.arange(1, bands + 1, dtype=U))
    for r in range(rows):
        key = W.mix(key * U(0x9FB21C651E98DF25) + sig[:, r::rows][:, :bands])
    return key.view(np.int64)


def _sign(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, 2)):
            cells, offsets = shingles(batch.column(2), width)
            keys = band_keys(signatures(cells, offsets, bands * rows), bands, rows)
            sizes = np.diff(offsets)
            keys = keys[sizes > 0]
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))])
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "digest": batch.column(1), "weight": pa.array(sizes, pa.int64()),
                "bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel(), pa.int64()))})

    return run


def _cells(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, 1)):
            cells, offsets = shingles(batch.column(1), width)
            data = [np.sort(cells[a:b]).tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "cells": pa.array(data, pa.binary())})

    return run


def _compare(num: int, den: int):
    """Pairs whose weighted Jaccard similarity is at least num / den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cell of a document, with the document's number of cells."""
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            cells = np.frombuffer(data.as_buffer(), np.int64)
            n = np.full(len(cells), len(cells), np.int64)
            yield pa.RecordBatch.from_pydict({"id": pa.array(np.full(len(cells), i, np.int64)), "size": pa.array(n), "cell": pa.array(cells)})


def _prefix_pairs(scratch: Scratch, members: DataFrame, cells: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ``members(id, c)`` of different components that can have a similarity of num / den, all of them."""
    flat = cells.join(members, "id", "left_semi").mapInArrow(_explode, "id long, size long, cell long")
    flat = scratch.write(flat, "flat")
    often = scratch.write(flat.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    shared = scratch.write(flat.join(often, "cell"), "shared")
    scratch.drop("flat")
    # cells of one document only are the rarest ones, and nobody's common ones
    own = Window.partitionBy("id")
    at = F.row_number().over(own.orderBy("n", "cell")) + F.col("size") - F.count(F.lit(1)).over(own)
    near = shared.withColumn("at", at).where(f"at <= size - (size * {num} + {den - 1}) div {den} + 1")
    near = scratch.write(near.select("id", "size", "cell", "at").join(members, "id"), "prefixes")
    scratch.drop("shared")
    # members of a cell's largest component are not paired among themselves
    main = near.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(
        F.max(F.struct("n", "c")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = scratch.write(main.select("cell", F.col("top.c").alias("main")), "prefix-main")
    rest = scratch.write(near.join(main, "cell").where("c <> main").select("cell", F.col("id").alias("x"), F.col("size").alias("m"),
                                                                          F.col("at").alias("p"), F.col("c").alias("d")), "prefix-rest")
    # the first common cell of two documents has all common ones at or after its place in either
    met = near.join(rest, "cell").where(f"c <> d and {num + den} * (1 + least(size - at, m - p)) >= {num} * (size + m)")
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: tuple[int, int] = (4, 5),
                    bands: int = BANDS, rows: int = BAND_ROWS, width: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: id, ``component_id`` (smallest id of its class) and ``kept`` (whether it is that)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    sig = scratch.write(docs.select("id", F.unhex(F.md5("text")).alias("digest"), "text").mapInArrow(
        _sign(bands, rows, width), "id long, digest binary, weight long, bands array<long>"), "signatures")
    members = sig.select("id", "digest", "weight")
    reps = sig.where("weight > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    reps = scratch.write(reps, "reps")
    links = members.where("weight > 0").join(reps, "digest").select("id", "rep")  # equal texts

    keys = (sig.join(reps.select(F.col("rep").alias("id"), F.col("digest").alias("own")), "id")
            .where(F.col("digest") == F.col("own")).select("id", F.explode("bands").alias("key")))
    keys = scratch.write(keys, "keys")
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = scratch.write(full, "full")  # written, so that AQE can split the join where a bucket is very full
    held = scratch.write(keys.join(full, "key"), "buckets")
    scratch.drop("keys")
    rank = held.groupBy("id").agg(F.sum("n").alias("fame"))
    held = scratch.write(held.join(rank, "id").select("id", "key", F.struct("fame", (-F.col("id")).alias("m")).alias("r")), "held")
    scratch.drop("buckets")

    need = held.select("id").distinct()
    few = need.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(need) if few else need, "id", "left_semi")
    cells = scratch.write(chosen.mapInArrow(_cells(width), "id long, cells binary"), "cells")

    comp, tested, k = None, None, 0
    famous = Window.partitionBy("key").orderBy(F.desc("r"))
    n_held = held.count()

    def undecided(state: DataFrame) -> tuple[DataFrame, int]:
        """Buckets with members (n) of several components, and their pairs of different ones, in all."""
        parts = state.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
        per = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        per = scratch.write(per.where("n * n > same"), f"undecided-{k}")
        return per, per.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0

    def compared(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(pairs not compared before, links among them)."""
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, f"pairs-{name}")
        both = (pairs.join(cells.select(F.col("id").alias("a"), F.col("cells").alias("x")), "a")
                .join(cells.select(F.col("id").alias("b"), F.col("cells").alias("y")), "b").select("a", "b", "x", "y"))
        return pairs, scratch.write(both.mapInArrow(_compare(*similarity), "a long, b long"), f"links-{name}")

    def joined(found: DataFrame, name: str) -> DataFrame:
        edges = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if comp is not None:
            edges = edges.unionByName(comp.select(F.col("v").alias("u"), F.col("c").alias("v")))
        return components(scratch, edges, name)

    state = held.withColumn("c", F.col("id"))
    buckets, left = undecided(state)
    while left > FEW * n_held:
        if k == 0:
            lead = scratch.write(held.withColumn("nth", F.row_number().over(famous)).where(F.col("nth") <= LEADERS)
                                 .select("key", F.col("id").alias("lead"), F.col("id").alias("lead_c"), "nth"), "lead-0")
            tops, rest = lead.where("nth = 1").select("key", F.col("lead").alias("id")), state
        else:
            # each bucket's members by component: that of its first leader, and the rest, which meets new leaders from both
            main = scratch.write(tops.join(state.select("id", "key", "c"), ["id", "key"]).select("key", F.col("c").alias("main")), f"main-{k}")
            sides = scratch.write(state.join(main, "key"), f"sides-{k}")
            rest = sides.where("c <> main")
            inner = sides.where("c = main").withColumn("nth", F.row_number().over(famous)).where(
                F.col("nth") <= LEADERS * (k + 1)).where(F.col("nth") > LEADERS * k)
            best = rest.groupBy("key", "c").agg(F.max("r").alias("r"))
            outer = best.withColumn("nth", F.row_number().over(famous)).where(F.col("nth") <= LEADERS * k).where(
                F.col("nth") > LEADERS * (k - 1))
            lead = scratch.write(inner.select("key", F.col("id").alias("lead"), F.col("c").alias("lead_c")).unionByName(
                outer.select("key", (-F.col("r.m")).alias("lead"), F.col("c").alias("lead_c"))), f"lead-{k}")
        pairs = (rest.join(lead.select("key", "lead", "lead_c"), "key").where("c <> lead_c")
                 .select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())
        pairs, found = compared(pairs, str(k))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if found.isEmpty():
            break
        comp = joined(found, f"cc-{k}")
        k += 1
        state = scratch.write(held.join(comp.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id")), f"state-{k}")
        buckets, left = undecided(state)

    if left:
        open_ = scratch.write(state.select("id", "key", "c").join(buckets.select("key", "n"), "key"), "open")
        one = open_.where(F.col("n") <= FULL)
        pairs = (one.join(one.select("key", F.col("id").alias("x"), F.col("c").alias("d")), "key").where("id < x and c <> d")
                 .select(F.col("id").alias("a"), F.col("x").alias("b")).distinct())
        full = open_.where(F.col("n") > FULL).select("id", "c").distinct()
        if not full.isEmpty():
            full = scratch.write(full, "full-members")
            pairs = pairs.unionByName(_prefix_pairs(scratch, full, cells, *similarity)).distinct()
        _, found = compared(pairs, "left")
        if not found.isEmpty():
            comp = joined(found, "cc-left")

    # a representative is the smallest id of its equal texts, so the component's smallest one is that of the class
    classes = links if comp is None else (links.join(comp.select(F.col("v").alias("rep"), "c"), "rep", "left")
                                    .select("id", F.coalesce("c", "rep").alias("rep")))
    out = sig.select("id").join(classes.select("id", F.col("rep").alias("c")).distinct(), "id", "left")
    cls = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), cls.alias("component_id"),
                      F.coalesce(F.col("id") == cls, F.lit(True)).alias("kept"))

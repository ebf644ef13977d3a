"""Embedding near-dedup: an exact metric range join of unit vectors.

Cosine of at least c is a distance of at most r = sqrt(2 - 2 c) between unit vectors. Pivots, spread out over a bounded sample,
partition the vectors into cells by the nearest pivot. A vector is also sent to another cell if a member of it may
lie within r: the triangle inequality bounds its distance to the cell's pivot by the cell's radii plus r, and its
distance to the plane between both pivots by r. Of two cells only one receives the other's vectors, so each pair meets
once; cells are cut into blocks and their visitors into chunks of bounded size, which are joined independently.
A task counts links and returns, instead of the pairs, a spanning star for each local component.

Links are decided by dot products and norms in double precision; a cosine within 1e-12 of the threshold is recomputed with
exact summation. Pivots only steer the work: with any choice of them no link is lost.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (an
n_links of 0, their own component); vectors of different lengths never link; equal vectors are compared once and
count as linked; a null id gets a null component and is kept; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import Scratch

#: Vectors of a cell that are joined in one task, visitors in one task, and columns compared at a time.
BLOCK, CHUNK, SLICE = 8192, 32768, 1024
#: Vectors looked at to choose pivots, vectors for each pivot, and the most pivots.
SAMPLE, PER_PIVOT, MAX_PIVOTS = 4096, 2048, 256


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as little-endian doubles, others as null."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            v = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype("<f8")
            ok = v is not None and len(v) > 0 and np.isfinite(v).all() and v.any()
            out.append((v + 0.0).tobytes() if ok else None)
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "vec": pa.array(out, pa.binary())})


def _matrix(col) -> np.ndarray:
    """Rows of equal length."""
    rows = [x.as_buffer() for x in col]
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def choose_pivots(sample: list[bytes], n: int) -> dict[int, np.ndarray]:
    """Per vector length, unit pivots far from each other."""
    out = {}
    by_dim: dict[int, list[bytes]] = {}
    for v in sample:
        by_dim.setdefault(len(v) // 8, []).append(v)
    for d, vs in by_dim.items():
        x = _unit(np.frombuffer(b"".join(vs), "<f8").reshape(-1, d))
        want = min(MAX_PIVOTS, len(x), max(1, n * len(vs) // (len(sample) * PER_PIVOT)))
        far, picked = np.full(len(x), np.inf), [0]
        for _ in range(want - 1):
            far = np.minimum(far, 2 - 2 * x @ x[picked[-1]])
            picked.append(int(far.argmax()))
        out[d] = x[picked]
    return out


class Cells:
    """Pivots of all lengths with consecutive cell numbers; a length without pivots is one cell, -length."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.first, self.pivots, n = {}, pivots, 0
        for d in sorted(pivots):
            self.first[d] = n
            n += len(pivots[d])

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * x @ self.pivots[x.shape[1]].T))


def _by_length(batch: pa.RecordBatch, col: int):
    """(row numbers, matrix of unit vectors) for each length in a batch."""
    sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column(col)], np.int64)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, _unit(_matrix(batch.column(col).take(pa.array(at))))


def _home(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d, at, x in _by_length(batch, 2):
                if d not in cells.pivots:
                    home[at] = -d
                    continue
                far = cells.distances(x)
                near = far.argmin(axis=1)
                home[at], dist[at] = cells.first[d] + near, far[np.arange(len(x)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(dist)],
                                             names=["id", "n", "vec", "home", "dist"])

    return run


def _goes(a, b):
    """Of two different numbers, whether ``a`` visits ``b``: true for exactly one order, balanced over all."""
    return np.where((a + b) % 2 == 0, a < b, a > b)


def _send(cells: Cells, stats: dict[int, tuple[int, float, float]], r: float, chunks: int):
    """Every vector to its own block of its cell (for each chunk of visitors) and, as a visitor, where a link may be."""
    blocks = {c: max(1, math.ceil(n / BLOCK)) for c, (n, _, _) in stats.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                ids = batch.column(0).to_numpy()
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                src, cell, block, chunk, own = [], [], [], [], []

                def put(rows, c, b, k, mine):
                    src.append(rows)
                    cell.append(np.full(len(rows), c))
                    block.append(np.broadcast_to(b, len(rows)))
                    chunk.append(np.broadcast_to(k, len(rows)))
                    own.append(np.full(len(rows), mine))

                home = batch.column(3).to_numpy()
                for d, at, x in _by_length(batch, 2):
                    part = (mixed[at] % np.uint64(chunks)).astype(np.int64)
                    for c in np.unique(home[at]):
                        sel = home[at] == c
                        mine = (mixed[at] // np.uint64(chunks) % np.uint64(blocks[c])).astype(np.int64)
                        for k in range(chunks):
                            put(at[sel], c, mine[sel], k, True)
                        for b in range(blocks[c]):
                            go = sel & (mine != b) & _goes(mine, b)
                            put(at[go], c, b, part[go], False)
                    if d not in cells.pivots:
                        continue
                    far, first, p = cells.distances(x), cells.first[d], cells.pivots[d]
                    near = home[at] - first
                    mine_far = far[np.arange(len(x)), near]
                    for j in range(len(p)):
                        if first + j not in stats:
                            continue
                        _, lo_j, hi_j = stats[first + j]
                        between = np.sqrt(np.maximum(0.0, 2 - 2 * p @ p[j]))[near]
                        plane = far[:, j] ** 2 - mine_far ** 2 <= 2 * r * between + 1e-9
                        go = (near != j) & _goes(near, j) & plane & (far[:, j] <= hi_j + r) & (far[:, j] >= lo_j - r)
                        if go.any():
                            for b in range(blocks[first + j]):
                                put(at[go], first + j, b, part[go], False)
                rows = np.concatenate(src)
                for a in range(0, len(rows), 8000):
                    take = pa.array(rows[a:a + 8000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(cell)[a:a + 8000], pa.int32()), pa.array(np.concatenate(block)[a:a + 8000], pa.int32()),
                         pa.array(np.concatenate(chunk)[a:a + 8000], pa.int32()), pa.array(np.concatenate(own)[a:a + 8000], pa.bool_()),
                         batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
                        names=["cell", "block", "chunk", "own", "id", "n", "vec"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, least: float) -> np.ndarray:
    cos = x @ y.T
    ok = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):
        a, b = xs[i] / np.abs(xs[i]).max(), ys[j] / np.abs(ys[j]).max()
        ok[i, j] = math.fsum(a * b) >= least * math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b))
    return ok


def _stars(ok: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """(vertex, smallest vertex of its component) of the bipartite graph of a slice."""
    r, c = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    ok = ok[np.ix_(r, c)]
    a, b = rows[r].copy(), cols[c].copy()
    big = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(ok, b[None, :], big).min(axis=1, initial=big))
        nb = np.minimum(b, np.where(ok, na[:, None], big).min(axis=0, initial=big))
        if (na == a).all() and (nb == b).all():
            return np.stack([np.concatenate([rows[r], cols[c]]), np.concatenate([a, b])], axis=1)
        a, b = na, nb


def _join(least: float):
    def run(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy(zero_copy_only=False)
        order = np.argsort(~own, kind="stable")
        table = table.take(pa.array(order))
        n_own = int(own.sum())
        ids, n = table["id"].to_numpy(), table["n"].to_numpy()
        raw = _matrix(table["vec"])
        x = _unit(raw) if len(raw) else raw
        links, edges = np.zeros(len(ids), np.int64), []
        # pairs within the block meet in the first chunk only
        start = 0 if table["chunk"][0].as_py() == 0 else n_own
        for lo in range(start, len(ids), SLICE):
            hi = min(lo + SLICE, len(ids))
            rows = min(n_own, hi)  # each pair of the block once
            ok = _linked(x[:rows], x[lo:hi], raw[:rows], raw[lo:hi], least)
            if lo < n_own:
                ok &= np.arange(rows)[:, None] < np.arange(lo, hi)[None, :]
            if ok.any():
                links[:rows] += ok @ n[lo:hi]
                links[lo:hi] += n[:rows] @ ok
                edges.append(_stars(ok, ids[:rows], ids[lo:hi]))
        some = np.flatnonzero(links)
        e = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
        e = e[e[:, 0] != e[:, 1]]
        return pa.Table.from_pydict({
            "id": pa.array(np.concatenate([ids[some], e[:, 0]]), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(e), np.int64)]), pa.int64()),
            "peer": pa.array(np.concatenate([ids[some], e[:, 1]]), pa.int64())})

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, cosine: float = 0.9) -> DataFrame:
    """One row per row of ``df``: id, n_links (other vectors with at least that cosine), component_id (smallest id that
    links reach) and kept (whether it is that).

    Vectors are told apart by their place, equal ones are one vector that is counted as often as it occurs, so
    rows that share an id, or have none, keep their links; a component without any id has a null component_id.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "embeddings")
    r = math.sqrt(2 - 2 * cosine) + 1e-9
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.mapInArrow(_prepare, "id long, vec binary").withColumn("digest", F.md5("vec")).withColumn("key", F.monotonically_increasing_id())
    rows = scratch.write(rows, "vectors")
    same = rows.where("vec is not null").groupBy("digest").agg(F.min("key").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    same = scratch.write(same, "same")
    reps = rows.select(F.col("key").alias("id"), "vec").join(same.select(F.col("rep").alias("id"), "n"), "id")
    reps = scratch.write(reps.select("id", "n", "vec"), "reps")
    total = reps.count()
    sample = [bytes(x["vec"]) for x in reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    cells = Cells(choose_pivots(sample, total))
    homes = scratch.write(reps.mapInArrow(_home(cells), "id long, n long, vec binary, home int, dist double"), "homes")
    stats = {x["home"]: (x["n"], x["lo"], x["hi"]) for x in homes.groupBy("home").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    chunks = 1 + total // (2 * CHUNK)
    sent = homes.mapInArrow(_send(cells, stats, r, chunks), "cell int, block int, chunk int, own boolean, id long, n long, vec binary")
    found = sent.groupBy("cell", "block", "chunk").applyInArrow(_join(cosine), "id long, links long, peer long")
    found = scratch.write(found, "found")
    comp = components(scratch, found.where("links = 0").select(F.col("id").alias("u"), F.col("peer").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = (same.join(links.withColumnRenamed("id", "rep"), "rep", "left")
             .join(comp.select(F.col("v").alias("rep"), "c"), "rep", "left")
             .select("digest", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("c", "rep").alias("root")))
    known = scratch.write(known, "known")
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(named, "root").select("digest", "n_links", "component")
    out = rows.select("id", "digest", F.col("vec").isNotNull().alias("good")).join(known, "digest", "left")
    cls = F.when(F.col("good"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      cls.alias("component_id"), F.col("id").eqNullSafe(cls).alias("kept"))

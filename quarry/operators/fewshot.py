"""Few-shot selection: positional (JN-4) and exact k-nearest neighbours by vector similarity (JN-5).

JN-5 never materializes pairs. Query and corpus vectors are packed into blocks of bounded size; groups of blocks of both
sides meet in the cells of a grid (an equi-join on the cell, all through Spark), and a task multiplies one pair of
blocks after the other and keeps the top k per query. A grouped merge of these short lists gives the exact
answer. Exact work is O(queries x corpus); an index of random-projection buckets, fitted on a bounded sample, leaves a
query only the buckets that it probes, at a recall that is measured. Memory per task is bounded by two groups of blocks and
the product of two blocks, whatever the size of a split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.evaluation import global_positions
from quarry.sources.jsonl import scratch_path

DEFAULT_CHUNK_ROWS = 2048
#: Blocks of one side in a cell, on average.
EDGE = 16


def positional_shots(df: DataFrame, order: str = "example_id", key: str = "example_id") -> DataFrame:
    """JN-4 (T8): for the row at position i, the first two of rows max(0, i-5)..i-1; row 0 takes rows 1
    and 2. Output long form ``(key, shot_rank, shot_<key>)``; an equi-join on position, no window over
    the whole set (positions come from a range-partitioned sort with per-partition offsets)."""
    p = global_positions(df.select(key) if order == key else df.select(key, order), order)
    i = F.col("pos")
    wanted = (F.when(i == 0, F.array(F.lit(1), F.lit(2)))
              .when(i == 1, F.array(F.lit(0)))
              .when(i <= 5, F.array(F.lit(0), F.lit(1)))
              .otherwise(F.array(i - 5, i - 4)))
    want = p.select(key, F.posexplode(wanted).alias("shot_rank", "shot_pos"))
    shots = p.select(F.col("pos").alias("shot_pos"), F.col(key).alias("shot_" + key))
    return want.join(shots, "shot_pos").select(key, (F.col("shot_rank") + 1).alias("shot_rank"), "shot_" + key)


def _top_k(sims, cid, kk):
    """Exact k best per row (largest similarity, ties to the smaller id) without sorting whole rows:
    ``argpartition`` picks k candidates; rows where the k-th value is tied with unpicked entries are
    re-ranked over all their tied entries, so the result equals a full sort."""
    import numpy as np
    n = sims.shape[1]
    rows = np.arange(sims.shape[0])[:, None]
    if kk < n:
        part = np.argpartition(-sims, kk - 1, axis=1)[:, :kk]
    else:
        part = np.broadcast_to(np.arange(n), (sims.shape[0], n)).copy()
    kth = sims[rows, part].min(axis=1)
    ties = (sims >= kth[:, None]).sum(axis=1) > kk
    sel_sims, sel_ids = sims[rows, part], cid[part]
    order = np.lexsort((sel_ids, -sel_sims), axis=1)
    top_ids, top_sims = sel_ids[rows, order], sel_sims[rows, order]
    for r in np.nonzero(ties)[0]:
        cand = np.nonzero(sims[r] >= kth[r])[0]
        o = np.lexsort((cid[cand], -sims[r, cand]))[:kk]
        top_ids[r], top_sims[r] = cid[cand][o], sims[r, cand][o]
    return top_ids, top_sims


def _pack(rows: int, index: "Index | None" = None, probes: int = 0):
    """Blocks of at most ``rows`` vectors: bucket, ids and vectors as little-endian bytes.

    Without an index all blocks are of bucket 0. With one a vector goes to its own bucket, or, if ``probes`` is
    given, to the ``probes`` buckets that are most likely to hold its neighbours.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(bucket, ids, vecs):
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()),
                                               "ids": [np.concatenate(ids).astype("<i8").tobytes()],
                                               "vecs": [np.concatenate(vecs).astype("<f8").tobytes()]})
        held: dict[int, list] = {}

        def put(bucket, ids, vecs):
            ours = held.setdefault(bucket, [[], [], 0])
            if ours[2] + len(ids) > rows:
                yield block(bucket, *ours[:2])
                ours = held[bucket] = [[], [], 0]
            ours[0].append(ids)
            ours[1].append(vecs)
            ours[2] += len(ids)

        for b in batches:
            for lo in range(0, b.num_rows, rows):
                piece = b.slice(lo, rows)
                ids = piece.column(0).to_numpy()
                vecs = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                if index is None:
                    yield from put(0, ids, vecs)
                    continue
                near = index.nearest(vecs, probes) if probes else index.own(vecs)[:, None]
                for bucket in np.unique(near).tolist():
                    at = (near == bucket).any(axis=1)
                    yield from put(bucket, ids[at], vecs[at])
        for bucket, (ids, vecs, n) in held.items():
            if n:
                yield block(bucket, ids, vecs)
    return run


def _best(k: int, exclude_self: bool):
    """The k best of a cell's corpus blocks for each query of its query blocks; one product of two blocks at a time."""
    def run(key, queries, corpus):
        import numpy as np
        import pyarrow as pa

        def blocks(t):
            for ids, vecs in zip(t["ids"], t["vecs"]):
                i = np.frombuffer(ids.as_buffer(), "<i8")
                yield i, np.frombuffer(vecs.as_buffer(), "<f8").reshape(len(i), -1)
        out = []
        for qid, qv in blocks(queries):
            ids, sims = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
            for cid, cv in blocks(corpus):
                new = qv @ cv.T
                if exclude_self:
                    new[qid[:, None] == cid[None, :]] = -np.inf
                i, s = _top_k(new, cid, min(k, len(cid)))
                ids, sims = np.hstack([ids, i]), np.hstack([sims, s])
                order = np.lexsort((ids, -sims), axis=1)[:, :k]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            ok = np.isfinite(sims).ravel()
            out.append(pa.table({"qid": np.repeat(qid, ids.shape[1])[ok], "nid": ids.ravel()[ok], "sim": sims.ravel()[ok]}))
        return pa.concat_tables(out) if out else pa.table({"qid": pa.array([], pa.int64()), "nid": pa.array([], pa.int64()),
                                                           "sim": pa.array([], pa.float64())})
    return run


@dataclass
class Index:
    """Random-projection buckets: a vector's bucket is on which side of a threshold its projections fall.

    ``directions`` (dimensions x bits) are drawn by a seed, ``thresholds`` are the sample's medians, ``probes`` is
    how many buckets a query visits, and ``sample_recall`` what that reached on the sample.
    """

    directions: "object"
    thresholds: "object"
    probes: int
    sample_recall: float

    def _margins(self, vecs):
        return vecs @ self.directions - self.thresholds

    def own(self, vecs):
        """Number of each vector's bucket."""
        import numpy as np
        return ((self._margins(vecs) > 0) @ (1 << np.arange(len(self.thresholds)))).astype(np.int64)

    def nearest(self, vecs, probes: int):
        """The buckets that cost least to reach, where a threshold crossed costs its distance."""
        import numpy as np
        bits = len(self.thresholds)
        sides = np.where(np.arange(1 << bits)[:, None] >> np.arange(bits) & 1, 1.0, -1.0)
        fit = self._margins(vecs) @ sides.T
        return np.argsort(-fit, axis=1, kind="stable")[:, :probes]


def fit_index(corpus: DataFrame, k: int = 2, bits: int = 6, sample: int = 2048, target: float = 0.95, seed: int = 42) -> Index:
    """Fit thresholds and the number of probes on at most ``sample`` vectors of the corpus (those of least md5(seed:id)).

    ``probes`` is the least number with which the k nearest neighbours inside the sample are found at rate
    ``target``. A larger corpus has nearer neighbours, so its recall is not expected to be lower; measure it with ``recall``.
    """
    import numpy as np
    from quarry.operators.mixing import sample_n
    rows = sample_n(corpus.select("id", "vec"), sample, "id", seed).orderBy("id").collect()  # at most ``sample`` rows
    vecs = np.array([r["vec"] for r in rows], np.float64)
    if len(rows) <= k:
        return Index(np.zeros((vecs.shape[1] if rows else 1, 0)), np.zeros(0), 1, 1.0)
    directions = np.random.default_rng(seed).normal(size=(vecs.shape[1], bits))
    index = Index(directions, np.median(vecs @ directions, axis=0), 1 << bits, 1.0)
    sims = vecs @ vecs.T
    np.fill_diagonal(sims, -np.inf)
    best, _ = _top_k(sims, np.arange(len(rows)), k)
    order, own = index.nearest(vecs, 1 << bits), index.own(vecs)
    place = np.argsort(order, axis=1)  # at which probe a bucket is visited
    needed = np.take_along_axis(place, own[best], axis=1) + 1
    for probes in range(1, (1 << bits) + 1):
        got = float((needed <= probes).mean())
        if got >= target:
            return Index(directions, index.thresholds, probes, got)
    return index


def knn(queries: DataFrame, corpus: DataFrame, k: int = 2, exclude_self: bool = True,
        chunk_rows: int = DEFAULT_CHUNK_ROWS, index: Index | None = None) -> DataFrame:
    """JN-5: k nearest neighbours by dot product (cosine for unit vectors), exact, or among an index's candidates.

    ``queries`` and ``corpus`` have ``id long`` and ``vec array<float>``. Output ``(query_id, rank,
    neighbour_id)``, rank 1..k, ties broken by the smaller neighbour id. With an ``index`` (of this corpus) a query meets
    only the buckets that it probes, and what it meets is ranked exactly.

    Within a bucket the blocks of both sides are dealt into groups of about EDGE and every query group meets every
    corpus group in one cell: a block is sent once for each group of the other side, not for each of its blocks.
    """
    spark = queries.sparkSession
    packed = "bucket int, ids binary, vecs binary"

    def blocks(df: DataFrame, name: str, probes: int) -> DataFrame:
        path = scratch_path(spark, name)
        b = df.select("id", "vec").mapInArrow(_pack(chunk_rows, index, probes), packed).withColumn("no", F.monotonically_increasing_id())
        b.write.option("compression", "uncompressed").parquet(path)
        return spark.read.schema(b.schema).parquet(path)

    q, c = blocks(queries, "knn-queries", index.probes if index else 0), blocks(corpus, "knn-corpus", 0)
    groups = (q.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / EDGE).alias("n_q"))
              .join(c.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / EDGE).alias("n_c")), "bucket"))  # one row for each bucket

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        d = side.join(groups, "bucket")
        return d.select("bucket", F.pmod(F.xxhash64("no"), F.col(own_n)).alias(own),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)).alias(other), "ids", "vecs")

    cell = ["bucket", "i", "j"]
    local = (dealt(q, "i", "n_q", "j", "n_c").groupBy(*cell).cogroup(dealt(c, "j", "n_c", "i", "n_q").groupBy(*cell))
             .applyInArrow(_best(k, exclude_self), "qid long, nid long, sim double"))
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), F.asc("nid"))
    # Per query at most k rows per cell reach this window.
    merged = local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return merged.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                         F.col("nid").alias("neighbour_id"))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: neighbours of the exact answer (n_neighbours), those that were found (n_found), and their share (recall)."""
    hit = exact.select("query_id", "neighbour_id").join(
        found.select("query_id", "neighbour_id", F.lit(1).alias("_hit")), ["query_id", "neighbour_id"], "left")
    n = hit.agg(F.count(F.lit(1)).alias("n_neighbours"), F.count("_hit").alias("n_found"))
    return n.withColumn("recall", F.try_divide(F.col("n_found").cast("double"), F.col("n_neighbours")))

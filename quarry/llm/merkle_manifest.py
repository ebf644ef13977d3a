"""Merkle manifest of a table: content-addressed records, and inclusion proofs by descent from the root.

Rows are leaves of a tree for each source, the sources' roots are leaves of one more tree. Every node is stored as a
record (digest -> children's digests) and equal nodes are one record. A request names a leaf by its rank; all
requests below one node travel together, as the set of base-16 digits that go on from there, so a step down is a join
of distinct nodes with their records. Each step keeps the children that were not chosen; reversed, these segments are
the proof from the leaf up.

Nulls: a null source is a tree of its own, before all others; null ids come first in their tree. Rows that are equal
in all hashed columns are leaves of their own with equal digests. An empty table has no leaves, no root and no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import Scratch

#: Base-2 logarithm of the children of a node.
BITS = 4
PATH = "array<struct<before: binary, after: binary>>"


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def field(c: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(cols: list[str | Column]) -> Column:
    """SHA-256 of the fields of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, cols)), 256))


def lower_ascii(c: str) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ranks(scratch: Scratch, df: DataFrame, group: list[str], order: list[str], part: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``at`` and ``piece``, pieces with ``first`` and ``base``): the rank of a row in its group is base + at - first.

    Rows are range-partitioned by group and order and numbered as they lie; a piece is a group's share of one
    range, so a group of any size is spread over many tasks and only one row for each piece is summed up.
    """
    keys = [F.col(c).asc_nulls_first() for c in group + order]
    laid = scratch.write(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("at", F.monotonically_increasing_id()), part).withColumn("piece", F.shiftright("at", 33))
    pieces = laid.groupBy(*group, "piece").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*group).orderBy("piece")
    return laid, pieces.withColumn("base", F.sum("rows").over(before) - F.col("rows"))


@dataclass
class Forest:
    """Roots (tree, digest, height), records (digest, children) and the greatest height."""

    roots: DataFrame
    records: DataFrame
    height: int


def build(scratch: Scratch, leaves: DataFrame, part: str) -> Forest:
    """Trees over ``leaves(tree, idx, n, digest)``, where idx counts from 0 to n - 1 in each tree."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    cur, height, roots, records = leaves, 0, [], []
    while True:
        roots.append(cur.where("n = 1").select("tree", "digest", F.lit(height).alias("height")))
        if most <= 1:
            break
        up = (cur.where("n > 1").groupBy("tree", F.shiftright("idx", BITS).alias("idx"), F.col("n").alias("below"))
              .agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run")))
        children = F.transform("run", lambda c: c["digest"])
        up = up.select("tree", "idx", F.shiftright(F.col("below") + ((1 << BITS) - 1), BITS).alias("n"), children.alias("children"))
        digest = F.unhex(F.sha2(F.concat_ws("", F.transform("children", _hex)), 256))
        height += 1
        cur = scratch.write(up.select("tree", "idx", "n", digest.alias("digest"), "children"), f"{part}-{height}")
        records.append(cur.select("digest", "children"))
        most = -(-most // (1 << BITS))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    store = leaves.select("digest", F.array("digest").alias("children")).where(F.lit(False))
    for r in records:
        store = store.unionByName(r)
    store = store.groupBy("digest").agg(F.first("children").alias("children"))  # content-addressed: equal digests, equal children
    return Forest(scratch.write(out, f"{part}-roots"), scratch.write(store, f"{part}-records"), height)


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def descend(scratch: Scratch, forest: Forest, paths: DataFrame, requests: DataFrame, part: str) -> DataFrame:
    """Leaves of ``requests(tree, idx, asked)`` with their digest, path and tree's root: (tree, root, digest, path, asked).

    ``paths(tree, path)`` holds what a tree's path begins with (the segments above its root). ``asked`` is handed
    through; requests are unique by tree and idx.
    """
    digit = F.col("idx").bitwiseAND((1 << BITS) - 1)
    wanted, low = {}, requests
    for level in range(1, forest.height + 1):  # which digits go on below each node
        item = F.struct(digit.alias("digit"), "asked") if level == 1 else F.struct(digit.alias("digit"))
        low = scratch.write(low.groupBy("tree", F.shiftright("idx", BITS).alias("idx")).agg(F.collect_list(item).alias("below")),
                            f"{part}-wanted-{level}")
        wanted[level], low = low, low.select("tree", "idx")
    tops = forest.roots.join(paths, "tree").select("tree", F.lit(0).cast("long").alias("idx"), "digest", F.col("digest").alias("root"),
                                                   "path", "height")
    flat = tops.where("height = 0").join(requests.drop("idx"), "tree").select("tree", "root", "digest", "path", "asked")
    here = None
    for level in range(forest.height, 0, -1):
        start = tops.where(F.col("height") == level).drop("height")
        here = start if here is None else here.unionByName(start)
        step = here.join(wanted[level], ["tree", "idx"]).join(forest.records, "digest").withColumn("one", F.explode("below"))
        at = F.col("one.digit").cast("int")
        segment = F.struct(_joined(F.slice("children", 1, at)).alias("before"),
                           _joined(F.slice("children", at + 2, F.size("children"))).alias("after"))
        step = step.select("tree", "root", (F.shiftleft("idx", BITS) + F.col("one.digit")).alias("idx"),
                           F.get("children", at).alias("digest"), F.concat("path", F.array(segment)).alias("path"),
                           *(["one.asked"] if level == 1 else []))
        here = step if level == 1 else scratch.write(step, f"{part}-at-{level - 1}")
    return flat if here is None else flat.unionByName(here.select(flat.columns))


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of the siblings of a path from the leaf up, left to right in each run."""
    parts = F.transform(F.reverse(path), lambda s: F.concat(_hex(s["before"]), _hex(s["after"])))
    return F.sha2(F.concat_ws("", parts), 256)


def fold(path: Column, leaf: Column) -> Column:
    """Hex root that a leaf (hex) leads to with the siblings of its path."""
    return F.aggregate(F.reverse(path), leaf,
                       lambda d, s: F.sha2(F.concat(_hex(s["before"]), d, _hex(s["after"])), 256))


def manifest(df: DataFrame, id_col: str, source_col: str, leaf: Column, asked: Column) -> DataFrame:
    """Every row's inclusion proof: tree (rank of its source), leaf, subroot and root (digests), path and ``asked``.

    ``leaf`` is the digest of a row, ``asked`` what its request carries.
    """
    scratch = Scratch(df.sparkSession, "merkle")
    slim = df.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), leaf.alias("digest"), asked.alias("asked"))
    laid, pieces = ranks(scratch, scratch.write(slim, "slim"), ["source"], ["id", "digest"], "laid")
    pieces = scratch.write(pieces, "pieces")
    rank = F.col("base") + F.col("at") - F.col("first")
    named, ranges = ranks(scratch, pieces.groupBy("source").agg(F.sum("rows").alias("n")), [], ["source"], "sources")
    named = scratch.write(named.join(ranges, "piece").select(F.col("source").alias("name"), "n", rank.alias("tree")), "trees")
    count = named.count()
    pieces = pieces.join(named, F.col("source").eqNullSafe(F.col("name"))).withColumnRenamed("piece", "own")
    leaves = laid.join(pieces.drop("source"), laid["source"].eqNullSafe(F.col("name")) & (F.col("piece") == F.col("own")))
    leaves = scratch.write(leaves.select("tree", rank.alias("idx"), "n", "digest", "asked"), "leaves")
    scratch.drop("slim")
    scratch.drop("laid")
    trees = build(scratch, leaves.select("tree", "idx", "n", "digest"), "tree")
    one = F.lit(0).cast("long").alias("tree")
    top = build(scratch, trees.roots.select(one, F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "digest"), "top")
    begin = top.roots.select("tree", F.array().cast(PATH).alias("path"))
    above = descend(scratch, top, begin, named.select(one, F.col("tree").alias("idx"), F.struct("tree").alias("asked")), "top")
    above = scratch.write(above.select(F.col("asked.tree").alias("tree"), "path"), "above")
    out = descend(scratch, trees, above, leaves.select("tree", "idx", "asked"), "down")
    root = top.roots.first()  # one row
    return out.select("tree", F.col("digest").alias("leaf"), F.col("root").alias("subroot"),
                      F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"), "path", "asked")


def verified_proofs(df: DataFrame, id_col: str, source_col: str, hashed: list[str], tampered: dict[str, Column], when: Column) -> DataFrame:
    """Hex digests of every row's proof, and whether its content, altered as ``tampered`` says where ``when`` holds, still leads to the root.

    ``hashed`` are the columns of a leaf in order; ``tampered`` maps some of them to what they become.
    """
    altered = F.when(when, leaf_digest([tampered.get(c, F.col(c)) for c in hashed]))
    proofs = manifest(df, id_col, source_col, leaf_digest(hashed), F.struct(F.col(id_col).alias("id"), altered.alias("altered")))
    folded = fold(F.col("path"), F.coalesce(_hex(F.col("asked.altered")), F.col("leaf")))
    out = proofs.select(F.col("asked.id").alias(id_col), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
                        _hex(F.col("root")).alias("root"), "path", "asked")
    return out.select(id_col, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))

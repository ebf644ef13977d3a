import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import kd_sharding as K
from quarry.llm.queries import QUERIES


def check(rows, n_shards, near):
    load, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for group, size, shard, slot in rows:
        load[shard] += size
        slots[shard].append(slot)
        where[group].add(shard)
    assert set(load) <= set(range(n_shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    goal = sum(load.values()) / n_shards
    assert max(load.values()) <= goal * (1 + near) and min(load.get(k, 0) for k in range(n_shards)) >= goal * (1 - near)
    return where


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op10_kd_sharding"](spark, sf).collect()
    raw = {i: (t or "").encode() for i, t in docs.items()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.size == len(raw[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(raw[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
    where = check([(docs[r.doc_id], r.size, r.shard, r.slot) for r in rows], 40, 0.03)
    assert all(len(s) == 1 for s in where.values())


def test_sources_of_a_common_prefix_are_split(spark, tmp_path):
    rows = [(i, f"text {i:04d} of one length", "en", f"common_prefix_{i % 40:02d}", 26) for i in range(2000)]
    rows += [(2000, "text 2000 of one length", "en", None, 26)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    source, spread = {r[0]: r[3] for r in rows}, defaultdict(set)
    for r in QUERIES["op10_kd_sharding"](spark, str(tmp_path)).collect():
        spread[r.shard].add(source[r.doc_id])
    assert len(spread) == 40 and max(map(len, spread.values())) <= 4


def test_hot_group_nulls_and_ties(spark):
    rows = [(i, "hot", 10, None, "x") for i in range(1000)] + [(1000 + i, f"g{i // 2}", 10, float(i % 7), "y") for i in range(2000)]
    rows += [(None, None, None, None, None), (4000, None, 5, 1.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, grp string, size long, x double, shard string").repartition(4)
    out = K.assign(df, F.col("grp"), F.col("size"), {"x": F.col("x")}, 8)
    got = out.join(df.select("doc_id", "grp"), "doc_id").collect()
    where = check([(r.grp, r["size"], r["shard"], r["slot"]) for r in got] + [(None, 0, r["shard"], r["slot"]) for r in out.where("doc_id is null").collect()], 8, 0.05)
    assert len(where["hot"]) > 1  # larger than a shard
    assert all(len(s) == 1 for g, s in where.items() if g not in ("hot", None))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, grp string, size long, x double")
    assert K.assign(df, F.col("grp"), F.col("size"), {"x": F.col("x")}, 4).count() == 0

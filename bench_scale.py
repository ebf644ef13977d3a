"""Scale check: keep-best dedup (AG-1), ledger (AG-3) and weighted interleave (ST-3) on the examples
replicated R times with altered keys, one third of all rows sharing a single hot question; result
comparison (ST-2) on result rows replicated R times, one third of them in a single hot pair.

usage: BENCH_SF_DIR=/root/testdata/sf0.1 REPLICATE=20 python bench_scale.py   (prints one JSON line)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def replicated(spark, sf_dir: str, r: int, parts: int):
    from pyspark.sql import functions as F
    from quarry.operators.mixing import unit_draw
    from quarry.sources import adapters as A
    ex = A.examples(spark, sf_dir)
    # A replicated input would arrive in proportionally more file splits; spread the base rows first.
    rep = ex.repartition(parts).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    new_id = F.col("example_id") * r + F.col("_r")
    hot = unit_draw(7, new_id) < 1.0 / 3
    q = F.when(hot, F.lit("How many orders are there?")) \
        .otherwise(F.concat(F.col("question"), F.lit(" #"), (F.col("_r") % 7).cast("string")))
    return rep.select(new_id.alias("example_id"), q.alias("question"), "sql", "db_id", "context",
                      "source_dataset", "priority",
                      ((F.lit(5) - F.col("priority")) * F.lit(10 ** 13) + new_id).alias("arrival"))


def replicated_results(spark, sf_dir: str, r: int, parts: int):
    """Result rows replicated R times with altered values; a third of them belong to one hot pair."""
    from pyspark.sql import functions as F
    from quarry.operators.mixing import unit_draw
    from quarry.sources import adapters as A
    rr = A.result_rows(spark, sf_dir).repartition(parts) \
        .withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    rid = F.xxhash64("pair_id", "side", "row_values", "_r")
    pair = F.when(unit_draw(11, rid) < 1.0 / 3, F.lit(-1)).otherwise(F.col("pair_id") * r + F.col("_r"))
    vals = F.transform("row_values", lambda v: F.concat(v, F.lit("#"), (F.col("_r") % 50).cast("string")))
    return rr.select(pair.alias("pair_id"), "side", vals.alias("row_values"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    r = int(os.environ.get("REPLICATE", "20"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quarry.operators import dedup as D
    from quarry.operators import mixing as M
    from quarry.session import get_session
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 4)
    ex = replicated(spark, sf_dir, r, int(cpus) * 4)
    n = ex.count()
    weights = {"spider": 0.4, "sqale": 0.3, "gretel": 0.1, "sql_context": 0.15, "know_sql": 0.05}
    from quarry.operators import compare as CMP
    rr = replicated_results(spark, sf_dir, r, int(cpus) * 4)
    n_rr = rr.count()
    jobs = {
        "ST-2": lambda: CMP.compare_results(rr),
        "AG-1": lambda: D.dedup(ex),
        "AG-3": lambda: D.with_ratios(D.ledger(ex)),
        "ST-3": lambda: M.interleave(D.dedup(ex).select("example_id", "source_dataset"), "source_dataset",
                                     "example_id", weights),
    }
    times = {}
    for name, fn in jobs.items():
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "scale_replicated_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": n, "replicate": r, "hot_key_share": 1 / 3,
                      "result_rows": n_rr,
                      "rows_per_sec": {k: round((n_rr if k == "ST-2" else n) / v, 1) for k, v in times.items()}}))


if __name__ == "__main__":
    main()

"""End-to-end workflows on files derived from the smallest driver tables."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.plans import workflows as PL
from quarry.sources import adapters as A
from quarry.sources import jsonl as J


def test_prepare_assemble_evaluate(spark):
    base = tempfile.mkdtemp()
    ex = A.examples(spark, SF_SMALL)
    src_dir = os.path.join(base, "train")
    J.write_jsonl(ex.filter(F.col("source_dataset") != "know_sql")
                  .select(F.col("source_dataset").alias("dataset"), "question", "sql", "db_id", "context",
                          "source_dataset"),
                  src_dir, partition_by=["source_dataset"])
    sources = {s: f"{src_dir}/source_dataset={s}/*.json" for s in A.SOURCE_NAMES}
    cat = A.catalog(spark, SF_SMALL).withColumn(
        "column_names_original",
        F.transform("column_names_original", lambda c: F.array(c["table_idx"].cast("string"), c["name"])))
    cat_path = os.path.join(base, "catalog")
    J.write_jsonl(cat, cat_path)
    out = PL.prepare_corpus(spark, sources, os.path.join(base, "out"), catalog_path=cat_path,
                            catalog_multi_line=False)
    assert out["totals"].first()["spider_enriched"] > 0
    led = out["ledger"].collect()
    assert {r["source_dataset"] for r in led} == {"spider", "sqale", "gretel", "sql_context"}
    for r in led:
        assert r["loaded"] == r["invalid"] + r["duplicate"] + r["kept"]
    kept = spark.read.parquet(out["kept"])
    assert kept.count() == sum(r["kept"] for r in led)

    counts = PL.assemble_training(spark, kept, os.path.join(base, "mix"),
                                  {"spider": 0.4, "sqale": 0.3, "gretel": 0.1, "sql_context": 0.15})
    assert counts["train"] > kept.count() * 0.9

    preds = A.model_text(spark, SF_SMALL).select(F.lit("zero_shot").alias("method"), "example_id",
                                                 "model_text", "gold_sql")
    ev = PL.evaluate_predictions(spark, preds, SF_SMALL, os.path.join(base, "eval"),
                                 ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"])
    m = ev["metrics"].collect()[0]
    assert m["total_examples"] == preds.count()
    assert 0 < m["result_match_count"] <= m["valid_sql_count"]


def test_command_line_prepare(spark, capsys):
    import json as _json
    from quarry.__main__ import main
    base = tempfile.mkdtemp()
    ex = A.examples(spark, SF_SMALL)
    J.write_jsonl(ex.select(F.col("source_dataset").alias("dataset"), "question", "sql", "db_id", "context",
                            "source_dataset"), os.path.join(base, "src"), partition_by=["source_dataset"])
    args = ["prepare", "--out", os.path.join(base, "out")]
    for s in A.SOURCE_NAMES:
        args += ["--source", f"{s}={base}/src/source_dataset={s}/*.json"]
    assert main(args) == 0
    out = _json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["totals"]["total_loaded"] == ex.count()

"""End-to-end workflows: corpus preparation, training-set assembly, evaluation of predictions.

Each pipeline is a chain of the library's DataFrame operators with explicit materialization points: the classified rows
(parsed, enriched, validated, keyed) and the keep-best result are written once (lineage cuts in shared storage, read
back by every downstream output), so raw text is parsed once and a lost executor later on recomputes from those tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.functions import prompts as P
from quarry.functions import text as T
from quarry.operators import catalog as C
from quarry.operators import dedup as D
from quarry.operators import evaluation as E
from quarry.operators import mixing as M
from quarry.plans import execeval as X
from quarry.sources import adapters as A
from quarry.sources import jsonl as J

EXAMPLE_SCHEMA = Ty.StructType([Ty.StructField(n, Ty.StringType())
                                for n in ("dataset", "question", "sql", "db_id", "context")])


def ingest_raw(spark: SparkSession, sources: dict[str, str], out_dir: str, truncate_context: bool = True) -> dict[str, str]:
    """Raw source files (each in its own shape) -> unified JSON Lines, one folder per source; the paths that
    ``prepare_corpus`` takes. Sources whose file is missing are skipped, as are unparsable lines."""
    rows = J.read_raw_sources(spark, sources, truncate_context).select(*J.EXAMPLE_FIELDS, "source_dataset")
    base = os.path.join(out_dir, "unified")
    J.write_jsonl(rows, base, partition_by=["source_dataset"])
    return {name: os.path.join(base, f"source_dataset={name}") for name in sources
            if J.existing_paths(spark, [os.path.join(base, f"source_dataset={name}")])}


def prepare_corpus(spark: SparkSession, sources: dict[str, str], out_dir: str,
                   catalog_path: str | None = None, eval_path: str | None = None,
                   priority: dict[str, int] | None = None, word_boundary: bool = False,
                   catalog_multi_line: bool = True, raw: bool = False) -> dict:
    """Corpus preparation: read sources (missing ones skipped) -> enrich -> validate -> keep-best ->
    per-source outputs, ledger, totals, weights, held-out eval set. Returns paths and small tables.

    With ``raw`` the sources are in their own shapes and are unified first (``ingest_raw``).
    """
    priority = priority or A.SOURCE_PRIORITY
    if raw:
        sources = ingest_raw(spark, sources, out_dir)
    rows = J.read_sources(spark, sources, EXAMPLE_SCHEMA, priority=priority)
    ranks = F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])
    rows = rows.withColumn("priority", F.coalesce(F.element_at(ranks, F.col("source_dataset")), F.lit(0))) \
               .withColumn("context", F.coalesce("context", F.lit(""))) \
               .withColumn("db_id", F.coalesce("db_id", F.lit("")))
    if catalog_path:
        rows = C.enrich_context(rows, C.render_schema(J.read_catalog(spark, catalog_path, catalog_multi_line)))
    else:
        rows = rows.withColumn("enriched", F.lit(False))
    # Lineage cut: parsed, enriched, validated and keyed once; everything below reads this table.
    classified_path, seen = J.scratch_path(spark, "classified"), Observation("classified")
    D.with_keys(D.classify(rows, word_boundary=word_boundary)).observe(seen, F.count_if("enriched").alias("enriched")) \
        .write.parquet(classified_path)
    classified = spark.read.parquet(classified_path)
    enriched_count = int(seen.get["enriched"])
    # Lineage cut: the winners are written once and every output below reads them back.
    kept_path = os.path.join(out_dir, "kept")
    payload = ["dataset", "question", "sql", "db_id", "context", "source_dataset"]
    D.best_of(classified, payload).write.mode("overwrite").partitionBy("source_dataset").parquet(kept_path)
    kept = spark.read.parquet(kept_path)
    clean_path = os.path.join(out_dir, "clean")
    J.write_jsonl(kept.select("question", "sql", "db_id", "context", "source_dataset"), clean_path,
                  partition_by=["source_dataset"])
    led = D.with_ratios(D.ledger_of(classified))
    totals = led.agg(F.sum("loaded").alias("total_loaded"), F.sum("invalid").alias("invalid"),
                     F.sum("duplicate").alias("duplicates"), F.sum("conflicts").alias("conflicts"),
                     F.sum("kept").alias("valid_unique")) \
        .withColumn("spider_enriched", F.lit(enriched_count).cast("long"))
    J.write_jsonl(led.coalesce(1), os.path.join(out_dir, "ledger"))
    J.write_jsonl(totals.coalesce(1), os.path.join(out_dir, "stats"))
    J.write_jsonl(M.weight_table(kept).coalesce(1), os.path.join(out_dir, "weights"))
    out = {"kept": kept_path, "clean": clean_path, "ledger": led, "totals": totals}
    if eval_path:
        ev = J.read_jsonl(spark, eval_path, EXAMPLE_SCHEMA)
        ev = D.classify(ev, word_boundary=word_boundary).filter(F.col("status") != D.INVALID) \
            .select("question", "sql", "db_id", "context", F.lit("spider_dev").alias("source_dataset"))
        J.write_jsonl(ev, os.path.join(out_dir, "eval"))
        out["eval"] = os.path.join(out_dir, "eval")
    return out


def assemble_training(spark: SparkSession, kept: DataFrame, out_dir: str, weights: dict[str, float],
                      template: str = "train_response_only", strategy: str = "all_exhausted",
                      val_fraction: float = 0.02, seed: int = 42, id_col: str = "arrival",
                      max_samples: dict[str, int] | None = None) -> dict:
    """Training-set assembly: split on the original row (ST-4) -> weighted interleave of the train part
    (ST-3) -> template (SC-12) -> length filter (FLT-5) -> JSONL. Shuffle-free up to the write except the
    per-source count behind the mixing quotas. ``max_samples`` limits single sources to a seeded sample. Returns
    the rows written of each part, and under ``<part>_dropped`` those the length filter left out."""
    k = kept.withColumn("_id", F.to_json(F.struct(F.col(id_col))) if dict(kept.dtypes).get(id_col, "")
                        .startswith("struct") else F.col(id_col).cast("string"))
    for name, n in (max_samples or {}).items():
        own = F.col("source_dataset").eqNullSafe(F.lit(name))
        k = k.filter(~own).unionByName(M.sample_n(k.filter(own), n, "_id", seed))
    s = M.split_train_val(k, "_id", val_fraction, seed)
    train = M.interleave(s.filter(F.col("split") == "train"), "source_dataset", "_id", weights, strategy, seed)
    val = s.filter(F.col("split") == "validation")
    outs = {}
    for name, df in (("train", train), ("validation", val)):
        txt = df.select(P.render(template).alias("text"))
        seen = Observation(f"{name}_texts")
        kept_txt = P.keep_long_texts(txt.observe(seen, F.count(F.lit(1)).alias("n")))
        path = os.path.join(out_dir, name)
        outs[name] = J.write_jsonl(kept_txt, path)
        outs[name + "_dropped"] = int(seen.get["n"]) - outs[name]
    return outs


def evaluate_predictions(spark: SparkSession, predictions: DataFrame, sf_dir: str, out_dir: str,
                         tables: list[str], mode: str = "reference", timeout_s: float | None = None) -> dict:
    """Evaluation: extract SQL from model text (SC-4) -> run generated and gold once per distinct text
    over registered views (EX-1) -> compare (ST-2) -> metrics per method and complexity (AG-4/5),
    error taxonomy (AG-6) -> results per method (SNK-3) and a summary (SNK-4).

    ``predictions`` has method, example_id, model_text, gold_sql.
    """
    X.register_views(spark, sf_dir, tables)
    p = predictions.withColumn("generated_sql", T.extract_sql(F.col("model_text"))) \
        .withColumn("_key", F.concat_ws(":", "method", F.col("example_id").cast("string")))
    ev = X.evaluate(spark, p.select("_key", "generated_sql", "gold_sql"), key="_key", mode=mode,
                    timeout_s=timeout_s)
    res = p.select("_key", "method", "example_id").join(ev, "_key").drop("_key") \
        .withColumn("inference_time", F.lit(None).cast("double")).withColumn("num_attempts", F.lit(None).cast("int"))
    res_path = os.path.join(out_dir, "results")
    res.write.mode("overwrite").partitionBy("method").parquet(res_path)
    res = spark.read.parquet(res_path)
    summary = E.metrics(res)
    J.write_jsonl(summary.coalesce(1), os.path.join(out_dir, "summary"))
    return {"results": res_path, "metrics": summary, "by_complexity": E.metrics_by_complexity(res),
            "errors": E.error_taxonomy(res.withColumn("error", F.col("error")))}

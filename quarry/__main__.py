"""Command line for the end-to-end workflows.

    python -m quarry prepare  --source spider=PATH --source sqale=PATH ... --out DIR [--catalog FILE] [--eval FILE] [--raw]
    python -m quarry assemble --kept DIR --out DIR [--weight spider=0.4 ...] [--template train_response_only]
    python -m quarry evaluate --predictions FILE --tables-dir DIR --out DIR [--timeout 60]

Run it with ``spark-submit -m``-style launchers or plainly with ``python -m``; on a cluster the session
created by the launcher is used as is.
"""

from __future__ import annotations

import argparse
import json
import sys


def _pairs(items: list[str], cast=str) -> dict:
    out = {}
    for it in items or []:
        k, _, v = it.partition("=")
        out[k] = cast(v)
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quarry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("prepare", help="validate, enrich, keep-best dedup, ledger, per-source outputs")
    p.add_argument("--source", action="append", required=True, help="name=path (glob allowed)")
    p.add_argument("--out", required=True)
    p.add_argument("--catalog")
    p.add_argument("--catalog-jsonl", action="store_true", help="catalog is JSON Lines, not one array")
    p.add_argument("--eval")
    p.add_argument("--word-boundary", action="store_true")
    p.add_argument("--raw", action="store_true", help="sources are in their own shapes and are unified first")
    a = sub.add_parser("assemble", help="split, weighted interleave, template, length filter")
    a.add_argument("--kept", required=True, help="the 'kept' folder written by prepare")
    a.add_argument("--out", required=True)
    a.add_argument("--weight", action="append", help="name=weight")
    a.add_argument("--template", default="train_response_only")
    a.add_argument("--strategy", default="all_exhausted", choices=["all_exhausted", "first_exhausted"])
    a.add_argument("--val-fraction", type=float, default=0.02)
    a.add_argument("--seed", type=int, default=42)
    e = sub.add_parser("evaluate", help="extract, execute, compare, metrics")
    e.add_argument("--predictions", required=True, help="JSONL: method, example_id, model_text, gold_sql")
    e.add_argument("--tables-dir", required=True, help="folder with one <table>.parquet per table")
    e.add_argument("--tables", default="region,nation,customer,supplier,part,orders,lineitem")
    e.add_argument("--out", required=True)
    e.add_argument("--mode", default="reference", choices=["reference", "strict"])
    e.add_argument("--timeout", type=float, help="seconds per query before it is cancelled")
    args = ap.parse_args(argv)

    from quarry.plans import workflows as PL
    from quarry.session import get_session
    spark = get_session()
    if args.cmd == "prepare":
        out = PL.prepare_corpus(spark, _pairs(args.source), args.out, catalog_path=args.catalog,
                                eval_path=args.eval, word_boundary=args.word_boundary,
                                catalog_multi_line=not args.catalog_jsonl, raw=args.raw)
        print(json.dumps({"kept": out["kept"], "totals": out["totals"].first().asDict()}))
    elif args.cmd == "assemble":
        kept = spark.read.parquet(args.kept)
        # fixed values: the training configuration's weights
        weights = _pairs(args.weight, float) or {"spider": 0.4, "sqale": 0.3, "sql_context": 0.15,
                                                 "gretel": 0.1, "know_sql": 0.05}
        print(json.dumps(PL.assemble_training(spark, kept, args.out, weights, args.template, args.strategy,
                                              args.val_fraction, args.seed)))
    else:
        from pyspark.sql import types as Ty
        schema = Ty.StructType([Ty.StructField("method", Ty.StringType()),
                                Ty.StructField("example_id", Ty.LongType()),
                                Ty.StructField("model_text", Ty.StringType()),
                                Ty.StructField("gold_sql", Ty.StringType())])
        preds = spark.read.schema(schema).json(args.predictions)
        out = PL.evaluate_predictions(spark, preds, args.tables_dir, args.out, args.tables.split(","), args.mode,
                                      args.timeout)
        print(json.dumps([r.asDict() for r in out["metrics"].collect()]))
    return 0


if __name__ == "__main__":
    sys.exit(main())

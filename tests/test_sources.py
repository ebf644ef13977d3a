"""File readers and writers: JSONL scan with bad lines and absent keys, arrival order, catalog arrays."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import catalog as C
from quarry.operators import dedup as D
from quarry.sources import jsonl as J
from quarry.plans.q_corpus import LINE_SCHEMA


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_read_jsonl_skips_bad_lines_and_flags_absent_keys(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "a.jsonl")
    _write(p, ['{"question": "Q1", "sql": "SELECT 1"}', "{bad", '{"sql": "SELECT 2"}',
               '{"question": null, "sql": "SELECT 3"}', ""])
    rows = J.read_jsonl(spark, p, LINE_SCHEMA).orderBy("arrival").collect()
    assert [r["sql"] for r in rows] == ["SELECT 1", "SELECT 2", "SELECT 3"]
    assert [r["missing_field"] for r in rows] == [False, True, False]
    lines = spark.read.text(p)
    assert lines.agg(J.skipped_lines(lines)).first()[0] == 2


def test_read_sources_priority_arrival_and_dedup(spark):
    d = tempfile.mkdtemp()
    _write(os.path.join(d, "low.jsonl"), ['{"question": "Same?", "sql": "SELECT 1"}'])
    _write(os.path.join(d, "high.jsonl"), ['{"question": "same", "sql": "SELECT 22"}'])
    srcs = {"spider": os.path.join(d, "high.jsonl"), "know_sql": os.path.join(d, "low.jsonl"),
            "gretel": os.path.join(d, "absent.jsonl")}
    df = J.read_sources(spark, srcs, LINE_SCHEMA, priority={"spider": 5, "gretel": 3, "know_sql": 1})
    df = df.withColumn("priority", F.when(F.col("source_dataset") == "spider", 5).otherwise(1))
    win = D.dedup(df).collect()
    assert len(win) == 1 and win[0]["source_dataset"] == "spider"
    led = {r["source_dataset"]: r for r in D.ledger(df).collect()}
    assert led["know_sql"]["duplicate"] == 1 and led["know_sql"]["conflicts"] == 1


def test_catalog_json_array_and_render(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "tables.json")
    cat = [{"db_id": "db1", "table_names_original": ["a", "b", "empty"],
            "column_names_original": [[-1, "*"], [0, "x"], [1, "y"], [0, "z"]],
            "column_types": ["text", "int", "text", "real"]}]
    with open(p, "w") as f:
        json.dump(cat, f)
    out = C.render_schema(J.read_catalog(spark, p)).collect()[0]
    assert out["schema"] == "CREATE TABLE a (x int, z real)\nCREATE TABLE b (y text)"


def test_write_jsonl_keeps_nulls_and_counts(spark):
    d = os.path.join(tempfile.mkdtemp(), "out")
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, v string")
    assert J.write_jsonl(df, d) == 2
    text = "".join(open(os.path.join(d, f)).read() for f in os.listdir(d) if f.endswith(".json"))
    assert '"v":null' in text


def test_execution_errors_and_timeout(spark):
    from quarry.plans import execeval as X
    spark.createDataFrame([(1,), (2,)], "a long").createOrReplaceTempView("tiny_t")
    texts = [("q1", "SELECT a FROM tiny_t", "SELECT"), ("q2", "SELECT b FROM tiny_t", "SELECT"),
             ("q3", "SELECT a FROM missing_t", "SELECT"), ("q4", "SELEC a", "UNKNOWN"),
             ("q5", "SELECT 1 / 0", "SELECT"), ("q6", "DROP TABLE tiny_t", "DROP"),
             ("q7", "SELECT sum(hash(a.id, b.id)) FROM range(200000) a JOIN range(200000) b ON a.id % 3 = b.id % 3", "SELECT")]
    status, rows = X.run_texts(spark, texts, parallelism=2, timeout_s=5)
    by = {s[0]: s for s in status}
    assert by["q1"][1] and not by["q2"][1] and by["q2"][2].startswith("UNRESOLVED_COLUMN")
    assert by["q3"][2] == "TABLE_OR_VIEW_NOT_FOUND"
    assert by["q4"][2] == "NOT_A_SELECT" and by["q6"][2] == "NOT_A_SELECT"
    assert not by["q5"][1] and "DIVIDE_BY_ZERO" in (by["q5"][2] + (by["q5"][3] or ""))
    assert by["q7"][2] == "QUERY_TIMEOUT"
    assert sorted(r["row_values"][0] for r in rows.filter("qid = 'q1'").collect()) == ["1", "2"]

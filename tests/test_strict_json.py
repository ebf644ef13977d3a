"""SRC-1 / FLT-2: one strict parse decides skip, absent, null and value; the stream keeps the same accounts."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.sources import jsonl as J
from quarry.streaming import augment_stream as STR

SCHEMA = Ty.StructType([Ty.StructField(n, Ty.StringType()) for n in ("question", "sql")] + [Ty.StructField("example_id", Ty.LongType())])
OK = '{"question": "q", "sql": "s", "example_id": 7}'

# line -> None (skipped) or (question, sql, missing_field)
PROBES = {
    OK: ("q", "s", False), f"  {OK}\t ": ("q", "s", False),
    OK + " trailing": None, OK + OK: None, OK + "," + OK: None, OK + "]": None, OK + "], [1": None, "1],[2": None, OK + "\x00": None,
    "{'question': 'q', 'sql': 's'}": None, '{"question": "a\tb", "sql": "s"}': None, '{"question": "q", "sql": "s",}': None,
    '{"question": NaN, "sql": "s"}': ("NaN", "s", False), '{"question": "q", "sql": "s", "x": [-Infinity, Infinity]}': ("q", "s", False),
    '{"question": "NaN, \\"Infinity\\"", "sql": "s", "x": NaN}': ('NaN, "Infinity"', "s", False), '{"question": "NaN", "x": NaN, "sql": "s}': None,
    "": None, "   ": None, "{bad": None, '{"question": "q", "sql": 01}': None, "﻿" + OK: None, '{"question": "\\x", "sql": "s"}': None,
    '{"sql": "s"}': (None, "s", True), '{"question": null, "sql": "s"}': (None, "s", False), '{"question": "", "sql": null}': ("", None, False),
    "[1, 2]": (None, None, True), "5": (None, None, True), "null": (None, None, True), '"question"': (None, None, True), "NaN": (None, None, True),
    '{"question": 12, "sql": true}': ("12", "true", False), '{"question": {"x": 1}, "sql": [1, "2"]}': ('{"x":1}', '[1,"2"]', False),
    '{"question": "\\u00e9\\n\\/", "sql": "s"}': ("é\n/", "s", False), '{"QUESTION": "q", "sql": "s"}': (None, "s", True),
    json.dumps({"question": "x\"\\" * 50_000, "sql": "NaN"}): ("x\"\\" * 50_000, "NaN", False),
}


def lines_of(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string")


def test_probe_lines(spark):
    for line, want in PROBES.items():  # the expectations hold for Python's parser
        try:
            json.loads(line)
            assert want is not None, line
        except json.JSONDecodeError:
            assert want is None, line
    lines = lines_of(spark, PROBES)
    got = {r.n: (r.question, r.sql, r.missing_field) for r in J.parse_json_lines(lines, SCHEMA).collect()}
    assert got == {i: w for i, w in enumerate(PROBES.values()) if w is not None}
    all_rows = J.parse_json_lines(lines, SCHEMA, keep_skipped=True).collect()
    assert {r.n for r in all_rows if r.skipped} == {i for i, w in enumerate(PROBES.values()) if w is None}
    assert not any(r.missing_field for r in all_rows if r.skipped) and {r.example_id for r in all_rows} == {None, 7}
    kept = [json.loads(x) for x, w in PROBES.items() if w]
    objects = [x for x in kept if isinstance(x, dict) and "question" in x and "sql" in x]
    null = sum(x["question"] is None or x["sql"] is None for x in objects)
    c = J.line_counts(lines).first()
    assert tuple(c) == (len(PROBES) - len(kept), len(kept) - len(objects), null, len(objects) - null)
    assert lines.agg(J.skipped_lines(lines)).first()[0] == c.skipped


def test_repeated_keys(spark):
    lines = lines_of(spark, ['{"question": "a", "question": "b", "sql": "s"}'])
    assert J.parse_json_lines(lines, SCHEMA).count() == 0
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        assert [r.question for r in J.parse_json_lines(lines, SCHEMA).collect()] == ["b"]
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_raw_sources_are_unified_with_their_tags(spark):
    base = tempfile.mkdtemp()

    def put(name, *rows):
        with open(os.path.join(base, name), "w") as f:
            f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        return os.path.join(base, name)
    src = {"spider": put("a", {"question": "q1", "query": "s1", "db_id": "d"}, "{broken"),
           "sqale": put("b", {"question": "q2", "query": "s2", "schema": "x" * 1500}, {"question": "q3", "sql": "s3", "schema": "c"},
                        {"question": "", "query": "s", "schema": ""}),
           "gretel": put("c", {"sql_prompt": "q4", "sql": "s4", "sql_context": "c4"}),
           "sql_context": put("d", {"question": "q5", "answer": "s5", "context": "c5"}),
           "know_sql": put("e", {"question": "q6", "answer": "s6"}), "absent": "/nowhere/x"}
    got = {r.question: (r.dataset, r.source_dataset, r.sql, r.db_id, r.context) for r in J.read_raw_sources(spark, src).collect()}
    assert got == {"q1": ("spider", "spider", "s1", "d", "Database: d"), "q2": ("sqale", "sqale", "s2", "", "x" * 1000),
                   "q3": ("sqale", "sqale", "s3", "", "c"), "q4": ("gretel-synthetic", "gretel", "s4", "", "c4"),
                   "q5": ("sql-context", "sql_context", "s5", "", "c5"), "q6": ("know-sql", "know_sql", "s6", "", "")}
    with pytest.raises(FileNotFoundError):
        J.read_raw_sources(spark, {"spider": "/nowhere/x"})


def stream_lines():
    rows = []
    for i in range(60):
        row = {"example_id": i, "question": f"What is {i}?", "sql": f"SELECT {i} FROM t", "db_id": "d",
               "schema": {"table_names": ["t"], "columns": ["a"]} if i % 3 else None}
        if i % 7 == 0:
            del row["question"]
        if i % 5 == 0:
            row["sql"] = "PRAGMA x" if i % 2 else "EXPLAIN SELECT 1"
        rows.append(json.dumps(row) + (" more" if i % 11 == 0 else ""))
    return [*rows, "", "[1]"]


def test_stream_accounts_equal_the_batch_after_a_restart(spark, monkeypatch):
    base = tempfile.mkdtemp()
    feed, sink, ckpt = (os.path.join(base, x) for x in ("feed", "sink", "ckpt"))
    os.mkdir(feed)
    lines = stream_lines()
    for k in range(4):
        with open(os.path.join(feed, f"{k}.jsonl"), "w") as f:
            f.write("\n".join(lines[k::4]) + "\n")
    write, failed = STR.write_batch(sink, 3), []

    def fails_once(df, batch):
        write(df, batch)
        if batch == 2 and not failed:  # everything is written, but the batch is not committed
            failed.append(batch)
            raise RuntimeError("lost in mid-stream")
    monkeypatch.setattr(STR, "write_batch", lambda *_: fails_once)
    q = STR.start(spark, feed, sink, ckpt, max_files=1)
    with pytest.raises(Exception, match="lost in mid-stream"):
        q.awaitTermination()
    variants = STR.run_available(spark, feed, sink, ckpt, max_files=1)
    assert failed == [2]
    rows = STR.outcomes(spark.read.text(feed))
    batch = rows.agg(*STR.counts()).first()
    assert STR.totals(spark, sink).first() == batch and batch.lines == 62 and min(batch) > 0
    want = STR.passing(rows)
    assert sorted(map(tuple, variants.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    held = STR.read_sink(spark, sink, "quarantine").select("outcome", "reason", "line").collect()
    assert sorted(map(tuple, held), key=str) == sorted(map(tuple, STR.quarantined(rows).collect()), key=str)
    assert {r.outcome for r in held} == {"skipped", "absent", "rejected"}

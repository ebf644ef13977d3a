"""Golden edge rows for the exact-semantics notes (T1..T13, WN-2)."""

from pyspark.sql import functions as F

from quarry.functions import prompts as P
from quarry.functions import text as T
from quarry.operators import augment as AU
from quarry.operators import compare as CMP
from quarry.operators import dedup as D
from quarry.operators import evaluation as E
from quarry.operators import fewshot as FS
from quarry.operators import mixing as M


def one_col(spark, values, fn, name="x"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return [r[0] for r in df.select(fn(F.col(name))).collect()]


def test_t2_dialect_and_type(spark):
    sqls = ["SELECT downloads FROM t", "WITH a AS (SELECT 1) SELECT * FROM a", "-- c\n SELECT 1",
            "EXPLAIN SELECT 1", "PRAGMA x"]
    reasons = one_col(spark, sqls, lambda c: T.validity_reason(c))
    assert reasons[0] == "Contains DuckDB keyword: LOAD"
    assert reasons[1] is None and reasons[2] is None
    assert reasons[3] == "Invalid statement type: UNKNOWN"
    assert reasons[4] == "Contains DuckDB keyword: PRAGMA"
    types = one_col(spark, sqls + ["with x as (select 'update' from t) update t set a=1"], T.statement_type)
    assert types == ["SELECT", "SELECT", "SELECT", "UNKNOWN", "UNKNOWN", "UPDATE"]


def test_t3_keys(spark):
    qs = ["a - b", "a b", "  Hi,  THERE!\t", "hi there", "é", "e", "x²"]
    norm = one_col(spark, qs, T.normalize_question)
    assert norm[0] != norm[1]
    assert norm[0] == "a  b"
    assert norm[2] == norm[3] == "hi there"
    assert norm[4] != norm[5]
    assert norm[6] == "x²"


def _rows(spark, rows):
    return spark.createDataFrame(rows, "example_id long, question string, sql string, source_dataset string, "
                                       "priority int, arrival long")


def test_t3_winner_and_t4_ledger(spark):
    rows = [(1, "Same?", "SELECT aaaaaaaaaaaaaaaaaaaaaaaaaa", "spider", 5, 1),
            (2, "same", "SELECT bbbbbbbbbbbbbbbb", "spider", 5, 2),
            (3, "SAME", "SELECT cccccccccccccccc", "spider", 5, 3),
            (4, "same!", "SELECT d", "sqale", 4, 4)]
    df = _rows(spark, rows)
    win = D.dedup(df).collect()
    assert len(win) == 1 and win[0]["example_id"] == 2 and win[0]["first_arrival"] == 1
    led = {r["source_dataset"]: r for r in D.ledger(df).collect()}
    assert led["spider"]["duplicate"] == 2 and led["sqale"]["duplicate"] == 1
    assert led["spider"]["conflicts"] + led["sqale"]["conflicts"] == 1
    for r in led.values():
        assert r["loaded"] == r["invalid"] + r["duplicate"] + r["kept"]


def test_t1_empty_question_is_duplicate(spark):
    rows = [(1, None, "SELECT 1", "spider", 5, 1), (2, "", "SELECT 1", "spider", 5, 2),
            (3, "q", "PRAGMA x", "spider", 5, 3), (4, "q", "SELECT 1", "spider", 5, 4)]
    led = D.ledger(_rows(spark, rows)).collect()[0]
    assert (led["loaded"], led["invalid"], led["duplicate"], led["kept"]) == (4, 1, 2, 1)


def _cmp(spark, gen, gold, mode="reference"):
    rows = [(1, "gen", r) for r in gen] + [(1, "gold", r) for r in gold]
    df = spark.createDataFrame(rows, "pair_id long, side string, row_values array<string>")
    pairs = spark.createDataFrame([(1,)], "pair_id long")
    return CMP.compare_results(df, pairs, mode).collect()[0]


def test_t5_result_equality(spark):
    assert _cmp(spark, [["1", "2"]], [["2", "1"]])["results_match"]
    assert _cmp(spark, [], [])["results_match"]
    assert _cmp(spark, [["1"]], [["1"], ["1"]])["results_match"]
    assert not _cmp(spark, [["1"]], [["1.0"]])["results_match"]
    assert _cmp(spark, [[None]], [[None]])["results_match"]
    r = _cmp(spark, [["1", None]], [["1", None]])
    assert not r["results_match"] and r["feedback"].startswith("Error normalizing")
    assert _cmp(spark, [["1", None]], [["1", None]], mode="strict")["results_match"]
    r = _cmp(spark, [["a"], ["b"]], [["a"]])
    assert r["feedback"] == "Result count mismatch: generated 2 rows, expected 1 rows"
    assert _cmp(spark, [["a"]], [["b"]])["feedback"] == CMP.MSG_DIFFER


def test_t6_final_attempt(spark):
    rows = [(1, 1, "a", False, None), (1, 2, "b", True, "No"), (1, 3, "c", True, "No"),
            (2, 1, "a", True, "No"), (2, 2, "b", True, "Yes"),
            (3, 1, "a", False, None), (3, 2, "b", False, None)]
    df = spark.createDataFrame(rows, "example_id long, attempt_number int, sql string, is_valid boolean, "
                                     "llm_validation string").withColumn("execution_error", F.lit(None).cast("string"))
    got = {r["example_id"]: r["final_attempt"] for r in E.final_attempt(df).collect()}
    assert got == {1: 2, 2: 2, 3: 2}


def test_t7_metrics(spark):
    empty = spark.createDataFrame([], "is_valid boolean, results_match boolean, inference_time double, "
                                      "num_attempts int")
    r = empty.agg(*E.metric_columns()).collect()[0]
    assert r["total_examples"] == 0 and r["valid_sql_pct"] == 0.0 and r["avg_inference_time"] == 0.0
    two = spark.createDataFrame([(True, None, None, None), (False, True, 4.0, 3)],
                                "is_valid boolean, results_match boolean, inference_time double, num_attempts int")
    r = two.agg(*E.metric_columns()).collect()[0]
    assert r["avg_inference_time"] == 2.0 and r["valid_sql_pct"] == 50.0 and r["avg_attempts"] == 2.0


def test_t8_positions(spark):
    df = spark.createDataFrame([(i * 10,) for i in range(12)], "example_id long")
    shots = FS.positional_shots(df).collect()
    by = {}
    for r in shots:
        by.setdefault(r["example_id"] // 10, []).append((r["shot_rank"], r["shot_example_id"] // 10))
    want = {0: [1, 2], 1: [0], 2: [0, 1], 5: [0, 1], 9: [4, 5]}
    for i, w in want.items():
        assert [p for _, p in sorted(by[i])] == w


def test_t10_extraction(spark):
    texts = ["```sql\nSELECT 1;\n```", "]] select a -- x", "The selected rows", "SELECT 1; ",
             "SELECT 1; -- note", "no query"]
    assert one_col(spark, texts, T.extract_sql) == ["SELECT 1", "select a", "selected rows", "SELECT 1",
                                                    "SELECT 1;", "no query"]


def test_t11_complexity(spark):
    got = one_col(spark, ["SELECT country FROM t", "SELECT a FROM t WHERE x=1", "SELECT * FROM a, b"],
                  lambda c: F.array_join(T.complexity_tags(c), ","))
    assert got == ["simple_select,with_aggregation", "with_where", "simple_select"]


def test_t12_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", " hi "), (1, 2, "assistant", "yo"),
            (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in P.render_chats(df).collect()}
    assert got[1]["text"] == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\n hi [/INST] yo </s>"
    assert got[1]["is_valid"] and not got[2]["is_valid"]
    assert got[3]["text"] == "" and got[3]["n_messages"] == 0


def test_t13_augmentation(spark):
    got = one_col(spark, ["What is the name?"], lambda c: F.array_join(AU.paraphrases(c, 2), "|"))
    assert got == ["Show me the name.|List the is the name."]
    got = one_col(spark, ["SELECT a FROM t ORDER BY a LIMIT 3"], AU.simplify)
    assert got == ["SELECT a FROM t"]


def test_wn2_accept_revert(spark):
    rows = [(1, i, s, f"p{i}") for i, s in enumerate([0.0, 3.0, 2.0, 3.0, 1.0])]
    df = spark.createDataFrame(rows, "run long, epoch long, score double, prompt string")
    out = E.accept_revert(df).orderBy("epoch").collect()
    assert [r["accepted"] for r in out] == [True, True, False, True, False]
    assert [r["current_prompt"] for r in out] == ["p0", "p1", "p1", "p3", "p3"]


def test_t9_mixing_quotas():
    q = M.mix_quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, "all_exhausted")
    assert q == {"a": 1.0, "b": 10.0}
    q = M.mix_quotas({"a": 100, "b": 10, "c": 0}, {"a": 0.5, "b": 0.5, "c": 0.3}, "first_exhausted")
    assert q["b"] == 1.0 and q["a"] == 0.1


def test_t9_interleave_copies(spark):
    rows = [(i, "a") for i in range(100)] + [(1000 + i, "b") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, src string")
    out = M.interleave(df, "src", "id", {"a": 0.5, "b": 0.5})
    counts = {r["src"]: r["count"] for r in out.groupBy("src").count().collect()}
    assert counts == {"a": 100, "b": 100}


def test_top_k_exact_with_ties():
    import numpy as np
    from quarry.operators.fewshot import _top_k
    rng = np.random.default_rng(0)
    sims = rng.integers(0, 4, size=(50, 30)).astype(float)   # many ties
    cid = np.arange(100, 130)
    ids, vals = _top_k(sims, cid, 3)
    for r in range(50):
        want = sorted(zip(-sims[r], cid))[:3]
        assert list(ids[r]) == [i for _, i in want]


def test_t5_strict_numeric_and_bag(spark):
    assert _cmp(spark, [["1"]], [["1.0"]], mode="strict")["results_match"]
    assert not _cmp(spark, [["1"]], [["1"], ["1"]], mode="strict")["results_match"]
    assert _cmp(spark, [["0.30000000000000004", "a"]], [["A ", "0.3"]], mode="strict")["results_match"]


def test_t10_semicolon_before_newline_kept(spark):
    # Python's rstrip(';') does not look past a trailing newline; strip() then removes the newline.
    assert one_col(spark, ["SELECT 1;\n-- x"], T.extract_sql) == ["SELECT 1;"]


def test_t4_missing_field_is_invalid_but_not_invalid_sql(spark):
    rows = [(1, "q1", "SELECT 1", "spider", 5, 1, False), (2, None, "SELECT 2", "spider", 5, 2, True),
            (3, "q3", "PRAGMA x", "spider", 5, 3, False)]
    df = spark.createDataFrame(rows, "example_id long, question string, sql string, source_dataset string, "
                                     "priority int, arrival long, missing_field boolean")
    led = D.ledger(df).collect()[0]
    assert (led["loaded"], led["invalid"], led["missing_field"], led["kept"]) == (3, 2, 1, 1)
    t = D.totals(df).collect()[0]
    assert t["invalid"] == 2 and t["invalid_sql"] == 1


def test_sc17_from_list(spark):
    got = one_col(spark, ["SELECT a FROM customer c, nation n WHERE x = 1",
                          "select c.c_name from customer c join nation n on c.k = n.k",
                          "SELECT s FROM supplier UNION SELECT c FROM customer;"],
                  lambda c: F.array_join(T.from_tables(c), "|"))
    assert got == ["customer c|nation n", "customer c", "supplier|customer"]

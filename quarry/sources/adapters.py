"""Adapters: derive the reference's row shapes from the driver tables.

The driver tables hold no SQL text, so examples, evaluation results, attempts and result rows are
generated from row keys by fixed rules (documented in README.md). Each adapter is a narrow,
shuffle-free projection of one table unless noted; the same rules are written in DuckDB SQL in
``quarry.oracle`` so the oracle reads the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T

# --- fixed values ------------------------------------------------------------------------------

# Source names by number in `source` % 5.
SOURCE_NAMES = ["spider", "sqale", "gretel", "sql_context", "know_sql"]
# Quality priority of each source; anything else is 0.
SOURCE_PRIORITY = {"spider": 5, "sqale": 4, "gretel": 3, "sql_context": 2, "know_sql": 1}
# Evaluation methods by doc_id % 3.
METHODS = ["zero_shot", "few_shot", "self_correction"]
# Error texts of invalid evaluation rows by (doc_id / 5) % 4.
EVAL_ERRORS = ["no such table: x", "no such column: y", 'near "z": syntax error', "out of memory"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priority_of(source_dataset) -> Column:
    """Priority dimension as a literal map lookup (5 fixed rows: no join needed)."""
    m = F.create_map(*[x for k, v in SOURCE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    c = F.col(source_dataset) if isinstance(source_dataset, str) else source_dataset
    return F.coalesce(F.element_at(m, c), F.lit(0))


def _s(c: Column) -> Column:
    return c.cast("string")


# SQL templates by doc_id % 10 (0 plain, 1 COUNT+WHERE, 2 lower-case join, 3 ORDER BY/LIMIT, 4 UNION,
# 5 WITH, 6 PRAGMA, 7 :: cast, 8 EXPLAIN, 9 scalar subquery with trailing ';'). Placeholders:
# {m5} = doc_id % 5, {m7} = doc_id % 7, {m25} = doc_id % 25, {lim} = doc_id % 10 + 1, {th} = (doc_id % 10) * 1000.
SQL_TEMPLATES = [
    "SELECT n_name FROM nation WHERE n_regionkey = {m5}",
    "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = {m7}",
    "select c.c_name, n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey "
    "where n.n_regionkey = {m5}",
    "SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_name LIMIT {lim}",
    "SELECT s_name FROM supplier WHERE s_nationkey = {m25} UNION SELECT c_name FROM customer WHERE c_nationkey = {m25}",
    "WITH t AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) "
    "SELECT COUNT(*) FROM t WHERE total > {th}",
    "PRAGMA table_info(orders)",
    "SELECT o_totalprice::INTEGER FROM orders",
    "EXPLAIN SELECT * FROM lineitem",
    "SELECT c_name FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer);",
]


def sql_template(doc_id: Column) -> Column:
    """SQL text for a document: template by doc_id % 10 with its placeholders filled.

    Kept as one array lookup plus replaces so the expression stays small wherever the optimizer inlines it.
    """
    t = F.element_at(F.array(*[F.lit(x) for x in SQL_TEMPLATES]), (doc_id % 10 + 1).cast("int"))
    for ph, v in (("{m5}", doc_id % 5), ("{m7}", doc_id % 7), ("{m25}", doc_id % 25),
                  ("{lim}", doc_id % 10 + 1), ("{th}", (doc_id % 10) * 1000)):
        t = F.replace(t, F.lit(ph), _s(v))
    return t


def sql_of_text(doc_id: Column, text: Column) -> Column:
    """The template of a document with the text inside it: as a literal (0), a comment (2), a literal of a WITH list (5) or
    a line comment before it (9)."""
    base, k, t = sql_template(doc_id), doc_id % 10, F.coalesce(text, F.lit(""))
    literal = F.replace(t, F.lit("'"), F.lit("''"))
    before = F.when(k == 9, F.concat(F.lit("-- "), F.translate(t, "\r\n", "  "), F.lit("\n"))) \
        .when(k == 5, F.concat(F.lit("WITH n AS (SELECT '"), literal, F.lit("' AS note),"))).otherwise(F.lit(""))
    after = F.when(k == 0, F.concat(F.lit(" AND n_comment <> '"), literal, F.lit("'"))) \
        .when(k == 2, F.concat(F.lit(" /* "), F.replace(t, F.lit("*/"), F.lit("* /")), F.lit(" */"))).otherwise(F.lit(""))
    return F.concat(before, F.when(k == 5, F.substring(base, 5, 1 << 30)).otherwise(base), after)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example rows from documents (one per document).

    Columns: example_id, question, sql, db_id, context, source_dataset, priority, arrival.
    ``arrival`` orders rows as the reference processes them: source priority desc, then position.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    doc = F.col("doc_id")
    src_no = F.substring(F.col("source"), 4, 10).cast("int")
    source_dataset = F.element_at(F.array(*[F.lit(s) for s in SOURCE_NAMES]), src_no % 5 + 1)
    db_id = F.when(doc % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("conv_"), _s(F.floor(doc / 4))))
    out = d.select(
        doc.alias("example_id"),
        F.col("text").alias("question"),
        sql_of_text(doc, F.col("text")).alias("sql"),
        db_id.alias("db_id"),
        source_dataset.alias("source_dataset"),
    )
    out = out.withColumn(
        "context",
        F.when(doc_mod(out, 3) == 0,
               F.concat(F.lit("CREATE TABLE t"), _s(F.col("example_id") % 10), F.lit(" (id INTEGER, name TEXT)")))
        .otherwise(F.concat(F.lit("Database: "), F.col("db_id"))))
    out = out.withColumn("priority", priority_of("source_dataset"))
    return out.withColumn("arrival", (F.lit(5) - F.col("priority")) * F.lit(10 ** 13) + F.col("example_id"))


def doc_mod(df: DataFrame, n: int) -> Column:
    return F.col("example_id") % n


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results derived from examples (one per example)."""
    ex = examples(spark, sf_dir)
    i = F.col("example_id")
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), (i % 3 + 1).cast("int"))
    is_valid = i % 5 != 0
    err = F.element_at(F.array(*[F.lit(e) for e in EVAL_ERRORS]), (F.floor(i / 5) % 4 + 1).cast("int"))
    return ex.select(
        "example_id", "question", "db_id",
        method.alias("method"),
        F.col("sql").alias("gold_sql"),
        F.col("sql").alias("generated_sql"),
        is_valid.alias("is_valid"),
        (is_valid & (i % 2 == 0)).alias("results_match"),
        F.when(i % 11 == 0, F.lit(None).cast("double")).otherwise((i % 100) / 10.0).alias("inference_time"),
        F.when(method == "self_correction", (i % 3 + 1).cast("int")).alias("num_attempts"),
        F.when(~is_valid, err).alias("error"),
        T.complexity_tags(F.col("sql")).alias("complexity"),
    )


def wrapped_sql(example_id: Column, sql: Column) -> Column:
    """Generated text that wraps a SQL text in six ways by the example's number."""
    k = example_id % 6
    return (F.when(k == 0, sql)
            .when(k == 1, F.concat(F.lit("```sql\n"), sql, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("]] "), sql))
            .when(k == 3, F.concat(F.lit("Here is the query you asked for: "), sql))
            .when(k == 4, F.concat(sql, F.lit("\n\nThis query answers the question.")))
            .otherwise(F.concat(sql, F.lit("; "))))


def model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated text wrapping the example SQL in six ways by doc_id % 6."""
    ex = examples(spark, sf_dir)
    return ex.select("example_id", F.col("sql").alias("gold_sql"), wrapped_sql(F.col("example_id"), F.col("sql")).alias("model_text"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-correction attempts: the assistant's turns of each conversation in groups of three (one example
    each, so no turn is lost), every group cut after the first yes.

    Attempt numbers come from a per-conversation window (bounded: one chat), not a global order.
    """
    from pyspark.sql import Window as W
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant") \
        .select("conv_id", "turn", "text")
    w = W.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    is_valid = n % 3 != 0
    nth = F.row_number().over(w) - 1
    verdict = F.when(is_valid, F.when(n % 5 == 0, F.lit("Yes, correct")).otherwise(F.lit("No, wrong")))
    a = c.select(
        (F.col("conv_id") * 1000000 + F.floor(nth / 3)).alias("example_id"),
        (nth % 3 + 1).cast("int").alias("attempt_number"),
        F.col("text").alias("sql"),
        is_valid.alias("is_valid"),
        F.when(~is_valid, F.lit("no such column: y")).alias("execution_error"),
        verdict.alias("llm_validation"),
    )
    yes = T.judge_says_yes(F.col("llm_validation")) & F.col("is_valid")
    a = a.withColumn("_first_yes", F.min(F.when(yes, F.col("attempt_number"))).over(W.partitionBy("example_id")))
    return a.filter(F.col("_first_yes").isNull() | (F.col("attempt_number") <= F.col("_first_yes"))) \
            .drop("_first_yes")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long result table ``(pair_id, side, row_values array<string>)`` from orders, in one scan.

    gold: (status, priority) of the customer's even orders; gen: the same columns swapped,
    upper-cased and space-padded, from even orders when custkey % 3 = 0 else from all orders.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    even = F.col("o_orderkey") % 2 == 0
    gold = F.when(even, F.struct(F.lit("gold").alias("side"),
                                 F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("row_values")))
    gen = F.when(even | (F.col("o_custkey") % 3 != 0), F.struct(
        F.lit("gen").alias("side"),
        F.array(F.concat(F.lit(" "), F.upper("o_orderpriority"), F.lit(" ")),
                F.concat(F.lit(" "), F.upper("o_orderstatus"))).alias("row_values")))
    r = o.select(F.col("o_custkey").alias("pair_id"), F.explode(F.array(gold, gen)).alias("r"))
    return r.filter(F.col("r").isNotNull()).select("pair_id", "r.side", "r.row_values")


def result_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that has a result table (both sides ran): one per ordering customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair_id")).distinct()


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (run, epoch) score from events: run = user_id, epoch = day number, score = avg value (cents exact)."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    epoch = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    g = e.groupBy(F.col("user_id").alias("run"), epoch.alias("epoch")).agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    return g.select(
        "run", "epoch",
        (F.col("cents") / F.col("n") / 100.0).alias("score"),
        F.concat(F.lit("prompt-"), _s(F.col("run")), F.lit("-"), _s(F.col("epoch"))).alias("prompt"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema catalog rows (one per database) in the reference's nested shape, from conversations.

    Database ``conv_<id>``; tables = roles in order of first turn, plus a table ``notes`` that has no
    columns; columns = one per turn (``turn_<n>``, type ``varchar(<length>)``) attached to the role's
    table, after the ``[-1, '*']`` pseudo-column.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "n"))).alias("turns"))
    tables = F.concat(F.array_distinct(F.transform("turns", lambda x: x["role"])), F.array(F.lit("notes")))
    g = g.select(F.concat(F.lit("conv_"), _s(F.col("conv_id"))).alias("db_id"), "turns",
                 tables.alias("table_names_original"))
    cols = F.transform("turns", lambda x: F.struct(
        (F.array_position(F.col("table_names_original"), x["role"]) - 1).cast("int").alias("table_idx"),
        F.concat(F.lit("turn_"), _s(x["turn"])).alias("name")))
    types = F.transform("turns", lambda x: F.concat(F.lit("varchar("), _s(x["n"]), F.lit(")")))
    star = F.array(F.struct(F.lit(-1).alias("table_idx"), F.lit("*").alias("name")))
    return g.select(
        "db_id", "table_names_original",
        F.concat(star, cols).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), types).alias("column_types"))


def questions_aug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Augmentable examples from part: question by partkey % 5, SQL by partkey % 4, schema by partkey % 3."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("p_partkey")
    q = (F.when(k % 5 == 0, F.concat(F.lit("What is the price of "), F.col("p_name"), F.lit("?")))
         .when(k % 5 == 1, F.concat(F.lit("How many "), F.col("p_name"), F.lit(" are there?")))
         .when(k % 5 == 2, F.concat(F.lit("Find "), F.col("p_name"), F.lit(".")))
         .when(k % 5 == 3, F.concat(F.lit("List all "), F.col("p_name"), F.lit(".")))
         .otherwise(F.concat(F.lit("Which "), F.col("p_brand"), F.lit("?"))))
    sql = (F.when(k % 4 == 0, F.concat(F.lit("SELECT price FROM product WHERE name = '"), F.col("p_name"), F.lit("'")))
           .when(k % 4 == 1, F.concat(F.lit("SELECT COUNT(*) FROM order WHERE product_id = "), _s(k)))
           .when(k % 4 == 2, F.concat(F.lit("SELECT name FROM customer ORDER BY name LIMIT "), _s(F.col("p_size"))))
           .otherwise(F.lit("SELECT p.name, o.qty FROM product p JOIN order o ON p.id = o.product_id "
                            "ORDER BY o.qty DESC;")))
    schema_t = "struct<table_names:array<string>,columns:array<string>>"
    schema = (F.when(k % 3 == 0, F.struct(F.array(F.lit("product"), F.lit("Order")).alias("table_names"),
                                         F.array(F.lit("name"), F.lit("price"), F.lit("qty")).alias("columns")))
              .when(k % 3 == 1, F.struct(F.array(F.lit("customer")).alias("table_names"),
                                        F.array().cast("array<string>").alias("columns")))
              .otherwise(F.lit(None).cast(schema_t)))
    return p.select(k.alias("example_id"), q.alias("question"), sql.alias("sql"),
                    F.lit("shop").alias("db_id"), schema.cast(schema_t).alias("schema"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))

"""Schema catalog: rendering (AG-12) and lookups (JN-1, JN-2, JN-3).

The catalog holds one row per database with nested arrays, so rendering is a row-local projection
with higher-order functions — no explode, no shuffle. Lookups are plain equi-joins: Spark broadcasts the
catalog when its size at run time allows it, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_catalog(df: DataFrame) -> DataFrame:
    """SRC-3 shape fix: ``column_names_original`` pairs ``[idx, name]`` (read by JSON as array<string>)
    become ``struct<table_idx:int, name:string>``."""
    col_t = df.schema["column_names_original"].dataType.elementType
    if col_t.typeName() == "array":
        pairs = F.transform("column_names_original", lambda x: F.struct(
            x[0].cast("int").alias("table_idx"), x[1].alias("name")))
        df = df.withColumn("column_names_original", pairs)
    return df


def render_schema(catalog: DataFrame) -> DataFrame:
    """AG-12: ``(db_id, schema)`` — ``CREATE TABLE t (c ty, ...)`` per table in column order, newline-joined
    in table order. Tables without columns vanish; the ``*`` pseudo-column (table -1) matches no table."""
    cat = normalize_catalog(catalog)
    cols = F.arrays_zip(F.col("column_names_original").alias("c"), F.col("column_types").alias("t"))
    tables = F.transform("table_names_original", lambda t, i: F.struct(
        t.alias("name"),
        F.filter(cols, lambda z: z["c"]["table_idx"] == i).alias("cols")))
    tables = F.filter(tables, lambda t: F.size(t["cols"]) > 0)
    lines = F.transform(tables, lambda t: F.concat(
        F.lit("CREATE TABLE "), t["name"], F.lit(" ("),
        F.array_join(F.transform(t["cols"], lambda z: F.concat(z["c"]["name"], F.lit(" "), z["t"])), ", "),
        F.lit(")")))
    return cat.select("db_id", F.array_join(lines, "\n").alias("schema"))


# Rows without a database ('') match none: as a null key they stay out of the shuffle by key.
def _key() -> Column:
    return F.nullif(F.col("db_id"), F.lit(""))


def _with_schema(examples: DataFrame, schema_text: DataFrame) -> DataFrame:
    """Left join on the database; Spark chooses the strategy from the sides' sizes at run time."""
    s = schema_text.select(F.col("db_id").alias("_known"), F.col("schema").alias("_schema"))
    return examples.join(s, _key() == F.col("_known"), "left").drop("_known")


def _known(databases: DataFrame) -> DataFrame:
    return databases.select(F.col("db_id").alias("_known")).distinct()


def enrich_context(examples: DataFrame, schema_text: DataFrame, only_source: str | None = "spider",
                   source: str = "source_dataset") -> DataFrame:
    """JN-1: replace ``context`` with the database's schema text when db_id is non-empty, the context lacks
    ``CREATE TABLE`` (case-sensitive) and the database is known. Adds ``enriched`` (boolean)."""
    j = _with_schema(examples, schema_text)
    cond = (F.col("db_id") != "") & ~F.col("context").contains("CREATE TABLE") & F.col("_schema").isNotNull()
    if only_source is not None:
        cond = cond & (F.col(source) == only_source)
    return j.withColumn("enriched", F.coalesce(cond, F.lit(False))) \
            .withColumn("context", F.when(F.col("enriched"), F.col("_schema")).otherwise(F.col("context"))) \
            .drop("_schema")


FALLBACK_POLICIES = {
    # catalog, else the row's context, else "Database: <db_id>"
    "context_then_db": lambda ctx, db: F.coalesce(ctx, F.concat(F.lit("Database: "), db)),
    # catalog, else "Database: <db_id>"
    "db": lambda ctx, db: F.concat(F.lit("Database: "), db),
    # catalog, else "No Schema"
    "none": lambda ctx, db: F.lit("No Schema"),
}


def lookup_schema(examples: DataFrame, schema_text: DataFrame, policy: str = "context_then_db") -> DataFrame:
    """JN-2: ``schema`` column from the catalog with a fallback policy. A present but empty context stays ''."""
    fb = FALLBACK_POLICIES[policy]
    ctx: Column = F.col("context") if "context" in examples.columns else F.lit(None).cast("string")
    j = _with_schema(examples, schema_text)
    return j.withColumn("schema", F.coalesce(F.col("_schema"), fb(ctx, F.col("db_id")))).drop("_schema")


def available(examples: DataFrame, databases: DataFrame) -> DataFrame:
    """JN-3: keep examples whose database is available (left semi join)."""
    return examples.join(_known(databases), _key() == F.col("_known"), "left_semi")


def unavailable(examples: DataFrame, databases: DataFrame) -> DataFrame:
    """JN-3 warning list: examples whose database is missing (left anti join)."""
    return examples.join(_known(databases), _key() == F.col("_known"), "left_anti")

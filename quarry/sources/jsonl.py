"""JSON Lines sources and sinks (SRC-1, SRC-2, SRC-3, SRC-4, SRC-5, SNK-1..4).

Lines are read as text and parsed once, strictly, into a VARIANT; that one value decides whether a line is
skipped, whether a key is absent or explicitly null, and what every field holds (T1).
Arrival order — needed for the keep-best tie-break — is (source rank, file path, split start,
row index inside the split), all taken from the scan itself, so it is stable under any parallelism.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# Unified Example schema.
EXAMPLE_FIELDS = ["dataset", "question", "sql", "db_id", "context"]

# --- fixed values: field mapping of the five public source shapes onto the Example schema ----------
# target field -> (source field(s) tried in order, default when absent)
SOURCE_MAPPINGS = {
    "spider": {"question": (["question"], None), "sql": (["query"], None), "db_id": (["db_id"], None),
               "context": ([], "db")},
    "sqale": {"question": (["question"], None), "sql": (["query", "sql"], None), "db_id": ([], ""),
              "context": (["schema"], None)},
    "gretel": {"question": (["sql_prompt"], None), "sql": (["sql"], None), "db_id": ([], ""),
               "context": (["sql_context"], None)},
    "sql_context": {"question": (["question"], None), "sql": (["answer"], None), "db_id": ([], ""),
                    "context": (["context"], None)},
    "know_sql": {"question": (["question"], ""), "sql": (["answer"], ""), "db_id": ([], ""),
                 "context": (["context"], "")},
}
# Value of ``dataset`` that each source's rows carry.
SOURCE_TAGS = {"spider": "spider", "sqale": "sqale", "gretel": "gretel-synthetic", "sql_context": "sql-context", "know_sql": "know-sql"}
CONTEXT_MAX_CHARS = 1000


# A string, or text outside strings, or a quote that is never closed: joined, the matches give back the line.
# Possessive repetition does not recurse, so strings of any length and number of escapes take no stack.
_JSON_PARTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'
_JSON_CONSTANT = r"-?Infinity|NaN"


def strict_json(line) -> Column:
    """A line as VARIANT, or null if it is not exactly one JSON value (white space around it allowed).

    As in the reference's parser, the bare constants ``NaN``, ``Infinity`` and ``-Infinity`` are values (they become
    strings) and trailing text, a second value, single quotes and raw control characters make a line unparsable. The
    line is parsed as first element of an array whose second one is the line's own digest, which shows that
    nothing else stood between them. A line in which one object has a key twice is unparsable, unless
    ``spark.sql.variant.allowDuplicateKeys`` is set (the last one counts then, as in the reference).
    """
    c = F.col(line) if isinstance(line, str) else line
    parts = F.transform(F.regexp_extract_all(c, F.lit(_JSON_PARTS), F.lit(0)),
                        lambda t: F.when(t.startswith('"'), t).otherwise(F.regexp_replace(t, _JSON_CONSTANT, '"$0"')))
    plain = F.when(F.contains(c, F.lit("NaN")) | F.contains(c, F.lit("Infinity")), F.array_join(parts, "")).otherwise(c)
    mark = F.md5(c)
    both = F.try_parse_json(F.concat(F.lit("["), plain, F.lit(',"'), mark, F.lit('"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == mark, F.try_variant_get(both, "$[0]", "variant"))


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def has_key(value, name: str) -> Column:
    """Whether a VARIANT is an object with that key; an explicit null counts, an array or scalar has no keys."""
    return F.try_variant_get(value, _path(name), "variant").isNotNull()


def key_is_null(value, name: str) -> Column:
    """Whether the key is there and explicitly null."""
    return F.coalesce(F.is_variant_null(F.try_variant_get(value, _path(name), "variant")), F.lit(False))


def parse_json_lines(lines: DataFrame, schema: Ty.StructType, value: str = "value",
                     required: tuple[str, ...] = ("question", "sql"), keep_skipped: bool = False) -> DataFrame:
    """SRC-1 + FLT-2 over a DataFrame of text lines.

    Returns parsed rows (unparsable lines dropped) with ``missing_field`` = a required key is absent. A field whose
    value does not fit its type is null; numbers, booleans, arrays and objects in string fields become text.
    Extra columns of ``lines`` (for example the arrival columns) are carried along. With ``keep_skipped`` the
    unparsable lines stay, with null fields and ``skipped`` = true, so that one scan serves rows and accounts.
    """
    carry = [c for c in lines.columns if c != value]
    parsed = lines.select(*carry, strict_json(value).alias("_json"))
    if not keep_skipped:
        parsed = parsed.filter(F.col("_json").isNotNull())
    missing = F.lit(False)
    for r in required:
        missing = missing | ~has_key("_json", r)
    fields = [F.try_variant_get("_json", _path(f.name), f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    flags = [F.col("_json").isNull().alias("skipped")] if keep_skipped else []
    return parsed.select(*carry, *fields, (F.col("_json").isNotNull() & missing).alias("missing_field"), *flags)


def skipped_lines(lines: DataFrame, value: str = "value") -> Column:
    """Aggregate expression: number of unparsable (skipped) lines, including empty ones."""
    return F.count_if(strict_json(value).isNull())


def line_counts(lines: DataFrame, value: str = "value", required: tuple[str, ...] = ("question", "sql")) -> DataFrame:
    """FLT-2 accounts of text lines: skipped, missing (a required key is absent), null (one is explicitly null), complete."""
    v = F.col("_json")
    parsed = lines.select(strict_json(value).alias("_json"))
    absent, null = F.lit(False), F.lit(False)
    for r in required:
        absent, null = absent | ~has_key(v, r), null | key_is_null(v, r)
    ok = v.isNotNull()
    return parsed.select(ok.alias("ok"), absent.alias("absent"), null.alias("null")).agg(
        F.count_if(~F.col("ok")).alias("skipped"), F.count_if(F.col("ok") & F.col("absent")).alias("missing"),
        F.count_if(F.col("ok") & ~F.col("absent") & F.col("null")).alias("null_field"),
        F.count_if(F.col("ok") & ~F.col("absent") & ~F.col("null")).alias("complete"))


def read_lines(spark: SparkSession, path: str | list[str], source_rank: int = 0) -> DataFrame:
    """Read text lines with an explicit arrival: struct(source_rank, file, split start, index in split)."""
    df = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    idx = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("arrival", F.struct(F.lit(source_rank).alias("rank"), F.col("_file"),
                                             F.col("_block"), idx.alias("idx"))).drop("_file", "_block")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: Ty.StructType,
               source_rank: int = 0, required: tuple[str, ...] = ("question", "sql")) -> DataFrame:
    """SRC-1: JSONL scan that silently skips unparsable lines, with FLT-2 flags and arrival order."""
    return parse_json_lines(read_lines(spark, path, source_rank), schema, required=required)


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """SRC-4: keep only paths (or globs) that match at least one file, using the cluster's file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        st = fs.globStatus(hp)
        if st is not None and len(st) > 0:
            out.append(p)
    return out


def read_sources(spark: SparkSession, sources: dict[str, str], schema: Ty.StructType,
                 priority: dict[str, int] | None = None) -> DataFrame:
    """SRC-4: read each named source present on storage (skip missing), tag it (PRJ-2) and union them.

    Sources are ranked by priority (high first), which becomes the first arrival component (SO-6).
    All missing -> error.
    """
    priority = priority or {}
    names = sorted(sources, key=lambda n: -priority.get(n, 0))
    frames = []
    for rank, name in enumerate(names):
        found = existing_paths(spark, [sources[name]])
        if not found:
            continue
        frames.append(read_jsonl(spark, found, schema, source_rank=rank)
                      .withColumn("source_dataset", F.lit(name)))
    if not frames:
        raise FileNotFoundError("no source found: " + ", ".join(sources.values()))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def raw_schema(name: str) -> Ty.StructType:
    """The fields of a raw source that its mapping reads, as strings."""
    fields = list(dict.fromkeys(f for srcs, _ in SOURCE_MAPPINGS[name].values() for f in srcs))
    return Ty.StructType([Ty.StructField(f, Ty.StringType()) for f in fields])


def unify_source(df: DataFrame, name: str, truncate_context: bool = True) -> DataFrame:
    """SRC-2: map one source shape onto ``dataset, question, sql, db_id, context`` (+ carried columns).

    ``dataset`` is the tag that the source's rows carry, ``source_dataset`` the source's short name. SQaLe rows with
    an empty question or SQL are dropped (FLT-1) and its context is cut to 1,000 characters (PRJ-1).
    """
    mapping = SOURCE_MAPPINGS[name]
    cols = set(df.columns)

    def pick(field: str) -> Column:
        srcs, default = mapping[field]
        present = [F.col(s) for s in srcs if s in cols]
        if field == "context" and default == "db":
            return F.concat(F.lit("Database: "), F.coalesce(F.col("db_id"), F.lit("")))
        if not present:
            return F.lit(default if default is not None else "")
        c = present[0] if len(present) == 1 else F.coalesce(*present)
        return F.coalesce(c, F.lit(default)) if default is not None else c

    carry = [c for c in df.columns if c in ("arrival", "example_id")]
    out = df.select(F.lit(SOURCE_TAGS[name]).alias("dataset"), *[pick(f).alias(f) for f in EXAMPLE_FIELDS[1:]],
                    F.lit(name).alias("source_dataset"), *carry)
    if name == "sqale":
        out = out.filter((F.length("question") > 0) & (F.length("sql") > 0))
        if truncate_context:
            out = out.withColumn("context", F.substring("context", 1, CONTEXT_MAX_CHARS))
    return out


def read_raw_sources(spark: SparkSession, sources: dict[str, str], truncate_context: bool = True) -> DataFrame:
    """SRC-2 over files: each raw source present on storage is parsed strictly with its own fields and unified.

    Sources whose path is missing are skipped; all missing is an error. Unparsable lines are dropped.
    """
    out = None
    for name, path in sources.items():
        if not existing_paths(spark, [path]):
            continue
        rows = unify_source(read_jsonl(spark, path, raw_schema(name), required=()).drop("missing_field"), name, truncate_context)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError("no source found: " + ", ".join(sources.values()))
    return out


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC-3: schema catalog (one JSON array of databases, or JSON Lines with ``multi_line=False``).

    A JSON array file is not splittable (one task parses it); large catalogs should be JSON Lines,
    which split like any text input."""
    from quarry.operators.catalog import normalize_catalog
    df = spark.read.option("multiLine", multi_line).json(path)
    return normalize_catalog(df)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> int:
    """SNK-1/2/3: JSON Lines write keeping null fields; returns the row count observed during the write.

    With ``partition_by`` the rows are first rebalanced by those columns, so a value's files follow its size (adaptive
    execution splits a large value and joins small ones) and not the number of tasks before.
    """
    from pyspark.sql import Observation
    obs = Observation("rows_written")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)
    return int(obs.get["n"])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for derived outputs."""
    import uuid
    from quarry.session import checkpoint_dir
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")

"""The registered queries of the subpackage: each applies one operator to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_substring_dedup", sql.SUBSTRING)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.substring_dedup import remove_repeated
    out = remove_repeated(_documents(spark, sf_dir), "doc_id", "text", width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_quality_rules", sql.QUALITY)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import quality_rules as Q
    from quarry.llm.shared import Scratch
    rules, scratch = Q.Rules(), Scratch(spark, "quality")
    docs = Q.measure(_documents(spark, sf_dir), "text")
    measured = scratch.write(docs.select("doc_id", "lang", "source", "quality_rules"), "measured")
    sketch = scratch.write(Q.sketches(measured, "lang", "source", rules), "sketches")
    limits = scratch.write(Q.fences(sketch, rules), "fences")
    out = Q.judge(measured, limits, "lang", "source", rules)
    return out.select("doc_id", *(f"quality_rules.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def source_targets(docs: DataFrame) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last, for weights 5, 2, 1 in turn; ``docs`` has source and size."""
    from quarry.llm.source_mix import capped_targets
    rows = sorted(((r["source"], int(r["size"] or 0)) for r in docs.groupBy("source").agg(F.sum("size").alias("size")).collect()),
                  key=lambda r: (r[0] is None, r[0] or ""))
    targets = capped_targets([s for _, s in rows], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(rows))])
    return [(name, size, t) for (name, size), t in zip(rows, targets)]


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies of every document, for the sizes and weights of the mix contract."""
    from quarry.llm.shared import Scratch, n_words
    from quarry.llm.source_mix import mix
    spark = docs.sparkSession
    sized = Scratch(spark, "sized").write(docs.select("doc_id", "source", n_words("text").alias("size")), "docs")
    goals = source_targets(sized)
    out = mix(sized.withColumn("sources", F.array("source")), {s: t for s, _, t in goals}, "doc_id", "size", "sources")
    known = spark.createDataFrame(goals, "name string, source_size long, target double")
    return (out.join(F.broadcast(known), F.col("members")[0].eqNullSafe(F.col("name")))
            .select("doc_id", "size", "source_size", "target", "copies"))


@query("op2_source_mix")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def ranked(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the place of each value among the column's distinct ones, null for null."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("__value")).distinct()
    places = values.withColumn(out, F.row_number().over(Window.orderBy("__value")))  # one row for each value
    return df.join(F.broadcast(places), F.col(col) == F.col("__value"), "left").drop("__value")


@query("op10_kd_sharding")
def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.kd_sharding import assign
    text = F.coalesce(F.encode("text", "utf-8"), F.lit("").cast("binary"))
    docs = ranked(ranked(_documents(spark, sf_dir), "lang", "lang_rank"), "source", "source_rank").select(
        "doc_id", text.alias("raw"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.col("lang_rank").cast("double").alias("lang"), F.col("source_rank").cast("double").alias("source"))
    # equal texts are known by their digest, from which the checksum is recovered after the join
    key = F.concat(F.unhex(F.md5("raw")), F.unhex(F.lpad(F.hex("crc"), 8, "0")))
    from quarry.llm.shared import Scratch
    slim = Scratch(spark, "sharding").write(docs.select("doc_id", "size", key.alias("grp"), "crc", "lang", "source"), "docs")
    out = assign(slim.withColumn("both", F.struct("doc_id", "crc")), F.col("grp"), F.col("size"),
                 {"size": F.log2("size"), "lang": F.col("lang"), "source": F.col("source")}, 40, id_col="both")
    return out.select("both.doc_id", "size", F.col("both.crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                      F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op9_dart_minhash")
def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.dart_minhash import near_duplicates
    return near_duplicates(_documents(spark, sf_dir), "doc_id", "text")


@query("op8_line_dedup", sql.LINES)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.line_dedup import remove_repeated_lines
    out = remove_repeated_lines(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", min_lines=2, min_words=20)
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed",
                      F.sha2(F.coalesce("line_dedup.kept_text", F.lit("")), 256).alias("kept_sha256"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    from quarry.llm.harmonic_packing import pack
    return pack(docs, "doc_id", "text", tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


def packed_digest(docs: DataFrame) -> DataFrame:
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_harmonic_packing")
def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(_documents(spark, sf_dir))


@query("op7_wavelet_tokens")
def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quarry.llm.shared import Scratch
    from quarry.llm.wavelet_tokens import FILE_SCHEMA, read_documents, write_files
    path = Scratch(spark, "wavelet").path("files")
    write_files(_documents(spark, sf_dir), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    out = read_documents(spark.read.schema(FILE_SCHEMA).parquet(path))
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_embedding_join")
def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.embedding_join import near_duplicates
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", cosine=0.9)


@query("op6_hidden_markov_lm")
def op6_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.hmm_lm import score
    return score(_documents(spark, sf_dir), "doc_id", "text", states=8, iterations=6)


@query("op13_merkle_manifest", sql.MERKLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.merkle_manifest import lower_ascii, verified_proofs
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return verified_proofs(_documents(spark, sf_dir), "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"],
                           {"text": lower_ascii("text")}, chosen)


#: (verdict, host, path) of the URL contract.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op12_url_rules", sql.URLS)
def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels speak of pages by their number: a page is bad if it is labelled toxic or of quality 0."""
    from quarry.llm.url_rules import judge
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null or quality is not null")
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", labels.select(F.col("doc_id").alias("id"), bad.alias("bad")),
                 URL_RULES, min_rows=25, min_support=0.001, min_confidence=0.5)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    from quarry.llm.token_alignment import align
    out = align(_documents(spark, sf_dir), "doc_id", "text", P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

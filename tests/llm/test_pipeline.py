"""Each stage of the pipeline against a brute-force version on its predecessor's output."""
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quarry.llm.shared import Scratch
from quarry.llm.source_mix import capped_targets
from tests.llm import test_dart_minhash, test_line_dedup, test_quality_rules, test_tokens
from tests.llm.common import words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    docs, scratch = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark, "test-pipeline")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.write(stage(spark, docs, SF), str(k))
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "source mix", "packing"]
    assert all(df.columns == COLUMNS and df.schema == outputs[0].schema for df in outputs[:5])


def test_quality(outputs):
    before, after = texts(outputs[0]), texts(outputs[1])
    assert set(after.items()) <= set(before.items())
    failed = {i for i, t in before.items() if test_quality_rules.base(t)[-1]}
    assert not failed & set(after) and len(after) >= 0.8 * (len(before) - len(failed))


def test_lines(outputs):
    want = {i: t for i, (n, gone, t) in test_line_dedup.brute(list(texts(outputs[1]).items()), 2).items() if gone == 0 or gone < n}
    assert texts(outputs[2]) == want
    assert all(r.n_chars == len(r.text) for r in outputs[2].collect())


def test_near_duplicates(outputs):
    before = texts(outputs[2])
    keep = {i for i, (_, kept) in test_dart_minhash.brute(before).items() if kept}
    assert texts(outputs[3]) == {i: before[i] for i in keep}


def test_mix(outputs):
    rows = {r.doc_id: r for r in outputs[3].collect()}
    copies = Counter(r.doc_id for r in outputs[4].collect())
    assert set(copies) <= set(rows) and max(copies.values()) <= 3
    size, taken = defaultdict(int), defaultdict(int)
    for i, r in rows.items():
        size[r.source] += len(words(r.text))
        taken[r.source] += copies[i] * len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, s))
    for s, target in zip(order, capped_targets([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])):
        assert abs(taken[s] - target) <= 0.2 * target  # ten documents a source
    assert sum(taken.values()) >= 0.9 * sum(size.values())


def test_packing(outputs):
    docs, copies = texts(outputs[4]), Counter(r.doc_id for r in outputs[4].collect())
    ids = test_tokens.reference(test_tokens.WORDS, docs, 1)
    total, places = Counter(), defaultdict(list)
    for r in outputs[5].collect():
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert test_tokens.crc(part) == r.ids_crc32 and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        total[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert total == {i: copies[i] * len(ids[i]) for i in copies}
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048


def test_run_and_edges(spark, tmp_path):
    """run() over documents with nulls in every column, repeated rows and clashing extra columns."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30 + i)), "en", "s1", 1, 5, "k") for i in range(40)]
    rows += [(None, " ".join(f"n{j}" for j in range(40)), None, None, None, None, None), (50, None, "en", None, 0, 1, "k"), (51, "", "en", "s1", 0, 1, "k"),
             rows[3], (60, rows[5][1], "en", "s2", 1, 2, "q"), (61, rows[6][1] + " end", "en", "s2", 1, 2, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, key string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in rows} and not {50, 51, 60, 61} & {r.doc_id for r in out}
    assert all(zlib.crc32(b"") <= r.ids_crc32 and r.length > 0 for r in out)
    spark.createDataFrame([], df.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

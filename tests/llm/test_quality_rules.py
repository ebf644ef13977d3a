import re
from collections import Counter

from quarry.llm import quality_rules as Q
from quarry.llm.queries import QUERIES
from tests.llm.common import EDGE, documents


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cov = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    n = len(cov)
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, n, len(w) < 10 or 100 * n > 20 * len(w))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures(spark):
    rows = [*EDGE, (20, "a b c d e f a b c d e x a b c d e f"), (21, "p q r s t\n<b>\np q r s t\n\n<b>|"), (None, "z")]
    got = {r.doc_id: tuple(r.quality_rules[c] for c in NAMES) for r in Q.measure(documents(spark, rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op5_quality_rules"](spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in NAMES) for r in rows} == {i: base(t) for i, t in docs.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in rows}
    failed = {r.doc_id for r in rows if r.base_failed}
    good = [i for i, q in labels.items() if q == 1 and i not in failed]
    assert sum(kept[i] for i in good) >= 0.99 * len(good)
    assert not any(kept[i] for i, q in labels.items() if q == 0)


def test_fences_follow_the_source_and_sketches_merge(spark):
    """The same text passes where its symbols are usual and fails where they are not."""
    clean = "the quick brown fox jumps over the lazy dog while it rains on and on today {}"
    odd = "a# b# c# d# e# f# g# h# i# j# k# l# m# n# o# {}"
    rows = [(i, clean.format(i), "en", "plain") for i in range(100)] + [(i, odd.format(i), "en", "marked") for i in range(100, 200)]
    rows += [(900, odd.format(1), "en", "plain"), (901, odd.format(2), "en", "marked"), (902, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.quality_rules.kept for r in Q.quality(df.repartition(7)).collect()}
    assert not got[900] and got[901] and not got[902] and got[5]
    assert got == {r.doc_id: r.quality_rules.kept for r in Q.quality(df.coalesce(1)).collect()}


def test_empty_table_and_null_groups(spark):
    assert Q.quality(documents(spark, [])).count() == 0
    rows = [(i, f"some plain words that make a text of ten and more {i}", None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert all(r.quality_rules.kept for r in Q.quality(df).collect())

"""Users' own code: expander, vectorizer, metric."""

from pyspark.sql import functions as F

from quarry.functions import user as U
from quarry.operators import evaluation as E
from quarry.operators import fewshot as FS


def test_row_expander(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "y"), (3, "c", "z")], "id long, text string, tag string")

    def words(row):
        for n, w in enumerate(row["text"].split()):
            yield n, w + row["tag"]
    out = U.expand_rows(df, words, "n int, word string")
    assert sorted((r.id, r.tag, r.n, r.word) for r in out.collect()) == [(1, "x", 0, "ax"), (1, "x", 1, "bx"), (3, "z", 0, "cz")]
    kept = U.expand_rows(df, words, "n int, word string", ["text", "tag"], keep_empty=True)
    assert sorted((r.id, r.word or "") for r in kept.collect()) == [(1, "ax"), (1, "bx"), (2, ""), (3, "cz")]


def test_vectorizer_sets_up_once_per_task_and_feeds_the_neighbours(spark):
    def setup():
        calls = []

        def embed(texts):
            calls.append(len(texts))
            return [(t.count("a"), t.count("b"), len(calls)) for t in texts]
        return embed
    df = spark.createDataFrame([(1, "aaa"), (2, "aab"), (3, None), (4, "bbb")], "id long, text string").coalesce(1)
    out = {r.id: r.vec for r in U.with_vectors(df, "text", setup).collect()}
    assert out == {1: [3.0, 0.0, 1.0], 2: [2.0, 1.0, 1.0], 3: None, 4: [0.0, 3.0, 1.0]}
    vecs = U.with_vectors(df.filter("text is not null"), "text", setup)
    assert {(r.query_id, r.neighbour_id) for r in FS.knn(vecs, vecs, k=1).collect()} == {(1, 2), (2, 1), (4, 2)}


def test_metric_column(spark):
    rows = [("a", True, 0.2), ("a", True, 0.4), ("b", False, 0.9), ("b", None, None)]
    df = spark.createDataFrame(rows, "candidate string, results_match boolean, score double")
    assert {r.candidate: r.is_best for r in E.best_candidate(df).collect()} == {"a": True, "b": False}
    own = E.best_candidate(df, metric=F.col("score") + F.when(F.col("results_match").isNull(), 1).otherwise(0)).collect()
    assert {r.candidate: (round(r.mean_score, 9), r.is_best) for r in own} == {"a": (0.3, False), "b": (0.45, True)}

"""Entry points for users' own Python code: row expanders, vectorizers and metrics.

Everything in this library runs on built-in expressions by default; these three take a user's function where the reference
takes a callback. Python workers run them in batches: an expander as a Python table function joined
laterally, a vectorizer as an Arrow-batched iterator function that sets itself up once per task. A metric is a column
expression and needs no Python (``evaluation.best_candidate(metric=...)``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_rows(df: DataFrame, expander: Callable[[dict], Iterable[tuple]], schema: str,
                columns: list[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """One row to many by a user's function: ``expander`` takes a row's ``columns`` (default all) as a dict and yields tuples of
    ``schema``. The new columns follow those of ``df``; a row that yields nothing is dropped, or kept with nulls."""

    class Expand:
        def eval(self, row):
            yield from expander(row.asDict(recursive=True))

    table = F.udtf(Expand, returnType=schema)
    row = F.struct(*[F.col(c).outer().alias(c) for c in columns or df.columns])
    return df.lateralJoin(table(row), on=F.lit(True) if keep_empty else None, how="left" if keep_empty else "inner")


def vectorizer(setup: Callable[[], Callable[[list[str]], Iterable]]):
    """A user's text embedder as a function of a string column to ``array<float>``.

    ``setup`` is called once per task (load a model there) and returns a function from a list of texts to one vector for
    each. A null text has a null vector and is not passed on.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = setup()
        for texts in batches:
            known = texts[texts.notna()].tolist()
            vectors = iter(embed(known) if known else [])
            yield pd.Series([None if t is None else [float(x) for x in next(vectors)] for t in texts.where(texts.notna(), None)], dtype=object)

    return F.pandas_udf(run, "array<float>")


def with_vectors(df: DataFrame, text: str, setup: Callable[[], Callable[[list[str]], Iterable]], out: str = "vec") -> DataFrame:
    """``df`` with the vectors of a text column, ready for ``fewshot.knn``."""
    return df.withColumn(out, vectorizer(setup)(F.col(text)))

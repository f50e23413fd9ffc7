"""Searches over DataFrames: text, vectors, values, pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import vectors


def text_search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``text`` in any text column, whatever its case; % and _ stand for themselves."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    pattern = "%" + "".join("\\" + c if c in "%_\\" else c for c in text) + "%"
    hits = [F.coalesce(F.col(f"`{c}`").ilike(pattern), F.lit(False)) for c in names]
    return df.filter(reduce(lambda a, b: a | b, hits)) if hits else df.limit(0)


def vector_search(df: DataFrame, column: str, query: Sequence[float], k: int = 10, where: Column | None = None, metric: str = "cosine", tie: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest rows that fulfil ``where``, nearest first, with a column score; exact. Ties by the columns ``tie``.

    A partial top-k in each task, then one of all: no full sort, and k rows a task in the last step.
    """
    if metric.lower() not in vectors.METRICS:
        raise ValueError(f"metric is one of {', '.join(vectors.METRICS)}")
    function, greater = vectors.METRICS[metric.lower()]
    rows = df if where is None else df.filter(where)
    scored = rows.withColumn("score", function(vectors.to_vector(F.col(column), df.schema[column].dataType), [float(x) for x in query]))
    score = F.col("score").desc_nulls_last() if greater else F.col("score").asc_nulls_last()
    return scored.orderBy(score, *[F.col(t).asc() for t in tie]).limit(k)


def distinct_values(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """The different values of a column without null."""
    rows = df if where is None else df.filter(where)
    return rows.select(column).filter(F.col(column).isNotNull()).distinct()


def exists(df: DataFrame, where: Column | None = None) -> bool:
    return not (df if where is None else df.filter(where)).limit(1).isEmpty()


def page(df: DataFrame, number: int, size: int, order: Sequence[Column | str]) -> DataFrame:
    """One page of the sorted rows, counted from 1; a page has 500 rows at most."""
    size = max(1, min(500, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def matching(df: DataFrame, **values) -> Column | None:
    """Columns that equal these values; None asks for null."""
    tests = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in values.items()]
    return reduce(lambda a, b: a & b, tests) if tests else None

"""A fluent query over one DataFrame: each call returns a new query, and nothing runs before a result is asked for."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sluice.operators import search
from sluice.plans import pipe


class Query:
    def __init__(self, df: DataFrame):
        self._df = df

    def _on(self, condition: str | Column) -> Column:
        return pipe.condition(self._df, condition) if isinstance(condition, str) else condition

    # steps

    def select(self, *columns: str | Column) -> Query:
        return Query(self._df.select(*columns))

    def where(self, condition: str | Column | None = None, **values) -> Query:
        tests = [t for t in (None if condition is None else self._on(condition), search.matching(self._df, **values)) if t is not None]
        out = self._df
        for t in tests:
            out = out.filter(t)
        return Query(out)

    filter = where

    def order_by(self, *columns: str, descending: bool = False) -> Query:
        """Null is the greatest value."""
        return Query(self._df.orderBy(*[F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last() for c in columns]))

    sort = order_by

    def limit(self, n: int) -> Query:
        return Query(self._df.limit(n))

    take = limit

    def offset(self, n: int) -> Query:
        return Query(self._df.offset(n))

    def pipe(self, text: str) -> Query:
        return Query(pipe.apply_pipe(self._df, text))

    def search(self, text: str, columns: Sequence[str] | None = None) -> Query:
        return Query(search.text_search(self._df, text, columns))

    def vector_search(self, column: str, query: Sequence[float], top_k: int = 10, filter: str | Column | None = None, metric: str = "cosine", tie: Sequence[str] = ()) -> Query:
        return Query(search.vector_search(self._df, column, query, top_k, None if filter is None else self._on(filter), metric, tie))

    def distinct(self, column: str, where: str | Column | None = None) -> Query:
        return Query(search.distinct_values(self._df, column, None if where is None else self._on(where)))

    def page(self, number: int, size: int, *order: str) -> Query:
        return Query(search.page(self._df, number, size, order))

    # results

    def df(self) -> DataFrame:
        return self._df

    execute = df

    def find(self, limit: int | None = None, **values) -> list[Row]:
        found = self.where(**values)
        return (found.limit(limit) if limit is not None else found).collect()

    def find_one(self, **values) -> Row | None:
        return self.where(**values).first()

    def first(self) -> Row | None:
        return self._df.first()

    def last(self, order: str) -> Row | None:
        """The last row in the order of a column: tables have no order of their own."""
        return self.order_by(order, descending=True).first()

    def collect(self) -> list[Row]:
        return self._df.collect()

    all = collect

    def to_dicts(self) -> list[dict]:
        return [r.asDict() for r in self._df.collect()]

    def to_list(self) -> list[list]:
        return [list(r) for r in self._df.collect()]

    def to_df(self):
        """As a pandas DataFrame."""
        return self._df.toPandas()

    def pluck(self, *columns: str) -> list:
        """One column's values, or tuples of several."""
        rows = self._df.select(*columns).collect()
        return [r[0] for r in rows] if len(columns) == 1 else [tuple(r) for r in rows]

    def count(self) -> int:
        return self._df.count()

    def exists(self, condition: str | Column | None = None) -> bool:
        return search.exists(self._df, None if condition is None else self._on(condition))

    def _number(self, function, column: str, where: str | Column | None):
        return (self._df if where is None else self._df.filter(self._on(where))).agg(function(column)).first()[0]

    def sum(self, column: str, where: str | Column | None = None):
        return self._number(F.sum, column, where) or 0

    def avg(self, column: str, where: str | Column | None = None):
        return self._number(F.avg, column, where)

    def min(self, column: str, where: str | Column | None = None):
        return self._number(F.min, column, where)

    def max(self, column: str, where: str | Column | None = None):
        return self._number(F.max, column, where)

    def show(self, n: int = 20) -> None:
        self._df.show(n)

    def __iter__(self) -> Iterator[Row]:
        return self._df.toLocalIterator()

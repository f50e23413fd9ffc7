"""Short ways in: a session, a table by its path, and searches in a table, without naming classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.operators import search as _search
from sluice.operators.session import Session
from sluice.operators.tables import Table
from sluice.sources import readers, writers


def connect(root: str, spark: SparkSession | None = None) -> Session:
    """A session whose databases stand under ``root``, on the given or the running Spark session."""
    return Session(spark or SparkSession.builder.getOrCreate(), root)


def open_table(path: str, spark: SparkSession | None = None) -> Table:
    """The table at a path, whether it exists yet or not."""
    return Table(spark or SparkSession.builder.getOrCreate(), path)


def find(table: Table | DataFrame, **values: object) -> DataFrame:
    """Rows with these values, none of them meaning all rows."""
    df = table if isinstance(table, DataFrame) else table.df()
    return df.filter(_search.matching(df, **values)) if values else df


def search(table: Table | DataFrame, text: str) -> DataFrame:
    """Rows in which any text column holds ``text``, in any case."""
    return _search.text_search(table if isinstance(table, DataFrame) else table.df(), text)


def import_file(table: Table, path: str, kind: str | None = None, **how) -> int:
    """Append the rows of a file, of the kind that its name says; returns how many."""
    rows = readers.import_file(table.spark, path, kind, **how)
    n = rows.count()
    table.insert(rows)
    return n


def export_file(table: Table | DataFrame, path: str, kind: str | None = None) -> None:
    """Write all rows, in the kind that the path's name says."""
    writers.export(table if isinstance(table, DataFrame) else table.df(), path, kind)

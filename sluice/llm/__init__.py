"""Operators for preparing training data at corpus scale. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

#: Bytes of a batch of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores after it as long as a column of that name, in any case, is there."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark close a batch for Python at BATCH_BYTES, where the session has no bound of its own: whole texts in batches of 10,000 rows need any amount of memory, on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, str(BATCH_BYTES))

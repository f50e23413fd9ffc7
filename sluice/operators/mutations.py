"""Row and schema changes as plain DataFrame transforms; sluice.operators.tables writes what they return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import scalars


def update(df: DataFrame, values: dict[str, object], where: Column | None = None) -> DataFrame:
    """Set columns to constants or expressions where the condition is true; rows where it is null stay as they are."""
    unknown = [c for c in values if c not in df.columns]
    if unknown:
        raise KeyError(f"no column {', '.join(unknown)}")
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    new = {c: (v if isinstance(v, Column) else F.lit(v)).cast(df.schema[c].dataType) for c, v in values.items()}
    return df.select(*[F.when(hit, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Without the rows where the condition is true; all go without a condition."""
    return df.limit(0) if where is None else df.filter(~F.coalesce(where, F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of known keys change the columns that ``rows`` has; others are new, with nulls in the columns that it lacks.

    Of rows with one key in ``rows`` the last counts, in the order of its partitions; rows with a null key are always new.
    """
    if key not in df.columns or key not in rows.columns:
        raise KeyError(f"no column {key}")
    unknown = [c for c in rows.columns if c not in df.columns]
    if unknown:
        raise KeyError(f"no column {', '.join(unknown)}")
    given = [c for c in df.columns if c in rows.columns]
    typed = rows.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c) for c in given]).withColumn("__n", F.monotonically_increasing_id())
    keyless = typed.filter(F.col(key).isNull()).drop("__n")
    last = Window.partitionBy(key).orderBy(F.col("__n").desc())
    keyed = typed.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__n", "__r")
    new = keyed.select(F.col(key).alias("__key"), F.struct(*[F.col(c) for c in given]).alias("__new"))
    old = df.select(F.col(key).alias("__k"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__old"))
    both = old.join(new, F.col("__k") == F.col("__key"), "full_outer")
    pick = lambda c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col("__old")[c]) if c in given else F.col("__old")[c]
    return both.select(*[pick(c).alias(c) for c in df.columns]).unionByName(keyless, allowMissingColumns=True)


def add_column(df: DataFrame, name: str, kind: str | T.DataType, default: object = None) -> DataFrame:
    """A new last column, filled with ``default``."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return df.withColumn(name, F.lit(default).cast(scalars.TYPES[kind.lower()] if isinstance(kind, str) else kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise KeyError(f"no column {name}")
    if len(df.columns) == 1:
        raise ValueError("a table keeps one column at least")
    return df.drop(F.col(f"`{name}`"))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise KeyError(f"no column {old}")
    if new in df.columns:
        raise ValueError(f"there is a column {new} already")
    return df.withColumnRenamed(old, new)

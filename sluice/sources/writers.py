"""Writers of files for elsewhere. All write a folder of part files; one(…) makes it one file where a single file is asked for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.tables import Files

FORMATS = ("csv", "json", "jsonl", "sql", "parquet")
SQL_TYPES = {"int": "BIGINT", "bigint": "BIGINT", "smallint": "BIGINT", "tinyint": "BIGINT", "float": "DOUBLE", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _flat(df: DataFrame) -> DataFrame:
    """Vectors as text, booleans as 1 and 0, for formats without either."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        out.append((F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else c.cast("int") if isinstance(f.dataType, T.BooleanType) else c).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    """Nulls as empty fields, quotes doubled."""
    _flat(df).write.mode("overwrite").csv(path, header=header, sep=delimiter, quote='"', escape='"', emptyValue='""', nullValue="")


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str) -> None:
    """An object a line, nulls as null."""
    df.select(_json(df).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One array in one file: the brackets and commas are put in as the rows pass through one task, in no driver's memory."""
    rows = df.select(_json(df).alias("value")).coalesce(1)

    def of(batches):
        first = True
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame({"value": [("[" if first else ",") + text]})
                first = False
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    rows.mapInPandas(of, "value string").write.mode("overwrite").text(path)


def _sql(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = F.when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif kind.simpleString() in SQL_TYPES:
        text = c.cast("string")
    else:
        plain = F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
        text = F.concat(F.lit("'"), F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), F.lit("NULL")).otherwise(text)


def write_sql(df: DataFrame, path: str, table: str) -> None:
    """A CREATE TABLE file and INSERT statements, one a row, in part files that sort after it."""
    columns = ", ".join(f"`{f.name}` {SQL_TYPES.get(f.dataType.simpleString(), 'TEXT')}" for f in df.schema)
    values = F.concat(F.lit(f"INSERT INTO `{table}` VALUES ("), F.concat_ws(", ", *[_sql(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]), F.lit(");"))
    df.select(values.alias("value")).write.mode("overwrite").text(path)
    Files(df.sparkSession).write(f"{path}/00-create.sql", f"CREATE TABLE IF NOT EXISTS `{table}` ({columns});\n")


def export(df: DataFrame, path: str, kind: str | None = None, table: str = "data") -> None:
    """Write in any of FORMATS, by name or by the end of the path."""
    kind = (kind or path.rstrip("/").rpartition("/")[2].rpartition(".")[2]).lower().lstrip(".")
    if kind not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    {"csv": write_csv, "json": write_json, "jsonl": write_jsonl, "sql": lambda d, p: write_sql(d, p, table), "parquet": lambda d, p: d.write.mode("overwrite").parquet(p)}[kind](df, path)


def one(df: DataFrame) -> DataFrame:
    """In one part, for a single file."""
    return df.coalesce(1)

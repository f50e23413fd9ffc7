"""Readers of files from elsewhere that may be damaged: what cannot be read is null or left out, and nothing stops the rest."""

from __future__ import annotations

import codecs
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.cluster import shared_path
from sluice.functions import scalars
from sluice.operators.tables import Files

_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?)$"


def infer_types(df: DataFrame) -> T.StructType:
    """Types of text columns by what stands in them: booleans, whole numbers, numbers, else text. One aggregation over all rows."""
    text = lambda c: F.trim(F.col(f"`{c}`"))
    known = lambda c: F.when(~F.upper(text(c)).isin(*scalars.NULL_TEXTS), text(c))
    tests = []
    for k, c in enumerate(df.columns):
        v = known(c)
        tests += [F.count(v).alias(f"n{k}"), F.bool_and(v.rlike(r"^[+-]?\d{1,18}$")).alias(f"i{k}"), F.bool_and(v.rlike("(?i)" + _NUMBER)).alias(f"f{k}"), F.bool_and(F.lower(v).isin("true", "false")).alias(f"b{k}")]
    found = df.agg(*tests).first() if tests else {}
    pick = lambda k: T.StringType() if not found[f"n{k}"] else T.BooleanType() if found[f"b{k}"] else T.LongType() if found[f"i{k}"] else T.DoubleType() if found[f"f{k}"] else T.StringType()
    return T.StructType([T.StructField(c, pick(k)) for k, c in enumerate(df.columns)])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as these types, by the rules for dirty values."""
    return df.select(*[scalars.cast_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema])


#: Encodings that Spark reads itself.
SPARK_ENCODINGS = {"iso-8859-1", "latin-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}
HEAD_BYTES = 1 << 16


def sniff_encoding(head: bytes) -> str:
    """The encoding of a file by its first bytes: a byte order mark, else UTF-8 if they are, else windows-1254, which reads any Latin text."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)  # a letter may be cut off at the end
        return "utf-8"
    except UnicodeDecodeError:
        return "windows-1254"


def _utf8(spark: SparkSession, path: str, encoding: str) -> str:
    """A copy in UTF-8 in the shared folder, for an encoding that Spark does not read; a file is decoded by one task."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [c.decode(encoding, "replace").rstrip("\n") for c in batch["content"]]})

    out = shared_path(spark, "utf8")
    spark.read.format("binaryFile").load(path).select("content").mapInPandas(of, "value string").write.text(out)
    return out


def _spans_lines(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether quoted values hold line feeds, so that a file has to be read whole: lines that open a quote, and as many that close one. Stray quotes are neither."""
    line, d = F.col("value"), re.escape(delimiter)
    odd = spark.read.text(path).filter((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1)
    opens, closes = line.rlike(rf'(^|{d})"([^"]|"")*$'), line.rlike(rf'^([^"]|"")*"({d}|\r?$)')
    found = odd.agg(F.count("*").alias("n"), F.count_if(opens).alias("a"), F.count_if(closes).alias("b"), F.count_if(opens | closes).alias("c")).first()
    n = found["n"]
    return n > 0 and n % 2 == 0 and found["c"] == n and min(found["a"], found["b"]) >= n // 2


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", encoding: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Rows of CSV files: short rows are filled with nulls, long ones cut, blank ones skipped, NUL bytes taken out; bad cells are null. Without an encoding, the first file's bytes tell it."""
    encoding = (encoding or sniff_encoding(Files(spark).head(path, HEAD_BYTES))).lower()
    if encoding not in SPARK_ENCODINGS:
        path, encoding = _utf8(spark, path, encoding), "utf-8"
    encoding = "iso-8859-1" if encoding == "latin-1" else encoding
    raw = spark.read.csv(path, header=header, sep=delimiter, encoding=encoding, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False, enforceSchema=True, multiLine=encoding.startswith("utf-8") and _spans_lines(spark, path, delimiter))
    names = [c.lstrip("\ufeff").replace("\x00", "") for c in raw.columns]
    if schema is not None and len(schema) == len(names):
        names = schema.names
    clean = raw.select(*[F.replace(F.col(f"`{c}`"), F.lit("\x00"), F.lit("")).alias(n) for c, n in zip(raw.columns, names, strict=True)])
    return typed(clean, schema or infer_types(clean))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One object a line; lines that are none are left out."""
    lines = spark.read.text(path).select(F.trim(F.replace(F.col("value"), F.lit("\x00"), F.lit(""))).alias("value"))
    return _objects(lines.filter(F.col("value").startswith("{")), schema)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """An array of objects, one object, or an object whose "data" is the array; of a broken file, the whole flat objects in it."""
    texts = spark.read.text(path, wholetext=True).select(F.trim(F.replace(F.col("value"), F.lit("\x00"), F.lit(""))).alias("value"))
    array = F.from_json("value", "array<string>")
    data = F.from_json(F.get_json_object("value", "$.data"), "array<string>")
    # a flat object without nested braces, strings whole
    loose = F.regexp_extract_all("value", F.lit(r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'), F.lit(0))
    whole = F.when(F.col("value").startswith("[") & F.col("value").endswith("]"), array)
    wrapped = F.when(F.col("value").startswith("{"), F.coalesce(data, F.when(F.get_json_object("value", "$").isNotNull(), F.array("value"))))
    found = F.coalesce(F.when(F.size(whole) > 0, whole), wrapped, loose)
    return _objects(texts.select(F.explode(found).alias("value")).filter("value is not null"), schema)


def _objects(texts: DataFrame, schema: T.StructType | None) -> DataFrame:
    bad = "_corrupt_record"
    if schema is None:
        seen = texts.sparkSession.read.option("columnNameOfCorruptRecord", bad).json(texts.rdd.map(lambda r: r[0])).schema
        schema = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.StructType, T.NullType)) else f.dataType) for f in seen if f.name != bad])
    if not len(schema):
        return texts.sparkSession.createDataFrame([], schema)
    full = T.StructType([*schema, T.StructField(bad, T.StringType())])
    return texts.select(F.from_json("value", full, {"columnNameOfCorruptRecord": bad}).alias("o")).filter(F.col("o").isNotNull() & F.col(f"o.{bad}").isNull()).select(*[F.col(f"o.`{n}`") for n in schema.names])


# SQL dumps

# What column types of dumps become, fixed values.
DUMP_TYPES = {
    "tinyint": "int64", "smallint": "int64", "mediumint": "int64", "int": "int64", "integer": "int64", "bigint": "int64", "serial": "int64", "bigserial": "int64",
    "decimal": "double", "numeric": "double", "float": "double", "double": "double", "real": "double", "bool": "bool", "boolean": "bool", "timestamp": "timestamp", "datetime": "string", "date": "string", "time": "string",
}
_CREATE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\(", re.I)
_INSERT = re.compile(r"\b(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\s+[`\"\[]?([\w.]+)[`\"\]]?\s*(?:\(([^)]*)\))?\s*VALUES\s*", re.I)
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,()']+))\s*", re.S)
_UNESCAPE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a"}
_NO_COLUMN = {"primary", "key", "unique", "index", "constraint", "foreign", "check", "fulltext", "spatial"}


def dump_schemas(text: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(table, its (column, type) pairs) of each CREATE TABLE of a dump, in order."""
    found = []
    for m in _CREATE.finditer(text):
        depth, end, start, parts = 1, m.end(), m.end(), []
        while end < len(text) and depth:
            c = text[end]
            depth += (c == "(") - (c == ")")
            if depth == 1 and c == "," or not depth:
                parts.append(text[start:end].strip())
                start = end + 1
            end += 1
        out = []
        for p in parts:
            words = p.split(None, 1)
            if len(words) == 2 and words[0].strip("`\"[]").lower() not in _NO_COLUMN:
                out.append((words[0].strip("`\"[]"), DUMP_TYPES.get(re.match(r"\w*", words[1].lower())[0], "string")))
        found.append((m[1], out))
    return found


def _tuple(text: str, at: int) -> tuple[list[str | None] | None, int]:
    """The values of a row that opens before ``at``, and where it ends; None for a row that is not closed."""
    row = []
    while v := _VALUE.match(text, at):
        quoted, plain = v[1], (v[2] or "").strip()
        row.append(re.sub(r"\\(.)|''", lambda x: _UNESCAPE.get(x[1], x[1]) if x[1] else "'", quoted, flags=re.S) if quoted is not None else None if plain.upper() == "NULL" else plain)
        at = v.end()
        if at >= len(text) or text[at] not in ",)":
            break
        at += 1
        if text[at - 1] == ")":
            return row, at
    return None, at


_NEXT, _OPEN, _LINE = re.compile(r"\s*,?\s*\("), re.compile(r"(?:\)\s*,|\n)\s*\("), re.compile(r"^[ \t]*\(", re.M)


def dump_rows(text: str, table: str | None = None) -> Iterator[tuple[list[str] | None, list[str | None]]]:
    """(columns, if they are named, and values as text) of the rows of all INSERT and REPLACE statements, of one table if it is named; of a text without any, of lines that open with a bracket.

    A row that is not closed is left out, and those after it are read.
    """
    starts = list(_INSERT.finditer(text))
    parts = [(m[1], m[2], m.end(), starts[k + 1].start() if k + 1 < len(starts) else len(text)) for k, m in enumerate(starts)]
    if not starts and not _CREATE.search(text) and (m := _LINE.search(text)):
        parts = [(table, None, m.start(), len(text))]
    for name, columns, at, end in parts:
        if table is not None and name.rpartition(".")[2].lower() != table.rpartition(".")[2].lower():
            continue
        named = [c.strip(" `\"[]\n\t") for c in columns.split(",")] if columns else None
        m = _NEXT.match(text, at, end)
        while m:
            row, at = _tuple(text, m.end())
            if row is not None:
                yield named, row
                m = _NEXT.match(text, at, end)
            else:
                m = _OPEN.search(text, m.end(), end)


def read_sql_dump(spark: SparkSession, path: str, schema: T.StructType | None = None, table: str | None = None) -> DataFrame:
    """Rows of one table of a dump, by its INSERT statements, typed by its CREATE TABLE in whichever file it stands, or by the values without one.

    Without a name: the first table by name of those that are created, or all rows if none is. Short rows that only repeat the start of the next one are left out.
    A dump is no format that can be split: a file is read by one task.
    """
    texts = spark.read.text(path, wholetext=True)
    if schema is None or table is None:

        def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(t, [c for c, _ in k], [x for _, x in k]) for text in batch["value"] for t, k in dump_schemas(text)]
                yield pd.DataFrame(found, columns=["name", "columns", "kinds"])

        created = texts.mapInPandas(heads, "name string, columns array<string>, kinds array<string>").distinct().orderBy("name").collect()  # a row for each CREATE TABLE
        mine = [r for r in created if table is None or r["name"].lower() == table.lower()]
        if mine:
            table = table or mine[0]["name"]
            schema = schema or T.StructType([T.StructField(c, scalars.TYPES[k]) for c, k in zip(mine[0]["columns"], mine[0]["kinds"], strict=True)])
    names = [n.lower() for n in schema.names] if schema else None

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                rows, held = [], None
                for columns, row in dump_rows(text, table):
                    if names and columns and len(columns) == len(row):
                        at = {c.lower(): v for c, v in zip(columns, row, strict=True)}
                        row = [at.get(n) for n in names]
                    if held is not None and not (len(held) < len(row) and row[: len(held)] == held):
                        rows.append(held)
                    held = row
                    if len(rows) >= 10_000:
                        yield pd.DataFrame({"cells": pd.Series(rows, dtype=object)})
                        rows = []
                if held is not None:
                    rows.append(held)
                yield pd.DataFrame({"cells": pd.Series(rows, dtype=object)})

    cells = texts.mapInPandas(of, "cells array<string>")
    if schema is None:
        width = cells.select(F.max(F.size("cells"))).first()[0] or 0
        named = cells.select(*[F.get("cells", F.lit(k)).alias(f"col_{k + 1}") for k in range(width)])
        return typed(named, infer_types(named))
    return typed(cells.select(*[F.get("cells", F.lit(k)).alias(f.name) for k, f in enumerate(schema)]), schema)


# SQLite

# What SQLite's declared types become, fixed values.
SQLITE_TYPES = {"INT": T.LongType(), "BOOL": T.BooleanType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType(), "DECIMAL": T.DoubleType(), "NUMERIC": T.DoubleType()}


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.columns = options, schema

    def partitions(self):
        if "query" in self.options:
            return [_Range(0, 0)]
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        db.close()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, (high - low + 1) // int(self.options.get("partitions", 8)) + 1)
        return [_Range(k, min(high, k + step - 1)) for k in range(low, high + 1, step)]

    def read(self, part):
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        rows = db.execute(self.options["query"]) if "query" in self.options else db.execute(f'SELECT * FROM "{self.options["table"]}" WHERE rowid BETWEEN ? AND ?', (part.low, part.high))
        for row in rows:
            yield tuple(_cell(v, f.dataType) for v, f in zip(row, self.columns, strict=True))
        db.close()


def _cell(v: object, kind: T.DataType) -> object:
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v.hex() if isinstance(v, bytes) else str(v)
    try:
        return bool(v) if isinstance(kind, T.BooleanType) else int(v) if isinstance(kind, T.LongType) else float(v)
    except (TypeError, ValueError):
        return None


class SqliteSource(DataSource):
    """Format "sqlite": options path, and table or query. A table has its declared types, a query's columns are text; blobs come as hexadecimal text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        if "query" in self.options:
            names = [(d[0], "") for d in db.execute(self.options["query"]).description]
            kinds = [(n, T.StringType()) for n, _ in names]
        else:
            declared = [(r[1], r[2].upper()) for r in db.execute(f'PRAGMA table_info("{self.options["table"]}")')]
            kinds = [(n, next((t for k, t in SQLITE_TYPES.items() if k in d), T.StringType())) for n, d in declared]
        db.close()
        return T.StructType([T.StructField(n, k) for n, k in kinds])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None) -> DataFrame:
    """A table, in ranges of its row ids, or a query of a SQLite file that all executors can open."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, **({"table": table} if table else {"query": query})).load()


def read_cursor(spark: SparkSession, cursor, chunk: int = 10_000) -> DataFrame:
    """What a DB-API cursor still has, as text columns, fetched in chunks."""
    names, out = [d[0] for d in cursor.description], None
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    while rows := cursor.fetchmany(chunk):
        part = spark.createDataFrame([tuple(None if v is None else v.hex() if isinstance(v, bytes) else str(v) for v in r) for r in rows], schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


#: Kinds of files by the end of their name.
EXTENSIONS = {"csv": "csv", "tsv": "tsv", "txt": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "sql": "sql", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite", "parquet": "parquet"}


def import_file(spark: SparkSession, path: str, kind: str | None = None, **how) -> DataFrame:
    """Rows of a file of any kind that there is a reader for, by name or by the end of the path; ``how`` goes to that reader."""
    kind = (kind or path.rstrip("/").rpartition("/")[2].rpartition(".")[2]).lower().lstrip(".")
    if kind not in EXTENSIONS:
        raise ValueError(f"no reader for {kind or path}: one of {', '.join(EXTENSIONS)}")
    read = {
        "csv": read_csv, "tsv": lambda s, p, **h: read_csv(s, p, delimiter="\t", **h), "json": read_json, "jsonl": read_jsonl, "sql": read_sql_dump, "sqlite": read_sqlite,
        "parquet": lambda s, p: s.read.parquet(p),
    }
    return read[EXTENSIONS[kind]](spark, path, **how)

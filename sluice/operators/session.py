"""A session: databases and tables under one folder, and every statement of the language as one call."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import scalars, sql as sql_functions
from sluice.operators.query import Query
from sluice.operators.tables import Files, Table, fit
from sluice.plans import pipe

_NAME = r"(?P<{}>[\w.]+|`[^`]+`|\"[^\"]+\"|'[^']+')"
_BODY = re.compile(r"\s*;?\s*\Z")


def _rule(text: str) -> re.Pattern:
    """A statement's pattern: words, any white space between them, names in braces."""
    named = re.sub(r"\{(\w+)\}", lambda m: _NAME.format(m[1]), text)
    return re.compile(r"\s*" + re.sub(r"\s+", r"\\s+", named) + r"\s*;?\s*\Z", re.I | re.S)


class Session:
    """``root`` holds a folder for each database; a table is a folder in it, a sub-table ``a.b`` the folder ``a/b``.

    ``default`` is the database that is there from the start.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.active = "default"
        self.views: dict[str, DataFrame] = {}
        self.files.make(f"{self.root}/default")
        sql_functions.register(spark)
        self.rules = [
            (_rule(r"SHOW DATABASES"), self._show_databases),
            (_rule(r"CREATE DATABASE (?P<ok>IF NOT EXISTS )?{name}"), self._create_database),
            (_rule(r"DROP DATABASE (?P<ok>IF EXISTS )?{name}"), self._drop_database),
            (_rule(r"USE (?:DATABASE )?{name}"), self._use),
            (_rule(r"SHOW TABLES(?: (?:FROM|IN) {name})?"), self._show_tables),
            (_rule(r"CREATE TABLE (?P<ok>IF NOT EXISTS )?{name}\s*\((?P<columns>.*)\)"), self._create_table),
            (_rule(r"INSERT INTO {name}(?:\s*\((?P<columns>[^)]*)\))?\s*VALUES\s*(?P<values>.*?)"), self._insert),
            (_rule(r"UPDATE {name} SET (?P<sets>.*?)"), self._update),
            (_rule(r"DELETE (?:FROM )?{name}(?: WHERE (?P<where>.*))?"), self._delete),
            (_rule(r"ALTER TABLE {name} RENAME (?:COLUMN )?{old} TO {new}"), lambda m: self._done(self.table(_bare(m["name"])).rename_column(_bare(m["old"]), _bare(m["new"])))),
            (_rule(r"ALTER TABLE {name} DROP (?:COLUMN )?{column}"), lambda m: self._done(self.table(_bare(m["name"])).drop_column(_bare(m["column"])))),
            (_rule(r"ALTER TABLE {name} ADD (?:COLUMN )?{column} (?P<kind>\w+)(?: DEFAULT (?P<value>.*?))?"), self._add_column),
            (_rule(r"DROP TABLE (?P<ok>IF EXISTS )?{name}"), lambda m: self._done(self.table(_bare(m["name"])).drop(bool(m["ok"])))),
            (_rule(r"TRUNCATE (?:TABLE )?{name}"), lambda m: self._rows(self.table(_bare(m["name"])).truncate())),
            (_rule(r"RENAME TABLE {name} TO {new}"), lambda m: self._done(self.rename_table(_bare(m["name"]), _bare(m["new"])))),
            (_rule(r"(?:DESCRIBE(?: TABLE)?|SHOW COLUMNS FROM) {name}"), self._describe),
            (_rule(r"COUNT {name}"), lambda m: self.resolve(_bare(m["name"])).agg(F.count(F.lit(1)).alias("count"))),
            (_rule(r"OPTIMIZE (?:TABLE )?{name}"), lambda m: self._done(self.table(_bare(m["name"])).optimize())),
            (_rule(r"INFO {name}"), self._info),
        ]

    # names

    def path(self, name: str) -> str:
        """Where a table is or would be: ``table``, ``database.table``, ``table.sub`` or ``database.table.sub``. The first part is a database if there is one of that name."""
        parts = name.split(".")
        if not all(re.fullmatch(r"[\w-]+", p) for p in parts):
            raise ValueError(f"{name!r} is no table name")
        if len(parts) > 1 and self.files.exists(f"{self.root}/{parts[0]}") and not self.files.exists(f"{self.root}/{self.active}/{parts[0]}/_log"):
            return f"{self.root}/{'/'.join(parts)}"
        return f"{self.root}/{self.active}/{'/'.join(parts)}"

    def table(self, name: str) -> Table:
        return Table(self.spark, self.path(name))

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame under a name, for this session."""
        self.views[name] = df
        df.createOrReplaceTempView(name)

    def resolve(self, name: str) -> DataFrame:
        """A registered DataFrame, a table, a Spark table, or a Parquet path."""
        if name in self.views:
            return self.views[name]
        if re.fullmatch(r"[\w.-]+", name) and (t := self.table(name)).exists():
            return t.df()
        if "/" in name:
            return Table(self.spark, name).df() if Table(self.spark, name).exists() else self.spark.read.parquet(name)
        return self.spark.table(name)

    def find(self, name: str) -> Query:
        return Query(self.resolve(name))

    # statements

    def query(self, text: str) -> DataFrame:
        """Run any statement; changes give one row that says how many rows they touched. What is no statement here goes to Spark SQL."""
        plain = re.sub(r"\A(?:\s|--[^\n]*\n|#[^\n]*\n)+", "", text)
        if re.match(r"FROM\b", plain, re.I) and "|>" not in plain:
            return pipe.compile_pipe(plain, self.resolve)
        for rule, run in self.rules:
            if m := rule.match(plain):
                return run(m)
        if m := re.match(r"EXPLAIN\s+(.*)", plain, re.I | re.S):
            return self.explain(m[1])
        return self.sql(plain)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL in which this session's tables are known by their names: of one part as they are, of several joined by two underscores."""
        for name in set(re.findall(r"\b(?:FROM|JOIN)\s+([\w.]+)", text, re.I)):
            if name not in self.views and (t := self.table(name)).exists():
                flat = name.replace(".", "__")
                t.df().createOrReplaceTempView(flat)
                text = re.sub(rf"\b((?:FROM|JOIN)\s+){re.escape(name)}(?![\w.])", rf"\g<1>{flat}", text, flags=re.I)
        return self.spark.sql(text)

    def explain(self, text: str) -> DataFrame:
        """The formatted physical plan, as one row."""
        plan = self.query(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(plan,)], "plan string")

    def _done(self, _=None) -> DataFrame:
        return self.spark.createDataFrame([("ok",)], "status string")

    def _rows(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows_affected long")

    def databases(self) -> list[str]:
        return self.files.folders(self.root)

    def tables(self, database: str | None = None) -> list[str]:
        """All tables and sub-tables of a database, by their dotted names."""
        out: list[str] = []

        def walk(at: str, name: str) -> None:
            for f in self.files.folders(at):
                if not (f.startswith("v-") or f == "_log"):
                    full = f"{name}.{f}" if name else f
                    if self.files.exists(f"{at}/{f}/_log"):
                        out.append(full)
                    walk(f"{at}/{f}", full)

        walk(f"{self.root}/{database or self.active}", "")
        return out

    def _show_databases(self, m) -> DataFrame:
        rows = [(d, len(self.tables(d)), self.files.size(f"{self.root}/{d}")) for d in self.databases()]
        return self.spark.createDataFrame(rows, "database string, tables long, bytes long")

    def _show_tables(self, m) -> DataFrame:
        database = _bare(m["name"]) if m["name"] else self.active
        rows = []
        for name in self.tables(database):
            t = Table(self.spark, f"{self.root}/{database}/{name.replace('.', '/')}")
            rows.append((name, "sub-table" if "." in name else "table", name.rpartition(".")[0] or None, t.count(), self.files.size(t.location)))
        return self.spark.createDataFrame(rows, "table string, type string, parent string, rows long, bytes long")

    def _create_database(self, m) -> DataFrame:
        name = _bare(m["name"])
        if name in self.databases() and not m["ok"]:
            raise ValueError(f"there is a database {name} already")
        self.files.make(f"{self.root}/{name}")
        return self._done()

    def _drop_database(self, m) -> DataFrame:
        name = _bare(m["name"])
        if name == "default":
            raise ValueError("the database default stays")
        if name not in self.databases():
            if m["ok"]:
                return self._done()
            raise ValueError(f"no database {name}")
        self.files.remove(f"{self.root}/{name}")
        self.active = "default" if self.active == name else self.active
        return self._done()

    def _use(self, m) -> DataFrame:
        name = _bare(m["name"])
        if name not in self.databases():
            raise ValueError(f"no database {name}")
        self.active = name
        return self._done()

    def _create_table(self, m) -> DataFrame:
        t = self.table(_bare(m["name"]))
        if not (m["ok"] and t.exists()):
            t.create(T.StructType([T.StructField(_bare(n), _type(k)) for n, k in (c.split()[:2] for c in _split(m["columns"]))]))
        return self._done()

    def _insert(self, m) -> DataFrame:
        t = self.table(_bare(m["name"]))
        names = [_bare(c.strip()) for c in m["columns"].split(",")] if m["columns"] else t.schema.names
        empty = self.spark.range(1).select()
        rows = [[pipe.expression(empty, v) for v in _split(row)] for row in _rows(m["values"])]
        if any(len(r) != len(names) for r in rows):
            raise ValueError(f"a row has {len(names)} values")
        kinds = t.schema
        cells = [F.struct(*[v.cast(kinds[n].dataType).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
        t.insert(self.spark.range(1).select(F.explode(F.array(*cells)).alias("r")).select("r.*"))
        return self._rows(len(rows))

    def _update(self, m) -> DataFrame:
        t = self.table(_bare(m["name"]))
        p, values = pipe.Parser(m["sets"]), {}
        now = t.df()
        while True:
            name = p.name()
            p.need("=")
            values[name] = pipe.Expressions(p, now).parse().column
            if not p.op(","):
                break
        where = None
        if p.word("WHERE"):
            e = pipe.Expressions(p, now)
            where = e.condition(e.parse())
        if p.now.kind != "end":
            raise pipe.PipeError(f"unexpected {p.now.text!r} at {p.now.at}")
        return self._rows(t.update(values, where))

    def _delete(self, m) -> DataFrame:
        t = self.table(_bare(m["name"]))
        return self._rows(t.delete(pipe.condition(t.df(), m["where"]) if m["where"] else None))

    def _add_column(self, m) -> DataFrame:
        kind = _type(m["kind"])
        value = pipe.unquote(m["value"].strip()) if (m["value"] or "").strip()[:1] in ("'", '"') and m["value"].strip() else m["value"]
        self.table(_bare(m["name"])).add_column(_bare(m["column"]), kind, fit(value, kind))
        return self._done()

    def rename_table(self, old: str, new: str) -> None:
        a, b = self.table(old), self.table(new)
        if not a.exists():
            raise FileNotFoundError(f"no table {old}")
        if b.exists():
            raise ValueError(f"there is a table {new} already")
        self.files.rename(a.location, b.location)

    def _describe(self, m) -> DataFrame:
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in self.resolve(_bare(m["name"])).schema], "column string, type string, nullable boolean")

    def _info(self, m) -> DataFrame:
        t = self.table(_bare(m["name"]))
        return self.spark.createDataFrame([(t.location, t.version(), t.count(), len(t.schema), t.bytes())], "location string, version long, rows long, columns long, bytes long")


def _bare(name: str) -> str:
    return name.strip("`\"'")


def _type(name: str) -> T.DataType:
    if name.lower() not in scalars.TYPES:
        raise ValueError(f"no type {name}")
    return scalars.TYPES[name.lower()]


def _split(text: str) -> list[str]:
    """Parts between commas that are in no quotes or brackets."""
    out, depth, start = [], 0, 0
    for t in pipe.tokenize(text):
        if t.kind == "op":
            depth += (t.text in "([") - (t.text in ")]")
            if t.text == "," and not depth:
                out.append(text[start : t.at].strip())
                start = t.at + 1
    return [*out, text[start:].strip()]


def _rows(text: str) -> list[str]:
    """The insides of (…), (…), …"""
    out, depth, start = [], 0, 0
    for t in pipe.tokenize(text):
        if t.kind == "op" and t.text in "()[]":
            if t.text == "(" and not depth:
                start = t.at + 1
            depth += 1 if t.text in "([" else -1
            if t.text == ")" and not depth:
                out.append(text[start : t.at])
        elif not depth and not (t.kind == "end" or t.kind == "op" and t.text == ","):
            raise pipe.PipeError(f"unexpected {t.text!r} at {t.at}")
    return out

"""Tables on Parquet: folders of rows, and a numbered list of the folders for each version.

A version's list is put in place whole, under a name that only one writer can take; who comes second starts again from the new version,
so no writer loses another one's rows. An insert adds a folder, other changes write the table anew. Readers see one version or
another, and a job that dies leaves the table as it was. Lists and folders are never written over; ``vacuum`` deletes what is not
current, while nobody writes. File access goes through Spark's own file systems.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import mutations

_LOG = "_log"
#: Bytes of a file that optimize makes.
FILE_BYTES = 128 << 20
#: Times that a change starts again because another writer came first.
ATTEMPTS = 50


class Files:
    """The few file operations that tables need, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def system(self, p: str):
        return self.path(p).getFileSystem(self.conf)

    def exists(self, p: str) -> bool:
        return self.system(p).exists(self.path(p))

    def make(self, p: str) -> None:
        self.system(p).mkdirs(self.path(p))

    def remove(self, p: str) -> None:
        self.system(p).delete(self.path(p), True)

    def rename(self, a: str, b: str) -> None:
        if not self.system(a).rename(self.path(a), self.path(b)):
            raise OSError(f"cannot rename {a} to {b}")

    def folders(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system(p).listStatus(self.path(p)) if s.isDirectory()) if self.exists(p) else []

    def size(self, p: str) -> int:
        return self.system(p).getContentSummary(self.path(p)).getLength()

    def read(self, p: str) -> str:
        stream = self.system(p).open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def head(self, p: str, n: int) -> bytes:
        """The first bytes of a file, or of the first file with any in a folder."""
        fs, at = self.system(p), self.path(p)
        found = [s for s in fs.globStatus(at) or []]
        files = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if f.getLen() and not f.getPath().getName().startswith(("_", "."))]
        if not files:
            return b""
        stream = fs.open(files[0].getPath())
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, files[0].getLen())))
        finally:
            stream.close()

    def names(self, p: str) -> list[str]:
        """Files of a folder, in order."""
        return sorted(s.getPath().getName() for s in self.system(p).listStatus(self.path(p)) if s.isFile()) if self.exists(p) else []

    def write(self, p: str, text: str, new: bool = False) -> bool:
        """Put a small file in place at once, in place of one that is there; or only if none is there (``new``): False if one is."""
        part = f"{p}.{uuid.uuid4().hex}.part"
        stream = self.system(part).create(self.path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if new and self.system(p).getScheme() == "file":  # where a rename is no test of what is there, a link is
            local = [self.jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(self.path(x)).toString() for x in (part, p)]
            try:
                os.link(*local)
            except FileExistsError:
                return False
            finally:
                self.remove(part)
            return True
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(part).toUri() if "://" in part else self.jvm.java.net.URI("file:///"), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.NONE if new else options.OVERWRITE
        try:
            context.rename(self.path(part), self.path(p), array)
        except Exception:
            taken = new and self.exists(p)
            self.remove(part)
            if not taken:
                raise
            return False
        return True


class Table:
    """One table. Reads give DataFrames; changes write a new version and return how many rows they touched, where that is known."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.location, self.files = spark, path.rstrip("/"), Files(spark)

    # reading

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.location}/{_LOG}") if n[:-5].isdigit() and n.endswith(".json")]

    def exists(self) -> bool:
        return bool(self._versions())

    def version(self) -> int:
        found = self._versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.location}")
        return found[-1]

    def _state(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.location}/{_LOG}/{version:08d}.json"))

    def df(self, version: int | None = None) -> DataFrame:
        state = self._state(self.version() if version is None else version)
        return self.spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(*[f"{self.location}/{x}" for x in state["folders"]])

    def bytes(self) -> int:
        return sum(self.files.size(f"{self.location}/{x}") for x in self._state(self.version())["folders"])

    @property
    def schema(self) -> T.StructType:
        return self.df().schema

    def count(self) -> int:
        return self.df().count()

    # writing

    def _change(self, make: Callable[[DataFrame | None], DataFrame], append: bool = False) -> None:
        """Write what ``make`` gives for the current rows (None without a table) and take the next version; again from the new one if another writer has it.

        ``append``: what it gives stands beside the rows that are there."""
        written = None
        for _ in range(ATTEMPTS):
            found = self._versions()
            now = self.df(found[-1]) if found else None
            if written is None or not append:
                df, written = make(now), f"v-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.location}/{written}")
                schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
            beside = append and now is not None
            if beside and now.schema.jsonValue() != schema.jsonValue():  # the columns have changed meanwhile
                self.files.remove(f"{self.location}/{written}")
                written = None
                continue
            state = {"folders": [*(self._state(found[-1])["folders"] if beside else []), written], "schema": schema.jsonValue()}
            self.files.make(f"{self.location}/{_LOG}")
            if self.files.write(f"{self.location}/{_LOG}/{found[-1] + 1 if found else 0:08d}.json", json.dumps(state), new=True):
                return
            if not append:
                self.files.remove(f"{self.location}/{written}")
        raise RuntimeError(f"other writers of {self.location} came first {ATTEMPTS} times")

    def create(self, schema: T.StructType | str) -> Table:
        """Empty, with these columns; a table that is there is replaced."""
        self._change(lambda _: self.spark.createDataFrame([], schema))
        return self

    def overwrite(self, df: DataFrame) -> None:
        self._change(lambda _: df)

    def insert(self, rows: DataFrame | dict | Sequence) -> None:
        """Append a DataFrame, one dict, dicts or lists. Columns go by name, those that are missing are null; a missing table takes the rows' schema. What is there is not read."""
        df = rows if isinstance(rows, DataFrame) else self._frame(rows)

        def fitted(now: DataFrame | None) -> DataFrame:
            if now is None:
                return df
            unknown = [c for c in df.columns if c not in now.columns]
            if unknown:
                raise KeyError(f"no column {', '.join(unknown)}")
            return df.select(*[(df[f"`{f.name}`"] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in now.schema])

        self._change(fitted, append=True)

    def batch_insert(self, rows: Sequence, size: int = 10_000) -> int:
        """Append many dicts or lists, in slices of ``size``, a version for each; returns how many rows."""
        for k in range(0, len(rows), size):
            self.insert(rows[k : k + size])
        return len(rows)

    def _frame(self, rows: dict | Sequence) -> DataFrame:
        rows = [rows] if isinstance(rows, dict) else list(rows)
        if not rows:
            raise ValueError("no rows")
        if isinstance(rows[0], dict):
            names = list(dict.fromkeys(c for r in rows for c in r))
            if self.exists():
                kinds = {f.name: f.dataType for f in self.schema}
                unknown = [c for c in names if c not in kinds]
                if unknown:
                    raise KeyError(f"no column {', '.join(unknown)}")
            else:
                kinds = {c: infer([r.get(c) for r in rows]) for c in names}
            schema = T.StructType([T.StructField(c, kinds[c]) for c in names])
            return self.spark.createDataFrame([tuple(fit(r.get(c), kinds[c]) for c in names) for r in rows], schema)
        schema = self.schema
        if any(len(r) > len(schema) for r in rows):
            raise ValueError(f"a row has {len(schema)} values at most")
        return self.spark.createDataFrame([tuple(fit(x, f.dataType) for x, f in zip([*r, *[None] * (len(schema) - len(r))], schema, strict=True)) for r in rows], schema)

    def _now(self, now: DataFrame | None) -> DataFrame:
        if now is None:
            raise FileNotFoundError(f"no table at {self.location}")
        return now

    def upsert(self, rows: DataFrame | dict | Sequence, key: str) -> None:
        df = rows if isinstance(rows, DataFrame) else self._frame(rows)
        self._change(lambda now: mutations.upsert(self._now(now), df, key))

    def _touch(self, change: Callable[[DataFrame], DataFrame], where: Column | None) -> int:
        touched = []

        def make(now: DataFrame | None) -> DataFrame:
            touched.append(self._now(now).count() if where is None else now.filter(where).count())
            return change(now)

        self._change(make)
        return touched[-1]

    def update(self, values: dict[str, object], where: Column | None = None) -> int:
        return self._touch(lambda now: mutations.update(now, values, where), where)

    def delete(self, where: Column | None = None) -> int:
        return self._touch(lambda now: mutations.delete(now, where), where)

    def truncate(self) -> int:
        return self.delete()

    def add_column(self, name: str, kind: str | T.DataType, default: object = None) -> None:
        self._change(lambda now: mutations.add_column(self._now(now), name, kind, default))

    def drop_column(self, name: str) -> None:
        self._change(lambda now: mutations.drop_column(self._now(now), name))

    def rename_column(self, old: str, new: str) -> None:
        self._change(lambda now: mutations.rename_column(self._now(now), old, new))

    def optimize(self, files: int | None = None) -> None:
        """Rewrite into this many files, or as many as its size needs."""
        n = files or max(1, -(-self.bytes() // FILE_BYTES))
        self._change(lambda now: self._now(now).repartition(n))

    def vacuum(self) -> None:
        """Delete what the current version does not need. Not while others write: their new rows are in no version yet."""
        version = self.version()
        keep = {_LOG, *self._state(version)["folders"]}
        for name in self.files.folders(self.location):
            if name.startswith("v-") and name not in keep:
                self.files.remove(f"{self.location}/{name}")
        for old in self._versions():
            if old != version:
                with contextlib.suppress(FileNotFoundError):
                    self.files.remove(f"{self.location}/{_LOG}/{old:08d}.json")

    def drop(self, missing_ok: bool = False) -> None:
        if not missing_ok and not self.exists():
            raise FileNotFoundError(f"no table at {self.location}")
        self.files.remove(self.location)


def infer(values: Sequence) -> T.DataType:
    """The type that holds all of these Python values: text before floats before whole numbers before booleans; lists of numbers are vectors."""
    seen = [v for v in values if v is not None]
    if seen and all(isinstance(v, bool) for v in seen):
        return T.BooleanType()
    if seen and all(isinstance(v, int) and not isinstance(v, bool) for v in seen):
        return T.LongType()
    if seen and all(isinstance(v, (int, float)) for v in seen):
        return T.DoubleType()
    if seen and all(isinstance(v, (list, tuple)) and v and all(isinstance(x, (int, float)) for x in v) for v in seen):
        return T.ArrayType(T.FloatType())
    return T.StringType()


def fit(value: object, kind: T.DataType) -> object:
    """A Python value as Spark wants it for this type; what does not fit is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        if isinstance(kind, T.ArrayType):
            return [float(x) for x in value]
        if isinstance(kind, T.BooleanType):
            return value.strip().lower() in ("true", "1", "yes", "t", "y", "on") if isinstance(value, str) else bool(value)
        if isinstance(kind, (T.IntegerType, T.LongType)):
            return int(float(value)) if isinstance(value, str) and not value.strip().lstrip("+-").isdigit() else int(value)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return value

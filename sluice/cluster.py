"""What the library needs to know of the cluster it runs on."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a local master gets a temporary folder; on a cluster that is an
    error, as executors would not see it.
    """
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set(_KEY, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path.rpartition("/")[0]))
    return path


def _clear() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone: nothing is left to do then
            return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark itself uses."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[table] = path.rpartition("/")[0]
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, before the driver ends; other DataFrames are left alone."""
    for table in tables:
        folder = _folders.pop(table, None)
        if folder is not None:
            remove(table.sparkSession, folder)
            _made[:] = [m for m in _made if m[1] != folder]


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of queries that are done: Spark removes them when the driver collects its garbage, which may be long after.

    The driver's Python gives the memory of fetched tables back to the system as well.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()

"""Rounds of an iterative operator: intermediate tables in storage that every executor and the driver share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_sizes: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Whether what a statement shuffled is deleted as it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local one only where that is unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    return _own[app]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def size(df: DataFrame) -> int:
    """Rows of a table: known of one that ``rounds`` holds in the plan, else counted."""
    return _sizes[df] if df in _sizes else df.count()


def release(*tables: DataFrame) -> None:
    """Delete tables of ``rounds`` that nothing will read any more, before the rounds end."""
    for df in tables:
        if path := _paths.pop(df, None):
            delete(df.sparkSession, path)


@contextmanager
def _swept(spark: SparkSession):
    """What statements within have shuffled is deleted as they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


@contextmanager
def buckets(spark: SparkSession, column: str, n: int):
    """A function that adds rows to a table in ``n`` buckets of ``column`` and reads it whole, so that groups of that column need no shuffle; it is deleted at the end."""
    name = f"buckets_{uuid.uuid4().hex}"
    path, name = f"{shared_dir(spark)}/folioscope/{name}", f"spark_catalog.default.{name}"

    def add(df: DataFrame) -> DataFrame:
        with _swept(spark):
            df.write.bucketBy(n, column).option("path", path).saveAsTable(name, format="parquet", mode="append")
        return spark.table(name)

    try:
        yield add
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


@contextmanager
def rounds(spark: SparkSession, small: int = 0):
    """A function that writes a table and reads it back; all but the last table are deleted at the end.

    A table of at most ``small`` rows is held in the plan instead of being written, which
    spares an iterative operator the files of its many small rounds.
    """
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        if small:
            rows = df.limit(small + 1).toArrow()  # a bounded number
            if rows.num_rows <= small:
                out = spark.createDataFrame(rows, df.schema)  # a local relation, whose size the planner knows
                _sizes[out] = rows.num_rows
                return out
        made.append(f"{shared_dir(spark)}/folioscope/round-{uuid.uuid4().hex}")
        with _swept(spark):
            df.write.parquet(made[-1])
        out = spark.read.schema(df.schema).parquet(made[-1])
        _paths[out] = made[-1]
        return out

    try:
        yield keep
    finally:
        for path in made[:-1]:
            delete(spark, path)

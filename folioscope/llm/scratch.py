"""Intermediate tables in storage that every executor and the driver share.

A stage boundary is a Parquet table below ``spark.checkpoint.dir``: it cuts the
lineage, survives the loss of executors, and keeps a scan of whole texts from
being repeated.  No machine-local folder is used unless the setting is unset,
which is the case in tests only.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows in Arrow format.
BATCH_BYTES = 8 << 20
_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local one only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    return _own[app]


def bound_batches(spark: SparkSession) -> None:
    """Batches of rows that go to Python hold ``BATCH_BYTES`` at most, as texts may be long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if now is not None and int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/folioscope/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def few(df: DataFrame, rows: int, per: int = 1_000_000, least: int = 8) -> DataFrame:
    """``df`` in no more tasks than so many rows need: a shuffle of a small table ends in few tasks, of a large one in as many as before."""
    return df.coalesce(max(least, rows // per + 1))


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hashable(column: Column, kind: str) -> list[Column]:
    """Columns whose hashes tell two values apart: nulls within arrays and structs, which a hash passes over, are spelt out."""
    if kind not in ("array", "struct", "map", "variant"):
        return [column]
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return [F.to_json(column, {"ignoreNullFields": "false", "timestampFormat": stamp + "XXX", "timestampNTZFormat": stamp})]


def row_key(df: DataFrame, text_col: str):
    """Column of 16 bytes that stand for a whole row: equal for rows equal in all columns only."""
    parts = []
    for f in df.schema.fields:
        if f.name != text_col and f.dataType.typeName() != "void":
            parts += [*_hashable(df[f.name], f.dataType.typeName()), df[f.name].isNull()]  # a hash passes over nulls
    rest = [F.hex(F.xxhash64(F.lit(seed), *parts)) for seed in (1, 2)]
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.md5(df[text_col].cast("binary")), F.lit("null")), *rest)))


def numbered(counted: DataFrame, same: str, number: str, span: int = 1 << 16) -> DataFrame:
    """Each row of a written table ``same`` times, numbered from 1; of rows that are very many, ``span`` a time in tasks of their own."""
    if counted.filter(F.col(same) > span).limit(1).count():
        first = F.sequence(F.lit(1).cast("long"), F.col(same), F.lit(span).cast("long"))
        counted = counted.withColumn(number, F.explode(first)).repartition(*[c for c in counted.columns], number)
        return counted.withColumn(number, F.explode(F.sequence(F.col(number), F.least(F.col(number) + span - 1, F.col(same)))))
    return counted.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(same))))

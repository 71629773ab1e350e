"""Tables as files of key ranges, and a merge that rewrites only the files its keys are in.

A table is a list of Parquet files, each sorted by the table's layout columns, with an
entry that tells the file's rows, the least and greatest value of some columns, sums of
others, and a fingerprint of its content.  Entries, not folders, say what belongs to the
table, so a file is replaced by naming another one.

``merge`` puts rows into a table by key.  Entries whose range the keys miss are passed
over unread; of the others only the key columns are read, once, to see which files hold a
key; those alone are read whole, without the keys, and written anew together with the
rows.  Files no key falls in stay as they are, whatever the size of the table.  Rows that
are new make files of their own ranges; many small files are put together by ``compact``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a file, at most.
FILE_ROWS = 1 << 20
#: Files that are not worth a look at the range of the keys first.
FEW_FILES = 8
#: So many files below a quarter of that size are put together.
SMALL_FILES = 16
_NESTED = ("array", "struct", "map", "variant")


@dataclass(frozen=True)
class Layout:
    """How a table lies in files: the columns of its order, those whose range and whose sum an entry tells."""

    order: tuple[str, ...]
    ranges: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    file_rows: int = FILE_ROWS

    @property
    def ranged(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.order[0], *self.ranges)))


@dataclass
class Merge:
    """What a merge did: the table's entries, and how much it read and wrote."""

    entries: list[dict]
    scanned: int = 0  # files whose keys were read
    rewritten: int = 0  # files that are replaced
    added: list[dict] = field(default_factory=list)


def _spelt(df: DataFrame) -> list[Column]:
    """Every column, null told from nothing, nested values spelt out."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        out += [F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if kind in _NESTED else F.col(f.name), F.col(f.name).isNull()]
    return out


def fingerprint(df: DataFrame) -> Column:
    """An aggregate that is equal for equal rows in any order: two sums of row hashes of independent seeds."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *_spelt(df)).cast("decimal(38,0)")).cast("string") for seed in (3, 5)]
    return F.concat_ws(":", *[F.coalesce(s, F.lit("0")) for s in sums])


def entries_of(spark: SparkSession, schema: StructType, folder: str, layout: Layout) -> list[dict]:
    """An entry for each file of a folder that was written: one pass over these files."""
    df = spark.read.schema(schema).parquet(folder)
    bounds = [f(c).alias(f"{n}_{c}") for c in layout.ranged for n, f in (("lo", F.min), ("hi", F.max))]
    totals = [F.sum(c).alias(f"sum_{c}") for c in layout.sums]
    found = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), *bounds, *totals, fingerprint(df).alias("content"))
    return sorted((r.asDict() for r in found.collect()), key=lambda r: r["path"])  # a row for each file


def write(df: DataFrame, schema: StructType, folder: str, layout: Layout) -> list[dict]:
    """Write rows below ``folder`` in files of ranges that follow each other; their entries."""
    target = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    rows.repartitionByRange(*layout.order).sortWithinPartitions(*layout.order).write.option("maxRecordsPerFile", layout.file_rows).parquet(target)
    return entries_of(df.sparkSession, schema, target, layout)


def read(spark: SparkSession, schema: StructType, entries: list[dict]) -> DataFrame:
    """The rows of some files."""
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[e["path"] for e in entries])


def _meeting(entries: list[dict], column: str, lo, hi) -> list[dict]:
    """Entries whose range of a column meets a range; all, if either is not known."""
    if lo is None:
        return entries
    return [e for e in entries if e.get(f"lo_{column}") is None or (e[f"lo_{column}"] <= hi and e[f"hi_{column}"] >= lo)]


def holding(spark: SparkSession, schema: StructType, entries: list[dict], keys: DataFrame, on: list[str], layout: Layout) -> tuple[list[dict], int]:
    """The files that hold a key, and how many files' key columns were read for it.

    A file is passed over if the range of a key column that its entry tells does not meet that of the keys.
    """
    known = [c for c in on if c in layout.ranged]
    if known and len(entries) > FEW_FILES:
        row = keys.agg(*[f(c).alias(f"{n}_{c}") for c in known for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for c in known:
            entries = _meeting(entries, c, row[f"lo_{c}"], row[f"hi_{c}"])
    if not entries:
        return [], 0
    seen = read(spark, schema, entries).select(*on, F.col("_metadata.file_path").alias("file__"))
    paths = {r["file__"] for r in seen.join(keys.select(*on).distinct(), on, "left_semi").select("file__").distinct().collect()}  # a row for each file
    return [e for e in entries if e["path"] in paths], len(entries)


def merge(spark: SparkSession, schema: StructType, entries: list[dict], rows: DataFrame | None, gone: DataFrame | None, on: list[str], folder: str, layout: Layout, held: list[dict] | None = None) -> Merge:
    """Put ``rows`` into a table in place of those of equal key, and take the keys ``gone`` out; both are tables that can be read again.

    ``held``: the files that hold a key, where ``holding`` has told them already.
    """
    keys = rows.select(*on) if rows is not None else None
    if gone is not None:
        keys = gone.select(*on) if keys is None else keys.unionByName(gone.select(*on))
    held, scanned = (held, 0) if held is not None else holding(spark, schema, entries, keys, on, layout)
    fresh = read(spark, schema, held).join(keys.distinct(), on, "left_anti").select(*schema.names) if held else None
    if rows is not None:
        new = rows.select(*schema.names)
        fresh = new if fresh is None else fresh.unionByName(new)
    paths = {e["path"] for e in held}
    added = write(fresh, schema, folder, layout) if fresh is not None else []
    return Merge([e for e in entries if e["path"] not in paths] + added, scanned, len(held), added)


def compact(spark: SparkSession, schema: StructType, entries: list[dict], folder: str, layout: Layout, small: int = SMALL_FILES) -> list[dict]:
    """The entries, after small files were put together if there are many; rows are not changed."""
    few = [e for e in entries if e["rows"] < layout.file_rows // 4]
    if len(few) < small:
        return entries
    paths = {e["path"] for e in few}
    return [e for e in entries if e["path"] not in paths] + write(read(spark, schema, few), schema, folder, layout)


def greatest(entries: list[dict], column: str, default=0):
    """The greatest value of a column that entries tell, without reading a file."""
    return max((e[f"hi_{column}"] for e in entries if e[f"hi_{column}"] is not None), default=default)


def damaged(spark: SparkSession, schema: StructType, entries: list[dict]) -> list[str]:
    """Files whose rows are not those that were written: by count and content of each."""
    if not entries:
        return []
    df = read(spark, schema, entries)
    found = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), fingerprint(df).alias("content"))
    now = {r["path"]: (r["rows"], r["content"]) for r in found.collect()}  # a row for each file
    return [e["path"] for e in entries if now.get(e["path"]) != (e["rows"], e["content"])]



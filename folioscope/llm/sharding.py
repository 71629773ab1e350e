"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records over memory-sized buckets by a seeded hash.  Pass 2
loads one bucket at a time, shuffles it by Fisher-Yates with a generator seeded by
(seed, bucket), and lays the buckets end to end: every order of the records is as
likely as any other.  Shards are equal ranges of that sequence, so their row counts
differ by one at most (law ``rows``).

The scatter hashes a key of the whole row and a copy number: rows that are equal in all
columns are counted first and numbered, so an id or a text that holds a third of all rows
fills no bucket beyond its share.  Only ids, sizes, checksums and keys are shuffled to
place the records.

Null texts count no bytes and have a null checksum; null ids are placed as any
value; equal rows are separate records; an empty table gives no rows.  Further columns
are written unchanged, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import materialize, numbered, row_key, unused

#: Bytes of records that pass 2 holds in memory at once, and rows, whichever is less.
BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 1 << 14
RECORD_BYTES = 16
#: Buckets whose counts one task sums up.
_SPAN = 4096


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 23) -> DataFrame:
    """One row per record: doc_id, row (a key of all its columns), size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    body = docs[text_col].cast("binary")
    narrow = docs.select(docs[id_col].alias("doc_id"), (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), row_key(docs, text_col).alias("row"))
    counted = materialize(narrow.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "text_crc32")], F.count(F.lit(1)).alias("same")), "shard-keys")
    total = counted.agg(F.sum("same").alias("rows"), F.sum(F.col("same") * F.col("size")).alias("bytes")).first()
    rows, size = int(total["rows"] or 0), int(total["bytes"] or 0)
    buckets = max(shards, -(-size // BUCKET_BYTES), -(-rows // BUCKET_ROWS))
    scattered = numbered(counted, "same", "copy")
    scattered = scattered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "row", "copy"), F.lit(buckets)))
    kind = counted.schema["doc_id"].dataType.simpleString()

    def shuffle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        # the arrival order depends on the cluster, so a fixed order comes first
        table = table.sort_by([(c, "ascending") for c in ("row", "copy")])
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(table))
        out = table.select(["doc_id", "row", "size", "text_crc32", "bucket"]).take(pa.array(order))
        return out.append_column("at", pa.array(np.arange(len(table)), pa.int64()))

    shuffled = scattered.select("doc_id", "row", "size", "text_crc32", "copy", "bucket").groupBy("bucket").applyInArrow(shuffle, f"doc_id {kind}, row binary, size long, text_crc32 long, bucket long, at long")
    shuffled = materialize(shuffled, "shard-buckets")
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("bucket") / _SPAN))
    spans = counts.groupBy("span").agg(F.sum("n").alias("m"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    before = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("in_span", F.coalesce(F.sum("n").over(before), F.lit(0))).join(spans, "span").select("bucket", (F.col("base") + F.col("in_span")).alias("base"))
    shard = F.expr(f"((base + at) * {shards}) div {max(rows, 1)}")
    first = F.expr(f"(shard * {max(rows, 1)} + {shards - 1}) div {shards}")
    out = shuffled.join(starts, "bucket").withColumn("shard", shard).withColumn("slot", F.expr("base + at") - first)
    return out.select("doc_id", "row", "size", "text_crc32", F.col("shard").cast("int"), F.col("slot").cast("long"))


def write(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 23) -> None:
    """Write the records below ``path``/shard=N in the order of their slots.

    Each record is written once with all its columns; the column of the shard is ``shard``,
    or a longer name where the records have one called so.
    """
    plan = materialize(place(docs, shards, id_col, text_col, seed).select("row", "shard", "slot"), "shard-plan")
    own, key, slot = (unused(c, docs.columns) for c in ("row__", "key__", "slot__"))
    named = unused("shard", docs.columns)
    rows = docs.withColumn(own, row_key(docs, text_col))
    if plan.groupBy("row").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates([own])
    places = plan.select(F.col("row").alias(key), F.col("shard").alias(named), F.col("slot").alias(slot))
    out = rows.join(places, rows[own] == places[key]).select(*docs.columns, named, slot)
    out.repartition(named).sortWithinPartitions(named, slot).drop(slot).write.partitionBy(named).parquet(path)

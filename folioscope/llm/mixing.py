"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a seeded hash.  A document's *virtual
finish time* is the number of its source's words up to and with it, divided by its
source's target; further passes over the source follow the first.  In order of
virtual time every source is served in proportion to its target, so the mix is the
range-sorted sequence, cut where the total budget is reached.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the
budget; a target stops at ``max_repeats`` times its source's size and the excess is
shared anew by weight until none is above.

Scale: one pass over the texts gives a narrow table, written to the shared folder, in
which rows that are equal in all columns are counted and then numbered, so no id that
repeats, or is null, fills a bucket.
Running sums are two-level - within (source, hash bucket), then over the buckets of
a source - so a source that holds a third of all rows is spread over its buckets.
The cut is found by histograms of virtual time, each of bounded size, that narrow
the crossing bin down to a single value: no sort of everything in one task.
The table of sources has one row for each name in the mix.

Null and empty texts have size 0 and take no words; a source without words has
target 0; a null source is a source; rows that repeat are separate documents, also of one
id or of none (rows equal in all columns may swap their places).  Ties in virtual time at
the cut are all taken.  Further columns are carried unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import materialize, numbered, release, row_key, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hash buckets of each source for its running sum.
BUCKETS = 1024
#: Bins of one histogram of virtual time.
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(key, source, source_size) to the same with ``target double``: budget shared by weight under caps.

    A source is at its cap exactly if the level at which the rest share what is left
    reaches it; by rising cap over weight the capped sources come first, so the level
    is known from running sums.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = (
        sizes.withColumn("rank", F.row_number().over(named) - 1)
        .withColumn("w", w)
        .withColumn("cap", max_repeats * F.col("source_size").cast("double"))
        .withColumn("r", F.col("cap") / F.col("w"))
    )
    rising = Window.orderBy("r", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(rising), F.lit(0.0)))
    free = ranked.withColumn("level", level).withColumn("rest", F.when(F.col("r") > F.col("level"), F.struct("r", "rank", "level")))
    first = F.min("rest").over(whole)["level"]  # of the first source that is not capped
    return free.withColumn("target", F.least("cap", F.coalesce(F.col("w") * first, F.col("cap")))).select("key", "source_size", "target")


def schedule(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, row (a key of all its columns), size, source_size, target, finish (words of its source up to and with it), copies.

    ``copies`` is how often the mix takes the document, ``taken`` = size * copies.
    """
    narrow = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("n")).alias("key"),
        docs[source_col].alias("source"),
        word_count(docs[text_col]).alias("size"),
        row_key(docs, text_col).alias("row"),
    )
    counted = materialize(narrow.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "key", "source", "size")], F.count(F.lit(1)).alias("same")), "mix-rows")
    narrow = numbered(counted, "same", "copy").withColumn("h", F.xxhash64(F.lit(seed), "row", "copy")).drop("same")
    narrow = materialize(narrow.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))), "mix-sizes")
    release(counted)
    buckets = narrow.groupBy("key", "bucket").agg(F.sum("size").alias("n"), F.first("source", ignorenulls=True).alias("source"))
    sums = materialize(buckets, "mix-buckets")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    goal = targets(sums.groupBy("key").agg(F.sum("n").alias("source_size"), F.first("source", ignorenulls=True).alias("source")), weights, max_repeats)
    base = base.join(goal, "key")
    within = Window.partitionBy("key", "bucket").orderBy("h", "row", "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        narrow.withColumn("upto", F.sum("size").over(within))
        .join(base, ["key", "bucket"])
        .select("doc_id", "row", "key", "size", "source_size", "target", (F.col("base") + F.col("upto")).alias("finish"))
    )
    placed = materialize(placed, "mix-placed")
    release(narrow, sums)
    cut = _cut(placed, max_repeats)
    times = [(F.col("finish") + k * F.col("source_size")) / F.col("target") for k in range(max_repeats)]
    copies = sum((F.when((F.col("target") > 0) & (t <= F.lit(cut)), 1).otherwise(0) for t in times), F.lit(0)) if cut is not None else F.lit(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0))
    out = placed.withColumn("copies", copies.cast("int"))
    return out.withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def _cut(placed: DataFrame, max_repeats: int) -> float | None:
    """The virtual time at which the words served reach the budget; None without words."""
    entries = (
        placed.filter((F.col("size") > 0) & (F.col("target") > 0))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .select("size", ((F.col("finish") + F.col("pass") * F.col("source_size")) / F.col("target")).alias("v"))
    )
    top = placed.agg(F.sum("size").alias("n")).first()["n"]
    if not top:
        return None
    served, lo, hi = 0, 0.0, float(1 << 40)
    width = 2.0  # the cut is at 1 or little above; what lies beyond the last bin shares it
    while True:
        step = width / BINS
        bin_ = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(step)), F.lit(BINS - 1)).cast("int")
        inside = entries.filter((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))).groupBy(bin_.alias("bin"))
        rows = sorted(inside.agg(F.sum("size").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect(), key=lambda r: r["bin"])
        if not rows:
            return None
        for r in rows:
            if served + r["n"] >= top or r is rows[-1]:
                if r["a"] == r["b"]:
                    return r["b"]
                lo, hi = r["a"], r["b"]
                width = (hi - lo) * (1 + 1e-12) or 1e-300
                break
            served += r["n"]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partitions: int | None = None, **options) -> DataFrame:
    """The mixed sequence: rows of ``docs`` in order of virtual time, each as often as the mix takes it.

    The columns are those of ``docs``.  A document's copies carry its row unchanged.
    Turns meet their row by its key; the turns of a row that repeats very often are a
    skewed key of an inner join, which adaptive execution splits.
    """
    plan = materialize(schedule(docs, id_col, text_col, source_col, **options).filter("copies > 0").select("row", "finish", "copies", "source_size", "target"), "mix-turns")
    own, key, finish, copies, size, target, at, copy = (unused(c, docs.columns) for c in ("row__", "key__", "finish__", "copies__", "size__", "target__", "virtual__", "copy__"))
    turns = plan.select(F.col("row").alias(key), F.col("finish").alias(finish), F.col("copies").alias(copies), F.col("source_size").alias(size), F.col("target").alias(target))
    rows = docs.withColumn(own, row_key(docs, text_col))
    if plan.groupBy("row").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates([own])
    joined = rows.join(turns.hint("merge"), rows[own] == turns[key])
    joined = joined.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    out = joined.withColumn(at, (F.col(finish) + F.col(copy) * F.col(size)) / F.col(target))
    return (out.repartitionByRange(partitions, at) if partitions else out.repartitionByRange(at)).sortWithinPartitions(at).select(*docs.columns)

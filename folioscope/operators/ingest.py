"""Incremental ingest: difference of a listing and the stored paths, merge and sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conflict_kind(name: Column) -> Column:
    """P2. How a file name tells of a sync conflict, or null."""
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")
    return F.when(F.lower(name).contains("conflicted copy"), F.lit("drive_conflicted_copy")).when(stem.rlike(r"\s\([0-9]+\)$"), F.lit("drive_numbered"))


def classify(listing: DataFrame, occurrences: DataFrame) -> DataFrame:
    """P3, P4. Listing (rel_path, size_bytes, mtime) with ``state``: new, changed or unchanged.

    Unchanged: the path is stored, live, and of equal time and size.  A path that comes
    back after it was missing is changed.
    """
    old = occurrences.select(F.col("rel_path").alias("rel_path__"), F.col("mtime").alias("mtime__"), F.col("size_bytes").alias("size__"), F.col("missing_since").alias("missing__"))
    joined = listing.join(old, F.col("rel_path") == F.col("rel_path__"), "left")
    same = F.col("missing__").isNull() & (F.col("mtime") == F.col("mtime__")) & (F.col("size_bytes") == F.col("size__"))
    state = F.when(F.col("rel_path__").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return joined.withColumn("state", state).select(*listing.columns, "state")


def merge_documents(documents: DataFrame, hashed: DataFrame, now: Column, top: int | None = None) -> DataFrame:
    """K1. Documents by content: a stored row keeps what it knows and fills what it lacks.

    New ids follow the largest stored one, or ``top``, in order of digest.  ``hashed``:
    sha256, size_bytes, mime, page_count.  Rows depend on the stored ones of their digest
    only, so with ``top`` those of the digests in ``hashed`` are all that is needed.
    """
    found = hashed.groupBy("sha256").agg(F.max("size_bytes").alias("size_bytes"), F.min("mime").alias("mime"), F.min("page_count").alias("page_count"))
    o, n = documents.alias("o"), found.alias("n")
    joined = o.join(n, F.col("o.sha256") == F.col("n.sha256"), "full_outer")
    touched = F.col("n.sha256").isNotNull()
    merged = joined.select(
        F.col("o.document_id").alias("document_id"),
        F.coalesce("o.sha256", "n.sha256").alias("sha256"),
        F.coalesce("o.size_bytes", "n.size_bytes").alias("size_bytes"),
        F.coalesce("o.mime", "n.mime").alias("mime"),
        F.coalesce("o.page_count", "n.page_count").alias("page_count"),
        F.coalesce("o.first_seen_at", now).alias("first_seen_at"),
        F.when(touched, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )
    if top is None:
        top = documents.agg(F.coalesce(F.max("document_id"), F.lit(0)).alias("top")).first()["top"]
    fresh = numbered(merged.filter("document_id IS NULL"), F.substring("sha256", 1, 3), "sha256", "document_id", top)
    return merged.filter("document_id IS NOT NULL").unionByName(fresh)


def numbered(rows: DataFrame, head: Column, key: str, number: str, top: int) -> DataFrame:
    """``number`` from ``top`` + 1 in order of ``head`` and a distinct key: places among rows of one head, after the rows of the heads before."""
    head = F.coalesce(head, F.lit(""))
    before = Window.orderBy("head__").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(head.alias("head__")).agg(F.count(F.lit(1)).alias("n__")).select("head__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("base__"))
    placed = rows.withColumn("in__", head).withColumn("place__", F.row_number().over(Window.partitionBy("in__").orderBy(key)))
    joined = placed.join(heads, F.col("in__") == F.col("head__"))
    return joined.withColumn(number, (F.lit(top) + F.col("base__") + F.col("place__")).cast("bigint")).select(*rows.columns)


def merge_occurrences(occurrences: DataFrame, seen: DataFrame, scan_id: int, now: Column, top: int | None = None) -> DataFrame:
    """K2, K3. Paths after a scan.  ``seen``: rel_path, size_bytes, mtime, state, document_id (null where unchanged), conflict_kind; ``top`` as for documents."""
    o, n = occurrences.alias("o"), seen.alias("n")
    joined = o.join(n, F.col("o.rel_path") == F.col("n.rel_path"), "full_outer")
    here = F.col("n.rel_path").isNotNull()
    moved = here & (F.col("n.state") != "unchanged")
    pick = lambda c: F.when(moved, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    merged = joined.select(
        F.col("o.occurrence_id").alias("occurrence_id"),
        pick("document_id"),
        F.coalesce("o.rel_path", "n.rel_path").alias("rel_path"),
        pick("mtime"),
        pick("size_bytes"),
        F.when(here, now).otherwise(F.col("o.seen_at")).alias("seen_at"),
        F.when(~here, F.col("o.missing_since")).alias("missing_since"),
        F.when(here, F.col("n.conflict_kind")).otherwise(F.col("o.conflict_kind")).alias("conflict_kind"),
        F.when(moved, now).otherwise(F.col("o.hashed_at")).alias("hashed_at"),
        F.when(here, F.lit(scan_id).cast("bigint")).otherwise(F.col("o.last_scan_id")).alias("last_scan_id"),
    )
    if top is None:
        top = occurrences.agg(F.coalesce(F.max("occurrence_id"), F.lit(0)).alias("top")).first()["top"]
    fresh = numbered(merged.filter("occurrence_id IS NULL"), F.regexp_extract("rel_path", "(?s)^(.*)/", 1), "rel_path", "occurrence_id", top)
    return merged.filter("occurrence_id IS NOT NULL").unionByName(fresh)


def sweep(occurrences: DataFrame, scan_id: int, now: Column) -> DataFrame:
    """J11, I1. Live paths that the scan did not see are missing from now on; by token, not by clock."""
    unseen = F.col("missing_since").isNull() & (F.col("last_scan_id").isNull() | (F.col("last_scan_id") < scan_id))
    return occurrences.withColumn("missing_since", F.when(unseen, now).otherwise(F.col("missing_since")))


def missing(stored: DataFrame, seen: DataFrame, key: str = "rel_path") -> DataFrame:
    """J11. Stored keys that are not in the listing."""
    return stored.join(seen.select(key).distinct(), key, "left_anti")


def summary(states: DataFrame) -> DataFrame:
    """A5. Counters of a scan, one row; ``state`` may also be error or missing."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    scanned = F.count_if(F.col("state").isin("new", "changed", "unchanged")).alias("scanned")
    return states.agg(scanned, count("new"), count("changed"), count("unchanged"), count("missing"), count("error"))

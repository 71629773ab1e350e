"""Ingest of listings as a stream; an extension of the batch.

Every micro-batch is a scan: its batch id is the monotonic token, so a batch that is
run again after a failure gives the same state.  A batch reads the keys of files that its
paths and digests may be in, and rewrites those that hold one; a full scan sees every path,
and writes all occurrences anew.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope import ranged
from folioscope.operators import ingest
from folioscope.scratch import rounds
from folioscope.store import Store


def absorb(store: Store, listing: DataFrame, scan_id: int, full: bool = False) -> DataFrame:
    """One scan: listing (rel_path, size_bytes, mtime, sha256, and mime and page_count if known) into the store; the states of its paths.

    full: what the listing lacks is missing.
    """
    now = F.lit(datetime.now(timezone.utc)).cast("timestamp")
    change = store.change()
    with rounds(store.spark) as keep:
        listing = keep(listing.dropDuplicates(["rel_path"]))
        paths = None
        if full:
            occurrences = change.read("occurrence")
        else:
            paths, occurrences = change.hold("occurrence", listing, ["rel_path"])
        states = keep(ingest.classify(listing, occurrences))
        told = {"mime": "string", "page_count": "int"}
        fresh = keep(states.filter("state <> 'unchanged'").select("sha256", "size_bytes", *[(F.col(c) if c in states.columns else F.lit(None)).cast(kind).alias(c) for c, kind in told.items()]))
        held, documents = change.hold("document", fresh, ["sha256"])
        merged = ingest.merge_documents(documents, fresh, now, ranged.greatest(change.entries("document"), "document_id"))
        merged = keep(_whole(merged, documents))
        change.merge("document", ["sha256"], merged, held=held)
        seen = states.join(merged.select("sha256", "document_id"), "sha256", "left").withColumn("conflict_kind", ingest.conflict_kind(F.substring_index("rel_path", "/", -1)))
        landed = ingest.merge_occurrences(occurrences, seen, scan_id, now, ranged.greatest(change.entries("occurrence"), "occurrence_id"))
        if full:
            change.replace("occurrence", ingest.sweep(landed, scan_id, now))
        else:
            change.merge("occurrence", ["rel_path"], keep(landed), held=paths)
        change.commit()
        return keep(states)


def _whole(merged: DataFrame, documents: DataFrame) -> DataFrame:
    """Merged identity columns beside the other columns of stored documents."""
    rest = documents.select("document_id", *[c for c in documents.columns if c not in merged.columns])
    return merged.join(rest, "document_id", "left")


def start(store: Store, listings: DataFrame, checkpoint: str) -> StreamingQuery:
    """Absorb a stream of listings; new and changed paths only, since a stream never sees all of a folder."""

    def run(batch: DataFrame, batch_id: int) -> None:
        absorb(store, batch, batch_id + 1)

    return listings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()

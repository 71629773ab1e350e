"""Last sightings of paths as keyed state, with timers for the missing sweep.

A stream of listings (rel_path, size_bytes, mtime, scanned_at) becomes a stream of states.
Each path keeps its last time, size and sighting in the state store, so a micro-batch costs
what its own paths cost, whatever the size of the index.  The sweep is a timer of each path:
when the watermark passes its last sighting by the patience, the path is missing.

Defined results: a path that is sighted again after it was missing is ``changed``; of
sightings of one path and one ``scanned_at`` the least by time and size counts; sightings
that are not later than the path's last one, and rows without a path or a ``scanned_at``,
give no state; times and sizes that are null on both sides are equal; further columns are left
out; an empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = "rel_path string, size_bytes long, mtime double, state string, at timestamp"
_KEPT = "size_bytes long, mtime double, seen_ms long, missing boolean"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_CHANGELOG = ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _ms(at: datetime) -> int:
    at = at.astimezone(timezone.utc)  # a time without a zone is the worker's own
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def _order(row: Row) -> tuple:
    values = (row.mtime, row.size_bytes)
    return (row.scanned_at, *((v is not None, v or 0) for v in values))


class Sightings(StatefulProcessor):
    """The state of one path: what it was last, when it was seen, and whether it is missing."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _KEPT)

    def _expect(self, seen_ms: int, before_ms: int | None) -> None:
        if before_ms is not None:
            self.handle.deleteTimer(before_ms + self.patience_ms)
        self.handle.registerTimer(seen_ms + self.patience_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.update((initialState.size_bytes, initialState.mtime, initialState.seen_ms, initialState.missing))
        if not initialState.missing:
            self._expect(initialState.seen_ms, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get() if self.last.exists() else None
        timed = known[2] if known is not None and not known[3] else None
        stored = known
        for row in sorted(rows, key=_order):  # the scans of one path that one batch has
            seen = _ms(row.scanned_at)
            if known is not None and seen <= known[2]:
                continue
            same = known is not None and not known[3] and (known[0], known[1]) == (row.size_bytes, row.mtime)
            state = "new" if known is None else "unchanged" if same else "changed"
            known = (row.size_bytes, row.mtime, seen, False)
            yield Row(rel_path=key[0], size_bytes=row.size_bytes, mtime=row.mtime, state=state, at=row.scanned_at)
        if known is not stored:
            self.last.update(known)
            self._expect(known[2], timed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        size, mtime, seen, _ = self.last.get()
        self.last.update((size, mtime, seen, True))
        at = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        yield Row(rel_path=key[0], size_bytes=size, mtime=mtime, state="missing", at=at)

    def close(self) -> None:
        pass


def track(listings: DataFrame, patience: timedelta, occurrences: DataFrame | None = None, late: str = "0 seconds") -> DataFrame:
    """States of a stream of listings: (rel_path, size_bytes, mtime, state, at).

    state: new, changed, unchanged, or missing ``patience`` after the last sighting.
    ``occurrences``: a stored index to start from, of distinct paths (rel_path, size_bytes,
    mtime, seen_at, missing_since).  Start the query within ``state_store``.
    """
    typed = listings.select("rel_path", F.col("size_bytes").cast("long"), F.col("mtime").cast("double"), F.col("scanned_at").cast("timestamp"))
    sighted = typed.filter("rel_path IS NOT NULL AND scanned_at IS NOT NULL").withWatermark("scanned_at", late)
    first = None
    if occurrences is not None:
        seen = F.unix_millis(F.col("seen_at").cast("timestamp"))
        first = occurrences.select("rel_path", F.col("size_bytes").cast("long"), F.col("mtime").cast("double"), seen.alias("seen_ms"), F.col("missing_since").isNotNull().alias("missing"))
        first = first.filter("rel_path IS NOT NULL AND seen_ms IS NOT NULL").groupBy("rel_path")
    processor = Sightings(patience // timedelta(milliseconds=1))
    return sighted.groupBy("rel_path").transformWithState(processor, STATES, "append", "eventTime", first)


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started within keep their state in the store on disk, and checkpoint its changes only."""
    before = {name: spark.conf.get(name, None) for name, _ in (_PROVIDER, _CHANGELOG)}
    for name, value in (_PROVIDER, _CHANGELOG):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)

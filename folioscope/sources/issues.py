"""Issues with their edges from a paged source, newest updated first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

PAGES, PAGE_SIZE = 20, 100
_EDGES = "array<struct<number:bigint,state:string>>"
SCHEMA = f"number long, id long, title string, state string, closed_at timestamp, created_at timestamp, updated_at timestamp, body string, labels array<string>, blocked_by {_EDGES}, blocking {_EDGES}"

#: Fetches a page: (cursor or None) to (nodes, next cursor or None).
Fetch = Callable[[str | None], tuple[list[dict], str | None]]


class SourceError(RuntimeError):
    """The source gave no page."""


def walk(fetch: Fetch, since: datetime | None = None, pages: int = PAGES) -> Iterator[dict]:
    """Nodes page by page, up to the first that was updated at or before ``since``: those after it are older still."""
    cursor = None
    for _ in range(pages):
        found = fetch(cursor)
        if found is None:
            raise SourceError("the source has no issues")
        nodes, cursor = found
        for node in nodes:
            if since is not None and (at := _time(node.get("updatedAt"))) is not None and at <= since:
                return
            yield node
        if cursor is None:
            return


def read(spark: SparkSession, fetch: Fetch, since: datetime | None = None, pages: int = PAGES) -> DataFrame:
    """Issues as a table.  A bounded number of pages passes through the driver, as the source gives one after another."""
    return spark.createDataFrame([_row(n) for n in walk(fetch, since, pages)], SCHEMA)


def _row(node: dict) -> tuple:
    nested = lambda x: (x.get("nodes") if isinstance(x, dict) else x) or []
    edges = lambda x: [(int(e["number"]), str(e.get("state") or "OPEN").upper()) for e in nested(x) if e and e.get("number") is not None]
    labels = [n if isinstance(n, str) else n["name"] for n in nested(node.get("labels"))]
    times = [_time(node.get(c)) for c in ("closedAt", "createdAt", "updatedAt")]
    return (node["number"], node.get("databaseId"), node.get("title") or "", node.get("state"), *times, node.get("body") or "", labels, edges(node.get("blockedBy")), edges(node.get("blocking")))


def _time(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None

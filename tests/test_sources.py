"""Issues by pages and the made-up collection."""

from datetime import datetime, timezone

import pytest

from folioscope.operators import search, workflow
from folioscope.sources import demo, issues


def test_issues_by_pages(spark):
    asked = []

    def fetch(cursor):
        asked.append(cursor)
        at = int(cursor or 0)
        nodes = [{"number": 10 * at + k, "updatedAt": f"2026-01-{28 - 3 * at - k:02}T00:00:00+00:00", "state": "OPEN", "labels": {"nodes": [{"name": "stage:build"}]}, "blockedBy": {"nodes": [{"number": 1, "state": "closed"}, {"number": 2}, None]}} for k in range(3)]
        return nodes, str(at + 1) if at < 4 else None

    found = issues.read(spark, fetch)
    assert found.count() == 15 and asked == [None, "1", "2", "3", "4"]
    row = found.filter("number = 0").first()
    assert [(e.number, e.state) for e in row.blocked_by] == [(1, "CLOSED"), (2, "OPEN")] and row.labels == ["stage:build"]
    assert {r.lane: r.blocked for r in workflow.lane_summary(found).collect()}["build"] == 15
    asked.clear()
    assert [n["number"] for n in issues.walk(fetch, datetime(2026, 1, 24, tzinfo=timezone.utc))] == [0, 1, 2, 10] and asked == [None, "1"]
    assert len(list(issues.walk(fetch, pages=2))) == 6
    with pytest.raises(issues.SourceError):
        list(issues.walk(lambda c: None))


def test_demo(spark):
    docs = demo.corpus(spark, 40).cache()
    posts, lens = search.postings(docs), search.lengths(docs)
    count = lambda q: search.find(q, posts, lens, None).count()
    assert docs.count() == 40 and docs.select("sha256").distinct().count() == 40
    assert [count(q) for q in ("Ines Calder", "QX-4471", "Osei", "Harrow AND Fenwater", "Filler")] == [3, 2, 1, 0, 36]
    assert demo.corpus(spark, 2).count() == 2
    with pytest.raises(ValueError):
        demo.corpus(spark, 0)

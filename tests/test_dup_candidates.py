"""Candidates for duplicates: scores against a loop, and texts that are cut into words once."""

import re

from folioscope.operators import workflow

QUERY = "The idiot and the trash rights in SRC1 en, idiot"
ISSUES = [
    (1, "Idiot trash", "rights rights idiot", ["en", "src1"]),
    (2, "idiots xtrash en_", "Trash-RIGHTS src1 src12", ["src1/en", "other"]),
    (3, None, "rights", None),
    (4, "", None, ["en", None]),
    (5, "İdiot K", "\ntrash\nénéen src1é", []),
    (6, "nothing", "at all the in and", ["label"]),
    (7, None, None, None),
    (8, "trash", "idiot", ["trash trash"]),
    (8, "trash", "idiot", ["trash trash"]),
]


def _loop(issues, weights):
    """(number, score) of every issue that scores, best first."""
    words = lambda text: set(re.findall("[a-z0-9]+", (text or "").lower()))
    out = []
    for number, title, body, labels in issues:
        t, b, found = words(title), words(body), words(" ".join(x for x in labels or [] if x is not None))
        score = sum((weights[0] if x in t else weights[1] if x in b else 0) + (weights[2] if x in found else 0) for x in workflow.query_terms(QUERY))
        if score > 0:
            out.append((number, score))
    return sorted(out, key=lambda r: (-r[1], r[0]))


def _issues(spark):
    return spark.createDataFrame(ISSUES, "number bigint, title string, body string, labels array<string>")


def test_scores_are_those_of_a_loop(spark):
    issues = _issues(spark)
    for weights in ((3, 1, 1), (0, 2, 1), (1, 3, 0), (2, 1, -1)):
        found = workflow.dup_candidates(QUERY, issues, *weights, limit=None)
        assert [tuple(r) for r in found.collect()] == _loop(ISSUES, weights)
    assert [tuple(r) for r in workflow.dup_candidates(QUERY, issues, limit=2, exclude=1).collect()] == [r for r in _loop(ISSUES, (3, 1, 1)) if r[0] != 1][:2]
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("number", "bigint"), ("score", "int")]
    assert workflow.dup_candidates("the of", issues).collect() == []


def test_a_body_is_cut_into_words_once(spark):
    issues = _issues(spark)
    for query, limit in (("idiot", 10), (QUERY, 10), (QUERY, None)):
        plan = workflow.dup_candidates(query, issues, limit=limit)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all(lower(coalesce(body") == 1

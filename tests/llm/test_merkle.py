"""The Merkle manifest against a loop over the whole tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def way(levels, at):
    """(place in the run, the run's others) from a leaf to the top."""
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        out.append((at - first, run[: at - first] + run[at - first + 1 :]))
        at //= 16
    return out


def by_a_loop(rows, claimed):
    """rows: (id, group, leaf), claimed: leaf of each; sorted rows of the manifest."""
    order = sorted(range(len(rows)), key=lambda k: ((rows[k][1] is not None, (rows[k][1] or "").encode()), (rows[k][0] is not None, rows[k][0] or 0), rows[k][2], claimed[k]))
    groups = {}
    for k in order:
        groups.setdefault(rows[k][1], []).append(k)
    trees = [tree([rows[k][2] for k in own]) for own in groups.values()]
    crown = tree([t[-1][0] for t in trees])
    out = []
    for g, own in enumerate(groups.values()):
        for at, k in enumerate(own):
            path = way(trees[g], at) + way(crown, g)
            now = claimed[k]
            for place, others in path:
                now = h(*others[:place], now, *others[place:])
            out.append((rows[k][0], rows[k][1], rows[k][2], trees[g][-1][0], crown[-1][0], h(*[x for _, o in path for x in o]), now, now == crown[-1][0]))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("block", [16, 256])
def test_manifest_against_a_loop(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice([None, k, k]), "hot", h(str(k))) for k in range(700)] + [(k % 40, rng.choice([None, "a", "b", "ü", "", "Z"]), h("x", str(k))) for k in range(120)]
    rows += [(k, "alone" + str(k), h("y", str(k))) for k in range(40)] + [(7, "same", h("equal"))] * 35
    claimed = [h("bad", r[2]) if k % 7 == 3 and r[1] != "same" else r[2] for k, r in enumerate(rows)]
    table = spark.createDataFrame([(*r, c) for r, c in zip(rows, claimed, strict=True)], "doc_id long, source string, leaf string, claimed string")
    found = [tuple(r) for r in merkle.manifest(table, claimed_col="claimed", block=block).collect()]
    assert sorted(found, key=key) == sorted(by_a_loop(rows, claimed), key=key)
    assert {r[7] for r in found} == {True, False}


def test_leaves_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, "ä|", None), (None, "", "", 5)], "doc_id long, lang string, text string, n long")
    got = [r[0] for r in rows.select(merkle.leaf([F.col(c) for c in rows.columns])).collect()]
    assert sorted(got) == sorted([h("1:1-3:ä|-"), h("-0:0:1:5")])
    none = spark.createDataFrame([], "doc_id long, source string, leaf string, claimed string")
    assert merkle.manifest(none).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, None, h("a"))], "doc_id long, source string, leaf string")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == h("")

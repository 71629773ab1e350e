"""Ranked search against a loop over all documents, and the radix order."""

import collections
import math
import random
import re

import numpy as np
import pytest

from folioscope.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_a_loop(items, docs, k):
    held = [collections.Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scores = collections.Counter(terms(text)), []
        for (doc, _), c, size in zip(docs, held, sizes, strict=True):
            score = 0
            for t, q in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += q * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * size * n // total)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("block_terms", [1 << 20, 12])
def test_rank_against_a_loop(spark, block_terms):
    rng = random.Random(11)
    words = ["The", "the", "Éa", "éa", "x1", "über", "日本", "of", "zz", "q", "a_b", "ⅷ", "ID"] + ["w%d" % k for k in range(30)]
    text = lambda n: rng.choice([" ", "\n", "\x00", "-", " "]).join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 3, 10, 60, 400]))) for k in range(150)] + [(None, None), (None, "über of"), (3, ""), (200, "…!?"), (9, "q q q"), (9, "q q q")]
    docs += [(300 + k, "one and the same text of zz") for k in range(80)]
    items = [(k, text(rng.choice([0, 1, 4, 9, 9]))) for k in range(12)] + [(1, "the same"), (1, "the same"), (None, "ÜBER of"), (50, None), (51, "nowhere")]
    queries = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, rank string").repartition(5)
    found = [tuple(r) for r in lexical.rank(queries, table, k=7, block_terms=block_terms).select("item_id", "rank", "doc_id", "score").collect()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(found, key=key) == sorted(by_a_loop(items, docs, 7), key=key)
    assert lexical.rank(queries.limit(0), table).collect() == [] and lexical.rank(queries, table.limit(0)).collect() == []


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    for top in (1, 3, 1 << 15, 1 << 20, 1 << 40):
        keys = rng.integers(0, top, 5000)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.zeros(0, np.int64))) == 0


def test_clashing_hashes_are_told_apart(monkeypatch):
    block = lexical.Block(np.array([0, 1]), ["ab", "cd"], np.array([1, 1]))
    text = lexical.words.text_of([b"ab xy cd ab"])
    real = text.hashes
    monkeypatch.setattr(text, "hashes", lambda s, e, lane=0: np.where(s == 3, block.hashes[0], real(s, e, lane)))
    doc, code = block.codes(text)
    names = [block.letters[a : a + n].tobytes() for a, n in zip(block.starts, block.lens, strict=True)]
    assert [names[c] for c in code] == [b"ab", b"cd", b"ab"] and list(doc) == [0, 0, 0]

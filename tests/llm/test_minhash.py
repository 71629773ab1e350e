"""Near-duplicate classes against all pairs that share a band."""

import random

import numpy as np
import pytest
from folioscope.llm import minhash


def drifting(groups, copies, words, edits, seed):
    """Texts of ``groups`` chains in which each copy is the one before with some words changed."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        text = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            out.append(" ".join(text))
            for _ in range(edits):
                text[rng.randrange(words)] = f"w{rng.randrange(5000)}"
    return out


def wanted_classes(texts, least=minhash.SIMILARITY):
    """Least index of the component of each text, by every pair that shares a band."""
    total, size = np.zeros(minhash.SLOTS, np.int64), len(texts)
    doc, key, tf = minhash.shingles(minhash.text_of([t.encode() for t in texts]))
    total += np.bincount(minhash.slot(key), minlength=minhash.SLOTS)
    weights = minhash.slot_weights(total, size)
    found = minhash.bands(minhash.Sampler().sample(doc, key, tf * weights[minhash.slot(key)], size))
    root = list(range(size))
    for i in range(size):
        for j in range(i):
            if root[i] != root[j] and (found[i] == found[j]).any() and minhash.similarity(texts[i].encode(), texts[j].encode(), weights) >= least:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("groups, copies, block", [(30, 60, 1 << 18), (4, 90, 2000)])
def test_every_banded_pair_counts(spark, monkeypatch, groups, copies, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = drifting(groups, copies, 120, 2, seed=5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == wanted_classes(texts)


def test_rows_that_repeat_have_one_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"])]
    docs = spark.createDataFrame([(k % 2, texts[k % 2]) for k in range(6000)] + [(7, "something else altogether in five words")], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in minhash.classes(docs).collect()}
    assert got == {(0, 0, 6000, True), (1, 0, 6000, False), (7, 7, 1, True)}
    assert sorted(r.doc_id for r in minhash.deduplicate(docs).collect()) == [0, 7]


def test_classes_without_ids_keep_one(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(900)}" for _ in range(200)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (3, 50, 120)]
    docs = spark.createDataFrame([(None, t) for t in near + near[:1]] + [(4, t[::-1]) for t in near], "doc_id long, text string")
    kept = [r.text for r in minhash.deduplicate(docs).collect()]
    assert len(kept) == 2 and kept[0] != kept[1][::-1]

"""Mixing, sharding, near-duplicates and the pipeline against loops over small tables."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from test_identity import passages_by_a_loop

from folioscope.llm import bpe, minhash, mixing, sharding, substring_dedup


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def taken_by_a_loop(rows, passes=3):
    """Words taken by serving entries in order of virtual time up to the budget."""
    entries = sorted((r.finish + k * r.source_size) / r.target for r in rows for k in range(passes) if r["size"] and r.target)
    weigh = sorted(((r.finish + k * r.source_size) / r.target, r["size"]) for r in rows for k in range(passes) if r["size"] and r.target)
    budget, served, cut = sum(r["size"] for r in rows), 0, None
    for v, n in weigh:
        served += n
        cut = v
        if served >= budget:
            break
    assert entries
    return [sum(n for k in range(passes) if (r.finish + k * r.source_size) / r.target <= cut) if (n := r["size"]) else 0 for r in rows]


def test_mix_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, k]), prose(rng, rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "b", "c", "d", None])) for k in range(400)]
    rows += [(900, "one and the same", "e")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.schedule(docs).collect()
    assert [r.taken for r in found] == taken_by_a_loop(found)
    by_source = collections.defaultdict(list)
    for r in found:
        by_source[r.key] += [(r.finish, r["size"])] * (r["size"] > 0)
    for key, places in by_source.items():  # finish times are running sums of some order
        places.sort()
        total = 0
        for finish, n in places:
            total += n
            assert finish == total, key


def test_shards_are_shuffled(spark):
    """Neighbours by id end up anywhere, differently for each seed."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    place = lambda seed: {r.doc_id: r.shard * 100 + r.slot for r in sharding.place(docs, 40, seed=seed).collect()}
    a, b = place(1), place(2)
    ids = np.arange(4000)
    x, y = np.array([a[k] for k in ids]), np.array([b[k] for k in ids])
    assert sorted(x) == list(range(4000)) and abs(np.corrcoef(ids, x)[0, 1]) < 0.06 and abs(np.corrcoef(x, y)[0, 1]) < 0.06
    assert abs(np.corrcoef(x[:-1], x[1:])[0, 1]) < 0.06


def places_by_a_loop(keys, size, shards, seed):
    """(key, shard, slot): copies scattered by a chained hash of seed, key and number, then each bucket shuffled in turn."""
    buckets = max(shards, -(-size // sharding.BUCKET_BYTES), -(-len(keys) // sharding.BUCKET_ROWS))
    held, copies = collections.defaultdict(list), collections.Counter()
    for key in sorted(keys):
        copies[key] += 1
        h = 42
        for part in (seed.to_bytes(4, "little"), key, copies[key].to_bytes(8, "little")):
            h = xxhash.xxh64_intdigest(part, h)
        held[(h - (1 << 64) if h >> 63 else h) % buckets].append((key, copies[key]))
    line = []
    for bucket in range(buckets):
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(held[bucket]))
        line += [held[bucket][k][0] for k in order]
    out, slots = [], collections.Counter()
    for at, key in enumerate(line):
        shard = at * shards // len(line)
        out.append((key, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [1 << 14, 20])
def test_shards_against_a_loop(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(15)
    rows = [(rng.choice([None, k]), rng.choice([None, "", prose(rng, 6)])) for k in range(500)] + [(7, "copy")] * 200
    found = sharding.place(spark.createDataFrame(rows, "doc_id long, text string"), 9).collect()
    size = sum(len(t or "") + sharding.RECORD_BYTES for _, t in rows)
    assert sorted((bytes(r.row), r.shard, r.slot) for r in found) == places_by_a_loop([bytes(r.row) for r in found], size, 9, 23)


def test_recall_at_the_threshold(spark):
    """Of all pairs whose weighted similarity reaches the threshold, nearly all are in one class; classes only join what a chain of such pairs joins."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = prose(rng, 150).split()
        for _ in range(14):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(150)] = prose(rng, 1) + "x"
            texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = minhash.slot_weights(*minhash.document_frequencies(docs))
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    root, links, kept = list(range(len(texts))), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            if minhash.similarity(texts[i].encode(), texts[j].encode(), weights) >= minhash.SIMILARITY:
                links += 1
                kept += got[i] == got[j]
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert links > 200 and kept / links >= 0.99
    assert all(root[i] == root[got[i]] for i in got)


def test_stages_against_loops(spark):
    """Near-duplicates, passages and tokens one after the other, as the pipeline runs them."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    passage = prose(rng, 80)
    rows = [(k, prose(rng, rng.randint(5, 120)) + (f" {passage} " if k % 4 == 0 else " ") + prose(rng, 20), 0) for k in range(40)]
    rows += [(100 + k, rows[k][1] + (" tail" if k % 2 else ""), 0) for k in range(10)] + [(200, None, 0), (201, "", 0)]
    docs = spark.createDataFrame([(k, t, n) for k, t, n in rows], "doc_id long, text string, n_chars int")
    left = minhash.deduplicate(docs)
    kept = {r.doc_id: r.text for r in left.collect()}
    assert set(kept) == {*range(40), 200, 201} or all(k < 110 or k >= 200 for k in kept) and len(kept) <= 45
    cut = substring_dedup.deduplicate(left)
    wanted = passages_by_a_loop(list(kept.items()))
    after = {r.doc_id: r.text for r in cut.collect()}
    assert after == {k: wanted.get((k, t), t) for k, t in kept.items()}
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text and r.text != kept[r.doc_id])
    theirs = Tokenizer.from_file(bpe.default_path())
    for r in bpe.encode(cut.select("doc_id", "text"), digests_only=True).collect():
        ids = theirs.encode(after[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)

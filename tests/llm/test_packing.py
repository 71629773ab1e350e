"""Packing: pieces against the tokenizers library, sequences against best fit by falling length, the sweep against a loop."""

import bisect
import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def best_fit(sizes, capacity):
    """Sequences that best fit by falling length opens."""
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        if at < len(gaps):
            room = gaps.pop(at)
        else:
            room, opened = capacity, opened + 1
        bisect.insort(gaps, room - s)
    return opened


def check(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        upto = 0
        for offset, length in sorted(own):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(by)


def expected_pieces(rows, capacity):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for k, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(k, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


@pytest.mark.parametrize("part_rows", [1 << 15, 60])
def test_pack_against_best_fit(spark, part_rows):
    rng = random.Random(5)
    rows = [(rng.choice([None, k]), rng.choice([None, "", "one", prose(rng, 3), prose(rng, 20), prose(rng, 45), prose(rng, 300)])) for k in range(260)]
    rows += [(5, "the same words once more")] * 130  # a third are equal
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, ids string")
    found = packing.pack(docs, capacity=128, part_rows=part_rows).collect()
    expect = expected_pieces(rows, 128)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r[:5]) for r in found), key=key) == sorted(expect, key=key)
    used = check(found, 128)
    assert used <= 1.02 * best_fit([e[3] for e in expect], 128) + 1


def test_lengths_that_fit_exactly(spark):
    cut = spark.createDataFrame([(k, 70 if k < 40 else 30) for k in range(120)], "uid long, length long")
    for part_rows in (1000, 16):
        found = packing.place(cut, 100, part_rows).collect()
        load = collections.Counter()
        for r in found:
            load[r.gap] += 70 if r.uid < 40 else 30
        assert len(found) == 120 and max(load.values()) <= 100
        assert len(load) <= 56  # 40 of 70 + 30, and 40 of 30 in threes: 54


def test_sweep_against_a_loop():
    rng = random.Random(9)
    for _ in range(50):
        rows = sorted(((-rng.randint(1, 40), rng.random() < 0.6, k) for k in range(rng.randint(0, 60))))
        placed, left, gaps = packing.sweep([-s for s, _, _ in rows], [p for _, p, _ in rows], [k for _, _, k in rows])
        rooms = {k: -s for s, p, k in rows if not p}
        sizes = {k: -s for s, p, k in rows if p}
        taken = collections.Counter()
        for piece, size, gap in placed:
            assert sizes[piece] == size
            taken[gap] += size
        assert {g: r for g, r in gaps} == {g: rooms[g] - taken[g] for g in rooms if rooms[g] > taken[g]}
        assert sorted([p for p, _, _ in placed] + [p for p, _ in left]) == sorted(sizes)
        pool, lost = [], []  # best fit by falling size over all gaps of the rows, those seen so far
        for s, p, _ in rows:
            if not p:
                bisect.insort(pool, -s)
            elif (at := bisect.bisect_left(pool, -s)) < len(pool):
                bisect.insort(pool, pool.pop(at) + s)
            else:
                lost.append(-s)
        assert sorted(lost) == sorted(s for _, s in left) and sorted(x for x in pool if x) == sorted(r for _, r in gaps)


def test_sequences_hold_their_documents(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, rng.choice([0, 2, 30, 90]))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*coder.encode(t, add_special_tokens=False).ids, 0] for k, t in rows}
    seen = collections.defaultdict(dict)
    for s in packing.sequences(docs, capacity=64).collect():
        assert s.length == len(s.ids) <= 64
        at = 0
        for p in s.pieces:
            assert s.ids[at : at + p.length] == ids[p.doc_id][p.start : p.start + p.length]
            seen[p.doc_id][p.start] = p.length
            at += p.length
    assert {k: sum(v.values()) for k, v in seen.items()} == {k: len(v) for k, v in ids.items()}
    none = packing.pack(docs.limit(0)).collect()
    assert none == []

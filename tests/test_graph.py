"""Cycles and ends against plain walks over small graphs, and how little long chains cost."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import graph, workflow


def cycles_by_walks(edges):
    onward, out = {}, set()
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    for start in onward:
        walks = [[start]]
        while walks:
            walk = walks.pop()
            for b in onward.get(walk[-1], ()):
                if b == start:
                    out.add(tuple(walk))
                elif b > start and b not in walk:
                    walks.append([*walk, b])
    return out


def ends_by_walks(edges):
    onward = {}
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    out = set()
    for start in onward:
        seen, todo = {start}, [start]
        while todo:
            for b in onward.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(start, x) for x in seen if x not in onward}
    return out


def table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def graphs():
    rng = random.Random(4)
    out = [{(rng.randrange(n), rng.randrange(n)) for _ in range(m)} for n, m in ((6, 9), (40, 44))]
    rings = {(k, (k + 1) % 5) for k in range(5)} | {(10 + k, 10 + (k + 1) % 4) for k in range(4)} | {(3, 20), (20, 21), (21, 11), (30, 2)}
    return [*out, rings | {(0, 2), (11, 10), (12, 12), (21, 3), (50, 51), (51, 50)}]


@pytest.mark.parametrize("k", range(3))
def test_cycles_and_ends_against_walks(spark, monkeypatch, k):
    edges = graphs()[k]
    if k == 0:
        monkeypatch.setattr(graph, "SMALL", 0)  # every round is written
    found = [tuple(r.path) for r in graph.simple_cycles(table(spark, list(edges))).collect()]
    assert sorted(found) == sorted(cycles_by_walks(edges))
    found = [tuple(r) for r in graph.ends(table(spark, list(edges))).collect()]
    assert sorted(found) == sorted(ends_by_walks(edges))


def test_a_long_chain_between_rings_adds_no_walk(spark, monkeypatch):
    n, made = 10_000, []
    chain = [(k, k + 1) for k in range(100, 100 + n)]
    rings = [(1, 2), (2, 3), (3, 1), (2, 100), (100 + n, 20_001), (20_001, 20_002), (20_002, 20_001), (20_002, 100 + n)]
    real = graph._core

    def core(keep, edges):
        out = real(keep, edges)
        made.append(out[0].count())
        return out

    monkeypatch.setattr(graph, "_core", core)
    found = workflow.cycles(table(spark, chain + rings))
    assert {r.path for r in found.collect()} == {"1>2>3", "10100>20001>20002", "20001>20002"}
    assert made[-1] <= 6  # what walks go over


def test_a_lattice_keeps_no_more_than_its_output(spark, monkeypatch):
    wide, long = 6, 30
    edges = [(x * wide + y, (x + 1) * wide + z) for x in range(long) for y in range(wide) for z in range(wide)]
    seen = []
    real = graph.rounds

    def counted(spark, small):
        inner = real(spark, small)

        class Held:
            def __enter__(self):
                keep = inner.__enter__()

                def counting(df):
                    out = keep(df)
                    seen.append(out.count())
                    return out

                return counting

            def __exit__(self, *e):
                return inner.__exit__(*e)

        return Held()

    monkeypatch.setattr(graph, "rounds", counted)
    found = {tuple(r) for r in graph.ends(table(spark, edges)).collect()}
    assert found == ends_by_walks(edges)
    assert max(seen) <= len(edges) + len(found)


def test_names_may_be_text(spark):
    pointers = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "b"), ("c", None), ("x", "x")], "doc string, by string")
    assert {tuple(r) for r in workflow.terminal_superseders(pointers).collect()} == {("a", "c"), ("b", "c")}
    assert workflow.cycles(pointers.select(F.lit(1).alias("src"), F.lit(2).alias("dst")).limit(0)).collect() == []

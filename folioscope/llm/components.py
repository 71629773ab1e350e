"""Connected components of a table of edges, by alternating large and small stars.

Each round is two grouped minima, written to the shared folder; the number of rounds
grows with the logarithm of the longest chain.  Only narrow tables of node pairs are
shuffled; a node with very many neighbours costs one pre-aggregated minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import few, materialize, release


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) to (node, component): component is the least node reachable; only nodes with an edge to another."""
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = materialize(few(links, 0), "cc")
    state = _state(links)
    if not state[0]:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        n = state[0]
        # large star: the neighbours above a node move to its least neighbour
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
        above = links.select(F.col("v").alias("u"), F.col("u").alias("far"))
        large = above.join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialize(few(large, n), "cc")
        # small star: the neighbours below a node and itself move to the least of them
        least = few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        before, links = links, materialize(few(few(small, n).distinct(), n), "cc")
        now = _state(links)
        release(before, large)
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
    raise RuntimeError("components did not settle")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]

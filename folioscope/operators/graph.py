"""Directed graphs as tables of edges: simple cycles and ends of chains, in rounds that do not grow with long chains.

A node that one edge enters and one leaves only hands on, so runs of such nodes are
*contracted* to one edge first.  Pointers along a run double their reach each round, so a
run of n nodes takes log2(n) rounds; a ring that nothing else enters or leaves shows as
pointers that never arrive.  What is left has an edge for every way between places where
ways part or meet, and rounds go by the longest way among those.

Rounds of few rows are held in the plan (``SMALL``), larger ones are written; results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.scratch import rounds, size

#: Rows of a round that is held in the plan instead of being written.
SMALL = 4096
Keep = Callable[[DataFrame], DataFrame]


def _jumped(keep: Keep, runs: DataFrame) -> DataFrame:
    """Pointers of runs (node, next, last, hops, low), ``next`` null at an end, until they arrive; those of rings never do.

    A row spans the nodes from ``node`` to ``last``, ``hops`` steps on; ``next`` follows
    the last, and ``low`` is the least of them.  Joining the span that begins at ``next``
    doubles it.  Runs arrive one after the other, so what no round brings any further is
    rings, and once no ``low`` gets less, it is that of the whole ring.
    """
    before = None
    while True:
        state = runs.filter("next IS NOT NULL").agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return runs
        before = state
        then = runs.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("last").alias("last2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"))
        far = F.col("last2").isNotNull()
        joined = runs.join(then, "next", "left")
        runs = keep(
            joined.select(
                "node", F.col("next2").alias("next"), F.coalesce("last2", "last").alias("last"),
                F.when(far, F.col("hops") + 1 + F.col("hops2")).otherwise(F.col("hops")).alias("hops"), F.least("low", F.coalesce("low2", "low")).alias("low"),
            )
        )


def _runs(steps: DataFrame) -> DataFrame:
    """Spans of one node each from (node, next)."""
    return steps.select("node", "next", F.col("node").alias("last"), F.lit(0).cast("long").alias("hops"), F.col("node").alias("low"))


def _strung(ranked: DataFrame) -> DataFrame:
    """(last, path): the nodes of each run in order, with what their edges have inside, from (node, last, hops, inner)."""
    part = F.struct((-F.col("hops")).alias("far"), "node", "inner")
    parts = ranked.groupBy("last").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return parts.select("last", F.flatten(F.transform("parts", lambda p: F.concat(F.array(p["node"]), p["inner"]))).alias("path"))


def contract(keep: Keep, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, inner) without nodes that only hand on, and the rings (path) that consist of such nodes.

    ``inner`` lists the nodes that an edge stands for.  Every node goes into one edge at
    most, so the lists hold no more than there are nodes.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"), F.first("dst").alias("dst"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("into"))
    plain = keep(out.join(into, "node").filter("out = 1 AND into = 1 AND node <> dst").select("node", "dst"))
    rings = edges.select(F.array("src").alias("path")).limit(0)
    if not size(plain):
        return edges, rings
    own = plain.select(F.col("node").alias("dst"), F.col("node").alias("next"))
    jumped = _jumped(keep, keep(_runs(plain.join(own, "dst", "left").select("node", "next"))))
    inner = edges.select(F.col("src").alias("node"), F.col("inner"))
    circling = jumped.filter("next IS NOT NULL").select("node", F.col("low").alias("least"))
    if not circling.isEmpty():
        circling = keep(circling.join(plain, "node"))
        cut = circling.select("node", F.when(F.col("dst") != F.col("least"), F.col("dst")).alias("next"))  # rings end before their least node
        ranked = _jumped(keep, keep(_runs(cut))).join(inner, "node")
        rings = keep(_strung(ranked).select("path"))
    arrived = jumped.filter("next IS NULL").select("node", "last", "hops").join(inner, "node")
    nodes = _strung(arrived)
    enters = edges.select("src", F.col("dst").alias("head"), F.col("inner").alias("first"))
    leaves = plain.select(F.col("node").alias("last"), "dst")
    strings = nodes.join(leaves, "last").withColumn("head", F.element_at("path", 1)).join(enters, "head").select("src", "dst", F.concat("first", "path").alias("inner"))
    rest = edges.join(plain.select(F.col("node").alias("src")), "src", "left_anti").join(plain.select(F.col("node").alias("dst")), "dst", "left_anti")
    return keep(rest.select("src", "dst", "inner").unionByName(strings)), rings


def _core(keep: Keep, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracted edges that may lie on a cycle - nothing ends or begins at them - and the cycles (path) that came out whole on the way."""
    found = edges.select(F.array("src").alias("path")).limit(0)
    while True:
        edges, rings = contract(keep, edges)
        loops = edges.filter("src = dst").select(F.concat(F.array("src"), F.col("inner")).alias("path"))
        found = found.unionByName(rings).unionByName(loops)
        edges = edges.filter("src <> dst")
        onward = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        held = keep(onward.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "inner"))
        if size(held) == edges.count():
            return held, keep(found)
        edges = held


def _grown(keep: Keep, members: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Members and all that steps from the newest of them lead to."""
    newest = members
    while size(newest):
        newest = keep(step(newest).distinct().join(members, members.columns, "left_anti"))
        members = keep(members.unionByName(newest))
    return members


def components(keep: Keep, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends are in one strongly connected component, and cycles (path) of components that came out whole on the way.

    Each node takes the greatest node from which it is reached.  The nodes that reach back
    to the one they took are its component; the rest goes into another round.
    """
    inside, found = edges.limit(0), edges.select(F.array("src").alias("path")).limit(0)
    while not edges.isEmpty():
        pairs = edges.select("src", "dst").distinct()
        taken = keep(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().withColumn("root", F.col("node")))
        changed = True
        while changed:
            told = pairs.join(taken.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("root").alias("told"))
            now = keep(taken.join(told, "node", "left").select("node", F.greatest("root", F.coalesce("told", "root")).alias("root"), F.col("root").alias("was")))
            changed = not now.filter("root <> was").isEmpty()
            taken = keep(now.select("node", "root"))
        back = pairs.join(taken.select(F.col("node").alias("src"), "root"), "src").join(taken.select(F.col("node").alias("dst"), F.col("root").alias("other")), "dst").filter("root = other").select("src", "dst", "root")
        back = keep(back)
        members = _grown(keep, taken.filter("node = root"), lambda new, back=back: back.join(new.select(F.col("node").alias("dst"), "root"), ["dst", "root"]).select(F.col("src").alias("node"), "root"))
        both = edges.join(members.select(F.col("node").alias("src"), F.col("root").alias("a")), "src", "left").join(members.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst", "left")
        both = keep(both.select("src", "dst", "inner", "a", "b"))
        inside = keep(inside.unionByName(both.filter("a = b").select("src", "dst", "inner")))
        edges, more = _core(keep, both.filter("a IS NULL AND b IS NULL").select("src", "dst", "inner"))
        found = found.unionByName(more)
    return inside, found


def simple_cycles(edges: DataFrame) -> DataFrame:
    """(path) of all simple cycles of (src, dst), each from its least node.

    Walks grow by an edge a round, within a component and through nodes above their start
    only, so each cycle is found once; rounds end when no walk is left.
    """
    spark = edges.sparkSession
    with rounds(spark, SMALL) as keep:
        none = F.array().cast(f"array<{edges.schema['src'].dataType.simpleString()}>")
        whole = keep(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().withColumn("inner", none))
        core, found = _core(keep, whole)
        core, more = components(keep, core)
        core, rest = _core(keep, core)
        found = found.unionByName(more).unionByName(rest)
        steps = core.select(F.col("src").alias("node"), F.col("dst").alias("next"), "inner")
        walks = core.filter("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src").alias("seen"), F.concat(F.array("src"), F.col("inner")).alias("path"))
        while size(walks):
            ways = walks.join(steps, "node").filter("next = start OR next > start AND next <> node AND NOT array_contains(seen, next)")
            path = F.concat("path", F.array("node"), "inner")
            grown = keep(ways.select("start", F.col("next").alias("node"), F.array_append("seen", F.col("node")).alias("seen"), path.alias("path")))
            found = found.unionByName(grown.filter("node = start").select("path"))
            walks = keep(grown.filter("node <> start"))
        at = F.array_position("path", F.array_min("path")).cast("int")
        turned = F.concat(F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at - 1))
        return keep(found.select(turned.alias("path")))


def ends(edges: DataFrame) -> DataFrame:
    """(node, end): for every node of (src, dst) that has a way out, the ends - nodes without one - that it reaches.

    A node with one way out reaches what its next one does, so pointers jump over runs of
    them to the first node that is an end or has several ways.  Among those that have,
    sets of ends are handed back along edges, each pair of a node and an end once.
    """
    spark = edges.sparkSession
    with rounds(spark, SMALL) as keep:
        left = keep(edges.select("src", "dst").distinct())
        stop = keep(left.select(F.col("dst").alias("node")).distinct().join(left.select(F.col("src").alias("node")), "node", "left_anti"))
        passed: list[DataFrame] = []  # of each contraction, (node, to): what leads to one thing only, and what that is
        while True:
            single = left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("dst")).filter("n = 1").select("node", "dst")
            single = keep(single)
            if not size(single):
                break
            steps = single.join(single.select(F.col("node").alias("dst"), F.col("node").alias("next")), "dst", "left").select("node", "next")
            jumped = _jumped(keep, keep(_runs(steps)))
            to = keep(jumped.filter("next IS NULL").select("node", "last").join(single.select(F.col("node").alias("last"), F.col("dst").alias("to")), "last").select("node", "to"))
            passed.append(to)
            lost = single.join(to, "node", "left_anti").select(F.col("node").alias("dst"))  # they go round in a ring
            several = left.join(single.select(F.col("node").alias("src")), "src", "left_anti").join(lost, "dst", "left_anti")
            moved = several.join(to.withColumnRenamed("node", "dst"), "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"))
            moved = moved.filter("src <> dst").distinct()
            # what had ways into rings only reaches nothing, and nothing comes through it
            left, n = keep(moved), -1
            while n != size(left):
                n = size(left)
                left = keep(left.join(left.select(F.col("src").alias("dst")).distinct().unionByName(stop.select(F.col("node").alias("dst"))), "dst", "left_semi").select("src", "dst"))
        direct = left.join(stop.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("end"))
        inner = keep(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        known = _grown(keep, keep(direct), lambda new: inner.join(new.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "end"))
        for to in reversed(passed):
            at_end = to.join(stop.select(F.col("node").alias("to")), "to", "left_semi").select("node", F.col("to").alias("end"))
            beyond = to.join(known.withColumnRenamed("node", "to"), "to").select("node", "end")
            known = keep(known.unionByName(at_end).unionByName(beyond))
        return keep(known)

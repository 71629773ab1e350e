"""Merkle manifest of a dataset: a digest for every row, one for every group, one for all.

A row's *leaf* is the digest of its columns, each written with its length so that no two
rows read alike.  The leaves of a group ascend by id; runs of ``FANOUT`` consecutive nodes
are hashed level by level until one is left, the group's *subroot*; the subroots, by group,
make the *root* in the same way.  A row's *proof* is the siblings on its way to the root:
with them anyone can fold a row back to the root, and tell a row that was tampered with.

Scale: rows are reduced to digests in one map over the texts.  A range sort gives every
leaf its place; the tree is cut into aligned blocks of ``BLOCK`` leaves (a power of the
fanout, so that no run crosses a border), each one group of bounded size.  Within a block
the leaves are one matrix of 64-byte hex digests: the rows of the matrix, reshaped by the
fanout, are hashed level by level, and siblings are found by arithmetic on indices.  Blocks
hand up one node each, and the table of nodes is cut into blocks again, so a tree of any
size takes a round for each factor of ``BLOCK``.  On the way down a block gets the path
from its node to the root once, not once for each leaf.  A group that holds a third of all
rows is as many blocks as its size needs.

Null columns are written ``-``; null groups come first, null ids first within a group.
Equal rows are separate leaves that follow each other; rows of one id are ordered by leaf.
A single leaf is its own subroot; an empty table gives no rows.  Further columns are left
out unless they are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import materialize, numbered, release

FANOUT = 16
#: Leaves of a block; a power of the fanout.
BLOCK = FANOUT**3
_HEX = 64
_ROW_BITS = 33  # of the number of a row within its task, in monotonically_increasing_id
PATH = "array<struct<at: int, others: string>>"


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of the columns in order: ``-`` for null, else byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# Within a block.


def _matrix(nodes: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of their 64 hex letters."""
    return np.frombuffer("".join(nodes.to_pylist()).encode(), np.uint8).reshape(-1, _HEX)


def _hashed(rows: Sequence) -> np.ndarray:
    """Digests of some byte strings, as rows of hex letters."""
    return np.frombuffer("".join([hashlib.sha256(r).hexdigest() for r in rows]).encode(), np.uint8).reshape(-1, _HEX)


def _level(nodes: np.ndarray) -> np.ndarray:
    """Parents of consecutive nodes: whole runs as one reshaped matrix, then the rest."""
    whole = len(nodes) // FANOUT * FANOUT
    runs = list(np.ascontiguousarray(nodes[:whole]).reshape(-1, FANOUT * _HEX))
    if whole < len(nodes):
        runs.append(np.ascontiguousarray(nodes[whole:]).reshape(-1))
    return _hashed(runs)


def _levels(nodes: np.ndarray, leaves: int, block: int) -> list[np.ndarray]:
    """All levels of a block of a tree with so many leaves; the last has one node."""
    levels = [nodes]
    size = min(leaves, block)
    while size > 1:
        levels.append(_level(levels[-1]))
        size = -(-size // FANOUT)
    return levels


def _siblings(level: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes ``at`` of a level, its run's others as (len(at), FANOUT - 1, 64), and which of them there are."""
    own = at % FANOUT
    other = np.arange(FANOUT - 1)[None, :]
    index = (at - own)[:, None] + other + (other >= own[:, None])
    there = index < len(level)
    return level[np.where(there, index, 0)], there


def _climb(nodes: DataFrame, block: int) -> DataFrame:
    """The nodes that blocks hand up: (tree, n, pos, node), as the leaves of the next table."""

    def up(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves = table.column("n")[0].as_py()
        top = _levels(_matrix(table.column("node")), leaves, block)[-1]
        return pa.table({"tree": [key[0].as_py()], "n": [-(-leaves // block)], "pos": [key[1].as_py()], "node": [top.tobytes().decode()]})

    return nodes.select("tree", "n", "pos", "node", F.expr(f"pos div {block}").alias("block")).groupBy("tree", "block").applyInArrow(up, "tree string, n long, pos long, node string")


def _descend(nodes: DataFrame, above: DataFrame, block: int) -> DataFrame:
    """(tree, pos, subroot, path) of nodes from those of their blocks."""

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        levels = _levels(_matrix(left.column("node")), left.column("n")[0].as_py(), block)
        rest, at = right.column("path")[0].as_py(), np.arange(len(left))
        paths: list[list[dict]] = [[] for _ in at]
        for level in levels[:-1]:
            others, there = _siblings(level, at)
            for path, own, row, mask in zip(paths, at % FANOUT, others, there, strict=True):
                path.append({"at": int(own), "others": row[mask].tobytes().decode()})
            at = at // FANOUT
        kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))
        out = {"tree": left.column("tree"), "pos": left.column("pos"), "subroot": pa.array(right.column("subroot").to_pylist() * len(left), pa.string())}
        return pa.table(out | {"path": pa.array([p + rest for p in paths], kind)})

    blocks = nodes.select("tree", "n", "pos", "node", F.expr(f"pos div {block}").alias("block")).groupBy("tree", "block")
    return blocks.cogroup(above.groupBy("tree", "pos")).applyInArrow(down, f"tree string, pos long, subroot string, path {PATH}")


def _prove(leaves: DataFrame, above: DataFrame, block: int) -> DataFrame:
    """The leaves with their subroot, the digest of their proof, and what they fold to as ``claimed`` has them."""

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        levels = _levels(_matrix(left.column("node")), left.column("n")[0].as_py(), block)
        at, now = np.arange(len(left)), _matrix(left.column("claimed"))
        proofs, masks = [], []
        for level in levels[:-1]:
            others, there = _siblings(level, at)
            proofs.append(others)
            masks.append(there)
            runs = np.empty((len(at), FANOUT, _HEX), np.uint8)
            own, places = at % FANOUT, np.arange(FANOUT)[None, :]
            is_own = places == own[:, None]
            runs[is_own] = now
            runs[~is_own] = others.reshape(-1, _HEX)
            held = np.concatenate([there, np.ones((len(at), 1), bool)], axis=1).sum(axis=1) * _HEX  # runs that end early lack their last nodes
            now = _hashed([row[:size] for row, size in zip(runs.reshape(len(at), -1), held.tolist(), strict=True)])
            at = at // FANOUT
        path = right.column("path")[0].as_py()
        for step in path:
            others, own = step["others"].encode(), step["at"] * _HEX
            now = _hashed([others[:own] + row.tobytes() + others[own:] for row in now])
        rest = "".join(step["others"] for step in path).encode()
        if proofs:
            bodies, held = np.concatenate(proofs, axis=1), np.concatenate(masks, axis=1)
            full = held.all(axis=1)
            digests = [hashlib.sha256((row.tobytes() if whole else row[mask].tobytes()) + rest).hexdigest() for row, mask, whole in zip(bodies, held, full.tolist(), strict=True)]
        else:
            digests = [hashlib.sha256(rest).hexdigest()] * len(left)
        folded = [row.tobytes().decode() for row in now]
        out = left.select(["id", "tree", "node"]).append_column("subroot", pa.array(right.column("subroot").to_pylist() * len(left), pa.string()))
        return out.append_column("proof_sha256", pa.array(digests, pa.string())).append_column("folded_root", pa.array(folded, pa.string()))

    blocks = leaves.withColumn("block", F.expr(f"pos div {block}")).groupBy("tree", "block")
    kind = leaves.schema["id"].dataType.simpleString()
    return blocks.cogroup(above.groupBy("tree", "pos")).applyInArrow(prove, f"id {kind}, tree string, node string, subroot string, proof_sha256 string, folded_root string")


# Between blocks.


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of trees with ``n``, the leaves of their tree, and ``pos``, their place in it by ``order``: a range sort, and counts of its parts."""
    table = materialize(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at__", F.monotonically_increasing_id()), "merkle-sorted")
    table = table.withColumn("part__", F.shiftright("at__", _ROW_BITS))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("tree", "part__").agg(F.count(F.lit(1)).alias("m__"), F.min("at__").alias("first__"))
    parts = parts.select("tree", "part__", "first__", F.coalesce(F.sum("m__").over(before), F.lit(0)).alias("base__"), F.sum("m__").over(whole).alias("n"))
    return table.join(parts, ["tree", "part__"]).select(*rows.columns, "n", (F.col("base__") + F.col("at__") - F.col("first__")).alias("pos"))


def _grown(leaves: DataFrame, block: int) -> list[DataFrame]:
    """Tables of nodes from the leaves to the tops; in the last every tree has one node."""
    tables = [leaves]
    while True:
        open_ = tables[-1] if len(tables) == 1 else tables[-1].filter("n > 1")
        tables.append(materialize(_climb(open_, block), "merkle-nodes"))
        if not tables[-1].filter("n > 1").limit(1).count():
            return tables


def _tops(tables: list[DataFrame]) -> DataFrame:
    """(tree, node) of all trees' last nodes."""
    tops = [t.filter("n = 1").select("tree", "node") for t in tables[1:]]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _paths(tables: list[DataFrame], tops: DataFrame, block: int) -> DataFrame:
    """(tree, pos, subroot, path) of the nodes above the leaves' blocks; ``tops``: the same of each tree's last node, with pos 0."""
    above = None
    for nodes in reversed(tables[1:]):
        found = nodes.filter("n = 1").select("tree").join(tops, "tree")
        if above is not None:
            found = found.unionByName(_descend(nodes.filter("n > 1"), above, block))
        above = materialize(found.select("tree", "pos", "subroot", "path"), "merkle-paths")
    return above


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf", claimed_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each row with an id, a group and its leaf (hex): id, group, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` comes from ``claimed_col`` (the leaf itself where it is not given) and
    the siblings in the tree of the leaves; ``verified``: whether it is the root.
    ``block``: a power of ``FANOUT``.
    """
    group = rows[group_col].cast("string")
    narrow = rows.select(rows[id_col].alias("id"), F.coalesce(F.concat(F.lit("s"), group), F.lit("n")).alias("tree"), rows[leaf_col].alias("node"), rows[claimed_col or leaf_col].alias("claimed"))
    counted = materialize(narrow.groupBy("tree", "id", "node", "claimed").agg(F.count(F.lit(1)).alias("same")), "merkle-leaves")
    leaves = materialize(_placed(numbered(counted, "same", "copy").drop("same"), "id", "node", "claimed", "copy").drop("copy"), "merkle-placed")
    release(counted)
    tables = _grown(leaves, block)
    groups = _tops(tables).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node")  # null, "n", comes before "s..."
    groups = materialize(_placed(groups, "group"), "merkle-groups")
    crown = _grown(groups.drop("group"), block)
    top = _tops(crown).first()
    root = F.lit(top["node"] if top else None).cast("string")
    bare = crown[-1].filter("n = 1").select("tree", F.lit(0).cast("long").alias("pos"), root.alias("subroot"), F.array().cast(PATH).alias("path"))
    ways = _descend(groups, _paths(crown, bare, block), block).select("pos", "path")
    ways = groups.join(ways, "pos").select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "path")
    proved = _prove(leaves, _paths(tables, materialize(ways, "merkle-ways"), block), block)
    named = F.when(F.col("tree") != "n", F.substring("tree", 2, 1 << 30))
    kept = proved.select(F.col("id").alias(id_col), named.alias(group_col), F.col("node").alias(leaf_col), "subroot", root.alias("root"), "proof_sha256", "folded_root")
    return kept.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Exact near-duplicate vectors by dual traversal of cover trees.

Unit vectors with cosine >= c lie within distance ``tau = sqrt(2 - 2c)``.

1. *Top of the tree, over the whole table.*  Centres are picked from a bounded sample of
   the vectors that no centre covers yet, thinned to a net; what lies within ``tau / 2`` of
   its nearest centre is that centre's cell, and so on for a few rounds.  The centres, at
   most ``CENTRES`` a round, and their true covering radii go to every task.
2. *Blocks.*  Cells are packed into blocks of bounded size; vectors that no cell has, as in
   noise, are dealt into blocks by hash.
3. *Pruning before the shuffle.*  A vector is sent to another block only if a cell there
   has a centre within ``tau`` plus its radius.  With a cell that lies within ``tau`` whole
   it is linked whole: a count for it, one for the cell, and no vector is sent.  So clusters
   cost in proportion to their vectors, however dense.
4. *Dual traversal.*  For each pair of blocks that is left (and each block with itself) the
   cover trees of both sides are built: nested levels of centres whose radii halve, each
   centre the representative of what it covers, with the true covering radius kept.  The
   two are traversed together, level by level.  A pair of nodes is dropped if their centres
   are further apart than ``tau`` plus both covering radii; it is linked whole if they are
   closer than ``tau`` minus both; the rest descend to the leaves, where cosines in double
   precision decide.

The pairs found are exactly those with cosine >= c.  Links leave a task as counts for each
vector and a spanning forest, not as pairs.  Equal vectors are one vector with a
multiplicity, counted before any shuffle of theirs.  Vectors without near neighbours are
compared block against block, all with all: exact search is quadratic where no bound can
prune, as among random vectors of many dimensions, and this shares it out evenly.

Null vectors, zero vectors and those with null or non-finite components or of another
length than they compare with link with nothing and are kept.  An empty table gives no
rows; repeated rows are separate vectors, also of one id; a component's id is its smallest
id that is not null, or null.  Further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.llm.components import components
from folioscope.llm.scratch import few, materialize, release

#: Distinct vectors of a block.
BLOCK_ROWS = 4096
#: Centres that a round picks at most, and bytes of them; rounds.
CENTRES, CENTRE_BYTES, ROUNDS = 4096, 32 << 20, 3
#: Bounds are compared with this much room, so that rounding never prunes or links wrongly.
_ROOM = 1e-6
#: Cosines held at once, at most.
_CELLS = 1 << 22


class Tree:
    """Cover tree of unit vectors: for each level the node of every row, and of each node the centre, parent and covering radius."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, labels: np.ndarray, centre_from: np.ndarray):
        self.x, self.weight, self.labels = x, weight, labels
        self.centres, self.radius, self.parent, self.order, self.cuts, self.heft = [], [], [], [], [], []
        for level in range(labels.shape[1]):
            label = labels[:, level]
            rows = np.flatnonzero(centre_from <= level)
            centre = np.zeros(len(rows), np.int64)
            centre[label[rows]] = rows
            gap = x - x[centre[label]]
            far = np.zeros(len(rows))
            np.maximum.at(far, label, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
            order = np.argsort(label, kind="stable")
            self.centres.append(centre)
            self.radius.append(far)
            self.parent.append(labels[centre, level - 1] if level else np.zeros(1, np.int64))
            self.order.append(order)
            self.cuts.append(np.searchsorted(label[order], np.arange(len(rows) + 1)))
            self.heft.append(np.bincount(label, weights=weight, minlength=len(rows)).astype(np.int64))
        self.single = x.astype(np.float32)

    def members(self, level: int, node: int) -> np.ndarray:
        return self.order[level][self.cuts[level][node] : self.cuts[level][node + 1]]

    def sizes(self, level: int) -> np.ndarray:
        return np.diff(self.cuts[level])

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of ``level`` by parent, and where each parent's begin."""
        order = np.argsort(self.parent[level], kind="stable")
        return order, np.searchsorted(self.parent[level][order], np.arange(len(self.centres[level - 1]) + 1))


def build(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Nested levels with halving radii down to ``least``: (node of each row on each level, first level at which it is a centre)."""
    n = len(x)
    labels, centre_from = [np.zeros(n, np.int64)], np.full(n, 1 << 30)
    centre_from[0] = 0
    centres, radius = np.zeros(1, np.int64), 2.0
    while radius > least:
        radius /= 2
        now, found, above = np.zeros(n, np.int64), [], labels[-1]
        order = np.argsort(above, kind="stable")
        cuts = np.searchsorted(above[order], np.arange(len(centres) + 1))
        count = 0
        for node, first in enumerate(centres.tolist()):
            rows = order[cuts[node] : cuts[node + 1]]
            own, picked = _net(x, rows, first, radius)
            now[rows] = count + own
            found.append(picked)
            count += len(picked)
        centres = np.concatenate(found)
        centre_from[centres] = np.minimum(centre_from[centres], len(labels))
        labels.append(now)
    return np.stack(labels, axis=1), centre_from


def _net(x: np.ndarray, rows: np.ndarray, first: int, radius: float, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net of ``rows``: (centre number of each row, centres); ``first``, the parent's centre, stays one."""
    if len(rows) == 1:
        return np.zeros(1, np.int64), rows
    label, todo = np.full(len(rows), -1), np.arange(len(rows))
    todo = np.concatenate([todo[rows == first], todo[rows != first]])
    centres: list[np.ndarray] = []
    count = 0
    while len(todo):
        some = todo[:most]
        gap = 2 - 2 * (x[rows[some]] @ x[rows[some]].T)
        free, taken = np.ones(len(some), bool), []
        for k in range(len(some)):
            if free[k]:
                taken.append(k)
                free &= gap[k] > radius * radius
        batch = some[taken]
        gap = 2 - 2 * (x[rows[todo]] @ x[rows[batch]].T)
        near = np.argmin(gap, axis=1)
        hit = gap[np.arange(len(todo)), near] <= radius * radius
        near[np.array(taken)], hit[np.array(taken)] = np.arange(len(batch)), True  # todo starts with some
        label[todo[hit]] = count + near[hit]
        centres.append(rows[batch])
        count += len(batch)
        todo = todo[~hit]
    return label, np.concatenate(centres)


class Links:
    """What a traversal found: links of each row on both sides, and edges (row of a, row of b)."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b = a, b
        self.of_a, self.of_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []

    def whole(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        """Every row below node i is linked with every row below node j."""
        a, b = self.a, self.b
        add_a = np.bincount(i, weights=b.heft[level][j], minlength=len(a.centres[level])).astype(np.int64)
        add_b = np.bincount(j, weights=a.heft[level][i], minlength=len(b.centres[level])).astype(np.int64)
        self.of_a += add_a[a.labels[:, level]]
        self.of_b += add_b[b.labels[:, level]]
        hub_b, hub_a = np.full(len(a.centres[level]), -1), np.full(len(b.centres[level]), -1)
        hub_b[i], hub_a[j] = b.centres[level][j], a.centres[level][i]
        self.u.append(a.centres[level][i])
        self.v.append(b.centres[level][j])
        rows = np.flatnonzero(hub_b[a.labels[:, level]] >= 0)
        self.u.append(rows)
        self.v.append(hub_b[a.labels[rows, level]])
        rows = np.flatnonzero(hub_a[b.labels[:, level]] >= 0)
        self.u.append(hub_a[b.labels[rows, level]])
        self.v.append(rows)

    def pairs(self, u: np.ndarray, v: np.ndarray, least: float) -> None:
        """Rows u and v, linked where their cosine is at least ``least``."""
        for at in range(0, len(u), _CELLS >> 6):
            p, q = u[at : at + (_CELLS >> 6)], v[at : at + (_CELLS >> 6)]
            ok = np.einsum("ij,ij->i", self.a.x[p], self.b.x[q]) >= least
            p, q = p[ok], q[ok]
            self.of_a += np.bincount(p, weights=self.b.weight[q], minlength=len(self.of_a)).astype(np.int64)
            self.of_b += np.bincount(q, weights=self.a.weight[p], minlength=len(self.of_b)).astype(np.int64)
            self.u.append(p)
            self.v.append(q)


def dual(a: Tree, b: Tree, least: float) -> Links:
    """Links between the rows of two trees of the same depth."""
    tau, links = math.sqrt(max(0.0, 2 - 2 * least)), Links(a, b)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth = a.labels.shape[1]
    for level in range(1, depth):
        open_i, open_j = [], []
        for ci, cj in _child_pairs(a, b, level, i, j, tau):
            p, q = a.centres[level][ci], b.centres[level][cj]
            gap = a.x[p] - b.x[q]
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            reach = a.radius[level][ci] + b.radius[level][cj]
            near = d + reach <= tau - _ROOM
            if near.any():
                links.whole(level, ci[near], cj[near])
            rest = ~near & (d - reach <= tau + _ROOM)
            ci, cj, p, q = ci[rest], cj[rest], p[rest], q[rest]
            alone = (a.sizes(level)[ci] == 1) & (b.sizes(level)[cj] == 1)
            links.pairs(p[alone], q[alone], least)
            open_i.append(ci[~alone])
            open_j.append(cj[~alone])
        i = np.concatenate(open_i) if open_i else np.zeros(0, np.int64)
        j = np.concatenate(open_j) if open_j else np.zeros(0, np.int64)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = a.members(depth - 1, x), b.members(depth - 1, y)
        for at in range(0, len(p), max(1, _CELLS // len(q))):
            part = p[at : at + max(1, _CELLS // len(q))]
            links.pairs(np.repeat(part, len(q)), np.tile(q, len(part)), least)
    return links


def _child_pairs(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray, tau: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of children of the pairs (i, j) that single precision cannot rule out."""
    (oa, sa), (ob, sb) = a.children(level), b.children(level)
    na, nb = sa[i + 1] - sa[i], sb[j + 1] - sb[j]
    large = na * nb > 4096
    for x, y in zip(i[large].tolist(), j[large].tolist(), strict=True):
        ca, cb = oa[sa[x] : sa[x + 1]], ob[sb[y] : sb[y + 1]]
        right = b.single[b.centres[level][cb]].T
        step = max(1, _CELLS // len(cb))
        for at in range(0, len(ca), step):
            part = ca[at : at + step]
            gap = 2 - 2 * (a.single[a.centres[level][part]] @ right)
            bound = tau + _ROOM + a.radius[level][part][:, None].astype(np.float32) + b.radius[level][cb][None, :].astype(np.float32)
            r, c = np.nonzero(gap <= bound * bound + np.float32(1e-4))
            for k in range(0, len(r), _CELLS >> 6):
                yield part[r[k : k + (_CELLS >> 6)]], cb[c[k : k + (_CELLS >> 6)]]
    i, j, na, nb = i[~large], j[~large], na[~large], nb[~large]
    total = np.concatenate([[0], np.cumsum(na * nb)])
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(total, total[at] + (_CELLS >> 6), "right")) - 1)
        n = (na * nb)[at:to]
        k = np.arange(total[to] - total[at]) - np.repeat(total[at:to] - total[at], n)
        width = np.repeat(nb[at:to], n)
        yield oa[np.repeat(sa[i[at:to]], n) + k // width], ob[np.repeat(sb[j[at:to]], n) + k % width]
        at = to


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least row of each row's component, for edges among ``n`` rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        while not (label[label] == label).all():
            label = label[label]
        if (label == before).all():
            return label


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Cells:
    """Centres of cells with their radii, weights, keys and blocks."""

    def __init__(self, x: np.ndarray, keys: np.ndarray):
        self.x, self.keys = x, keys
        self.radius, self.weight, self.size = np.zeros(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        self.block, self.alone = np.zeros(len(x), np.int64), np.zeros(len(x), bool)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (x @ self.x.T)))

    def pack(self, most: int) -> None:
        """Blocks of about ``most`` vectors: cells near to each other first, large ones alone."""
        guides = self.x[np.argsort(-self.size, kind="stable")[:64]]
        order = np.lexsort((-self.size, np.argmax(self.x @ guides.T, axis=1)))
        block, held = 0, 0
        for c in order.tolist():
            if held and held + self.size[c] > most:
                block, held = block + 1, 0
            self.block[c], self.alone[c] = block, self.size[c] > most
            held += int(self.size[c])


def _pieces(rows: int, width: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dim, rows, their part) of a batch with a column dim."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, batch.take(pa.array(rows))


def cover(distinct: DataFrame, counts: dict[int, int], tau: float, block_rows: int) -> tuple[DataFrame, dict[int, Cells]]:
    """(``distinct`` with the number of each vector's cell or -1, cells of each length of vectors that fills more than a block)."""
    spark = distinct.sparkSession
    held = distinct.withColumn("cell", F.lit(-1)).withColumn("away", F.lit(0.0))
    cells: dict[int, Cells] = {}
    free = {d: n for d, n in counts.items() if n > block_rows}
    for turn in range(ROUNDS):
        new: dict[int, tuple[int, np.ndarray]] = {}
        for dim in free:
            most = max(1, min(CENTRES, CENTRE_BYTES // (8 * dim)))
            picked = held.filter((F.col("dim") == dim) & (F.col("cell") < 0)).select("key", "x", F.xxhash64(F.lit(11 + turn), "x").alias("h")).orderBy("h", "key").limit(most).toArrow()
            if not len(picked):
                continue
            x, keys = _matrix(picked.column("x"), len(picked)), picked.column("key").to_numpy()
            _, chosen = _net(x, np.arange(len(x)), 0, tau / 2)
            had = cells.get(dim)
            new[dim] = (len(had.x) if had else 0, x[chosen])
            cells[dim] = Cells(x[chosen], keys[chosen]) if had is None else Cells(np.concatenate([had.x, x[chosen]]), np.concatenate([had.keys, keys[chosen]]))
        if not new:
            break
        sent = spark.sparkContext.broadcast(new)

        def assign(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, away = (batch.column(batch.schema.get_field_index(c)).to_numpy().copy() for c in ("cell", "away"))
                for dim, rows, part in _by_dim(batch):
                    if dim not in sent.value:
                        continue
                    first, centres = sent.value[dim]
                    x = _matrix(part.column(part.schema.get_field_index("x")), len(part))
                    for some in _pieces(len(rows), len(centres)):
                        gap = 2 - 2 * (x[some] @ centres.T)
                        near = np.argmin(gap, axis=1)
                        d = np.sqrt(np.maximum(0, gap[np.arange(len(near)), near]))
                        hit = (at[rows[some]] < 0) & (d <= tau / 2 - _ROOM)
                        at[rows[some][hit]], away[rows[some][hit]] = first + near[hit], d[hit]
                yield batch.set_column(batch.schema.get_field_index("cell"), "cell", pa.array(at, pa.int32())).set_column(batch.schema.get_field_index("away"), "away", pa.array(away))

        before, held = held, materialize(held.mapInArrow(assign, held.schema), "vec-cells")
        release(before)
        covered = {d: len(x) for d, (_, x) in new.items()}
        left = {r["dim"]: r["n"] for r in held.filter("cell < 0").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        # go on where much is left and the round took its share, beside the centres themselves
        free = {d: left[d] for d in free if left.get(d, 0) > block_rows and free[d] - left[d] - covered.get(d, 0) > 0.1 * free[d]}
    found = held.filter("cell >= 0").groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.max("away").alias("radius"))
    for r in found.collect():  # a row for each centre
        c = cells[r["dim"]]
        c.size[r["cell"]], c.weight[r["cell"]], c.radius[r["cell"]] = r["n"], r["weight"], r["radius"]
    for c in cells.values():
        c.size[c.size < 2] = 0  # alone: no cell
        c.pack(block_rows)
    return held, cells


def send(held: DataFrame, cells: dict[int, Cells], tau: float, least: float) -> DataFrame:
    """What each vector is to meet: (key, weight, x, dim, cell, block or -1, clique: its block is one cell, to: other blocks it may reach, whole: cells it is linked with whole).

    All vectors of one cell are linked with each other, as its radius is below ``tau / 2``.
    """
    sent = held.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            block, clique, to, whole = np.full(n, -1), np.zeros(n, bool), [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
            for dim, rows, part in _by_dim(batch):
                if dim not in sent.value:
                    continue
                c = sent.value[dim]
                there = np.flatnonzero(c.size > 0)
                x = _matrix(part.column(part.schema.get_field_index("x")), len(part))
                mine = cell[rows]
                block[rows] = np.where((mine >= 0) & (c.size[mine] > 0), c.block[mine], -1)
                clique[rows] = (block[rows] >= 0) & c.alone[mine]
                for some in _pieces(len(rows), len(c.x)):
                    d = c.distances(x[some])[:, there]
                    other = c.block[there][None, :] > block[rows[some]][:, None]  # each pair of blocks from the one below
                    full = other & (d + c.radius[there] <= tau - _ROOM)
                    part_ = other & ~full & (d - c.radius[there] <= tau + _ROOM)
                    for k, row in enumerate(rows[some].tolist()):
                        to[row] = np.unique(c.block[there[part_[k]]])
                        whole[row] = there[full[k] & ~np.isin(c.block[there], to[row])]  # else it meets the cell there
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in vs])), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *vs]).astype(np.int64))) for vs in (to, whole)]
            columns = [batch.column(batch.schema.get_field_index(name)) for name in ("key", "weight", "x", "dim", "cell")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(block, pa.int64()), pa.array(clique), *lists], names=["key", "weight", "x", "dim", "cell", "block", "clique", "to", "whole"])

    return held.mapInArrow(run, "key long, weight long, x array<double>, dim int, cell int, block long, clique boolean, to array<long>, whole array<long>")


def meet(sent: DataFrame, block_rows: int, least: float) -> DataFrame:
    """(key, weight, x, dim, task, side, labels, first): the vectors of each pair of blocks to be compared; side 0 alone is compared with itself.

    Blocks that are larger than ``block_rows``, of one great cell or of vectors sent or without
    a cell, are split by hash, so a task has two sides of about that size at most.  A block's
    tree is built once, down to radius ``least``, and goes along; vectors sent come without one.
    """

    def plant(table: pa.Table) -> pa.Table:
        labels, first = build(_matrix(table.column("x"), len(table)), least)
        table = table.append_column("labels", pa.FixedSizeListArray.from_arrays(pa.array(labels.ravel()), labels.shape[1]).cast(pa.list_(pa.int64())))
        return table.append_column("first", pa.array(first))

    split = lambda n: F.greatest(F.ceil(F.col(n) / block_rows), F.lit(1))
    part = lambda of: F.pmod(F.xxhash64(F.lit(5), "x"), F.col(of))
    hosts = sent.select("key", "weight", "x", "dim", F.col("block").alias("b"), "clique", F.lit(False).alias("guest"))
    guests = sent.select("key", "weight", "x", "dim", F.explode("to").alias("b"), "clique", F.lit(True).alias("guest"))
    every = hosts.unionByName(guests)
    sizes = every.groupBy("dim", "b").agg(F.count_if(~F.col("guest")).alias("own_n"), F.count_if(F.col("guest")).alias("guest_n"))
    sizes = sizes.select("dim", "b", split("own_n").alias("own"), F.when(F.col("guest_n") > 0, split("guest_n")).otherwise(0).alias("guests"))
    sizes = materialize(few(sizes, 0), "vec-blocks")
    every = every.join(sizes, ["dim", "b"])  # a row for each block, which may be many: adaptive execution decides
    host = every.filter("NOT guest").withColumn("i", part("own"))
    planted = StructType(host.schema.fields + StructType.fromDDL("labels array<long>, first long").fields)
    host = materialize(host.groupBy("dim", "b", "i").applyInArrow(plant, planted), "vec-trees")
    host = host.withColumn("j", F.explode(F.expr("concat(if(clique, array(), sequence(0L, own - 1)), transform(if(guests > 0, sequence(0L, guests - 1), array()), g -> -1 - g))")))
    host = host.withColumn("side", F.expr("if(j >= 0 AND i > j, 1, 0)"))
    host = host.withColumn("task", F.expr("concat_ws(':', b, if(j >= 0, least(i, j), i), if(j >= 0, greatest(i, j), j))"))
    guest = every.filter("guest").withColumn("i", F.explode(F.expr("sequence(0L, own - 1)"))).withColumn("side", F.lit(1))
    guest = guest.withColumn("task", F.concat_ws(":", "b", "i", -1 - part("guests")))
    guest = guest.withColumn("labels", F.lit(None).cast("array<long>")).withColumn("first", F.lit(None).cast("long"))
    columns = ["key", "weight", "x", "dim", "task", "side", "labels", "first"]
    return host.select(*columns).unionByName(guest.select(*columns))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    tau = math.sqrt(max(0.0, 2 - 2 * least))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("v"))
    sound = F.expr("v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(v, c -> c <> 0)")
    # scaled by its largest part, so that no square over- or underflows
    scaled = F.expr("transform(v, c -> double(c) / array_max(transform(v, e -> abs(double(e)))))")
    usable = rows.filter(sound)
    # numbered once and for all by being written
    same = usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn("key", F.monotonically_increasing_id())
    distinct = materialize(same.withColumn("x", scaled).withColumn("dim", F.size("v")), "vec-distinct")
    counts = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    held, cells = cover(distinct.select("key", "weight", "x", "dim"), counts, tau, block_rows)
    sent = materialize(send(held, cells, tau, least), "vec-sent")
    release(held)

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sides = []
        for s in (0, 1):
            part = table.filter(pa.array(side == s))
            if len(part):
                x, labels = _matrix(part.column("x"), len(part)), part.column("labels").combine_chunks()
                tree = build(x, tau / 2) if labels.null_count else (labels.flatten().to_numpy().reshape(len(part), -1), part.column("first").to_numpy())
                sides.append((Tree(x, part.column("weight").to_numpy(), *tree), part.column("key").to_numpy()))
        lonely = len(sides) == 1
        i, j = table.column("task")[0].as_py().split(":")[1:]
        if lonely and i != j:
            return pa.table({"key": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        (a, ka), (b, kb) = sides[0], sides[-1]
        links = dual(a, b, least)
        u = np.concatenate([np.zeros(0, np.int64), *links.u])
        v = np.concatenate([np.zeros(0, np.int64), *links.v])
        keys, counted = ka, links.of_a
        if not lonely:
            keys, counted, v = np.concatenate([ka, kb]), np.concatenate([links.of_a, links.of_b]), v + len(ka)
        root = _forest(u, v, len(keys))
        hit = counted > 0
        return pa.table({"key": keys[hit], "links": counted[hit], "to": keys[root][hit]})

    found = meet(sent, block_rows, tau / 2).groupBy("dim", "task").applyInArrow(compare, "key long, links long, to long")
    # cells linked whole: the vector counts the cell, each vector of the cell counts it, and all are one component
    table = [(d, k, int(c.weight[k]), int(c.keys[k])) for d, c in cells.items() for k in np.flatnonzero(c.size > 0).tolist()]
    centres = F.broadcast(sent.sparkSession.createDataFrame(table, "dim int, cell int, heft long, centre long"))  # a row for each centre
    whole = sent.select("key", "weight", "dim", F.explode(F.col("whole").cast("array<int>")).alias("cell")).join(centres, ["dim", "cell"])
    told = whole.select("key", F.col("heft").alias("links"), F.col("centre").alias("to"))
    back = whole.groupBy("dim", "cell").agg(F.sum("weight").alias("links"), F.min("key").alias("to"))
    own = sent.filter("clique").join(centres, ["dim", "cell"]).select("key", F.col("heft").alias("links"), F.col("centre").alias("to"))
    members = sent.filter("block >= 0").select("key", "dim", "cell").join(F.broadcast(back), ["dim", "cell"]).select("key", "links", "to")
    found = materialize(found.unionByName(told).unionByName(own).unionByName(members), "vec-links")
    release(sent)
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    placed = distinct.select("v", "key", "least").join(groups, F.col("key") == F.col("node"), "left").join(linked.withColumnRenamed("key", "linked"), F.col("key") == F.col("linked"), "left")
    placed = placed.select("v", "least", "links", F.coalesce("component", "key").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_vector = placed.join(named, "root").select(F.col("v").alias("v__"), "links", "component_id")
    joined = rows.join(by_vector, rows["v"] == F.col("v__"), "left")
    n_links = F.coalesce(F.col("links") - 1, F.lit(0)).cast("long")
    out = joined.select(rows["vec_id"], n_links.alias("n_links"), F.coalesce("component_id", rows["vec_id"]).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

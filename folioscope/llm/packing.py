"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous rounds.

A document is its token ids and an end id.  One that is longer than a sequence is cut into
pieces of a sequence's length, the first of which is shorter; others stay whole.  Then, in
each round:

1. Open pieces and gaps (the free ends of sequences) are range-sorted together, longest
   first.
2. Every part of that order is swept: a piece takes its *successor*, the smallest gap of
   the part that holds it, and what is left of the gap comes back where its new size
   stands.  Within a part this is best fit by falling length.
3. Pieces whose part has no gap left turn to the parts before, all of whose gaps hold
   them.  Which part serves which follows from a row of counts for each part, as brackets
   are matched; pieces that want the same gaps go by their rank among those in want, as
   many to a gap as surely fit.
4. Gaps shrink by what they took.  The longest of the pieces that are left open new
   sequences, as many as are needed anyhow: for the tokens that all gaps together cannot
   take, or for those of pieces longer than every gap, whichever is more.  The others look
   again in the next round; one of them is placed there, as long as a gap holds it.

Rounds end when no piece is open.  Once the open pieces and the gaps that hold one are no
more than a part, they are swept together, and what finds no gap opens a sequence there
and then, so the last rounds are one.  Every round ends in written tables of narrow rows; the
texts are read once, and token ids do not move.  A length that a third of all pieces have
is spread over parts like any other run of the order, as ids break ties.

Null and empty texts are one end id.  Rows that repeat, or have no id, are separate
documents.  An empty table gives no rows.  Further columns are left out.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import bpe
from folioscope.llm.scratch import bound_batches, materialize

CAPACITY = 2048
#: Open pieces and gaps that one task sweeps.
PART_ROWS = 1 << 15
_GAP, _OPEN, _PLACED, _SPENT = range(4)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32), with ``ids`` where asked: the pieces of every document."""
    bound_batches(docs.sparkSession)
    path = path or bpe.default_path()
    spec, key = docs.sparkSession.sparkContext.broadcast(bpe.load(path)), hash(path)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe._encoder(key, spec.value)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            row, out, at = [], [], 0
            for group in bpe._groups(texts):
                for ids in coder.encode_batch(group):
                    whole = np.append(ids, end_id).astype("<u4")
                    first = (len(whole) - 1) % capacity + 1
                    for piece, (a, b) in enumerate(zip([0, *range(first, len(whole), capacity)], range(first, len(whole) + 1, capacity), strict=True)):
                        row.append(at)
                        out.append((piece, a, b - a, zlib.crc32(whole[a:b].tobytes())) + ((whole[a:b].astype(np.int32),) if with_ids else ()))
                    at += 1
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=False)]
            columns = columns[: 4 + with_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names=["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sweep(size: list[int], is_piece: list[bool], name: list[int], used: int | None = None, capacity: int = 0) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Best fit over rows of falling size, gaps before pieces of their size: (piece, size, gap) placed, (piece, size) not, (gap, size) left.

    Gaps wait on a stack, the smallest on top; what is left of a gap waits until the sweep has come down to it.
    With ``used``, the number of sequences so far, pieces without a gap open new ones.
    """
    stack: list[tuple[int, int]] = []
    rest: list[tuple[int, int]] = []
    placed, open_ = [], []
    for s, piece, k in zip(size, is_piece, name, strict=True):
        while rest and -rest[0][0] >= s:
            least, gap = heapq.heappop(rest)
            stack.append((-least, gap))
        if not piece:
            stack.append((s, k))
        elif stack or used is not None:
            if stack:
                room, gap = stack.pop()
            else:
                room, gap, used = capacity, used, used + 1
            placed.append((k, s, gap))
            if room > s:
                heapq.heappush(rest, (s - room, gap))
        else:
            open_.append((k, s))
    return placed, open_, [(gap, room) for room, gap in stack] + [(gap, -least) for least, gap in rest]


def _together(open_: DataFrame, gaps: DataFrame) -> DataFrame:
    return open_.select("size", F.lit(True).alias("piece"), F.col("uid").alias("name")).unionByName(gaps.select("size", F.lit(False).alias("piece"), F.col("gap").alias("name")))


def _order() -> list:
    """Longest first; at one size gaps, then pieces."""
    return [F.col("size").desc(), F.col("piece"), F.col("name")]


def _finished(open_: DataFrame, gaps: DataFrame, used: int, capacity: int) -> DataFrame:
    """(uid, gap) of all open pieces, which with the gaps are no more than one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            table = pa.Table.from_batches(held)
            placed, _, _ = sweep(*(table.column(c).to_pylist() for c in ("size", "piece", "name")), used, capacity)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in placed], pa.int64()) for k in (0, 2)], names=["uid", "gap"])

    return _together(open_, gaps).coalesce(1).sortWithinPartitions(*_order()).mapInArrow(run, "uid long, gap long")


def _swept(open_: DataFrame, gaps: DataFrame, parts: int) -> DataFrame:
    """(part, rank, kind, name, size, gap): the outcome of a sweep of every part.

    ``rank``: of open pieces from the longest, of gaps from the smallest that holds whatever stands in later parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        size = table.column("size").to_pylist()
        placed, left, gaps = sweep(size, table.column("piece").to_pylist(), table.column("name").to_pylist())
        fits = sorted((room, gap) for gap, room in gaps if room >= size[-1])
        small = [(gap, room) for gap, room in gaps if room < size[-1]]
        rows = [(k, _OPEN, piece, s, None) for k, (piece, s) in enumerate(left)]
        rows += [(k, _GAP, gap, room, None) for k, (room, gap) in enumerate(fits)]
        rows += [(None, _SPENT, gap, room, None) for gap, room in small] + [(None, _PLACED, piece, s, gap) for piece, s, gap in placed]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)] if rows else []
        if columns:
            part = pa.array(np.full(len(rows), TaskContext.get().partitionId()), pa.int32())
            yield pa.RecordBatch.from_arrays([part, *columns], names=["part", "rank", "kind", "name", "size", "gap"])

    return _together(open_, gaps).repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).mapInArrow(run, "part int, rank long, kind int, name long, size long, gap long")


def served(counts: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int]]]:
    """Which part's gaps serve which part's open pieces, as brackets match.

    ``counts``: for each part in order its open pieces and the longest of them, its gaps
    and the smallest of them.  Returns (part, first rank, end rank, part of the gaps,
    first rank of the gaps, pieces to a gap), and (part, first rank) of those in want.
    """
    waiting: list[list[int]] = []
    found, want = [], []
    for part, pieces_, longest, gaps, least in sorted(counts):
        at = 0
        while at < pieces_ and waiting:
            top = waiting[-1]
            fit = max(1, top[3] // longest)
            upto = min(pieces_, at + fit * (top[2] - top[1]))
            found.append((part, at, upto, top[0], top[1], fit))
            top[1] += -(-(upto - at) // fit)
            at = upto
            if top[1] == top[2]:
                waiting.pop()
        if at < pieces_:
            want.append((part, at))
        if gaps:
            waiting.append([part, 0, gaps, least])
    return found, want


def _round(spark: SparkSession, open_: DataFrame, gaps: DataFrame, parts: int, used: int, capacity: int) -> tuple[DataFrame, DataFrame, list[DataFrame], int]:
    """Open pieces, gaps, placed pieces (uid, gap) after a round, and the number of sequences."""
    swept = materialize(_swept(open_, gaps, parts), "pack-swept")
    kind = F.col("kind")
    of = lambda k, f, c="size": f(F.when(kind == k, F.col(c)))
    counts = swept.groupBy("part").agg(of(_OPEN, F.count).alias("pieces"), of(_OPEN, F.max).alias("longest"), of(_GAP, F.count).alias("gaps"), of(_GAP, F.min).alias("least"), of(_OPEN, F.sum).alias("tokens"))
    rows = counts.collect()  # a row for each task of the sweep
    found, want = served([(r["part"], r["pieces"], r["longest"], r["gaps"], r["least"]) for r in rows])
    placed = [swept.filter(kind == _PLACED).select(F.col("name").alias("uid"), "gap")]
    left = swept.filter(kind == _OPEN).select("part", "rank", F.col("name").alias("uid"), "size")
    there = swept.filter(kind.isin(_GAP, _SPENT)).select("part", "rank", F.col("name").alias("gap"), "size")
    if found:
        ways = spark.createDataFrame(found, "to int, first long, upto long, from int, start long, fit long")
        go = left.join(ways, (F.col("part") == F.col("to")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("upto")))
        go = go.select("uid", "size", F.col("from").alias("part"), F.expr("start + (rank - first) div fit").alias("rank"))
        took = go.groupBy("part", "rank").agg(F.sum("size").alias("took"), F.collect_list("uid").alias("uids"))  # as many as fit
        there = materialize(there.join(took, ["part", "rank"], "left").select("gap", (F.col("size") - F.coalesce("took", F.lit(0))).alias("size"), "uids"), "pack-gaps")
        placed.append(there.select(F.explode("uids").alias("uid"), "gap"))
    there = there.select("gap", "size").filter("size > 0")
    if not want:
        return open_.limit(0), there, placed, used
    number, base = [], 0
    count = {r["part"]: r["pieces"] for r in rows}
    for part, first in want:
        number.append((part, first, base))
        base += count[part] - first
    ranks = spark.createDataFrame(number, "in int, first long, base long")
    homeless = left.join(ranks, (F.col("part") == F.col("in")) & (F.col("rank") >= F.col("first"))).select("uid", "size", (F.col("base") + F.col("rank") - F.col("first")).alias("place"))
    homeless = materialize(homeless, "pack-homeless")
    least, tokens = homeless.agg(F.min("size"), F.sum("size")).first()
    room, widest = there.filter(F.col("size") >= least).agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    beyond = homeless.agg(F.coalesce(F.sum(F.when(F.col("size") > widest, F.col("size"))), F.lit(0))).first()[0]
    new = max(0, -(-(tokens - room) // capacity), -(-beyond // capacity))
    opened = homeless.filter(F.col("place") < new).select("uid", "size", (F.lit(used) + F.col("place")).alias("gap"))
    if new:
        placed.append(opened.select("uid", "gap"))
        there = there.unionByName(opened.select("gap", (F.lit(capacity) - F.col("size")).alias("size")).filter("size > 0"))
    return homeless.filter(F.col("place") >= new).select("uid", "size"), there, placed, used + new


def place(cut: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """(uid, gap): the sequence of each piece of a written table with ``uid`` and ``length`` of at most ``capacity``."""
    spark = cut.sparkSession
    open_ = cut.select("uid", F.col("length").alias("size"))
    gaps = spark.createDataFrame([], "gap long, size long")
    placed: list[DataFrame] = []
    used = 0
    while True:
        todo = open_.agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least")).first()
        if not todo["n"]:
            break
        gaps = gaps.filter(F.col("size") >= todo["least"])
        rows = todo["n"] + gaps.count()
        if rows <= part_rows:
            placed.append(_finished(open_, gaps, used, capacity))
            break
        open_, gaps, new, used = _round(spark, open_, gaps, -(-rows // part_rows), used, capacity)
        placed += new
    if not placed:
        return cut.select("uid", F.lit(0).cast("long").alias("gap"))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (its place in the sequence, longest first); with ``ids`` where asked."""
    cut = materialize(pieces(docs, capacity, end_id, path, id_col, text_col, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    where = materialize(place(cut, capacity, part_rows), "pack-placed")
    joined = cut.join(where, "uid").withColumnRenamed("gap", "sequence_id")
    own = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "uid")  # capacity pieces at most
    offset = F.sum("length").over(own) - F.col("length")
    return joined.withColumn("offset", offset).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", **options) -> DataFrame:
    """The packed sequences: sequence_id, length, ids, and of each piece in order its document, place and length."""
    packed = pack(docs, capacity, id_col=id_col, with_ids=True, **options)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", F.struct(id_col, "piece", "start", "length").alias("own"))))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return grouped.select("sequence_id", "length", F.flatten("parts.ids").alias("ids"), F.col("parts.own").alias("pieces"))

"""The stored search index: segments of blocked postings, and a search that skips blocks.

Documents come in ranges of ``BLOCK`` ids.  A row is a term in one range: the documents that
have it, with positions, and beside them the most a document of the range has of the term
and the length of its shortest one, which bound every score in the row from above.

*Segments.*  A change writes one segment: rows of the changed documents as they are now,
and, for the terms of their texts before, counts to be taken off.  So a term's document
frequency is a sum over rows, of any number of segments, and no row that is there is
touched.  A document in a row counts if its ``epoch`` is the one that ``doc_length`` has
for it; those of an older epoch are marked as dead by that.  When ``FAN`` segments of one
size have gathered they are merged into one, without their dead, so a document is written
again as often as the logarithm of the number of changes.

*Search.*  For the best k of words joined by AND, OR and NOT, bounds of all ranges are had
from the narrow columns.  The ranges of the highest bounds are scored first; of the others
only those whose bound reaches the k-th best score found are read at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import ranged
from folioscope.functions import text as tx
from folioscope.operators import search
from folioscope.scratch import rounds
from folioscope.store import Change

_SEGMENT = "term string, block bigint, n bigint, max_tf int, min_dl bigint, docs array<struct<document_id:bigint,tf:int,dl:bigint,epoch:bigint,positions:array<int>>>"
#: Ids of a range of documents.
BLOCK = 1024
#: Segments of one size that are merged, and the factor from one size to the next.
FAN = 4
#: Ranges that are scored first, and the most of them if those hold fewer matches than are wanted; then all are scored at once.
SEEDS, MOST_SEEDS = 8, 4096


def segment(new: DataFrame, dead: DataFrame | None, epoch: int, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Rows of a segment: documents (document_id, ocr_text) as they are now, and those whose earlier texts no longer count.

    Texts meet by ranges of ids, and a range is inverted as a whole: the many more postings are not shuffled.
    ``parts``: in so many tasks, where what a task writes should not grow with the texts.
    """
    texts = new.select("document_id", "ocr_text", F.lit(True).alias("now"))
    if dead is not None:
        texts = texts.unionByName(dead.select("document_id", "ocr_text", F.lit(False).alias("now")))
    texts = texts.withColumn("block", F.expr(f"document_id div {block}"))
    texts = (texts.repartition(parts, "block") if parts else texts.repartition("block")).sortWithinPartitions("block", "document_id")
    words = texts.select("block", F.col("document_id").cast("bigint").alias("document_id"), "now", tx.tokens(F.col("ocr_text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one range
        for batch in batches:
            at = batch.column("block").to_numpy()
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1), len(at)] if len(at) else []):
                if held and held[0].column("block")[0].as_py() != at[a]:
                    yield from inverted(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from inverted(pa.Table.from_batches(held)).to_batches()

    def inverted(table: pa.Table) -> pa.Table:
        now = table["now"].to_numpy()
        words = table["words"].combine_chunks()
        found = search.inverted(words, by_term=True)
        own = now[found.row]
        terms = len(found.names)
        n = np.bincount(found.code, np.where(own, 1, -1), terms).astype(np.int64)
        row, code, tf = found.row[own], found.code[own], found.tf[own].astype(np.int32)
        dl = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        posts = {"document_id": table["document_id"].combine_chunks().take(pa.array(row)), "tf": pa.array(tf), "dl": pa.array(dl), "epoch": pa.array(np.full(len(row), epoch, np.int64)), "positions": found.positions.filter(pa.array(own))}
        return _packed(found.names, table["block"][0].as_py(), n, code, posts)

    return words.mapInArrow(run, _SEGMENT)


def _packed(names: pa.Array, block: int, n: np.ndarray, code: np.ndarray, posts: dict[str, pa.Array]) -> pa.Table:
    """Rows of one range: ``posts`` in order of their terms, whose codes are ``code``."""
    terms = len(names)
    tf, dl = posts["tf"].to_numpy(), posts["dl"].to_numpy()
    ends = np.append(0, np.cumsum(np.bincount(code, minlength=terms)))
    docs = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(list(posts.values()), list(posts)))
    none = np.diff(ends) == 0
    most, least = np.zeros(terms, np.int32), np.full(terms, np.iinfo(np.int64).max)
    np.maximum.at(most, code, tf)
    np.minimum.at(least, code, dl)
    columns = [names, pa.array(np.full(terms, block, np.int64)), pa.array(n), pa.array(most, mask=none), pa.array(least, mask=none), docs]
    return pa.Table.from_arrays(columns, ["term", "block", "n", "max_tf", "min_dl", "docs"])


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("term", "block", F.inline("docs"))


def flat(rows: DataFrame, lens: DataFrame) -> DataFrame:
    """(document_id, term, tf, positions) of documents as they are now."""
    return _exploded(rows).join(lens.select("document_id", "epoch"), ["document_id", "epoch"], "left_semi").select("document_id", "term", "tf", "positions")


def merged(rows: DataFrame, lens: DataFrame, block: int = BLOCK) -> DataFrame:
    """One segment of several: dead documents go, counts are added up.

    Rows are shuffled once, as they are, and meet by ranges of ids, as texts do; single postings are not shuffled.
    """
    each = ("document_id", "tf", "dl", "epoch")
    parts = rows.select("term", "block", "n", *[F.col(f"docs.{c}").alias(c) for c in each], F.flatten("docs.positions").alias("positions"))
    now = lens.select(F.expr(f"document_id div {block}").alias("block"), F.col("document_id").cast("bigint").alias("document_id"), F.col("epoch").cast("bigint").alias("epoch"))

    def one(found: pa.Table, live: pa.Table) -> pa.Table:
        """The rows of one range."""
        names = found["term"].combine_chunks().dictionary_encode()
        of = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = found["document_id"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        ids, tf, dl, epoch = (found[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in each)
        code = np.repeat(of, sizes)
        known = live.sort_by("document_id")
        at = np.searchsorted(known["document_id"].to_numpy(), ids)
        own = np.append(known["document_id"].to_numpy(), -1)[at] == ids
        own &= np.append(known["epoch"].to_numpy(), -1)[at] == epoch
        order = np.lexsort((ids, code))
        order = order[own[order]]
        n = np.zeros(len(names.dictionary), np.int64)
        np.add.at(n, of, found["n"].to_numpy())
        ends = np.append(0, np.cumsum(tf, dtype=np.int64)).astype(np.int32)
        positions = pa.ListArray.from_arrays(pa.array(ends), found["positions"].combine_chunks().flatten()).take(pa.array(order))
        posts = {"document_id": pa.array(ids[order]), "tf": pa.array(tf[order]), "dl": pa.array(dl[order]), "epoch": pa.array(epoch[order]), "positions": positions}
        out = _packed(names.dictionary, found["block"][0].as_py() if len(found) else 0, n, code[order], posts)
        return out.filter(pa.array((n != 0) | (np.bincount(code[order], minlength=len(n)) > 0)))

    return parts.groupBy("block").cogroup(now.groupBy("block")).applyInArrow(one, _SEGMENT)


def _segments(entries: list[dict]) -> dict[str, list[dict]]:
    """Files by segment, which is the folder they were written to."""
    out: dict[str, list[dict]] = {}
    for e in entries:
        out.setdefault(e["path"].rpartition("/")[0], []).append(e)
    return out


def update(change: Change, old: DataFrame, new: DataFrame, block: int = BLOCK) -> int:
    """K8. Bring the index of a change from ``old`` to ``new`` (document_id, ocr_text); only rows of touched documents are needed.

    Returns the number of documents that were indexed anew or taken out.
    """
    before = old.select("document_id", F.col("ocr_text").alias("was"), F.lit(True).alias("had"))
    both = new.select("document_id", "ocr_text", F.lit(True).alias("has")).join(before, "document_id", "full_outer")
    both = change.keep(both.filter(F.col("has").isNull() | ~F.col("ocr_text").eqNullSafe(F.col("was"))))
    n = both.count()
    if not n:
        return 0
    fresh, dead = both.filter("has").select("document_id", "ocr_text"), both.filter("was IS NOT NULL").select("document_id", F.col("was").alias("ocr_text"))
    change.append("posting", change.keep(segment(fresh, dead, change.number, block)))
    lens = search.lengths(fresh).withColumn("epoch", F.lit(change.number).cast("bigint"))
    change.merge("doc_length", ["document_id"], lens, both.filter("has IS NULL").select("document_id"))
    tier(change, block=block)
    return n


def tier(change: Change, fan: int = FAN, block: int = BLOCK) -> None:
    """Merge segments while ``fan`` or more are of one size."""
    while True:
        sizes: dict[int, list[list[dict]]] = {}
        for files in _segments(change.entries("posting")).values():
            sizes.setdefault(int(math.log(max(1, sum(e["rows"] for e in files)), fan)), []).append(files)
        full = [x for _, x in sorted(sizes.items()) if len(x) >= fan]
        if not full:
            return
        taken = [e for files in full[0] for e in files]
        paths = {e["path"] for e in taken}
        rows = ranged.read(change.store.spark, change.store.schema("posting"), taken)
        change.set("posting", [e for e in change.entries("posting") if e["path"] not in paths])
        change.append("posting", change.keep(merged(rows, change.read("doc_length"), block)))


def totals(entries: list[dict]) -> tuple[int, float]:
    """A18. Documents and their mean length, by the sums that the files of ``doc_length`` tell."""
    n = sum(e["rows"] for e in entries)
    return n, sum(e["sum_dl"] or 0 for e in entries) / max(n, 1)


def of_words(tree: search.Leaf | search.Node) -> bool:
    """Whether a query is of single whole words only, whose scores the rows bound."""
    return all(len(x.words) == 1 and not x.prefix and not x.parts for x in search.leaves(tree))


@dataclass(frozen=True)
class Found:
    """The best documents (document_id, rank), and of how many ranges that a match may lie in how many were read."""

    rows: DataFrame
    ranges: int
    read: int


def _part(idf: float, tf: Column, dl: Column, avgdl: float) -> Column:
    return F.lit(idf) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * dl / F.lit(avgdl)))


def best(query: str, rows: DataFrame, lens: DataFrame, limit: int = search.DEFAULT_LIMIT, size: tuple[int, float] | None = None, seeds: int = SEEDS) -> Found:
    """W5. The best ``limit`` of a query of single words, as ``search.find`` has them, with ranges skipped by their bounds.

    ``size``: number and mean length of all documents, counted from ``lens`` where it is not given.
    """
    tree = search.parse(search.escape(query))
    if not of_words(tree):
        raise search.QueryError("ranges are skipped for single words only")
    leaves = search.leaves(tree)
    words = [x.words[0] for x in leaves]
    n, avgdl = size or lens.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    avgdl = avgdl or 1.0
    own = rows.filter(F.col("term").isin(*words))
    with rounds(rows.sparkSession) as keep:
        heads = keep(own.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl")))
        df = {r["term"]: r["n"] for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each word
        raw = {w: math.log((n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) if n - df.get(w, 0) + 0.5 > 0 else 0.0 for w in words}
        idf = {w: x if x > 0 else search.LEAST_IDF for w, x in raw.items()}
        scoring = {x.words[0] for x in search._scoring(tree)}
        bound = sum((F.coalesce(F.max(F.when((F.col("term") == w) & F.col("tf").isNotNull(), _part(idf[w], F.col("tf"), F.col("dl"), avgdl))), F.lit(0.0)) for w in sorted(scoring)), F.lit(0.0))
        there = {x: F.coalesce(F.max((F.col("term") == x.words[0]) & F.col("tf").isNotNull()), F.lit(False)) for x in leaves}
        blocks = keep(heads.groupBy("block").agg(bound.alias("bound"), _may(tree, there).alias("may")).filter("may").select("block", "bound"))

        def scored(of: DataFrame) -> DataFrame:
            docs = of.select("term", F.inline("docs")).join(lens.select("document_id", "epoch"), ["document_id", "epoch"], "left_semi")
            flags = {x: F.max(F.col("term") == x.words[0]) for x in leaves}
            parts = F.lit(0.0)
            for w in sorted(scoring):
                parts = F.when(F.col("term") == w, _part(idf[w], F.col("tf"), F.col("dl"), avgdl)).otherwise(parts)
            found = docs.groupBy("document_id").agg(search._truth(tree, flags).alias("ok"), (-F.sum(parts)).alias("rank"))
            return found.filter("ok").select("document_id", "rank").orderBy("rank", "document_id").limit(limit)

        ranges, done, top, least = blocks.count(), 0, None, None
        while done < ranges and least is None and seeds <= MOST_SEEDS:
            first = [r["block"] for r in blocks.orderBy(F.desc("bound"), "block").limit(seeds).collect()]
            top = keep(scored(own.filter(F.col("block").isin(first))))
            done, seeds = len(first), seeds * 8
            worst = top.agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank")).first()
            least = -worst["rank"] if worst["n"] == limit else None
        if top is None:
            return Found(keep(lens.select("document_id", F.lit(0.0).alias("rank")).limit(0)), 0, 0)
        if done < ranges:
            rest = keep(blocks.filter((F.col("bound") >= (least or 0.0) * (1 - 1e-9)) & ~F.col("block").isin(first)).select("block"))
            more = rest.count()
            if more:
                top = top.unionByName(scored(own.join(rest, "block", "left_semi"))).orderBy("rank", "document_id").limit(limit)
            done += more
        return Found(keep(top), ranges, done)


def _may(node: search.Leaf | search.Node, there: dict[search.Leaf, Column]) -> Column:
    """Whether a range may hold a match, by which words it has; what must be absent from a document may be in its range."""
    if isinstance(node, search.Leaf):
        return there[node]
    if node.op == "NOT":
        return _may(node.left, there)
    left, right = _may(node.left, there), _may(node.right, there)
    return left & right if node.op == "AND" else left | right

"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; a word whose preceding ``WINDOW`` bytes
hash below ``CUT`` begins a new chunk.  As a cut depends on those bytes only, chunks
line up again right after an insertion, and a passage is cut alike wherever it stands.
Chunks are known by digests of 94 bits of their words, and by how many these are.  The first chunk of a digest -
by doc_id, then place - stays; later ones are repeats.  Where a run of repeats has
``MIN_WORDS`` words or more that follow each other in one earlier place too, it is removed.

Chunks are shuffled once, by digest.  A slice of half a megabyte of text sends one row for
each digest it has, with the places it stands in, so a chunk that every document holds
is one row a slice.  What returns to a document are its repeated chunks only.  Texts are
shuffled once, to meet the chunks to remove; only texts that lose some go to Python.

Texts are cut whole.  Null texts stay null; texts without words stay as they are; rows
that repeat both id and text are one document and stay; documents of one id, or of none,
and different texts are told apart by a digest of 128 bits (which is left out where every
row has an id of its own).  An empty table gives no rows.  Further columns stay as they
are, whatever they are called; those of the report get longer names where they clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import materialize, unused
from folioscope.llm.words import Text, slices, text_of

#: Bytes that decide about a cut, and the share of words that begin a chunk, of 2**16.
WINDOW, CUT = 16, (1 << 16) // 5
#: Words of repeated chunks in the order of one other place from which on they are removed: of a passage
#: of over 50 words, what surely is left without the chunks at its ends, which share words with what is around.
MIN_WORDS = 25
#: A chunk ends after so many words, as in a text that says one word over and over.
MAX_WORDS = 32
#: Bytes of text whose chunks are sent together, one row for each digest.
DIGEST_BYTES = 1 << 19
#: Bits that hold the words of a chunk less one.
WORD_BITS = 5
REPORT = ("removed_words__", "removed__", "firsts__")
_GEAR = np.random.default_rng(29).integers(0, 1 << 32, 256, dtype=np.uint32)


def _roll(buf: np.ndarray) -> np.ndarray:
    """Gear hash of the ``WINDOW`` bytes that end at each byte: sum of G[byte k back] << k."""
    h, step = _GEAR[buf], 1
    while step < WINDOW:
        h = h.copy()
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def chunks(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte, words and digest (two rows of 62 bits) of each chunk of a slice; the first chunk begins where the document does."""
    if not len(text.starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((2, 0), np.int64)
    own = text.offsets[text.doc]
    h = _roll(text.buf)
    new = np.append(True, text.doc[1:] != text.doc[:-1])
    far = text.starts - own >= WINDOW
    cut = far & ((h[np.maximum(text.starts - 1, 0)] >> np.uint32(16)) < CUT)
    first = np.flatnonzero(new | cut)
    run = np.arange(len(cut)) - first[np.searchsorted(first, np.arange(len(cut)), "right") - 1]
    first = np.flatnonzero(new | cut | (run % MAX_WORDS == 0))
    after = np.append(first[1:], len(text.starts))
    digest = np.stack([text.hashes(text.starts[first], text.ends[after - 1], lane).view(np.int64) for lane in (0, 1)])
    begin = np.where(new[first], own[first], text.starts[first])
    return text.doc[first], begin, after - first, digest


def version(text: Column, versioned: bool) -> Column:
    """What tells texts of one id apart; nothing where ids do."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))) if versioned else F.lit(b"")


def _order(ids: pa.Array, versions: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row by id, nulls first, then version; and whether a row is the first of its place."""
    table = pa.table([ids, versions], names=["id", "version"])
    order = pa.compute.sort_indices(table, sort_keys=[("id", "ascending"), ("version", "ascending")], null_placement="at_start").to_numpy()
    table = table.take(order)
    same = np.ones(max(0, len(order) - 1), bool)
    for column in table.columns:
        column = column.combine_chunks()
        left, right = column.slice(0, len(same)), column.slice(1)
        equal = pa.compute.or_(pa.compute.fill_null(pa.compute.equal(left, right), False), pa.compute.and_(left.is_null(), right.is_null()))
        same &= equal.to_numpy(zero_copy_only=False)
    first = np.zeros(len(order), bool)
    first[order[np.flatnonzero(np.append(True, ~same))[: len(order)]]] = True
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, first


def occurrences(docs: DataFrame, id_col: str, text_col: str, versioned: bool) -> DataFrame:
    """(d1, d2, doc_id, version, at, more): for each slice and digest the first place in it, and the others; rows in order of place.

    d2 holds 32 bits of the digest and, in its last ``WORD_BITS``, the words less one.  No version where ids tell texts apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    place_kind = f"struct<doc_id:{kind},version:binary,at:int>" if versioned else f"struct<doc_id:{kind},at:int>"
    names = ["d1", "d2", "doc_id", *["version"] * versioned, "at", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            place, once = _order(ids, versions)
            for start, stop, text in slices(batch.column(2), DIGEST_BYTES):
                doc, _, words, digest = chunks(text)
                at = np.arange(len(doc)) - np.searchsorted(doc, doc)
                row = start + doc
                second = (digest[1].view(np.uint64) >> np.uint64(32) << np.uint64(WORD_BITS)).astype(np.int64) + words - 1
                digest = np.stack([digest[0], second])
                if not once[start:stop].all():
                    keep = once[row]
                    row, at, digest = row[keep], at[keep], digest[:, keep]
                order = np.lexsort((at, place[row], digest[1], digest[0]))
                row, at, digest = row[order], at[order].astype(np.int32), digest[:, order]
                first = np.flatnonzero(np.append(True, (digest[:, 1:] != digest[:, :-1]).any(axis=0))[: len(row)])
                sizes = np.diff(np.append(first, len(row))) - 1
                # in order of place neighbours have much in common, which compresses well
                turn = np.lexsort((at[first], row[first]))
                rest = np.repeat(first[turn] + 1, sizes[turn]) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes[turn]) - sizes[turn], sizes[turn])
                first, sizes = first[turn], sizes[turn]

                def held(which: np.ndarray, row=row, at=at) -> list[pa.Array]:
                    own = pa.array(row[which])
                    return [ids.take(own), *([versions.take(own)] if versioned else []), pa.array(at[which])]

                others = pa.StructArray.from_arrays(held(rest), names=["doc_id", *["version"] * versioned, "at"])
                more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), others, mask=pa.array(sizes == 0))
                yield pa.RecordBatch.from_arrays([pa.array(digest[0][first]), pa.array(digest[1][first]), *held(first), more], names=names)

    rows = docs.select(docs[id_col].alias("doc_id"), version(docs[text_col], versioned).alias("version"), docs[text_col].alias("t"))
    return rows.mapInArrow(run, f"d1 long, d2 long, doc_id {kind}, {'version binary, ' * versioned}at int, more array<{place_kind}>")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", versioned: bool = True) -> DataFrame:
    """(doc_id, version, chunks, firsts): per document the numbers of the chunks to remove, and ids of documents that hold them first."""
    place = F.struct("doc_id", *["version"] * versioned, "at")
    alike = Window.partitionBy("d1", "d2")
    found = occurrences(docs, id_col, text_col, versioned)
    found = found.withColumn("first", F.min(place).over(alike)).withColumn("n", F.count(F.lit(1)).over(alike)).filter("n > 1 OR more IS NOT NULL")
    every = F.concat(F.array(place), F.coalesce("more", F.array().cast(found.schema["more"].dataType)))
    words = (F.col("d2").bitwiseAND((1 << WORD_BITS) - 1) + 1).cast("int").alias("words")
    later = found.select(words, "first", F.explode(every).alias("place")).filter("NOT place <=> first")
    key, origin = ["doc_id", *["version"] * versioned], ["origin", *["origin_version"] * versioned]
    later = later.select(*[f"place.{c}" for c in key], "place.at", "words", *[F.col(f"first.{c}").alias(o) for c, o in zip(key, origin, strict=True)], F.col("first.at").alias("origin_at"))
    lists = later.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("at", "words", *origin, "origin_at"))).alias("later")).select(*key, "later")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(key))
            flat, cuts = column.flatten(), np.append(0, np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)))
            at, words = flat.field("at").to_numpy(), flat.field("words").to_numpy()
            own = np.repeat(np.arange(len(column)), np.diff(cuts))
            code = lambda name: flat.field(name).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
            place = np.unique(np.stack([code(c) for c in origin]), axis=1, return_inverse=True)[1].ravel()
            left = np.flatnonzero(_aligned(own, at, words, place, flat.field("origin_at").to_numpy()))
            bounds = pa.array(np.searchsorted(left, cuts), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, flat.field(c).take(pa.array(left))) for c in ("at", "origin")]
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(key)], *lists], names=[*key, "chunks", "firsts"])
            yield out.filter(pa.array(np.diff(np.searchsorted(left, cuts)) > 0))

    found = lists.mapInArrow(run, f"doc_id {kind}, {'version binary, ' * versioned}chunks array<int>, firsts array<{kind}>")
    return found.withColumn("firsts", F.array_sort(F.array_distinct("firsts")))


def _aligned(own: np.ndarray, at: np.ndarray, words: np.ndarray, origin: np.ndarray, origin_at: np.ndarray) -> np.ndarray:
    """Which repeated chunks go: those of a run from the first to the last that stand in one other
    place in the same order, or are one chunk said over and over, if these have ``MIN_WORDS`` words.  Short common chunks that happen
    to be known from here and there neither make a run nor lengthen one."""
    if not len(at):
        return np.zeros(0, bool)
    run = np.cumsum(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))
    edge = np.zeros(len(at) + 1, np.int64)
    for place in (origin_at.astype(np.int64) - at, origin_at.astype(np.int64)):  # in the same order; or one chunk over and over
        _, group = np.unique(np.stack([run, origin.astype(np.int64), place]), axis=1, return_inverse=True)
        group = group.ravel()
        heavy = np.bincount(group, weights=words) >= MIN_WORDS
        first, last = np.full(len(heavy), len(at)), np.full(len(heavy), -1)
        np.minimum.at(first, group, np.arange(len(at)))
        np.maximum.at(last, group, np.arange(len(at)))
        np.add.at(edge, first[heavy], 1)
        np.add.at(edge, last[heavy] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` without the repeated passages in its texts; a column ``n_chars`` is kept true.

    report: adds ``removed_words__ long``, ``removed__ array<array<long>>`` (first and last+1
    code point of each removed piece in the old text) and ``firsts__`` (ids that keep them).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    versioned = not docs.select(docs[id_col].alias("id")).groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty()
    i, v, c, f, own, new = (unused(x, [*docs.columns, *REPORT]) for x in ("id__", "version__", "chunks__", "where__", "own__", "new__"))
    found = materialize(repeats(docs, id_col, text_col, versioned), "sub-repeats")
    found = found.select(F.col("doc_id").alias(i), *[F.col("version").alias(v)] * versioned, F.col("chunks").alias(c), F.col("firsts").alias(f))
    rows = docs.withColumn(own, version(docs[text_col], versioned)) if versioned else docs
    on = (rows[id_col].eqNullSafe(found[i]) & (rows[own] == found[v])) if versioned else rows[id_col] == found[i]
    joined = rows.join(found.hint("merge"), on, "left").select(*[rows[x] for x in docs.columns], c, f)

    @F.arrow_udf("struct<text:string,words:bigint,spans:array<array<bigint>>>")
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        # texts that lose nothing come as nulls
        done = [without(t.as_py(), d.as_py()) if d.is_valid else (None, None, None) for t, d in zip(texts, drops, strict=True)]
        parts = [pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64()))))]
        return pa.StructArray.from_arrays(parts, names=["text", "words", "spans"])

    hit = joined[c].isNotNull()
    joined = joined.withColumn(new, cut(F.when(hit, joined[text_col]), joined[c]))
    text = F.when(hit, joined[new]["text"]).otherwise(joined[text_col])
    counted = next((x for x in docs.columns if x == "n_chars" and x != text_col), None)
    kept = {text_col: text} | ({counted: F.when(hit, F.length(joined[new]["text"]).cast(docs.schema[counted].dataType)).otherwise(joined[counted])} if counted else {})
    out = [kept[x].alias(x) if x in kept else joined[x] for x in docs.columns]
    if report:
        none = F.array()
        values = (F.coalesce(joined[new]["words"], F.lit(0)).cast("long"), F.coalesce(joined[new]["spans"], none.cast("array<array<bigint>>")), F.coalesce(joined[f], none.cast(f"array<{kind}>")))
        out += [value.alias(unused(name, docs.columns)) for name, value in zip(REPORT, values, strict=True)]
    return joined.select(*out)


def without(text: str, drop: list[int]) -> tuple[str, int, list[list[int]]]:
    """A text without some of its chunks, the words removed, and what was removed in code points."""
    body = text.encode()
    _, begin, words, _ = chunks(text_of([body]))
    bounds = np.append(begin, len(body))
    gone = np.zeros(len(begin), bool)
    gone[drop] = True
    kept: list[bytes] = []
    spans: list[list[int]] = []
    for k in np.flatnonzero(np.append(True, gone[1:] != gone[:-1])).tolist():
        rest = np.flatnonzero(gone[k:] != gone[k])
        piece = body[bounds[k] : bounds[k + rest[0] if len(rest) else len(gone)]]
        if gone[k]:
            at = len(body[: bounds[k]].decode())
            spans.append([at, at + len(piece.decode())])
        else:
            kept.append(piece)
    return b"".join(kept).decode(), int(words[gone].sum()), spans

"""Ranked lexical search of a set of query texts over all documents, by sort-based accumulation.

A first pass cuts every document into terms and keeps, for the terms that any query has,
how often the document has them; numbers of documents and of terms are counted over all
documents.  A second pass accumulates: for a slice of documents the impacts of their terms
are laid out once for every query that holds the term, as packed (query, document) keys;
the keys are radix sorted, 16 bits a turn, runs of one key are summed by ``reduceat``, and
what beats a query's k-th best so far goes to that query's heap.  Tasks hand on k rows a
query; these are range-partitioned by (query, score), so that each part keeps the first k
of the queries it holds, and the last selection sees k rows a part of them.

Score: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); its impact on a document
that holds it tf times is weight * (10**9 tf div (1000 tf + 12 m)), where m is
75 + (25 n N div L) for a document of n terms; N documents have L terms in all.  A query
adds an impact as often as it has the term.

Scale: the documents are read once, and never shuffled; a slice's contributions are bounded
(``SLICE``), and a document that is very long has no more of them than the queries have
terms.  Queries go in blocks of ``BLOCK_TERMS`` terms, which is the bound of what is
broadcast; further blocks take further passes.

Terms are looked up by hash and compared byte by byte.  Null and empty texts have no term
and are found by nothing; a query without terms has no row.  Rows that repeat are separate
documents; equal queries of one id are one.  Equal scores go by ascending id, null ids
last.  Ids are whole numbers.  Empty tables give no rows.  Further columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import words
from folioscope.llm.scratch import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct (query, term) pairs of a block of queries.
BLOCK_TERMS = 1 << 20
#: Contributions that are sorted at once.
SLICE = 1 << 20
_BYTES = np.array([b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)
_BYTES[list(UPPER.encode())] = list(LOWER.encode())


def _plain(column: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and a blank for every byte that is in no term."""
    column = column.fill_null("") if column.null_count else column
    size = 8 if pa.types.is_large_string(column.type) else 4
    ends = np.frombuffer(column.buffers()[1], f"i{size}")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return column
    body = _BYTES[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    return type(column).from_buffers(len(column), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(body))


class Block:
    """Some queries: their terms by hash, and for each term the queries that hold it."""

    def __init__(self, queries: np.ndarray, terms: list[str], times: np.ndarray):
        """Pairs in any order: number of the query, term, how often the query has it."""
        names, code = np.unique(np.array([t.encode() for t in terms], object), return_inverse=True)
        text = words.text_of(list(names))
        ends = np.cumsum([len(x) for x in names], dtype=np.int64)
        starts = ends - [len(x) for x in names]
        self.lane = 0 if len(np.unique(text.hashes(starts, ends, 0))) == len(names) else 1
        hashes = text.hashes(starts, ends, self.lane)
        order = np.argsort(hashes)  # codes go by hash
        self.hashes, self.starts, self.lens, self.letters = hashes[order], starts[order], (ends - starts)[order], text.buf.copy()
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        code = place[code]
        self.numbers, query = np.unique(queries, return_inverse=True)
        by = np.argsort(code, kind="stable")
        self.query, self.times = query[by], times[by]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))])

    def codes(self, text: words.Text) -> tuple[np.ndarray, np.ndarray]:
        """(document, term) of the words of ``text`` that are terms of this block."""
        hashes = text.hashes(text.starts, text.ends, self.lane)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lens[at] == text.ends - text.starts))
        code, size = at[hit], self.lens[at[hit]]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = text.buf[np.repeat(text.starts[hit], size) + within] != self.letters[np.repeat(self.starts[code], size) + within]
        if differ.any():
            same = np.ones(len(hit), bool)
            same[np.repeat(np.arange(len(hit)), size)[differ]] = False
            hit, code = hit[same], code[same]
        return text.doc[hit], code


def _postings(docs: DataFrame, block: Block) -> DataFrame:
    """(id, n, codes, tfs): every document's number of terms, and those of the block with how often they occur."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        lists = pa.list_(pa.int32())
        for batch in batches:
            for at, to, text in words.slices(_plain(batch.column(1))):
                doc, code = block.codes(text)
                key, tf = np.unique(doc * len(block.hashes) + code, return_counts=True)
                doc, code = key // len(block.hashes), key % len(block.hashes)
                ends = pa.array(np.searchsorted(doc, np.arange(to - at + 1)), pa.int32())
                found = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(text.counts, pa.int64()), *(x.cast(lists) for x in found)], names=["id", "n", "codes", "tfs"])

    return docs.mapInArrow(run, f"id {kind}, n long, codes array<int>, tfs array<int>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of whole numbers, 16 bits a turn from the lowest; equal ones stay in place."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    shift = 0
    while True:
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # a radix sort at this width
        shift += 16
        if not top >> shift:
            return order


def accumulate(doc: np.ndarray, code: np.ndarray, impact: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of all queries that share a term with a document, from its terms' impacts."""
    fan = block.first[code + 1] - block.first[code]
    total = int(fan.sum())
    place = np.repeat(block.first[code] - (np.cumsum(fan) - fan), fan) + np.arange(total)
    value = np.repeat(impact, fan) * block.times[place]
    bits = int(doc.max()).bit_length() if len(doc) else 0
    key = (block.query[place] << bits) | np.repeat(doc, fan)
    order = radix_order(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if total else np.zeros(0, np.int64)
    sums = np.add.reduceat(value[order], starts) if total else value
    return key[starts] >> bits, key[starts] & ((1 << bits) - 1), sums


def _scored(posts: DataFrame, block: Block, weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(query, id, score): each task's k best of every query of the block."""
    sent = posts.sparkSession.sparkContext.broadcast((block, weights))
    kind = posts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = sent.value
        heaps: list[list[tuple]] = [[] for _ in block.numbers]
        least = np.zeros(len(heaps), np.int64)  # the k-th best of each query so far
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = batch.column(2)
            ends = codes.offsets.to_numpy().astype(np.int64)
            code, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            doc = np.repeat(np.arange(len(n)), np.diff(ends))
            m = 75 + 25 * n * documents // max(terms, 1)
            impact = weights[code] * (10**9 * tf // (1000 * tf + 12 * m[doc]))
            fan = np.where(impact > 0, block.first[code + 1] - block.first[code], 0)
            upto = np.concatenate([[0], np.cumsum(fan)])[ends - ends[0]]
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE, "right")) - 1)
                own = slice(ends[at] - ends[0], ends[to] - ends[0])
                live = impact[own] > 0
                query, found, score = accumulate(doc[own][live] - at, code[own][live], impact[own][live], block)
                for q, d, s in zip(*(x[score >= least[query]].tolist() for x in (query, found, score)), strict=True):
                    heap, own_id = heaps[q], ids[at + d]
                    entry = (s, -math.inf if own_id is None else -own_id)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        least[q] = heap[0][0]
                at = to
        rows = [(int(block.numbers[q]), None if minus == -math.inf else -minus, s) for q, heap in enumerate(heaps) for s, minus in heap]
        if rows:
            query, own_id, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(own_id, codes_type), pa.array(score, pa.int64())], names=["query", "id", "score"])

    codes_type = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32()}.get(kind, pa.int64())
    return posts.select("id", "n", "codes", "tfs").mapInArrow(run, f"query long, id {kind}, score long")


def rank(queries: DataFrame, docs: DataFrame, k: int = 20, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query text, scores above 0."""
    spark = docs.sparkSession
    items = queries.select(queries[item_col].alias("item"), F.coalesce(queries[text_col], F.lit("")).alias("text")).distinct()
    items = materialize(items.withColumn("query", F.monotonically_increasing_id()), "lexical-queries")
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    pairs = materialize(items.select("query", F.explode(found).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times")), "lexical-terms")
    blocks = -(-pairs.count() // block_terms)
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    best = None
    for b in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas()  # block_terms rows, give or take a query
        if not len(own):
            continue
        block = Block(own["query"].to_numpy(), own["term"].tolist(), own["times"].to_numpy())
        posts = materialize(_postings(narrow, block), "lexical-postings")
        total = posts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
        documents, terms = int(total["documents"]), int(total["terms"] or 0)
        held = posts.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).collect()  # a row for each term of the block
        weights = np.zeros(len(block.hashes), np.int64)
        for r in held:
            weights[r["code"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
        scored = materialize(_scored(posts, block, weights, documents, terms, k), "lexical-scored")
        best = scored if best is None else best.unionByName(scored)
    if best is None:
        kinds = docs.schema[id_col].dataType
        best = spark.createDataFrame([], "query long, score long").withColumn("id", F.lit(None).cast(kinds))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    ranged = best.repartitionByRange("query", *order)
    ranked = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(items.select("query", F.col("item").alias(item_col)), "query").select(item_col, "rank", F.col("id").alias(id_col), "score")

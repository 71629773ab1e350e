"""MinHash near-duplicates: consistent weighted sampling over TF-IDF shingles.

A text is its windows of five words, each weighing its count times a damped inverse
document frequency.  Improved consistent weighted sampling draws ``HASHES`` samples of
which two texts agree in each with the probability of their weighted Jaccard
similarity; ``ROWS`` samples make a band, and texts that share a band are candidates.

* Document frequencies come from all documents, counted in ``SLOTS`` hashed slots: a
  table of fixed size, summed in pieces, whatever the corpus.
* The weight of a shingle lies between 1 and 1.5, so words that very many copies share
  weigh less than rare ones but cannot hide that the copies are alike.
* Texts that are equal are one node from the start, by digest.
* In a band's bucket every node is first compared with the bucket's hub, the node whose
  bands are shared most: as many pairs as members.
* Then every pair of a bucket's nodes that these links leave in different classes is
  compared, block against block of nodes with ``BLOCK`` words: no pair that shares a band
  is left out unless its two nodes are in one class already.  Nodes of a bucket's largest class
  meet the others only, so what is sent and compared grows with the others.  A bucket of
  several blocks first has each block compared within itself, which joins most.
* Candidates are verified by their exact weighted Jaccard similarity over whole texts.

Classes are the connected components of the links; a class's id is its smallest
doc_id, and that document is kept; of several texts of that id, or of a class without
ids, that of the least digest.  A text of one to four words is one shingle of all
its words; texts without words, and null texts, are only like equal texts (null like
null).  Rows that repeat are in one class.  A pair at the very threshold is alike.  Further
columns are left out of the classes, and kept by ``deduplicate``, whatever they are called.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.scratch import few, materialize, release, unused
from folioscope.llm.words import SHINGLE, Text, distinct, mix, slices, text_of

HASHES, ROWS = 36, 3
SIMILARITY = 0.8
#: Words of a bucket's nodes in a block, about, as many as a task holds at ease; pairs of blocks are compared in tasks of their own.
BLOCK = 1 << 18
#: Slots of document frequencies, and pieces in which they are summed.
SLOTS, PIECES = 1 << 18, 64
#: How much more the rarest shingle weighs than one that all documents have.
DAMPING = 0.5
#: Pairs with their texts in a task, and tasks for these at least.
_PAIRS = (5000, 24)
_TABLE = 1 << 16


def shingles(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of a slice, by document; short texts are one shingle."""
    doc, _, key = text.shingles()
    few = (text.counts > 0) & (text.counts < SHINGLE)
    if few.any():
        words, of = text.word_hashes(), text.doc
        total = np.zeros(text.n, np.uint64)
        first = np.searchsorted(of, np.arange(text.n))
        for k in range(SHINGLE - 1):
            here = np.flatnonzero(few & (text.counts > k))
            total[here] = total[here] * np.uint64(0xC2B2AE3D27D4EB4F) + words[first[here] + k]
        short = np.flatnonzero(few)
        doc, key = np.concatenate([doc, short]), np.concatenate([key, mix(total[short] + np.uint64(1))])
    return distinct(doc, key)


def slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents that have a shingle of each slot, all documents)."""
    size = SLOTS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            n += len(batch)
            for _, _, text in slices(batch.column(0)):
                _, key, _ = shingles(text)
                total += np.bincount(slot(key), minlength=SLOTS)
        if n:
            pieces = [total[k * size : (k + 1) * size].astype("<u4").tobytes() for k in range(PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary()), pa.array([n] + [0] * (PIECES - 1), pa.int64())], names=["piece", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, counts, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held = sums.setdefault(piece, [np.zeros(size, np.int64), 0])
                held[0] += np.frombuffer(counts, "<u4")
                held[1] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], names=["piece", "counts", "n"])

    counted = docs.select(docs[text_col].alias("t")).mapInArrow(count, "piece int, counts binary, n long")
    rows = counted.repartition(PIECES, "piece").mapInArrow(add, "piece int, counts binary, n long").collect()
    total = np.zeros((PIECES, size), np.int64)
    for r in rows:
        total[r["piece"]] += np.frombuffer(r["counts"], np.int64)
    return total.ravel(), sum(r["n"] for r in rows)


def slot_weights(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Damped inverse document frequency of each slot, from 1 to 1 + DAMPING."""
    return (1 + DAMPING * np.log((n + 1) / (np.minimum(frequencies, n) + 1)) / np.log(n + 2)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with tabulated random variables."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        r, c, beta = rng.gamma(2, 1, _TABLE), rng.gamma(2, 1, _TABLE), rng.random(_TABLE)
        self.r, self.inverse, self.beta = r.astype(np.float32), (1 / r).astype(np.float32), beta.astype(np.float32)
        self.base = (np.log(c) + r * beta - r).astype(np.float32)  # ln a = ln c - r (t - beta) - r
        self.factors = rng.integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """n x HASHES samples; documents without shingles have zeros."""
        out = np.zeros((n, HASHES), np.uint64)
        if not len(doc):
            return out
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        lens, own = np.diff(np.append(starts, len(doc))), doc[starts]
        log_w = np.log(weight).astype(np.float32)
        for k in range(HASHES):
            at = ((key * self.factors[k]) >> np.uint64(48)).astype(np.int32)
            t = np.floor(log_w * self.inverse[at] + self.beta[at])
            a = self.base[at] - self.r[at] * t
            hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lens))
            d = doc[hit]
            hit = hit[np.append(True, d[1:] != d[:-1])]
            out[own, k] = mix(key[hit] ^ (t[hit].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return out


def bands(samples: np.ndarray) -> np.ndarray:
    """Hashes of the bands of each document, told apart by their number."""
    out = np.zeros((len(samples), HASHES // ROWS), np.uint64)
    for b in range(HASHES // ROWS):
        total = np.full(len(samples), b + 1, np.uint64)
        for k in range(ROWS):
            total = mix(total * np.uint64(0xC2B2AE3D27D4EB4F) + samples[:, b * ROWS + k])
        out[:, b] = total
    return out.view(np.int64)


def signatures(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, size, bands): the digest of the text, its words, and its bands, empty without words."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            parts: list = []
            sizes: list = []
            for _, _, text in slices(batch.column(2), 1 << 19):
                doc, key, tf = shingles(text)
                found = bands(sampler.sample(doc, key, tf * sent.value[slot(key)], text.n))
                has = text.counts > 0
                parts += [row if ok else [] for row, ok in zip(found.tolist(), has.tolist(), strict=True)]
                sizes += text.counts.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["doc_id", "key", "size", "bands"])

    rows = docs.select(docs[id_col].alias("doc_id"), digest(docs[text_col]).alias("key"), docs[text_col].alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, size long, bands array<long>")


def digest(text):
    """Sixteen bytes that stand for a text; null has its own."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.unhex(F.lit("00")))


def similarity(a: bytes, b: bytes, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts."""
    doc, key, tf = shingles(text_of([a, b]))
    cut = int(np.searchsorted(doc, 1))
    ka, kb = key[:cut], key[cut:]
    wa, wb = tf[:cut] * weights[slot(ka)].astype(np.float64), tf[cut:] * weights[slot(kb)].astype(np.float64)
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    shared = np.minimum(wa[both], wb[at[both]]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def verify(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """(a, b, like) for pairs of keys, by their texts; the text of a hub goes to each of its pairs."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    n = pairs.count()
    joined = few(few(pairs.join(left, "a"), n, *_PAIRS).join(right, "b"), n, *_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())
            like = [similarity(x.as_py(), y.as_py(), sent.value) >= least for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.bool_())], names=["a", "b", "like"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, like boolean")


def block_links(comp: np.ndarray, side: np.ndarray, texts: list[bytes], weights: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join all components some pair of texts is alike across; of two sides, only pairs across them are compared."""
    doc, key, tf = shingles(text_of(texts))
    weight = tf * weights[slot(key)].astype(np.float64)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    own, total = doc[starts], np.add.reduceat(weight, starts) if len(doc) else np.zeros(0)
    ends = np.append(starts[1:], len(doc))
    words, at = np.unique(key, return_inverse=True)
    dense = np.zeros(len(words))
    comp, side = np.unique(comp, return_inverse=True)[1][own], side[own]
    largest = comp == np.bincount(comp).argmax() if len(comp) else np.zeros(0, bool)
    two = len(np.unique(side)) > 1
    # each pair once: of two sides from the first; of one from nodes outside the largest component, to that and to later ones
    ask = np.flatnonzero(side == side.min() if two else ~largest) if len(comp) else []
    target = side != side.min() if two else np.ones(len(comp), bool)
    out = []
    for i in ask:
        if not two:
            target[i] = False
        open_ = target & (comp != comp[i])
        if not open_.any():
            continue
        mine = slice(starts[i], ends[i])
        dense[at[mine]] = weight[mine]
        shared = np.add.reduceat(np.minimum(weight, dense[at]), starts)
        dense[at[mine]] = 0
        for j in np.flatnonzero(open_ & (shared / (total + total[i] - shared) >= least)):
            if comp[j] != comp[i]:
                out.append((int(own[i]), int(own[j])))
                comp[comp == comp[j]] = comp[i]
    return out


def _open(left: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """(key, size, bucket, comp, main, others, most) of buckets with nodes in several components; of buckets with equal nodes, one.

    ``main`` is the largest component of the bucket with ``most`` words; ``others`` counts those of the rest.
    """
    held = left.select("key", "size", "bucket").join(groups.select(F.col("node").alias("key"), "component"), "key", "left")
    held = materialize(few(held.select("key", "size", "bucket", F.coalesce("component", "key").alias("comp")), rows), "mh-held")
    print_ = [F.sum(F.xxhash64("key", F.lit(k)).cast("decimal(38,0)")).alias(f"p{k}") for k in (1, 2)]
    per = held.groupBy("bucket", "comp").agg(F.sum("size").alias("n"), *print_)
    whole = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"), F.sum("p1").alias("p1"), F.sum("p2").alias("p2"))
    whole = few(whole, rows).filter("comps > 1").groupBy("p1", "p2", "all").agg(F.min(F.struct("bucket", "top")).alias("one"))
    whole = few(whole, rows).select("one.bucket", F.col("one.top.comp").alias("main"), (F.col("all") - F.col("one.top.n")).alias("others"), F.col("one.top.n").alias("most"))
    found = materialize(few(held.join(whole, "bucket"), rows).select("key", "size", "bucket", "comp", "main", "others", "most"), "mh-open")
    release(held)
    return found


def resolve(opened: DataFrame, texts: DataFrame, weights: np.ndarray, least: float, all_blocks: bool) -> DataFrame:
    """(a, b): links between the components of each bucket of ``_open``, by all pairs of its blocks or only by one or two for each block."""
    sent = opened.sparkSession.sparkContext.broadcast(weights)
    single = F.col("others") + F.col("most") <= BLOCK
    parts = opened.withColumn("nb", F.when(single, 1).otherwise(F.ceil(F.col("others") / BLOCK)).cast("int")).withColumn("mb", F.when(single, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("int"))
    parts = parts.withColumn("is_main", (F.col("mb") > 0) & (F.col("comp") == F.col("main")))
    parts = parts.withColumn("mine", F.expr("cast(if(is_main, nb + pmod(xxhash64(key), mb), pmod(xxhash64(key), nb)) as int)"))
    if all_blocks:
        partners = F.expr("if(is_main, sequence(0, nb - 1), sequence(0, nb + mb - 1))")
    else:
        partners = F.expr("if(is_main, filter(sequence(0, nb - 1), x -> x % mb = mine - nb), if(mb = 0, array(mine), array(mine, cast(nb + mine % mb as int))))")
    dealt = parts.select("key", "bucket", "comp", "mine", F.explode(partners).alias("other"))
    dealt = dealt.select("key", "bucket", "comp", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    full = dealt.join(texts, "key").select("bucket", "i", "j", "key", "comp", "mine", "text")
    full = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        ids: dict[bytes, int] = {}
        comp = np.array([ids.setdefault(r[1], len(ids)) for r in rows])
        found = block_links(comp, np.array([r[2] for r in rows]), [r[3].encode() for r in rows], sent.value, least)
        return [(rows[i][0], rows[j][0]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            out = []
            for bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, i, j) != now:
                    out += links(held) if held else []
                    now, held = (bucket, i, j), []
                held.append(row)
            yield made(out)
        if held:
            yield made(links(held))

    return materialize(full.mapInArrow(run, "a binary, b binary"), "mh-links")


def _crowded(held: DataFrame, rows: int) -> DataFrame:
    """Members (key, size, bucket, weight) of buckets that hold two nodes or more; weight: by how much they are shared."""
    counts = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    inside = materialize(few(held.join(counts, "bucket"), rows), "mh-members")
    shared = few(inside.groupBy("key").agg(F.sum("n").alias("weight")), rows)
    found = materialize(few(inside.select("key", "size", "bucket").join(shared, "key"), rows), "mh-weighed")
    release(inside)
    return found


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, key (digest of its text), class_id, class_size, kept (doc_id = class_id)."""
    weights = slot_weights(*document_frequencies(docs, text_col))
    signed = materialize(signatures(docs, weights, id_col, text_col), "mh-signed")
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    size = signed.count()
    nodes = materialize(few(nodes, size), "mh-nodes")
    size = nodes.count()
    rows_ = size * (HASHES // ROWS)
    members = _crowded(nodes.select("key", "size", F.explode("bands").alias("bucket")), rows_)
    wanted = members.select("key").distinct().join(nodes.select("key", "rep"), "key").select(F.col("key").alias("key__"), F.col("rep").alias("rep__"))
    rows = docs.select(docs[id_col].alias("doc_id"), digest(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("rep__")) & (rows["key"] == F.col("key__"))).select("key", "text")
    if not signed.groupBy("key", "doc_id").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["key"])  # rows that repeat have one text
    texts = materialize(few(texts, size, *_PAIRS), "mh-texts")
    # Spark limits the rows of each bucket before the shuffle, so a crowded one sends a few from each task
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("weight"), F.desc("key")))
    hubs = members.withColumn("place", place).filter("place = 1").select("bucket", F.col("key").alias("hub"))
    star = materialize(few(members.join(few(hubs, rows_), "bucket").filter("key <> hub"), rows_), "mh-star")
    ends = [F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")]
    pairs = materialize(few(star.select(*ends).distinct(), rows_), "mh-pairs")
    verified = materialize(verify(pairs, texts, weights, least), "mh-verified")
    edges = verified.filter("like").select("a", "b")
    groups = components(edges)
    # a hub has met all of its bucket; all others go on where their bucket is not in one component
    opened = _open(star, groups, rows_)
    if not opened.filter(F.col("others") + F.col("most") > BLOCK).isEmpty():
        edges = edges.union(resolve(opened, texts, weights, least, all_blocks=False))
        groups = components(edges)
        opened = _open(opened, groups, rows_)
    if not opened.isEmpty():
        groups = components(edges.union(resolve(opened, texts, weights, least, all_blocks=True)))
    release(members, star, pairs, verified, texts, opened)
    groups = groups.withColumnRenamed("node", "node__")
    rooted = nodes.join(groups, nodes["key"] == F.col("node__"), "left").select("key", "rep", "copies", F.coalesce("component", "key").alias("root"))
    rooted = few(rooted, size)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("first")
    named = few(rooted.groupBy("root").agg(first, F.sum("copies").alias("class_size")), size)
    by_key = few(rooted.join(named, "root"), size).select(F.col("key").alias("key__"), F.col("first.rep").alias("class_id"), F.col("first.key").alias("first__"), "class_size")
    out = signed.select("doc_id", "key").join(by_key, F.col("key") == F.col("key__"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("first__"))
    return out.select("doc_id", "key", "class_id", "class_size", kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the document with the smallest id, once."""
    found = materialize(classes(docs, id_col, text_col, least).filter("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "mh-kept")
    i, k = unused("id__", docs.columns), unused("key__", docs.columns)
    kept = found.select(F.col("doc_id").alias(i), F.col("key").alias(k))
    own = unused("own__", docs.columns)
    rows = docs.withColumn(own, digest(docs[text_col]))
    out = rows.join(kept, rows[id_col].eqNullSafe(kept[i]) & (rows[own] == kept[k]), "left_semi")
    if found.filter("n > 1").limit(1).count():
        out = out.dropDuplicates([id_col, own])
    return out.select(*docs.columns)

"""Search over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import index, search
from folioscope.plans import adapters as ad
from folioscope.scratch import rounds


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = ad.doc(spark, sf_dir)
    return search.looked_up(docs), search.lengths(docs)


def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each term: documents, occurrences, and the sum of their first positions."""
    posts = search.postings(ad.doc(spark, sf_dir))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"), F.sum(F.element_at("positions", 1)).alias("firsts"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lens = _index(spark, sf_dir)
    return lens.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens"), F.round(F.avg("dl"), 6).alias("avgdl"))


def _found(spark: SparkSession, sf_dir: str, query: str, limit: int | None = None) -> DataFrame:
    posts, lens = _index(spark, sf_dir)
    return search.find(query, posts, lens, limit).select("document_id", F.round("rank", 6).alias("rank"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 for one word: a top-k, which is the operator."""
    return _found(spark, sf_dir, "idiot", search.DEFAULT_LIMIT)


def bm25_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 of either of two words, from rows of document ranges whose bounds let most ranges be skipped."""
    with rounds(spark) as keep:  # the index is stored, as it is for the verbs
        docs = keep(ad.doc(spark, sf_dir).select("document_id", "ocr_text"))
        rows = keep(index.segment(docs, None, 1, block=64))
        lens = keep(search.lengths(docs).withColumn("epoch", F.lit(1).cast("bigint")))
        found = index.best("idiot OR stupid", rows, lens, search.DEFAULT_LIMIT).rows
    return found.select("document_id", F.round("rank", 6).alias("rank"))


def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "all rights reserved")


def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "idiot AND trash")


def search_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "idiot OR stupid")


def search_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "idiot NOT trash")


def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "stupi*")


def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two words stand within ten of each other."""
    return _found(spark, sf_dir, "NEAR(idiot the, 10)").select("document_id")


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, lens = _index(spark, sf_dir)
    found = search.find("idiot", posts, lens)
    docs = ad.doc(spark, sf_dir).select("document_id", "ocr_text")
    return found.join(docs, "document_id").select("document_id", search.snippet(F.col("ocr_text"), ["idiot"]).alias("snippet"))


QUERIES = {f.__name__: f for f in (term_postings, corpus_stats, bm25_topk, bm25_blockmax, bm25_phrase, search_and, search_or, search_not, search_prefix, search_near, snippet)}

_BASE = f"WITH {ad.DOC}, {ad.TOKENS}, st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"


def _rank(hits: str, keep: str = "true", limit: str = "") -> str:
    """BM25 of hits(document_id, leaf, tf), over documents for which ``keep`` holds."""
    return f"""{_BASE}, hits AS ({hits}), df AS (SELECT leaf, count(*) AS df FROM hits GROUP BY 1),
        idf AS (SELECT leaf, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, st),
        r AS (SELECT document_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM hits JOIN idf USING (leaf) JOIN dl USING (document_id), st GROUP BY 1)
        SELECT document_id, round(rank, 6) AS rank FROM r WHERE {keep} {limit}"""


_ONE = "SELECT document_id, '{0}' AS leaf, count(*) AS tf FROM tok WHERE term = '{0}' GROUP BY 1"
_HAS = "document_id IN (SELECT document_id FROM tok WHERE term = '{0}')"

ORACLES = {
    "term_postings": f"{_BASE}, p AS (SELECT document_id, term, count(*) AS tf, min(pos) AS first FROM tok GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS n, sum(first)::BIGINT AS firsts FROM p GROUP BY 1",
    "corpus_stats": f"{_BASE} SELECT count(*) AS n, sum(dl)::BIGINT AS tokens, round(avg(dl), 6) AS avgdl FROM dl",
    "bm25_topk": _rank(_ONE.format("idiot"), limit="ORDER BY r.rank, document_id LIMIT 20"),
    "bm25_blockmax": _rank(_ONE.format("idiot") + " UNION ALL " + _ONE.format("stupid"), limit="ORDER BY r.rank, document_id LIMIT 20"),
    "bm25_phrase": _rank("SELECT a.document_id, 'p' AS leaf, count(*) AS tf FROM tok a JOIN tok b ON a.document_id = b.document_id AND b.pos = a.pos + 1 AND b.term = 'rights' JOIN tok c ON a.document_id = c.document_id AND c.pos = a.pos + 2 AND c.term = 'reserved' WHERE a.term = 'all' GROUP BY 1"),
    "search_and": _rank(_ONE.format("idiot") + " UNION ALL " + _ONE.format("trash"), _HAS.format("idiot") + " AND " + _HAS.format("trash")),
    "search_or": _rank(_ONE.format("idiot") + " UNION ALL " + _ONE.format("stupid")),
    "search_not": _rank(_ONE.format("idiot"), "NOT " + _HAS.format("trash")),
    "search_prefix": _rank("SELECT document_id, 'p' AS leaf, count(*) AS tf FROM tok WHERE starts_with(term, 'stupi') GROUP BY 1"),
    "search_near": f"{_BASE} SELECT DISTINCT a.document_id FROM tok a JOIN tok b ON a.document_id = b.document_id AND abs(a.pos - b.pos) - 1 <= 10 WHERE a.term = 'idiot' AND b.term = 'the'",
}

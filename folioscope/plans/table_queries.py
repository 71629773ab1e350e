"""Upserts, selectors, paths and review lists over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import ranged
from folioscope.functions import phash
from folioscope.functions import text as tx
from folioscope.operators import classify, duplicates, index, ingest, plan, reading, search
from folioscope.plans import adapters as ad
from folioscope.plans import index_queries, search_queries
from folioscope.scratch import buckets, release, rounds, shared_dir


def _now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def occurrence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths after a second scan: new, changed, unchanged, back again, and missing."""
    n = F.col("rel_path").cast("bigint")
    old = ad.sightings(spark, sf_dir, True).filter(n % 5 > 0)
    null = F.lit(None)
    stored = old.select((n + 1).alias("occurrence_id"), (n % 10).alias("document_id"), "rel_path", "mtime", "size_bytes", _now().alias("seen_at"), "missing_since", F.when(n % 3 == 0, "old").alias("conflict_kind"), _now().alias("hashed_at"), F.lit(1).cast("bigint").alias("last_scan_id"))
    listing = ad.sightings(spark, sf_dir, False).drop("missing_since").filter(n % 7 > 0)
    seen = ingest.classify(listing, stored).withColumn("document_id", F.when(F.col("state") != "unchanged", n % 6)).withColumn("conflict_kind", null.cast("string"))
    merged = ingest.sweep(ingest.merge_occurrences(stored, seen, 2, _now()), 2, _now())
    return merged.select("occurrence_id", "document_id", "rel_path", "mtime", "size_bytes", F.col("missing_since").isNotNull().alias("missing"), "conflict_kind", "last_scan_id")


def page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.page_ocr(spark, sf_dir)
    new = p.filter("page_number >= 3").withColumn("text", F.concat(F.lit("again "), F.col("page_number").cast("string"))).withColumn("status", F.lit("ok"))
    return reading.upsert_pages(p.filter("page_number <= 4"), new).select("document_id", "page_number", "text", "status")


def classification_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored verdicts and as new ones, which are cleaned; two for some, of which the later counts."""
    c = ad.table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("bigint")
    kinds = {"party": "c_name", "doc_type": "c_mktsegment"}
    blank = {x: F.lit(None).cast("string") for x in ("detail", "doc_date", "folder", "provenance", "note")}
    tags = F.array().cast("array<string>").alias("tags")
    stored = c.filter(k % 3 > 0).select(k.alias("document_id"), *[F.col(v).alias(x) for x, v in kinds.items()], *[v.alias(x) for x, v in blank.items()], tags, F.lit("2025-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    stored = stored.select("document_id", "party", "doc_type", "detail", "doc_date", "tags", "folder", "provenance", "note", "created_at", "updated_at")
    said = lambda seq, mark: c.filter(k % 2 == seq % 2).select(k.alias("document_id"), F.lit(seq).alias("seq"), F.concat(F.lit(" \t"), "c_name", F.lit(mark)).alias("party"), F.when(k % 5 > 0, " ").otherwise("note").alias("doc_type"), F.when(k % 7 == 0, "2024-02-03").when(k % 7 == 1, "3 Feb").alias("doc_date"))
    new = said(0, " ").unionByName(said(2, "! ").filter("document_id % 4 = 0")).unionByName(said(1, "").filter("document_id % 9 = 0"))
    out = classify.upsert(stored, new, _now())
    return out.select("document_id", "party", "doc_type", "doc_date", F.year("created_at").alias("created"), F.year("updated_at").alias("updated"))


def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents with the path of their lowest occurrence, and what is stored of them."""
    occ = ad.occ(spark, sf_dir).withColumns({"missing_since": F.when(F.col("occurrence_id") % 4 == 0, _now()), "mtime": F.lit(1.0), "size_bytes": F.lit(1)})
    docs = ad.doc(spark, sf_dir).select("document_id", "sha256", "ocr_text")
    lab = ad.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")).distinct()
    null = F.lit(None).cast("string")
    stored = lab.select("document_id", F.lit("someone").alias("party"), *[null.alias(c) for c in ("doc_type", "detail", "doc_date", "folder")], F.array().cast("array<string>").alias("tags"))
    return classify.plan_rows(docs, occ, stored).select("document_id", "sha256", "rel_path", "agent_party", F.coalesce("agent", F.lit(False)).alias("agent"))


def _edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents before and after some texts grew, some went and some came."""
    k = F.col("document_id")
    new = docs.filter(k % 11 > 0).withColumn("ocr_text", F.when(k % 3 == 0, F.concat("ocr_text", F.lit(" added wörd added"))).otherwise(F.col("ocr_text")))
    return docs.filter(k % 7 > 0), new


def postings_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after some texts grew, some went and some came: a row for each term."""
    with rounds(spark) as keep:  # what is indexed is stored, as it is for the verbs
        old, new = _edited(keep(ad.doc(spark, sf_dir).select("document_id", "ocr_text")))
        posts, lens = search.update(old, new, search.postings(old).select("term", "document_id", "tf", "positions"), search.lengths(old))
        total = lens.agg(F.sum("dl").alias("tokens"), F.count(F.lit(1)).alias("documents"))
        return keep(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"), F.sum(F.element_at("positions", -1)).alias("lasts")).join(F.broadcast(total)))  # one row


def document_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_upsert`` into a table of key ranges: only rows of the digests that were found are merged, only files that hold one are written anew."""
    stored, found = index_queries.upserted(spark, sf_dir)
    folder, layout = f"{shared_dir(spark)}/folioscope/ranges-{uuid.uuid4().hex}", ranged.Layout(("sha256",), ("document_id",), file_rows=2000)
    schema = stored.schema
    entries = ranged.write(stored, schema, folder, layout)
    with rounds(spark) as keep:
        keys = keep(found)
        held, _ = ranged.holding(spark, schema, entries, keys, ["sha256"], layout)
        old = ranged.read(spark, schema, held).join(keys.select("sha256"), "sha256", "left_semi").select(*schema.names)
        fresh = keep(ingest.merge_documents(old, keys, _now(), ranged.greatest(entries, "document_id")))
        done = ranged.merge(spark, schema, entries, fresh, None, ["sha256"], folder, layout, held)
    return ranged.read(spark, schema, done.entries).select("document_id", "sha256", "size_bytes", "mime", "page_count")


def posting_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by segments: one of the texts as they were, one of what changed, then both merged; frequencies are sums over rows."""
    with rounds(spark) as keep:  # segments are stored, as they are for the verbs
        docs = keep(ad.doc(spark, sf_dir).select("document_id", "ocr_text"))
        parts = max(8, docs.count() // (4 * index.BLOCK))  # a task has about four ranges of texts, however many there are
        with buckets(spark, "block", parts) as add:  # ranges lie together, as they are merged by them
            old, new = _edited(docs)
            fresh = keep(search.changed(old, new))
            gone = keep(fresh.select("document_id").union(old.select("document_id").join(new.select("document_id"), "document_id", "left_anti")))
            dead = keep(old.join(gone, "document_id", "left_semi"))
            lens = search.lengths(fresh).withColumn("epoch", F.lit(2).cast("bigint"))
            lens = keep(lens.unionByName(search.lengths(old).join(gone, "document_id", "left_anti").withColumn("epoch", F.lit(1).cast("bigint"))))
            add(index.segment(fresh, dead, 2, parts=parts))
            release(fresh, gone, dead)  # a table goes when nothing reads it any more, as postings take more room than texts
            for k in range(2):  # every other range, as the texts of one half only are shuffled then
                both = add(index.segment(old.filter(F.expr(f"document_id div {index.BLOCK} % 2 = {k}")), None, 1, parts=parts))
            release(docs)
            rows = index.merged(both, lens)  # without dead ones, so rows tell all
            total = lens.agg(F.sum("dl").alias("tokens"), F.count(F.lit(1)).alias("documents"))
            per = lambda f: F.aggregate("docs", F.lit(0).cast("bigint"), lambda s, d: s + f(d))
            found = rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum(per(lambda d: d["tf"])).alias("n"), F.sum(per(lambda d: F.element_at(d["positions"], -1))).alias("lasts"))
            return keep(found.filter("n > 0").join(F.broadcast(total)))  # one row


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 with their paths: a top-k, which is the operator."""
    docs, occ = ad.doc(spark, sf_dir), ad.occ(spark, sf_dir).withColumn("missing_since", F.when(F.col("occurrence_id") % 3 == 0, _now()))
    found = search.find("idiot", search.looked_up(docs), search.lengths(docs))
    return search.hits(found, docs.select("document_id", "sha256"), occ).select("document_id", F.round("rank", 6).alias("rank"), "sha256", "rel_path")


def snippet_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each hit: whether the snippet marks the word, whether it is a piece of the text, and that it has twelve words at most."""
    docs = ad.doc(spark, sf_dir)
    found = search.find("idiot", search.looked_up(docs), search.lengths(docs), None)
    shown = found.join(docs, "document_id").withColumn("s", search.snippet(F.col("ocr_text"), ["idiot"]))
    bare = F.trim(F.regexp_replace(F.col("s"), r"^\.\.\. | \.\.\.$|\[|\]", ""))
    text = F.regexp_replace("ocr_text", r"\[|\]", "")
    return shown.select("document_id", F.lower("s").contains("[idiot]").alias("marked"), text.contains(bare).alias("inside"), (F.size(F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))) <= 12).alias("short"))


def summaries_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.page_ocr(spark, sf_dir)
    parts = [reading.summary(p.filter(F.col("document_id") % 3 == k)) for k in range(3)]
    return reading.merge_summaries(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def local_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local rung on pages whose layer, tool, rendering and recognition go well or not."""
    p = ad.page_ocr(spark, sf_dir)
    d, t = F.col("document_id"), F.col("page_number")
    ocr = F.when(d % 4 == 0, "").otherwise("read")
    out = reading.local_result(F.col("text"), F.col("confidence"), ocr, (d % 10) / 10, d % 5 > 0, t % 3 > 0, 0.4)
    return p.select("document_id", "page_number", *[out[c].alias(c) for c in ("text", "confidence", "ocr_source", "status", "note")])


def drive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.page_ocr(spark, sf_dir)
    answers = p.select("document_id").distinct().filter("document_id % 2 = 0").select("document_id", F.concat(F.lit("answer "), F.col("document_id").cast("string")).alias("answer"))
    return reading.drive_pages(p, answers).select("document_id", "page_number", "text", "status", "ocr_source")


def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.pending(index_queries._reviews(spark, sf_dir)).select("kind", "document_a", "document_b")


def pending_hash_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 of lowest id: a deterministic limit, which is the operator."""
    hashed = ad.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    occ = ad.occ(spark, sf_dir)
    docs = occ.select("document_id").distinct().withColumn("page_count", F.when(F.col("document_id") % 5 > 0, 1))
    return duplicates.pending_hash(docs, occ, hashed, 25)


def pair_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,000 pairs in order: a budget, which is the operator."""
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("n"))
    pairs = s.join(s.select(F.col("a").alias("b"), "n"), "n").filter("a < b").select("a", "b")
    return duplicates.budget(pairs, 1000, "a", "b")


def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = index_queries._bits(spark, sf_dir).select("document_id", "phash")
    after = b.select((F.col("document_id") - 1).alias("document_id"), F.col("phash").alias("next"))
    return b.join(after, "document_id").select("document_id", phash.hamming_hex(F.col("phash"), F.col("next")).alias("distance"))


_PATHS = ("a/b{}.pdf", "../{}.pdf", "x/../{}.pdf", "x/../../{}", "/abs/{}", "C:/{}", "\\srv\\{}", "..\\{}", ".\\in\\{}.PDF", "./ /{}")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all shapes: whether they stay below the root, are barred, and how they are written."""
    p = ad.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    shape = F.get(F.array(*map(F.lit, _PATHS)), (k % len(_PATHS)).cast("int"))
    path = F.replace(shape, F.lit("{}"), k.cast("string"))
    barred = classify.blocked(path, ["a/b10.pdf"], ["x"], [".PDF"], allow=r"/1\d*\.pdf$")
    return p.select(k.alias("id"), plan.inside_root(path).alias("inside"), barred.alias("barred"), tx.normalise_rel_path(F.concat(F.lit("  "), path, F.lit("\t"))).alias("written"))


def verdict_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.normalise_verdict(F.concat(F.lit("\t "), F.translate("p_type", " ", "-"), F.lit(" "))).alias("verdict"))


QUERIES = {f.__name__: f for f in (
    occurrence_upsert, page_upsert, classification_upsert, plan_rows, postings_delta, posting_segments, document_ranges, search_hits, snippet_marks, summaries_merged, local_read, drive_pages, pending_reviews, pending_hash_first, pair_budget, hamming, paths, verdict_words,
)}

_STATED = f"""{ad.SIGHTINGS}, o AS (SELECT rel_path::BIGINT + 1 AS id, rel_path::BIGINT % 10 AS doc, CASE WHEN rel_path::BIGINT % 3 = 0 THEN 'old' END AS kind, * FROM stored WHERE rel_path::BIGINT % 5 > 0), n AS (SELECT * FROM seen WHERE rel_path::BIGINT % 7 > 0),
    j AS (SELECT o.id, coalesce(o.rel_path, n.rel_path) AS rel_path, o.doc, o.kind, o.mtime AS om, o.size_bytes AS os, n.mtime AS nm, n.size_bytes AS ns, o.missing_since, n.rel_path IS NOT NULL AS here,
      n.rel_path IS NOT NULL AND NOT coalesce(o.missing_since IS NULL AND o.mtime = n.mtime AND o.size_bytes = n.size_bytes AND o.id IS NOT NULL, false) AS moved FROM o FULL JOIN n ON o.rel_path = n.rel_path)"""
_NEWDOC = f"{ad.DOC}, newdoc AS (SELECT document_id, ocr_text || CASE WHEN document_id % 3 = 0 THEN ' added wörd added' ELSE '' END AS ocr_text FROM doc WHERE document_id % 11 > 0), {ad.TOKENS.replace('FROM doc)', 'FROM newdoc)')}"
_PATH = "(['" + "', '".join(_PATHS) + "'])[p_partkey % 10 + 1]"

ORACLES = {
    "occurrence_upsert": f"""WITH {_STATED} SELECT coalesce(id, (SELECT max(id) FROM o) + row_number() OVER (PARTITION BY id IS NULL ORDER BY rel_path)) AS occurrence_id, CASE WHEN moved THEN rel_path::BIGINT % 6 ELSE doc END AS document_id, rel_path,
        CASE WHEN moved THEN nm ELSE om END AS mtime, CASE WHEN moved THEN ns ELSE os END AS size_bytes, NOT here AS missing, CASE WHEN NOT here THEN kind END AS conflict_kind, CASE WHEN here THEN 2 ELSE 1 END::BIGINT AS last_scan_id FROM j""",
    "page_upsert": f"WITH {ad.PAGE_OCR} SELECT document_id, page_number::INT AS page_number, CASE WHEN page_number >= 3 THEN 'again ' || page_number ELSE text END AS text, CASE WHEN page_number >= 3 THEN 'ok' ELSE status END AS status FROM page_ocr",
    "classification_upsert": """WITH c AS (SELECT c_custkey AS k, *, c_custkey % 2 = 0 OR c_custkey % 9 = 0 AS said FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0 OR c_custkey % 9 = 0)
        SELECT k AS document_id, CASE WHEN k % 4 = 0 THEN c_name || '!' ELSE c_name END AS party, CASE WHEN NOT said THEN c_mktsegment WHEN k % 5 = 0 THEN 'note' END AS doc_type, CASE WHEN said AND k % 7 = 0 THEN '2024-02-03' END AS doc_date,
        CASE WHEN k % 3 > 0 THEN 2025 ELSE 2026 END::INT AS created, CASE WHEN said THEN 2026 ELSE 2025 END::INT AS updated FROM c""",
    "plan_rows": f"""WITH {ad.OCC}, f AS (SELECT document_id, any_value(sha256) AS sha256, arg_min(rel_path, occurrence_id) AS rel_path FROM occ WHERE occurrence_id % 4 <> 0 GROUP BY 1)
        SELECT *, CASE WHEN document_id IN (SELECT doc_id FROM labels) THEN 'someone' END AS agent_party, document_id IN (SELECT doc_id FROM labels) AS agent FROM f""",
    "postings_delta": f"""WITH {_NEWDOC}, p AS (SELECT document_id, term, count(*) AS tf, max(pos) AS last FROM tok GROUP BY 1, 2)
        SELECT term, count(*) AS df, sum(tf)::BIGINT AS n, sum(last)::BIGINT AS lasts, (SELECT sum(dl)::BIGINT FROM dl) AS tokens, (SELECT count(*) FROM dl) AS documents FROM p GROUP BY 1""",
    "posting_segments": f"""WITH {_NEWDOC}, p AS (SELECT document_id, term, count(*) AS tf, max(pos) AS last FROM tok GROUP BY 1, 2)
        SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS n, sum(last)::BIGINT AS lasts, (SELECT sum(dl)::BIGINT FROM dl) AS tokens, (SELECT count(*) FROM dl) AS documents FROM p GROUP BY 1""",
    "document_ranges": index_queries.ORACLES["document_upsert"],
    "search_hits": f"""WITH best AS ({search_queries.ORACLES['bm25_topk']}), {ad.OCC}, live AS (SELECT document_id, arg_min(rel_path, occurrence_id) AS rel_path FROM occ WHERE occurrence_id % 3 <> 0 GROUP BY 1)
        SELECT b.document_id, rank, sha256(text) AS sha256, rel_path FROM best b JOIN documents d ON d.doc_id = b.document_id LEFT JOIN live ON live.document_id = b.document_id""",
    "snippet_marks": f"WITH {ad.DOC}, {ad.TOKENS} SELECT DISTINCT document_id, true AS marked, true AS inside, true AS short FROM tok WHERE term = 'idiot'",
    "summaries_merged": index_queries.ORACLES["ocr_status_hist"],
    "local_read": f"""WITH {ad.PAGE_OCR}, r AS (SELECT *, document_id % 10 / 10 AS oc, CASE WHEN confidence >= 0.4 THEN 'layer' WHEN document_id % 5 = 0 THEN 'tesseract_missing' WHEN page_number % 3 = 0 THEN 'render_failed' WHEN document_id % 10 / 10 < confidence THEN 'tesseract_below_text_layer'
        WHEN document_id % 4 = 0 THEN 'tesseract_empty' ELSE 'read' END AS what FROM page_ocr)
        SELECT document_id, page_number::INT AS page_number, CASE WHEN what = 'read' THEN 'read' WHEN what = 'tesseract_empty' OR (what <> 'layer' AND text = '') THEN NULL ELSE text END AS text, CASE WHEN what IN ('read', 'tesseract_empty') THEN oc ELSE confidence END::DOUBLE AS confidence,
        CASE what WHEN 'layer' THEN 'local_text' WHEN 'read' THEN 'local_tesseract' END AS ocr_source, CASE WHEN what = 'layer' OR (what IN ('read', 'tesseract_empty') AND oc >= 0.4) THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN what NOT IN ('layer', 'read') THEN what END AS note FROM r""",
    "drive_pages": f"""WITH {ad.PAGE_OCR}, w AS (SELECT *, status IN ('pending_drive', 'pending_vision') AS waits FROM page_ocr), r AS (SELECT *, waits AND document_id % 2 = 0 AS hit, min(CASE WHEN waits THEN page_number END) OVER (PARTITION BY document_id) = page_number AS first FROM w)
        SELECT document_id, page_number::INT AS page_number, CASE WHEN hit AND first THEN 'answer ' || document_id ELSE text END AS text, CASE WHEN hit THEN 'ok' ELSE status END AS status, CASE WHEN hit THEN 'drive' ELSE ocr_source END AS ocr_source FROM r""",
    "pending_reviews": "SELECT DISTINCT 'near' AS kind, doc_id AS document_a, doc_id + 1 AS document_b FROM labels WHERE toxic <> 1",
    "pending_hash_first": f"WITH {ad.OCC} SELECT document_id, min(rel_path) AS rel_path FROM occ WHERE document_id NOT IN (SELECT doc_id FROM labels) AND document_id % 5 > 0 GROUP BY 1 ORDER BY 1 LIMIT 25",
    "pair_budget": "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey ORDER BY 1, 2 LIMIT 1000",
    "hamming": """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings)
        SELECT a.vec_id AS document_id, list_sum(list_transform(range(1, 65), lambda i: abs(a.s[i] - c.s[i])))::INT AS distance FROM b a JOIN b c ON c.vec_id = a.vec_id + 1""",
    "paths": f"""WITH p AS (SELECT p_partkey AS id, p_partkey % 10 AS kind, replace({_PATH}, '{{}}', p_partkey::VARCHAR) AS path FROM part)
        SELECT id, kind IN (0, 2, 8, 9) AS inside, (path = 'a/b10.pdf' OR starts_with(path, 'x/') OR ends_with(lower(path), '.pdf')) AND NOT regexp_matches(path, '/1[0-9]*\\.pdf$') AS barred,
        CASE kind WHEN 4 THEN 'abs/' || id WHEN 6 THEN 'srv/' || id WHEN 7 THEN '../' || id WHEN 8 THEN 'in/' || id || '.PDF' WHEN 9 THEN ' /' || id ELSE path END AS written FROM p""",
    "verdict_words": "SELECT p_partkey, lower(replace(replace(p_type, ' ', '-'), '-', '_')) AS verdict FROM part",
}

"""The driver tables in the shapes of the index, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import phash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their digests: doc_id, sha256, rel_path, text, lang, source."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), path.alias("rel_path"), "text", "lang", "source")


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document: one row per content; the text is joined back from the lowest doc_id."""
    rows = contents(spark, sf_dir)
    first = rows.groupBy("sha256").agg(F.min("doc_id").alias("document_id"))
    texts = rows.select(F.col("doc_id").alias("document_id"), F.col("text").alias("ocr_text"))
    return first.join(texts, "document_id")


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occurrence: one row per documents row."""
    rows = contents(spark, sf_dir).select("doc_id", "sha256", "rel_path")
    first = rows.groupBy("sha256").agg(F.min("doc_id").alias("document_id"))
    return rows.join(first, "sha256").select(F.col("doc_id").alias("occurrence_id"), "document_id", "rel_path", "sha256")


def page_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of the lines of every text that are not blank, as pages: document_id, page_no, phash, sha256; up to three bits of a document's hashes are turned."""
    rows = contents(spark, sf_dir)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    pages = rows.select(F.col("doc_id").alias("document_id"), "sha256", F.posexplode(lines).alias("page_no", "line"))
    bits = F.expr("shiftleft(shiftleft(1L, cast(document_id % 4 as int)) - 1, page_no % 50)")
    turned = phash.to_long(F.substring(F.md5(F.substring("line", 1, 12)), 1, 16)).bitwiseXOR(bits)
    return pages.select("document_id", "sha256", "page_no", F.lpad(F.lower(F.hex(turned)), 16, "0").alias("phash"))


def page_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages that were read in different ways."""
    c = table(spark, sf_dir, "conversations")
    source = F.when(F.col("role") == "user", "local_text").when(F.col("role") == "assistant", "drive").otherwise("vision")
    rung = F.when(F.col("turn") == 0, F.lit(None)).when(F.col("role") == "user", "local").when(F.col("role") == "assistant", "drive").otherwise("vision")
    status = F.when(F.col("turn") == 1, "pending_drive").when(F.col("turn") == 2, "pending_vision").when(F.col("turn") == 3, "skipped").otherwise("ok")
    note = F.when(F.col("turn") == 3, "tesseract_missing").when(F.col("turn") == 4, "drive_offline").when(F.col("turn") == 5, "drive_too_long")
    text = F.when(F.col("turn") == 3, " \n").otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), text.alias("text"), (F.col("turn") / 10).alias("confidence"), rung.alias("rung"), source.alias("ocr_source"), status.alias("status"), note.alias("note"))


def sightings(spark: SparkSession, sf_dir: str, before: bool) -> DataFrame:
    """Paths as two scans saw them: users of the first half of the events, or of the second."""
    e = table(spark, sf_dir, "events")
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    e = e.filter(half if before else ~half)
    return e.groupBy(F.col("user_id").cast("string").alias("rel_path")).agg(
        (F.min("event_id") % 4).alias("size_bytes"), (F.count(F.lit(1)) % 3).cast("double").alias("mtime"), F.when(F.min("event_type") != "click", F.max("ts")).alias("missing_since")
    )


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as text in one of five forms, with another date after it."""
    o = table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d MMMM yyyy")).when(k == 2, F.date_format(d, "MMMM d, yyyy"))
        .when(k == 3, F.date_format(d, "d-MMM-yy")).otherwise(F.date_format(d, "d/M/yyyy"))
    )
    return o.select("o_orderkey", "o_orderdate", F.concat(F.lit("dated "), text, F.lit(" ref 1999-12-31 end")).alias("text"))


def plan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents to be named after customer and priority; customers have clashes."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("document_id"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"),
        F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("rel_path"),
        F.lower("c_mktsegment").alias("folder"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("doc_date"),
        F.col("c_name").alias("party"),
        F.col("o_orderpriority").alias("doc_type"),
        F.when(F.col("o_orderstatus") == "P", F.lit("part / paid")).alias("detail"),
        F.lit("rule").alias("provenance"),
        F.lit(False).alias("on_disk"),
        F.lit(False).alias("suffixed_on_disk"),
    )


_STAGES = ("build", "mystery", "queued", "intake", "design", "build", "verify", "audit", "ship", "queued")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues: no stage, one, two or one unknown; all flags and some together; edges that are open, closed, without a state, or none."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stage = F.get(F.array(*[F.lit(f"stage:{x}") for x in _STAGES]), (c % 11).cast("int"))
    more = F.when(c % 11 == 0, "stage:verify")
    rank = F.substring("o_orderpriority", 1, 1)
    priority = F.when(rank == "1", "priority:critical").when(rank == "2", "priority:medium").when(rank == "3", "priority:future")
    first = F.when((k % 13).isin(0, 3, 4), "sdlc:hold").when(k % 13 == 1, "sdlc:needs-human").when(k % 13 == 2, "sdlc:wip")
    second = F.when(k % 13 == 3, "sdlc:wip").when(k % 13 == 4, "sdlc:needs-human")
    labels = F.array_compact(F.array(stage, more, priority, first, second, F.when(k % 5 == 0, "blocked"), F.when(k % 7 == 0, "ready")))
    edge = lambda n, state: F.struct(n.cast("bigint").alias("number"), state.cast("string").alias("state"))
    price = F.col("o_totalprice")
    one = F.array(edge(c, F.when(price > 200000, "OPEN").otherwise("CLOSED")))
    two = F.array(edge(c, F.lit("CLOSED")), edge(k - 1, F.when(price > 350000, "open").when(price < 300000, "closed")), edge(F.lit(None), F.lit("OPEN")))
    blocked_by = F.when(k % 3 == 1, one).when(k % 3 == 2, two).otherwise(F.array().cast(two_type := "array<struct<number:bigint,state:string>>"))
    return o.select(k.cast("bigint").alias("number"), F.lit("OPEN").alias("state"), F.col("o_orderdate").alias("created_at"), labels.alias("labels"), blocked_by.cast(two_type).alias("blocked_by"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as comments of issues: claims, outcomes of every kind, marks in later lines, notes, and none."""
    e = table(spark, sf_dir, "events")
    run, kind = F.col("event_id").cast("string"), F.col("event_id") % 16
    said = {
        0: F.concat(F.lit("sdlc:claim run-"), run), 1: F.concat(F.lit("sdlc:claim  r"), run, F.lit(" more")), 2: F.lit("sdlc:emit cycle-9-verify BOUNCE -> stage:build\nwhy"),
        3: F.lit("sdlc:emit x-ship BOUNCE → stage:build"), 4: F.lit("sdlc:emit nolane BOUNCE"), 5: F.lit("note\nsdlc:emit z-verify BOUNCE -> stage:build"), 6: F.lit("ADVANCE to build"),
        7: F.lit("sdlc-dispatch: reaped"), 8: F.lit("sdlc:emit a-verify ADVANCE -> stage:audit"), 9: F.lit(None).cast("string"), 10: F.lit(" sdlc:claim late"), 11: F.concat(F.lit("sdlc:claim run-"), run),
    }
    body = F.lit("note")
    for n, text in said.items():
        body = F.when(kind == n, text).otherwise(body)
    return e.select(F.col("user_id").alias("issue"), F.col("event_id").alias("pos"), F.col("ts").alias("created_at"), body.alias("body"))


def unlocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the lock of an issue was last taken off: issue, at."""
    e = table(spark, sf_dir, "events").filter("event_id % 23 = 0")
    return e.groupBy(F.col("user_id").alias("issue")).agg(F.max("ts").alias("at"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues whose bodies tell of dependencies in all forms, and of what is none."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    n = lambda by: (k + by).cast("string")
    bodies = [
        F.concat(F.lit("Text #9\nBlocked by #"), c, F.lit(", #"), n(0), F.lit(" and #"), n(1), F.lit(" as #7\n")), F.concat(F.lit("- Requires #"), c),
        F.concat(F.lit("1. [ ] depends on K.3b #"), c, F.lit(" & #"), n(2)), F.concat(F.lit("**Dependencies:** Blocked on #"), c, F.lit(" / #"), n(3)),
        F.concat(F.lit("None depends on #"), c), F.concat(F.lit("x\r\nAfter: #"), c, F.lit(" and the rest #5")), F.concat(F.lit("* [x] **Depends on** owner/repo #"), c, F.lit(",#"), n(0)), F.lit(None).cast("string"),
    ]
    body = F.lit(None).cast("string")
    for j, text in enumerate(bodies):
        body = F.when(k % 8 == j, text).otherwise(body)
    state = F.when(k % 2 == 0, "OPEN").otherwise("CLOSED")
    return o.select(k.cast("bigint").alias("number"), body.alias("body"), F.array(F.struct((F.col("o_custkey") * (k % 3)).cast("bigint").alias("number"), state.alias("state"))).alias("blocked_by"))


DOC = "doc AS (SELECT sha256(text) AS sha256, min(doc_id) AS document_id, any_value(text) AS ocr_text FROM documents GROUP BY 1)"
OCC = "occ AS (SELECT doc_id AS occurrence_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS document_id, source || '/' || lang || '/' || doc_id || '.txt' AS rel_path, sha256(text) AS sha256 FROM documents)"
PAGES = """lines AS (SELECT doc_id, sha256(text) AS sha256, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS l FROM documents),
pages AS (SELECT doc_id AS document_id, sha256, unnest(l) AS line, unnest(range(len(l))) AS page_no FROM lines),
hashed AS (SELECT document_id, sha256, page_no, xor(('0x' || substr(md5(substr(line, 1, 12)), 1, 16))::UBIGINT, ((1::UBIGINT << (document_id % 4)) - 1) << (page_no % 50)) AS h FROM pages),
page_hash AS (SELECT document_id, sha256, page_no, format('{:016x}', h) AS phash, h FROM hashed)"""
PAGE_OCR = """page_ocr AS (SELECT conv_id AS document_id, turn + 1 AS page_number, CASE WHEN turn = 3 THEN ' ' || chr(10) ELSE text END AS text, turn / 10 AS confidence,
CASE WHEN turn = 0 THEN NULL WHEN role = 'user' THEN 'local' WHEN role = 'assistant' THEN 'drive' ELSE 'vision' END AS rung,
CASE role WHEN 'user' THEN 'local_text' WHEN 'assistant' THEN 'drive' ELSE 'vision' END AS ocr_source,
CASE turn WHEN 1 THEN 'pending_drive' WHEN 2 THEN 'pending_vision' WHEN 3 THEN 'skipped' ELSE 'ok' END AS status,
CASE turn WHEN 3 THEN 'tesseract_missing' WHEN 4 THEN 'drive_offline' WHEN 5 THEN 'drive_too_long' END AS note FROM conversations)"""
_SEEN = "SELECT user_id::VARCHAR AS rel_path, min(event_id) % 4 AS size_bytes, (count(*) % 3)::DOUBLE AS mtime, CASE WHEN min(event_type) <> 'click' THEN max(ts) END AS missing_since FROM events WHERE ts {} TIMESTAMP '2024-01-16' GROUP BY 1"
SIGHTINGS = f"stored AS ({_SEEN.format('<')}), seen AS ({_SEEN.format('>=')})"
DATED = """dated AS (SELECT o_orderkey, o_orderdate, 'dated ' || CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d %B %Y')
WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 3 THEN strftime(o_orderdate, '%-d-%b-%y') ELSE strftime(o_orderdate, '%-d/%-m/%Y') END || ' ref 1999-12-31 end' AS text FROM orders)"""
PLAN_IN = """plan_in AS (SELECT o_orderkey AS document_id, sha256(o_orderkey::VARCHAR) AS sha256, 'in/' || o_orderkey || '.pdf' AS rel_path, lower(c_mktsegment) AS folder,
strftime(o_orderdate, '%Y-%m-%d') AS doc_date, c_name AS party, o_orderpriority AS doc_type, CASE WHEN o_orderstatus = 'P' THEN 'part / paid' END AS detail FROM orders JOIN customer ON o_custkey = c_custkey)"""
_LIST = ", ".join(f"'stage:{x}'" for x in _STAGES)
ISSUES = f"""issues AS (SELECT o_orderkey AS number, o_orderdate AS created_at, list_filter([CASE WHEN o_custkey % 11 < 10 THEN ([{_LIST}])[o_custkey % 11 + 1] END, CASE WHEN o_custkey % 11 = 0 THEN 'stage:verify' END,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'priority:critical' WHEN '2' THEN 'priority:medium' WHEN '3' THEN 'priority:future' END,
CASE WHEN o_orderkey % 13 IN (0, 3, 4) THEN 'sdlc:hold' WHEN o_orderkey % 13 = 1 THEN 'sdlc:needs-human' WHEN o_orderkey % 13 = 2 THEN 'sdlc:wip' END,
CASE o_orderkey % 13 WHEN 3 THEN 'sdlc:wip' WHEN 4 THEN 'sdlc:needs-human' END, CASE WHEN o_orderkey % 5 = 0 THEN 'blocked' END, CASE WHEN o_orderkey % 7 = 0 THEN 'ready' END], lambda x: x IS NOT NULL) AS labels,
CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_edges,
list_sort(CASE WHEN o_orderkey % 3 = 1 AND o_totalprice > 200000 THEN [o_custkey::BIGINT] WHEN o_orderkey % 3 = 2 AND o_totalprice >= 300000 THEN [o_orderkey::BIGINT - 1] ELSE []::BIGINT[] END) AS blockers FROM orders),
staged AS (SELECT *, list_transform(list_filter(labels, lambda x: starts_with(x, 'stage:')), lambda x: substr(x, 7)) AS stages FROM issues),
judged AS (SELECT *, list_filter([CASE WHEN list_contains(labels, 'sdlc:hold') THEN 'hold' END, CASE WHEN list_contains(labels, 'sdlc:needs-human') THEN 'needs-human' END, CASE WHEN list_contains(labels, 'sdlc:wip') THEN 'wip' END,
CASE WHEN len(blockers) > 0 THEN 'blocked' END], lambda x: x IS NOT NULL) AS reasons FROM staged),
names AS (SELECT unnest(['intake', 'design', 'queued', 'build', 'verify', 'audit', 'ship']) AS lane),
laned AS (SELECT j.*, n.lane, coalesce(reasons[1], 'eligible') AS st FROM judged j JOIN names n ON list_contains(j.stages, n.lane))"""
COMMENTS = """comments AS (SELECT user_id AS issue, event_id AS pos, ts AS created_at, CASE WHEN event_id % 16 IN (0, 11) THEN 'run-' || event_id WHEN event_id % 16 = 1 THEN 'r' || event_id END AS claim,
event_id % 16 IN (2, 3, 4, 6, 7, 8) AS outcome, event_id % 16 AS kind FROM events),
unlocked AS (SELECT user_id AS issue, max(ts) AS "at" FROM events WHERE event_id % 23 = 0 GROUP BY 1)"""
PROSE = """prose AS (SELECT o_orderkey::BIGINT AS number, o_custkey::BIGINT * (o_orderkey % 3) AS edge, unnest(CASE o_orderkey % 8 WHEN 0 THEN [o_custkey, o_orderkey, o_orderkey + 1, 7] WHEN 1 THEN [o_custkey] WHEN 2 THEN [o_custkey, o_orderkey + 2]
WHEN 3 THEN [o_custkey, o_orderkey + 3] WHEN 5 THEN [o_custkey] WHEN 6 THEN [o_custkey, o_orderkey] END)::BIGINT AS blocker FROM orders)"""
TOKENS = """words AS (SELECT document_id, regexp_extract_all(lower(strip_accents(coalesce(ocr_text, ''))), '[\\p{L}\\p{N}\\p{Co}]+') AS w FROM doc),
tok AS (SELECT document_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM words),
dl AS (SELECT document_id, len(w) AS dl FROM words)"""

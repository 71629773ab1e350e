"""Dates, rules, names and plans over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import dates
from folioscope.functions import text as tx
from folioscope.operators import plan, rules
from folioscope.plans import adapters as ad

YEAR = 2026

#: Rules over documents; ASCII terms, so that SQL sees them alike.
TAXONOMY = rules.Taxonomy.of(
    {
        "rule": [
            {"id": "rude", "party": "desk", "doc_type": "complaint", "any": ["idiot", "stupid", "trash"], "priority": 5, "tags": ["rude"]},
            {"id": "mail", "party": "post", "doc_type": "letter", "regex": r"@mail[0-9]+\.example", "none": ["rights reserved"], "detail_regex": r"@mail([0-9]+)\.example", "detail": "post"},
            {"id": "license", "doc_type": "license", "all": ["rights", "reserved"], "priority": 5, "folder": "legal"},
            {"id": "phone", "doc_type": "call", "any": ["+1 ("], "detail": "phone"},
            {"id": "empty", "none": ["x"]},
        ],
        "party": {"desk": {"display": "Front Desk"}},
    }
)


def _dates(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = ad.dated(spark, sf_dir)
    return rows.select("o_orderkey", dates.extract_date(F.col("text"), current_year=YEAR, **options).alias("iso"))


def extract_first_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir)


def extract_last_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, select="last")


def numeric_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, order="mdy")


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ISO dates of a text with their offsets, as one string."""
    rows = ad.dated(spark, sf_dir)
    hits = F.array_sort(F.filter(dates.scan(F.col("text"), current_year=YEAR), lambda h: h["kind"] == 0))
    shown = F.array_join(F.transform(hits, lambda h: F.concat(h["at"].cast("string"), F.lit(":"), h["iso"])), ",")
    return rows.select("o_orderkey", shown.alias("hits"))


def year_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ad.table(spark, sf_dir, "orders").select(F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0").alias("yy")).distinct()
    return n.select("yy", dates.full_year(F.col("yy"), YEAR).alias("full_year"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("m", rules.match_rule(TAXONOMY, F.col("text")))


def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("doc_id", "m.rule_id", "m.party", "m.doc_type", "m.folder")


def rule_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).groupBy("m.rule_id").agg(F.count(F.lit(1)).alias("n"))


def rule_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.detail_by_rule(TAXONOMY, F.col("m.rule_id"), F.col("text"))
    return _matched(spark, sf_dir).withColumn("d", d).select("doc_id", "d.detail", "d.source")


def rule_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dates.date_for_rule(F.col("text"), r"ref ([0-9-]+) end", None, "dmy", YEAR)
    return ad.dated(spark, sf_dir).withColumn("d", found).select("o_orderkey", "d.iso", "d.source")


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "documents").select("doc_id", tx.sanitize_component(F.col("text")).alias("component"))


def render_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.plan_in(spark, sf_dir)
    name = plan.render_name("{doc_date}_{party}_{doc_type}_{detail}", {c: F.col(c) for c in ("doc_date", "party", "doc_type", "detail")}, ascii_only=True)
    return rows.select("document_id", name.alias("name"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.targets(ad.plan_in(spark, sf_dir), "{party}_{doc_type}", ascii_only=True)


def plan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).select("document_id", "target_path", "suffix6")


def plan_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.first_pass(_targets(spark, sf_dir)).select("document_id", "status", "final_path", "claimed_by")


def plan_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fold; the same as the window here, as no suffixed name is a plain one."""
    return plan.fold(_targets(spark, sf_dir)).select("document_id", "status", "final_path", "claimed_by")


def plan_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, and the fold only where suffixed names meet others."""
    return plan.claims(_targets(spark, sf_dir)).select("document_id", "status", "final_path", "claimed_by")


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.summary(plan.first_pass(_targets(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    extract_first_date, extract_last_date, numeric_dates, iso_dates, year_pivot, rule_match, rule_priority, rule_detail, rule_date, sanitize, render_name,
    plan_targets, plan_collisions, plan_fold, plan_claims, plan_summary,
)}

_RULE = r"""m AS (SELECT doc_id, text, CASE WHEN h LIKE '%rights%' AND h LIKE '%reserved%' THEN 'license' WHEN h LIKE '%idiot%' OR h LIKE '%stupid%' OR h LIKE '%trash%' THEN 'rude'
  WHEN regexp_matches(h, '@mail[0-9]+\.example') AND h NOT LIKE '%rights reserved%' THEN 'mail' WHEN h LIKE '%+1 (%' THEN 'phone' END AS rule_id
  FROM (SELECT doc_id, text, substr(lower(regexp_replace(text, '\s+', ' ', 'g')), 1, 200000) AS h FROM documents))"""
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._-]', '_', 'g'), '_{{2,}}', '_', 'g'), '^[._\- ]+|[._\- ]+$', '', 'g')"
_NO_CONTROLS = r"regexp_replace(nfc_normalize(text), '\p{C}', '', 'g')"
_TARGETS = f"""t AS (SELECT document_id, sha256, rel_path, folder || '/' || {_CLEAN.format("party")} || '_' || {_CLEAN.format("doc_type")} AS stem, substr(sha256, 1, 6) AS suffix6 FROM plan_in)"""
_CLAIMED = f"""WITH {ad.PLAN_IN}, {_TARGETS}, c AS (SELECT *, min(document_id) OVER (PARTITION BY lower(stem) ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS claimed_by FROM t)"""

ORACLES = {
    "extract_first_date": f"WITH {ad.DATED} SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM dated",
    "extract_last_date": f"WITH {ad.DATED} SELECT o_orderkey, '1999-12-31' AS iso FROM dated",
    "numeric_dates": f"""WITH {ad.DATED} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM dated""",
    "iso_dates": f"""WITH {ad.DATED} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '6:' || strftime(o_orderdate, '%Y-%m-%d') || ',' ELSE '' END || (strpos(text, '1999-12-31') - 1) || ':1999-12-31' AS hits FROM dated""",
    "year_pivot": "SELECT DISTINCT lpad((o_orderkey % 100)::VARCHAR, 2, '0') AS yy, CASE WHEN o_orderkey % 100 <= 27 THEN 2000 ELSE 1900 END + (o_orderkey % 100)::INT AS full_year FROM orders",
    "rule_match": f"""WITH {_RULE} SELECT doc_id, rule_id, CASE rule_id WHEN 'rude' THEN 'Front Desk' WHEN 'mail' THEN 'post' END AS party,
        CASE rule_id WHEN 'rude' THEN 'complaint' WHEN 'mail' THEN 'letter' WHEN 'license' THEN 'license' WHEN 'phone' THEN 'call' END AS doc_type, CASE rule_id WHEN 'license' THEN 'legal' END AS folder FROM m""",
    "rule_priority": f"WITH {_RULE} SELECT rule_id, count(*) AS n FROM m GROUP BY 1",
    "rule_detail": rf"""WITH {_RULE}, d AS (SELECT doc_id, rule_id, nullif(regexp_extract(text, '(?i)@mail([0-9]+)\.example', 1), '') AS cap FROM m)
        SELECT doc_id, CASE rule_id WHEN 'mail' THEN coalesce(cap, 'post') WHEN 'phone' THEN 'phone' END AS detail, CASE rule_id WHEN 'mail' THEN CASE WHEN cap IS NULL THEN 'rule' ELSE 'rule-regex' END WHEN 'phone' THEN 'rule' END AS source FROM d""",
    "rule_date": f"WITH {ad.DATED} SELECT o_orderkey, '1999-12-31' AS iso, 'rule-regex' AS source FROM dated",
    "sanitize": f"""WITH a AS (SELECT doc_id, {_CLEAN.format(_NO_CONTROLS)} AS s FROM documents)
        , b AS (SELECT doc_id, regexp_replace(substr(s, 1, 80), '^[._\\- ]+|[._\\- ]+$', '', 'g') AS c FROM a)
        SELECT doc_id, CASE WHEN regexp_matches(lower(split_part(c, '.', 1)), '^(con|prn|aux|nul|(com|lpt)[1-9])$') THEN '_' ELSE '' END || c AS component FROM b""",
    "render_name": f"""WITH {ad.PLAN_IN} SELECT document_id, doc_date || '_' || {_CLEAN.format("party")} || '_' || {_CLEAN.format("doc_type")} || coalesce('_' || {_CLEAN.format("detail")}, '') AS name FROM plan_in""",
    "plan_targets": f"WITH {ad.PLAN_IN}, {_TARGETS} SELECT document_id, stem || '.pdf' AS target_path, suffix6 FROM t",
    "plan_collisions": f"{_CLAIMED} SELECT document_id, 'move' AS status, stem || CASE WHEN claimed_by IS NULL THEN '' ELSE '_' || suffix6 END || '.pdf' AS final_path, claimed_by FROM c",
    "plan_fold": f"{_CLAIMED} SELECT document_id, 'move' AS status, stem || CASE WHEN claimed_by IS NULL THEN '' ELSE '_' || suffix6 END || '.pdf' AS final_path, claimed_by FROM c",
    "plan_claims": f"{_CLAIMED} SELECT document_id, 'move' AS status, stem || CASE WHEN claimed_by IS NULL THEN '' ELSE '_' || suffix6 END || '.pdf' AS final_path, claimed_by FROM c",
    "plan_summary": f"""{_CLAIMED} SELECT count(*) AS documents, count(*) AS "move", 0::BIGINT AS noop, 0::BIGINT AS unclassified, 0::BIGINT AS collision, 0::BIGINT AS error, 0::BIGINT AS by_agent, count(*) AS by_rule FROM c""",
}

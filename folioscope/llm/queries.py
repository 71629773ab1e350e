"""Registered queries of this subpackage: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_weighted_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.schedule(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_shard_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import sharding

    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op3_near_minhash_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import minhash

    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")


#: The production rules of the URL filter.
URL_RULES = ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")


def op4_url_rarest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import url_filter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_pages(pages, [url_filter.parse(r) for r in URL_RULES])


def op5_embedding_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import embed_dedup

    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import html_extract

    return html_extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_quality_risk_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op8_substring_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import substring_dedup

    done = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return done.select("doc_id", "text", F.col("removed_words__").alias("removed_words"), F.col("removed__").alias("removed_spans"), F.col("firsts__").alias("first_doc_ids"))


def op9_quality_cotrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import quality_classifier

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = quality_classifier.score(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels, ids_only=True)
    return scored.select("doc_id", F.col("quality_score__").alias("score"), F.col("kept__").alias("kept"))


def op10_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import bpe

    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digests_only=True)


def op11_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import packing

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_ranked_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import lexical

    return lexical.rank(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import merkle

    docs = table(spark, sf_dir, "documents")
    columns = {c: docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lowered = columns | {"text": F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    leaf = merkle.leaf(list(columns.values()))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(hit, merkle.leaf(list(lowered.values()))).otherwise(leaf).alias("claimed"))
    return merkle.manifest(rows, claimed_col="claimed").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_weighted_fair": op1_mix_weighted_fair,
    "op2_shard_two_pass": op2_shard_two_pass,
    "op3_near_minhash_icws": op3_near_minhash_icws,
    "op4_url_rarest_token": op4_url_rarest_token,
    "op5_embedding_cover_tree": op5_embedding_cover_tree,
    "op6_html_template": op6_html_template,
    "op7_quality_risk_controlled": op7_quality_risk_controlled,
    "op8_substring_gear_chunks": op8_substring_gear_chunks,
    "op9_quality_cotrained": op9_quality_cotrained,
    "op10_bpe_speculate_verify": op10_bpe_speculate_verify,
    "op11_pack_best_fit": op11_pack_best_fit,
    "op12_ranked_lexical": op12_ranked_lexical,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _parts(text: str) -> str:
    """DuckDB's spelling of a row as a leaf's input."""
    return " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))


#: Twins of those queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_url_rarest_token": r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op12_ranked_lexical": r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
totals AS (SELECT count(*)::BIGINT AS nd, sum(len(terms))::BIGINT AS nt FROM words WHERE len(terms) > 0),
postings AS (SELECT doc_id, k, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, k, len(terms)::BIGINT AS n, unnest(terms) AS term FROM words) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term),
impacts AS (
  SELECT doc_id, k, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))) AS impact
  FROM postings JOIN weights USING (term), totals),
asked AS (
  SELECT item_id, text, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL),
scores AS (SELECT item_id, text, doc_id, k, sum(impact * times)::BIGINT AS score FROM impacts JOIN asked USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 20""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('s' || source, 'n') AS g, doc_id::VARCHAR AS d,
    {_parts("text")} AS plain, {_parts("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered
  FROM documents),
sums AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(d) + 1), lambda i: ord(substr(d, i, 1))::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) AS crc
  FROM rows),
hashed AS (SELECT k, doc_id, g, sha256(plain) AS leaf, sha256(CASE WHEN crc % 5 = 0 THEN lowered ELSE plain END) AS claimed FROM rows JOIN sums USING (k)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claimed, k) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
tree AS (
  SELECT g, 0 AS lvl, pos, leaf AS node, n FROM leaves
  UNION ALL SELECT g, lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 16, n),
tops AS (SELECT g, lvl AS height, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, pos, subroot AS node, n FROM tops
  UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM crown WHERE n > 1 GROUP BY lvl, pos // 16, n),
runs AS (SELECT g, lvl, pos // 16 AS run, list(node ORDER BY pos) AS l FROM tree WHERE n > 1 GROUP BY ALL),
crown_runs AS (SELECT lvl, pos // 16 AS run, list(node ORDER BY pos) AS l FROM crown WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT k, r.lvl AS step, l[1:(pos >> (4 * r.lvl)) % 16] AS pre, l[(pos >> (4 * r.lvl)) % 16 + 2:] AS post
  FROM leaves JOIN runs r ON r.g = leaves.g AND r.run = pos >> (4 * (r.lvl + 1))
  UNION ALL SELECT k, height + r.lvl, l[1:(t.pos >> (4 * r.lvl)) % 16], l[(t.pos >> (4 * r.lvl)) % 16 + 2:]
  FROM leaves JOIN tops t USING (g) JOIN crown_runs r ON r.run = t.pos >> (4 * (r.lvl + 1))),
folded AS (
  SELECT k, 0 AS step, claimed AS node FROM leaves
  UNION ALL SELECT f.k, f.step + 1, sha256(array_to_string(pre, '') || node || array_to_string(post, '')) FROM folded f JOIN steps s ON s.k = f.k AND s.step = f.step),
ends AS (SELECT k, arg_max(node, step) AS folded_root FROM folded GROUP BY 1),
proofs AS (SELECT k, sha256(coalesce(string_agg(array_to_string(pre, '') || array_to_string(post, ''), '' ORDER BY step), '')) AS proof_sha256 FROM leaves LEFT JOIN steps USING (k) GROUP BY 1),
top AS (SELECT node AS root FROM crown WHERE n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN tops USING (g) JOIN ends USING (k) JOIN proofs USING (k), top""",
}

"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path; it becomes one regular expression over host and path
and a list of its literal tokens (labels of the host, and the parts of the path that
are surely whole in any URL that fits).  How often each rule token occurs is counted
over all URLs; a rule is filed under its rarest one.  The distinct tokens of a URL
fetch the rules filed under them, only these run their expression, and the longest
rule that fits decides.  A rule without a token is filed under ``ANY``, which every URL
carries.  A URL that no rule fits takes ``default``.

Only DataFrame functions are used.  URLs are made distinct first (pre-aggregated), so
a URL that repeats is judged once.  The index is broadcast while the rules' text is
within ``BROADCAST_BYTES``; beyond it the join shuffles.

A null URL, or one without ``://``, has empty host and path, which no rule fits; an
empty table gives no rows; repeated rows are judged alike; further columns stay out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The index is sent to executors up to this size.
BROADCAST_BYTES = 8 << 20
TOKEN = "[a-z0-9]+"
#: Stands for a token that every URL has; no token is empty.
ANY = ""
_UPPER_LETTERS, _LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER_LETTERS, _LOWER_LETTERS)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def patterns(self) -> tuple[str, str]:
        """Expressions over the host and over the path."""
        return rf"(?s)\A(.*\.)?{re.escape(self.host)}\z", rf"(?s)\A{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has whole: all of the host, those of the path that something ends."""
        ended = re.findall(rf"({TOKEN})(?=[^a-z0-9])", self.path.translate(_LOWER))
        return list(dict.fromkeys(re.findall(TOKEN, self.host) + ended))


def parse(text: str) -> Rule:
    """Rule of a line like ``block example.com/de/``."""
    verdict, _, rest = text.strip().partition(" ")
    host, slash, path = rest.strip().partition("/")
    return Rule(verdict, host.translate(_LOWER), slash + path)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER_LETTERS, _LOWER_LETTERS)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per distinct url: url, host, path, rule (null where none fits), verdict."""
    spark = pages.sparkSession
    urls = pages.select(pages[url_col].alias("url")).distinct()
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not rules:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    small = sum(len(r.name) + 128 for r in rules) <= BROADCAST_BYTES
    light = F.broadcast if small else (lambda df: df)
    listed = spark.createDataFrame([(r.name, r.verdict, *r.patterns, len(r.name), r.tokens or [ANY]) for r in rules], "rule string, verdict string, on_host string, on_path string, size int, tokens array<string>")
    wanted = listed.select(F.explode("tokens").alias("token")).distinct()
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(F.concat_ws(" ", "host", "path"), _UPPER_LETTERS, _LOWER_LETTERS), F.lit(TOKEN), F.lit(0)))
    if not all(r.tokens for r in rules):
        tokens = F.array_append(tokens, F.lit(ANY))
    split = urls.select("url", "host", "path", F.explode(tokens).alias("token"))
    seen = split.select("token").join(light(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    filed = listed.select("rule", "verdict", "on_host", "on_path", "size", F.explode("tokens").alias("token")).join(seen, "token", "left")
    index = filed.groupBy("rule", "verdict", "on_host", "on_path", "size").agg(F.min_by("token", F.struct(F.coalesce("seen", F.lit(0)), F.col("token"))).alias("token"))
    candidates = split.join(light(index), "token").filter(F.expr("host rlike on_host AND path rlike on_path"))
    best = candidates.groupBy("url").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    out = urls.join(best, "url", "left")
    return out.select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_pages(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    found = judge(pages, rules, url_col, default).select(F.col("url").alias("url__"), "rule", "verdict")
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    joined = rows.join(found.filter("rule IS NOT NULL"), rows["url"] == F.col("url__"), "left")
    return joined.select("page_id", host_of(rows["url"]).alias("host"), path_of(rows["url"]).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

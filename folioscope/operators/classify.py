"""Stored verdicts and which documents are to be planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.functions.text import clean_field, iso_gate
from folioscope.operators import rules

FIELDS = ("party", "doc_type", "detail", "doc_date", "folder", "note")


class SelectorError(ValueError):
    """A document that is not named, or not by one name."""


def upsert(stored: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """K7, T25. One verdict for each document: a new one replaces all but the time of the first; what it does not name is null.

    Of several new ones for a document the last by ``seq`` counts, where that column is there, else the greatest.
    """
    missing = [f for f in stored.schema.fields if f.name not in verdicts.columns and f.name not in ("created_at", "updated_at")]
    new = verdicts.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    new = new.withColumns({c: clean_field(F.col(c)) for c in FIELDS} | {"doc_date": iso_gate(F.col("doc_date"))})
    own = [c for c in stored.columns if c not in ("document_id", "created_at", "updated_at")]
    order = ["seq"] if "seq" in verdicts.columns else []
    new = new.groupBy("document_id").agg(F.max(F.struct(*order, *own)).alias("v")).select("document_id", *[F.col(f"v.{c}").alias(c) for c in own])
    before = stored.select(F.col("document_id"), F.col("created_at").alias("first__"))
    new = new.join(before, "document_id", "left").withColumn("created_at", F.coalesce("first__", now)).withColumn("updated_at", now)
    return stored.join(new.select("document_id"), "document_id", "left_anti").unionByName(new.select(*stored.columns))


def plan_rows(documents: DataFrame, occurrences: DataFrame, classification: DataFrame) -> DataFrame:
    """J3, J4, J5. Live documents with the path of their lowest occurrence and their stored verdict, by id."""
    live = occurrences.filter(F.col("missing_since").isNull())
    first = live.groupBy("document_id").agg(F.min_by(F.struct("rel_path", "mtime", "size_bytes"), "occurrence_id").alias("o"))
    first = first.select("document_id", "o.rel_path", F.col("o.mtime").alias("mtime"), F.col("o.size_bytes").alias("size_bytes"))
    agent = classification.select("document_id", *[F.col(c).alias(f"agent_{c}") for c in ("party", "doc_type", "detail", "doc_date", "folder", "tags")], F.lit(True).alias("agent"))
    return documents.select("document_id", "sha256", "ocr_text").join(first, "document_id").join(agent, "document_id", "left")


def verdicts(rows: DataFrame, taxonomy: rules.Taxonomy, current_year: int) -> DataFrame:
    """The verdict of each row: the stored one, else the first rule's; date and detail with where they come from.

    A stored date wins; under a stored verdict without one the date is read from the text.
    """
    found = rows.withColumn("m", rules.match_rule(taxonomy, F.col("ocr_text")))
    agent = F.coalesce("agent", F.lit(False))
    pick = lambda c: F.when(agent, F.col(f"agent_{c}")).otherwise(F.col(f"m.{c}"))
    rule = F.when(~agent, F.col("m.rule_id"))
    out = found.withColumn("rule_id", rule).withColumn("provenance", F.when(agent, "agent").when(F.col("m").isNotNull(), "rule"))
    out = out.withColumn("window__", text.window(F.col("ocr_text")))  # normalised once; dates and details are read within lambdas
    read = rules.date_by_rule(taxonomy, F.col("rule_id"), F.col("window__"), current_year, ascii_only=True)
    out = out.withColumn("d", read).withColumn("e", rules.detail_by_rule(taxonomy, F.col("rule_id"), F.col("window__"), ascii_only=True).cast("struct<detail:string,source:string>"))
    dated = agent & F.col("agent_doc_date").isNotNull()
    out = out.withColumns(
        {
            "party": pick("party"), "doc_type": pick("doc_type"), "folder": pick("folder"), "tags": pick("tags"),
            "doc_date": F.when(dated, F.col("agent_doc_date")).otherwise(F.col("d.iso")), "date_source": F.when(dated, "agent").otherwise(F.col("d.source")),
            "detail": F.when(agent, F.col("agent_detail")).otherwise(F.col("e.detail")), "detail_source": F.when(agent & F.col("agent_detail").isNotNull(), "agent").otherwise(F.col("e.source")),
        }
    )
    keep = ["document_id", "sha256", "rel_path", "mtime", "size_bytes", "provenance", "rule_id", "party", "doc_type", "detail", "doc_date", "folder", "tags", "date_source", "detail_source"]
    return out.select(*keep)


def select_document(documents: DataFrame, occurrences: DataFrame, document_id: int | None = None, sha256: str | None = None, rel_path: str | None = None) -> int:
    """P7, P6. The id of the document named in exactly one way; a bare file name is refused, and so is one that fits several."""
    if sum(x is not None for x in (document_id, sha256, rel_path)) != 1:
        raise SelectorError("name the document by exactly one of id, sha256, path")
    if rel_path is not None:
        path = rel_path.replace("\\", "/").strip().removeprefix("./").lstrip("/")
        if "/" not in path:
            same = occurrences.filter(F.col("rel_path") == path)
        else:
            same = occurrences.filter((F.col("rel_path") == path) | F.col("rel_path").endswith("/" + path))
        found = same.select("document_id")
    else:
        found = documents.filter(F.col("sha256") == sha256.lower() if sha256 is not None else F.col("document_id") == document_id).select("document_id")
    ids = [r.document_id for r in found.distinct().limit(2).collect()]
    if len(ids) != 1:
        raise SelectorError("no such document" if not ids else "the name fits several documents")
    return ids[0]


def blocked(path: Column, names: list[str], folders: list[str], suffixes: list[str], allow: str | None = None) -> Column:
    """P12. Whether a file is barred by its whole path, folder or suffix and not let through."""
    hit = path.isin(*names) if names else F.lit(False)
    for f in folders:
        hit = hit | path.startswith(f.rstrip("/") + "/")
    for s in suffixes:
        hit = hit | F.lower(path).endswith(s.lower())
    return hit & ~path.rlike(allow) if allow else hit


def rule_stanza(verdict: dict, terms: list[str]) -> str:
    """T27. A rule that would give a verdict, for a person to paste."""
    import json

    lines = ["[[rule]]", f"id = {json.dumps(verdict.get('id') or 'new-rule')}"]
    lines += [f"{k} = {json.dumps(verdict[k])}" for k in ("party", "doc_type", "detail", "folder") if verdict.get(k)]
    return "\n".join([*lines, f"all = {json.dumps(terms)}"]) + "\n"

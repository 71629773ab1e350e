"""Markdown of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import strip


def page_text(pages: DataFrame) -> DataFrame:
    """M11. (document_id, body): texts of pages that are ok and not blank, in order, by a blank line."""
    good = pages.filter((F.col("status") == "ok") & (F.length(strip(F.col("text"))) > 0))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return good.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("body"))


def rows(documents: DataFrame) -> DataFrame:
    """K11, T28. (document_id, file_name, markdown) of documents (document_id, sha256, rel_path, body) whose text is not blank.

    The name tells nothing of the content.
    """
    some = documents.filter(F.length(strip(F.col("body"))) > 0)
    name = F.concat(F.lpad(F.col("document_id").cast("string"), 5, "0"), F.lit("-"), F.substring("sha256", 1, 12), F.lit(".md"))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("document_id: "), F.col("document_id").cast("string")), F.concat(F.lit("sha256: "), "sha256"), F.concat(F.lit("source: "), F.coalesce("rel_path", F.lit(""))), F.lit("---"), F.lit(""))
    return some.select("document_id", name.alias("file_name"), F.concat(head, F.lit("\n"), "body", F.lit("\n")).alias("markdown"))


def write(markdown: DataFrame, path: str) -> None:
    """One file for each document and a manifest, written by executors below a shared path."""
    markdown.select("file_name", "markdown").write.mode("errorifexists").json(f"{path}/documents")
    markdown.select("document_id", "file_name", F.length("markdown").alias("chars")).write.mode("errorifexists").json(f"{path}/manifest")

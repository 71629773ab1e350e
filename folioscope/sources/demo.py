"""A made-up collection for trying out search and links: linked letters, padded with others that share nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (party, kind, date, first page, second page): a person, an account and a house run through them, never all in one.
LINKED = (
    ("harrow-bank", "statement", "2025-03-31", "Harrow Bank statement for Ines Calder, account QX-4471.", "Balance carried forward in account QX-4471."),
    ("fenwater", "invoice", "2025-04-02", "Fenwater supplies 12 Quarry Lane, to be paid from account QX-4471.", "Meter read on the first of April."),
    ("quarry-lettings", "letter", "2025-04-20", "Quarry Lettings to Ines Calder about 12 Quarry Lane.", "The lease is renewed for a year."),
    ("dr-osei", "invoice", "2025-05-06", "Dr Osei, visit of Ines Calder.", "Payable within a month."),
)
FILLER = ("stock-list", "letter", "2025-12-01")


def corpus(spark: SparkSession, documents: int) -> DataFrame:
    """(document_id, party, doc_type, doc_date, rel_path, ocr_text, page_count): the linked letters, then fillers; a row each."""
    if documents < 1:
        raise ValueError("a collection has one document at least")
    k = F.col("id") + 1
    batch = F.format_string("Filler %05d", k)
    named = lambda at, other: F.coalesce(*[F.when(k == j, F.lit(row[at])) for j, row in enumerate(LINKED, start=1)], other)
    first, second = named(3, F.concat(batch, F.lit(" encloses its list."))), named(4, F.concat(batch, F.lit(" asks for no answer.")))
    party = named(0, F.concat(F.lit("filler-"), F.format_string("%05d", k)))
    rows = spark.range(documents).select(
        k.alias("document_id"), party.alias("party"), named(1, F.lit(FILLER[1])).alias("doc_type"), named(2, F.lit(FILLER[2])).alias("doc_date"),
        F.concat_ws("\n\n", first, second).alias("ocr_text"), F.lit(2).alias("page_count"),
    )
    return rows.withColumn("rel_path", F.concat(F.lit("inbox/"), F.format_string("%05d", "document_id"), F.lit("-"), "party", F.lit("-"), "doc_type", F.lit(".pdf"))).withColumn("sha256", F.sha2(F.concat_ws(":", "document_id", "ocr_text"), 256))

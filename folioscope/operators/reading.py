"""Text of pages: the reading ladder, roll-up, and word tables of a recogniser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import strip, strip_trailer

LADDER = ("local", "drive", "vision")
MIN_CONFIDENCE = 0.75
STATUSES = ("ok", "pending_vision", "pending_drive", "skipped", "exhausted")
# Notes that tell of the environment, not of the page.
ENVIRONMENT_NOTES = ("drive_unauthenticated", "drive_offline", "drive_quota")
_RANK = {"local_text": 1, "local_tesseract": 1, "local": 1, "drive": 2, "vision": 3}


def has_text(text: Column) -> Column:
    """M4. Whether a text has more than white space."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def coarse_rank(source: Column) -> Column:
    """Rank of a fine source: local below drive below vision; null for others."""
    pairs = F.create_map(*[F.lit(x) for p in _RANK.items() for x in p])
    return F.try_element_at(pairs, source)


def coarse_source(source: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LADDER)), coarse_rank(source))


def roll_up(pages: DataFrame) -> DataFrame:
    """A4. (document_id, ocr_text, ocr_source): texts that are there, in page order, by a blank line; the highest source of any page."""
    there = pages.withColumn("here__", has_text(F.col("text")))
    parts = F.array_sort(F.collect_list(F.when(F.col("here__"), F.struct("page_number", "text"))))
    body = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n"))
    rank = F.max(coarse_rank(F.col("ocr_source")))
    return there.groupBy("document_id").agg(body.alias("ocr_text"), F.when(rank.isNotNull(), F.element_at(F.array(*map(F.lit, LADDER)), rank)).alias("ocr_source"))


def unavailable_rung(note: Column) -> Column:
    """M3. The rung that a note says could not run at all, or null."""
    named = F.regexp_extract(note, r"^rung_unavailable:(.+)$", 1)
    return F.when(note == "tesseract_missing", "local").when(note.isin(*ENVIRONMENT_NOTES), "drive").when(F.length(named) > 0, named)


def resume_index(rung: Column, status: Column, note: Column, ladder: tuple[str, ...] = LADDER) -> Column:
    """I3. Rung (0-based) at which a page goes on: after the one recorded, at one that could
    not run, at drive if it never answered; from the start for a new page or an unknown rung."""
    place = lambda name: F.nullif(F.array_position(F.array(*map(F.lit, ladder)), name), F.lit(0)) - 1
    new = rung.isNull() | (rung == "")
    out = F.when(new, F.lit(0))
    out = out.when(place(unavailable_rung(note)).isNotNull(), place(unavailable_rung(note)))
    if "drive" in ladder:
        at = ladder.index("drive")
        answered = F.coalesce(note.startswith("drive_"), F.lit(False))
        out = out.when(status == "pending_drive", F.lit(at)).when((status == "pending_vision") & ~answered & (place(rung) > at), F.lit(at))
    return out.otherwise(F.coalesce(place(rung) + 1, F.lit(0))).cast("int")


def is_done(confidence: Column, least: float = MIN_CONFIDENCE) -> Column:
    """P8."""
    return F.coalesce(confidence, F.lit(0.0)) >= least


def _answer(text, confidence, rung, source, status, note) -> Column:
    return F.struct(
        text.cast("string").alias("text"), confidence.cast("double").alias("confidence"), rung.cast("string").alias("rung"), source.cast("string").alias("ocr_source"),
        status.cast("string").alias("status"), note.cast("string").alias("note"),
    )


def local_result(layer_text: Column, layer_confidence: Column, ocr_text: Column, ocr_confidence: Column, tool: Column, rendered: Column, least: float = MIN_CONFIDENCE) -> Column:
    """I5. The local rung: the text layer if it is good enough, else the better of it and what was recognised."""
    local, none = F.lit("local"), F.lit(None)
    layer = F.when(F.length(layer_text) > 0, layer_text)
    skipped = lambda note: _answer(layer, layer_confidence, local, none, F.lit("skipped"), F.lit(note))
    read = F.length(F.coalesce(ocr_text, F.lit(""))) > 0
    status = F.when(ocr_confidence >= least, "ok").otherwise("skipped")
    return (
        F.when(layer_confidence >= least, _answer(layer_text, layer_confidence, local, F.lit("local_text"), F.lit("ok"), none))
        .when(~tool, skipped("tesseract_missing"))
        .when(~rendered, skipped("render_failed"))
        .when(ocr_confidence < layer_confidence, skipped("tesseract_below_text_layer"))
        .otherwise(_answer(F.when(read, ocr_text), ocr_confidence, local, F.when(read, "local_tesseract"), status, F.when(~read, "tesseract_empty")))
    )


def drive_result(answer: Column, note: Column, first: Column, most: int = 1_000_000) -> Column:
    """The drive rung: a document's answer on the ``first`` of its pages that ask, an empty one on the rest; or why there is none."""
    clean = strip_trailer(answer)
    why = F.when(answer.isNull(), F.coalesce(note, F.lit("drive_convert_failed"))).when(F.length(answer) > most, "drive_too_long").when(~has_text(clean), "drive_empty")
    drive, none = F.lit("drive"), F.lit(None)
    fine = _answer(F.when(first, clean), F.lit(1.0), drive, drive, F.lit("ok"), none)
    return F.when(why.isNull(), fine).otherwise(_answer(none, F.lit(0.0), drive, none, F.lit("skipped"), why))


def vision_result() -> Column:
    """The vision rung: a page that waits for an agent."""
    return _answer(F.lit(None), F.lit(0.0), F.lit("vision"), F.lit(None), F.lit("pending_vision"), F.lit(None))


def unknown_result(rung: str) -> Column:
    return _answer(F.lit(None), F.lit(0.0), F.lit(rung), F.lit(None), F.lit("skipped"), F.lit(f"rung_unavailable:{rung}"))


def walk(results: Column, least: float = MIN_CONFIDENCE, seed_note: Column | None = None) -> Column:
    """I4. The outcome of a ladder whose rungs gave ``results`` (array of text, confidence, rung, ocr_source, status, note), in order.

    It stops at the first rung that is sure enough or that waits for an agent; the best
    read so far is carried; a note on what could not run outlives one on quality; with
    no rung left the page is exhausted, unless the last rung was skipped with a note.
    """
    blank = _answer(F.lit(None), F.lit(0.0), F.lit(None), F.lit(None), F.lit(None), F.lit(None))
    start = F.struct(
        blank.alias("best"), F.lit(False).alias("have"), F.when(F.lit(False), blank).alias("last"),
        (seed_note if seed_note is not None else F.lit(None)).cast("string").alias("carry"), F.when(F.lit(False), blank).alias("out"),
    )

    def step(s: Column, r: Column) -> Column:
        environment = unavailable_rung(r["note"]).isNotNull()
        quality = F.coalesce(r["note"].startswith("drive_"), F.lit(False)) & unavailable_rung(s["carry"]).isNull()
        carry = F.when(environment | quality, r["note"]).otherwise(s["carry"])
        skip = F.coalesce(r["note"].startswith("rung_unavailable:"), F.lit(False))
        waits = r["status"].isin("pending_vision", "pending_drive")
        best, have = s["best"], s["have"]
        pick = lambda c: F.when(have, best[c]).otherwise(r[c])
        waiting = _answer(pick("text"), pick("confidence"), r["rung"], pick("ocr_source"), r["status"], F.coalesce(carry, r["note"]))
        kept = F.when(~has_text(r["text"]) & have & has_text(best["text"]), best["text"]).otherwise(r["text"])
        sure = _answer(kept, r["confidence"], r["rung"], r["ocr_source"], F.lit("ok"), r["note"])
        out = F.when(~skip & waits, waiting).when(~skip & (r["confidence"] >= least), sure)
        better = ~skip & (~have | (r["confidence"] > best["confidence"]))
        same = _answer(*[r[c] for c in ("text", "confidence", "rung", "ocr_source", "status", "note")])
        moved = F.struct(F.when(better, same).otherwise(best).alias("best"), (have | ~skip).alias("have"), same.alias("last"), carry.alias("carry"), out.alias("out"))
        return F.when(s["out"].isNotNull(), s).otherwise(moved)

    def finish(s: Column) -> Column:
        best, last = s["best"], s["last"]
        fill = ~has_text(last["text"]) & s["have"] & has_text(best["text"])
        pick = lambda c: F.when(fill, best[c]).otherwise(last[c])
        skipped = _answer(pick("text"), pick("confidence"), last["rung"], pick("ocr_source"), last["status"], last["note"])
        spent = _answer(best["text"], best["confidence"], F.coalesce(last["rung"], best["rung"]), best["ocr_source"], F.lit("exhausted"), F.coalesce(s["carry"], best["note"]))
        return F.when(s["out"].isNotNull(), s["out"]).when((last["status"] == "skipped") & (F.length(last["note"]) > 0), skipped).otherwise(spent)

    return F.aggregate(results, start, step, finish)


def keep_earlier(new: DataFrame, stored: DataFrame) -> DataFrame:
    """I6. Results of pages; one without text keeps the stored text, its source, and the larger confidence."""
    keys = ["document_id", "page_number"]
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("text", "confidence", "ocr_source")])
    joined = new.join(old, keys, "left")
    keep = ~has_text(F.col("text")) & has_text(F.col("old_text"))
    out = joined.withColumns(
        {
            "text": F.when(keep, F.col("old_text")).otherwise(F.col("text")),
            "confidence": F.when(keep, F.greatest(F.col("confidence"), F.coalesce("old_confidence", F.lit(0.0)))).otherwise(F.col("confidence")),
            "ocr_source": F.when(keep, F.coalesce("ocr_source", "old_ocr_source")).otherwise(F.col("ocr_source")),
        }
    )
    return out.select(*new.columns)


def upsert_pages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """K6. One row for each page; a new row replaces the stored one."""
    keys = ["document_id", "page_number"]
    return stored.join(new.select(keys), keys, "left_anti").unionByName(new.select(*stored.columns))


def drive_pages(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """I7. A document's answer (document_id, answer) lands on its lowest pending page; its other pending pages keep their own text."""
    waiting = F.col("status").isin("pending_drive", "pending_vision")
    order = Window.partitionBy("document_id").orderBy(F.when(waiting, 0).otherwise(1), "page_number")
    ranked = pages.withColumn("rank__", F.row_number().over(order)).join(answers, "document_id", "left")
    hit = waiting & F.col("answer").isNotNull()
    out = ranked.withColumn("text", F.when(hit & (F.col("rank__") == 1), F.col("answer")).otherwise(F.col("text")))
    out = out.withColumn("ocr_source", F.when(hit, "drive").otherwise(F.col("ocr_source"))).withColumn("rung", F.when(hit, "drive").otherwise(F.col("rung")))
    return out.withColumn("status", F.when(hit, "ok").otherwise(F.col("status"))).select(*pages.columns)


def tsv_words(text: Column) -> Column:
    """S10. (text, confidence) of a recogniser's table: words joined by blanks, mean confidence over 100 to 3 places."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    header = F.split(F.get(lines, F.lit(0)), "\t", -1)
    conf, word = F.array_position(header, F.lit("conf")) - 1, F.array_position(header, F.lit("text")) - 1
    named = (conf >= 0) & (word >= 0)
    conf, word = F.when(named, conf).otherwise(10).cast("int"), F.when(named, word).otherwise(11).cast("int")

    def read(line: Column) -> Column:
        fields = F.split(line, "\t", -1)
        return F.struct(strip(F.get(fields, word)).alias("word"), F.get(fields, conf).try_cast("double").alias("conf"))

    rows = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), read)
    rows = F.filter(rows, lambda r: (F.length(r["word"]) > 0) & r["conf"].isNotNull() & ~(r["conf"] < 0))
    mean = F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["conf"]) / F.size(rows) / 100
    return F.struct(F.array_join(F.transform(rows, lambda r: r["word"]), " ").alias("text"), F.when(F.size(rows) > 0, F.bround(mean, 3)).otherwise(0.0).alias("confidence"))


def summary(pages: DataFrame) -> DataFrame:
    """A7. Counters of pages by status; ``degraded`` counts notes on rungs that could not run, in addition."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return pages.agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("pages"), *counts, F.count_if(unavailable_rung(F.col("note")).isNotNull()).alias("degraded"))


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """A8. The sum of summaries."""
    return summaries.agg(*[F.sum(c).alias(c) for c in summaries.columns])


def submit_error(page_count: int | None, page: int | None, rung: str, text: str, most: int = 1_000_000) -> str | None:
    """I8. Why an agent's text is refused, or None."""
    if rung not in ("vision", "drive"):
        return f"unknown rung {rung}"
    if rung == "vision" and page is None:
        return "a page is required for vision"
    if rung == "drive" and page is not None:
        return "a page is not allowed for drive"
    if page is not None and (page < 1 or (page_count is not None and page > page_count)):
        return "there is no such page"
    if not text.strip():
        return "the text is empty"
    return "the text is too long" if len(text) > most else None

"""Dates in text, by position.

Five classes of dates are read independently, so overlapping hits of different classes
are all seen; hits that no calendar has are dropped; at one offset the class that is
declared first wins.  The first date is the leftmost match of all classes as one
expression, unless no calendar has that.  No builtin tells the offsets of all matches, so
they come from running sums of the lengths of the matches and of the text between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
_NAME = "|".join(sorted(MONTHS, key=len, reverse=True))
# The classes of dates, in order of precedence at one offset.
CLASSES = (
    r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b",
    rf"(?i)\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_NAME})\.?,?\s+([0-9]{{4}})\b",
    rf"(?i)\b({_NAME})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})\b",
    rf"(?i)\b([0-9]{{1,2}})[-.]({_NAME})\.?[-.]([0-9]{{4}}|[0-9]{{2}})\b",
    r"\b([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})\b",
)


def full_year(year: Column, current_year: int) -> Column:
    """T9. Four digits as written; two are this century's unless more than a year ahead."""
    ahead = F.lit(2000) + year.cast("int")
    return F.when(F.length(year) == 4, year.cast("int")).otherwise(F.when(ahead <= current_year + 1, ahead).otherwise(ahead - 100))


def iso(year: Column, month: Column, day: Column) -> Column:
    """T7. ``YYYY-MM-DD`` if the calendar has the day, else null; there is no year 0."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when((year >= 1) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def _parts(kind: int, match: Column, order: str, current_year: int) -> Column:
    a, b, c = (F.regexp_extract(match, CLASSES[kind], k) for k in (1, 2, 3))
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    if kind == 0:
        return iso(a.cast("int"), b.cast("int"), c.cast("int"))
    if kind in (1, 3):
        return iso(full_year(c, current_year), F.element_at(months, F.lower(b)), a.cast("int"))
    if kind == 2:
        return iso(full_year(c, current_year), F.element_at(months, F.lower(a)), b.cast("int"))
    first, second = a.cast("int"), b.cast("int")
    swap = (first <= 12) & ((second > 12) | F.lit(order == "mdy"))  # T8
    return iso(full_year(c, current_year), F.when(swap, first).otherwise(second), F.when(swap, second).otherwise(first))


def _running(lengths: Column) -> Column:
    """Sums of an array before each of its elements: within parts of about the root of its size, then over parts, so no long array is grown one by one."""
    size = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / size).cast("int"), F.lit(0))), lambda k: F.slice(lengths, k * size + 1, size))
    begun = _before(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x)))
    return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), begun.alias("begun")), lambda p: F.transform(_before(p["part"]), lambda x: x + p["begun"])))


def _before(values: Column) -> Column:
    """The sum of what stands before each element of a short array."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], s["sum"]).alias("out")), lambda s: s["out"])


def offsets(text: Column, pattern: str) -> Column:
    """T6. Array of (at, match) for all matches of a pattern, by their offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
    steps = F.zip_with(gaps, found, lambda g, m: F.coalesce(g, F.lit(0)) + F.length(m))
    at = F.zip_with(_running(steps), gaps, lambda before, g: before + F.coalesce(g, F.lit(0)))
    placed = F.zip_with(at, found, lambda p, m: F.struct(p.cast("int").alias("at"), m.alias("match")))
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast("array<struct<at:int,match:string>>"))


def scan(text: Column, order: str = "dmy", current_year: int = 2026) -> Column:
    """T6. Array of (at, kind, iso) of all dates of a text."""
    return F.concat(*[_hits(text, kind, order, current_year) for kind in range(len(CLASSES))])


def _hits(text: Column, kind: int, order: str, current_year: int) -> Column:
    read = lambda h: F.struct(h["at"].alias("at"), F.lit(kind).alias("kind"), _parts(kind, h["match"], order, current_year).alias("iso"))
    return F.filter(F.transform(offsets(text, CLASSES[kind]), read), lambda h: h["iso"].isNotNull())


def _first(text: Column, kind: int, order: str, current_year: int) -> Column:
    """(at, kind, iso) of the first date of a class: of its first match, if the calendar has that, else of the first of all."""
    pattern = CLASSES[kind]

    def read(match: Column) -> Column:
        iso_ = _parts(kind, match, order, current_year)
        at = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
        return F.when(match != "", F.coalesce(F.when(iso_.isNotNull(), F.struct(at.alias("at"), F.lit(kind).alias("kind"), iso_.alias("iso"))), F.array_min(_hits(text, kind, order, current_year))))

    return F.get(F.transform(F.array(F.regexp_extract(text, pattern, 0)), read), F.lit(0))


def _last(text: Column, kind: int, order: str, current_year: int) -> Column:
    """(at, -kind, iso) of the last date of a class, from the end: what follows a match is all that has to be summed."""
    found = F.regexp_extract_all(text, F.lit(CLASSES[kind]), F.lit(0))
    gaps = F.split(text, CLASSES[kind], -1)
    start = F.struct(F.lit(0).alias("after"), F.size(found).alias("i"), F.lit(None).cast("string").alias("iso"))

    def step(state: Column, match: Column) -> Column:
        after = state["after"] + F.length(F.get(gaps, state["i"])) + F.length(match)
        seen = state["iso"].isNotNull()
        return F.struct(F.when(seen, state["after"]).otherwise(after).alias("after"), (state["i"] - 1).alias("i"), F.when(seen, state["iso"]).otherwise(_parts(kind, match, order, current_year)).alias("iso"))

    end = lambda s: F.when(s["iso"].isNotNull(), F.struct((F.length(text) - s["after"]).alias("at"), F.lit(-kind).alias("kind"), s["iso"].alias("iso")))
    return F.aggregate(F.reverse(found), start, step, end)


#: The five classes as one expression: its first match is that of the class whose first match is leftmost, the earlier class at one offset.
_ANY = "|".join(f"(?:{c})" for c in CLASSES)


def extract_date(text: Column, order: str = "dmy", select: str = "first", current_year: int = 2026) -> Column:
    """T10, W3. The first or the last date by position."""
    kinds = range(len(CLASSES))
    if select != "last":
        # every class has a year of two digits at least; only where no calendar has the leftmost match is each class looked at
        every = F.array_min(F.array_compact(F.array(*[_first(text, kind, order, current_year) for kind in kinds])))["iso"]

        def read(match: Column) -> Column:
            leftmost = F.lit(None).cast("string")
            for kind in reversed(kinds):
                leftmost = F.when(F.regexp_extract(match, CLASSES[kind], 0) == match, _parts(kind, match, order, current_year)).otherwise(leftmost)
            return F.when(match != "", F.coalesce(leftmost, every))

        return F.when(text.rlike("[0-9]{2}"), F.get(F.transform(F.array(F.regexp_extract(text, _ANY, 0)), read), F.lit(0)))
    return F.when(text.rlike("[0-9]{2}"), F.array_max(F.array_compact(F.array(*[_last(text, kind, order, current_year) for kind in kinds])))["iso"])


def date_for_rule(text: Column, date_regex: str | None = None, select: str | None = None, order: str = "dmy", current_year: int = 2026) -> Column:
    """T11. (iso, source): the first capture of the rule's expression that holds a date, else the selected date."""
    chosen = extract_date(text, order, select or "first", current_year)
    one = F.array(F.struct(chosen.alias("iso"), F.lit(select or "first").alias("source")))
    fallback = F.get(F.filter(one, lambda d: d["iso"].isNotNull()), F.lit(0))
    if date_regex is None:
        return fallback
    captures = F.regexp_extract_all(text, F.lit("(?i)" + date_regex), F.lit(1))
    parsed = F.transform(captures, lambda c: F.struct(extract_date(c, order, "first", current_year).alias("iso"), F.lit("rule-regex").alias("source")))
    return F.coalesce(F.get(F.filter(parsed, lambda d: d["iso"].isNotNull()), F.lit(0)), fallback)

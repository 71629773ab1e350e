"""Page hashes, dates and text against literal values and plain models."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from folioscope.functions import dates, phash
from folioscope.functions import text as tx

FRAMES = ("{}", "the letter came on {}", "{} was the day", "see page 4 ({}), line 12", "a\nb {}\nc", "№ 5: {}; thanks")


def written(day, rng, order):
    """A day in every form that is understood, and the same with the digits swapped where the order says so."""
    name = day.strftime("%B")
    short, end = name[:3], {1: "st", 2: "nd", 3: "rd"}.get(day.day % 10 if day.day not in (11, 12, 13) else 0, "th")
    first, second = (day.day, day.month) if order == "dmy" else (day.month, day.day)
    mark = rng.choice("/.-")
    yield day.isoformat()
    yield f"{day.day} {rng.choice([name, name.upper(), short, short + '.'])} {day.year}"
    yield f"{day.day}{end} of {name}, {day.year}"
    yield f"{rng.choice([name, short.lower()])} {day.day}{rng.choice(['', end])}{rng.choice([',', ''])} {day.year}"
    yield f"{day.day}-{short}-{day.year}"
    yield f"{day.day:02}.{name.lower()}.{day.year % 100:02}"
    yield f"{first:02}{mark}{second:02}{mark}{day.year}"
    yield f"{first}{mark}{second}{mark}{day.year % 100:02}"


@pytest.mark.parametrize("order", ["dmy", "mdy"])
def test_dates(spark, order):
    rng = random.Random(order)
    cases = []
    for _ in range(60):
        day = date(rng.randint(1990, 2026), rng.randint(1, 12), rng.randint(1, 28))
        for form in written(day, rng, order):
            pivot = day if re.search(r"(?<!\d)\d{4}(?!\d)", form) or day.year >= 1928 else None
            cases.append((rng.choice(FRAMES).format(form), pivot.isoformat()))
    # a day that the given order cannot mean is read in the other
    cases += [(f"on {17}/{m}/2019", f"2019-{m:02}-17") for m in range(1, 13)] + [(f"on {m}/{23}/2019", f"2019-{m:02}-23") for m in range(1, 13)]
    # no calendar has these, and these are no dates
    wrong = ["30/02/2021", "31 April 2020", "2023-13-01", "2021-02-29", "0/5/2020", "40 May 2001", "5/6", "2020-1-1", "May 2020", "1/2/345", "12-May", "x1/2/2020y", "٣/٤/٢٠٢٠", "1/2/20201"]
    cases += [(frame.format(w), None) for w in wrong for frame in FRAMES[:2]]
    rows = spark.createDataFrame([(t, w) for t, w in cases], "t string, want string").select("t", "want", dates.extract_date(F.col("t"), order, current_year=2026).alias("got")).collect()
    assert [(r.t, r.got) for r in rows if r.got != r.want] == []


def test_first_and_last_are_by_position(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(40):
        days = [date(rng.randint(1950, 2026), rng.randint(1, 12), rng.randint(1, 28)) for _ in range(rng.randint(1, 5))]
        said = " and then ".join(rng.choice([d.isoformat(), f"{d.day} {d:%B} {d.year}", f"{d:%B} {d.day}, {d.year}"]) for d in days)
        texts.append((f"first of all {said}; as due by {days[0].isoformat()}.", days[0].isoformat(), days[0].isoformat()))
        texts.append((f"no 31/02/2020, but {said}", days[0].isoformat(), days[-1].isoformat()))
    df = spark.createDataFrame(texts, "t string, first string, last string")
    read = df.select("*", dates.extract_date(F.col("t")).alias("a"), dates.extract_date(F.col("t"), select="last").alias("b"), dates.date_for_rule(F.col("t"), r"due by (.*?)\.").alias("c")).collect()
    assert all((r.a, r.b) == (r.first, r.last) for r in read)
    assert all((r.c.source == "rule-regex") == ("due by" in r.t) and r.c.iso == r.first for r in read)


def test_year_pivot(spark):
    years = [("26", 2026), ("27", 2027), ("28", 1928), ("99", 1999), ("2025", 2025)]
    rows = spark.createDataFrame(years, "y string, want int").select(dates.full_year(F.col("y"), 2026).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def _model(text):
    """First ISO or numeric date by position, day first."""
    hits = []
    for kind, pattern in ((0, dates.CLASSES[0]), (4, dates.CLASSES[4])):
        for m in re.finditer(pattern, text, re.ASCII):
            a, b, c = m.groups()
            y, mo, d = (int(a), int(b), int(c)) if kind == 0 else (int(c) if len(c) == 4 else 2000 + int(c) if int(c) <= 27 else 1900 + int(c), int(b), int(a))
            if kind == 4 and int(a) <= 12 < int(b):
                mo, d = int(a), int(b)
            try:
                hits.append((m.start(), kind, date(y, mo, d).isoformat()))
            except ValueError:
                pass
    return min(hits)[2] if hits else None


def test_dates_against_a_model(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123/-. 29ax") for _ in range(rng.randint(5, 40))) + f" {rng.randint(1, 31)}/{rng.randint(1, 13)}/{rng.randint(0, 99):02d} " for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.extract_date(F.col("t"), current_year=2026).alias("got")).collect()
    assert [r.got for r in rows] == [_model(r.t) for r in rows]


def _match(a, b, most):
    free, total = list(b), 0
    if not a or len(a) > len(b):
        return None
    for page in a:
        d, k = min((bin((page ^ h) & (2**64 - 1)).count("1"), k) for k, h in enumerate(free))
        if d > most:
            return None
        total += d
        free.pop(k)
    return total / len(a)


def test_match_pages(spark):
    rng = random.Random(2)
    word = lambda: rng.choice([rng.getrandbits(4), rng.getrandbits(63), -1, 0])
    cases = [([word() for _ in range(rng.randint(0, 4))], [word() for _ in range(rng.randint(0, 5))]) for _ in range(300)]
    rows = spark.createDataFrame(cases, "a array<bigint>, b array<bigint>").select("a", "b", phash.match_pages(F.col("a"), F.col("b"), 3).alias("got")).collect()
    assert [r.got for r in rows] == [_match(r.a, r.b, 3) for r in rows]


def test_hamming_and_bands(spark):
    row = spark.sql("SELECT 'ffffffffffffffff' AS a, '0000000000000000' AS b").select(phash.hamming_hex(F.col("a"), F.col("b")).alias("d")).first()
    assert row.d == 64
    rng = random.Random(3)
    pairs = []
    for _ in range(200):
        x = rng.getrandbits(63)
        y = x
        for bit in rng.sample(range(63), rng.randint(0, 6)):
            y ^= 1 << bit
        pairs.append((x, y))
    rows = spark.createDataFrame(pairs, "x bigint, y bigint").select(F.arrays_overlap(phash.bands(F.col("x"), 6), phash.bands(F.col("y"), 6)).alias("hit")).collect()
    assert all(r.hit for r in rows)


SANITIZED = [(None, ""), ("Müller & Co / Bücher", "M_ller_Co_B_cher"), ("con.txt", "_con.txt"), ("..", ""), ("a" * 100, "a" * 80), ("  x  ", "x"), ("a​b", "ab"), ("ﬁle", "file"), ("AUX", "_AUX")]


def test_sanitize(spark):
    rows = spark.createDataFrame(SANITIZED, "v string, want string").select("want", tx.sanitize_component(F.col("v")).alias("got")).collect()
    assert [r.got for r in rows] == [w for _, w in SANITIZED]


def test_text(spark):
    df = spark.createDataFrame([("two lines\nof text\nImage labels: cat, hat \n", "  Straße\tＡ  B "), ("an Image labels: inside", None)], "t string, n string")
    rows = df.select(tx.strip_trailer(F.col("t")).alias("s"), tx.normalize_text(F.col("n")).alias("n"), tx.tokens(F.col("n")).alias("w")).collect()
    assert [r.s for r in rows] == ["two lines\nof text", "an Image labels: inside"]
    assert rows[0].n.strip() == "strasse a b" and rows[0].w == ["straße", "a", "b"]
    values = [("", 0.0), ("   ", 0.0), ("Total", 0.025), ("�" * 400, 0.0), ("word " * 50, 1.0)]
    rows = spark.createDataFrame(values, "t string, want double").select(tx.confidence_of(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [w for _, w in values]
    assert spark.createDataFrame([(" " * 200_000,)], "t string").select(F.length(tx.strip_trailer(F.col("t"))).alias("n")).first().n == 0


def test_match_pages_of_many_sizes(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(12)]
    near = lambda h: h ^ sum(1 << k for k in rng.sample(range(62), rng.choice([0, 0, 1, 4, 7])))
    cases = []
    for _ in range(400):
        b = [near(rng.choice(base)) for _ in range(rng.choice([1, 2, 3, 9, 40]))]
        cases.append(([near(rng.choice(b)) for _ in range(rng.randint(0, len(b)))], b))
    cases += [(None, [1]), ([1], None), ([], []), ([5], [])]
    rows = spark.createDataFrame(cases, "a array<bigint>, b array<bigint>").repartition(3).select("a", "b", phash.match_pages(F.col("a"), F.col("b"), 6).alias("got")).collect()
    assert all(r.got == (_match(r.a, r.b, 6) if r.a is not None and r.b is not None else None) for r in rows)
    assert sum(r.got is not None for r in rows) > 50


def test_very_many_dates(spark):
    day = lambda k: date(1970 + k % 50, 1 + k % 12, 1 + k % 28)
    said = [day(k).isoformat() if k % 3 else f"{day(k).day} {day(k):%B} {day(k).year}" for k in range(10_000)]
    body = "; ".join(said) + "; never 31/02/2020"
    row = spark.createDataFrame([(body,)], "t string").select(dates.scan(F.col("t")).alias("all"), dates.extract_date(F.col("t"), select="last").alias("last"), dates.extract_date(F.concat(F.lit("30/02/2001 "), F.col("t"))).alias("first")).first()
    places, at = [], 0
    for s in said:
        places.append(at)
        at += len(s) + 2
    assert sorted((h.at, h.iso) for h in row.all) == [(p, day(k).isoformat()) for k, p in enumerate(places)]
    assert row.last == day(9_999).isoformat() and row.first == day(0).isoformat()

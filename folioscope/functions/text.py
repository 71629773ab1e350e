"""Text functions: normal forms, file-name components, confidence, trailers, tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that rules look at.
MATCH_WINDOW = 200_000
#: Code points of one component of a file name.
COMPONENT_LIMIT = 80
#: Length from which on a page counts as fully read.
DENSE_AT = 200
# Device names that Windows reserves.
RESERVED = "con prn aux nul com1 com2 com3 com4 com5 com6 com7 com8 com9 lpt1 lpt2 lpt3 lpt4 lpt5 lpt6 lpt7 lpt8 lpt9"
_ASCII = r"\A\p{ASCII}*\z"
#: White space as Python's str.strip() sees it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


#: Texts that Python holds at once beside those of an Arrow batch.
_TEXTS = 128


def _mapped(text: Column, f: Callable[[str], str]) -> Column:
    """A function of each text that is not null, a few texts at a time."""

    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        parts = [pa.array([None if s is None else f(s) for s in values.slice(at, _TEXTS).to_pylist()], pa.string()) for at in range(0, len(values), _TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return apply(text)


def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII, which it leaves alone, stays in the JVM."""
    return F.when(text.rlike(_ASCII), text).otherwise(_mapped(F.when(~text.rlike(_ASCII), text), lambda s: unicodedata.normalize("NFKC", s)))


def casefold(text: Column) -> Column:
    return F.when(text.rlike(_ASCII), F.lower(text)).otherwise(_mapped(F.when(~text.rlike(_ASCII), text), str.casefold))


def fold_marks(text: Column) -> Column:
    return F.when(text.rlike(_ASCII), text).otherwise(_mapped(F.when(~text.rlike(_ASCII), text), _without_marks))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}++|{SPACE}++\z", "")


def window(text: Column, ascii_only: bool = False) -> Column:
    """T10. The normalised slice that dates and details are read from; case stays."""
    return F.substring(text if ascii_only else nfkc(text), 1, MATCH_WINDOW)


def normalize_text(text: Column, ascii_only: bool = False) -> Column:
    """T3. NFKC, runs of white space as one blank, case folded, the first MATCH_WINDOW code points."""
    plain = text if ascii_only else nfkc(text)
    one = F.regexp_replace(plain, rf"{SPACE}+", " ")
    return F.substring(F.lower(one) if ascii_only else casefold(one), 1, MATCH_WINDOW)


def sanitize_component(value: Column, ascii_only: bool = False) -> Column:
    """T13. A value as one safe component of a file name; null and what has nothing left are ''."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.regexp_replace(text if ascii_only else nfkc(text), r"\p{C}", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), "_{2,}", "_")
    edge = r"^[._\- ]+|[._\- ]+$"
    text = F.regexp_replace(F.substring(F.regexp_replace(text, edge, ""), 1, COMPONENT_LIMIT), edge, "")
    return F.when(F.lower(F.substring_index(text, ".", 1)).isin(RESERVED.split()), F.concat(F.lit("_"), text)).otherwise(text)


def confidence_of(text: Column) -> Column:
    """T17. Share of legible characters times how far the text reaches DENSE_AT, to 3 places."""
    bare = strip(F.coalesce(text, F.lit("")))
    bad = F.regexp_count(bare, F.lit(r"�|[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^\s\x1c-\x1f\x85\p{Z}]]"))
    legible = (F.length(bare) - bad) / F.length(bare)
    value = F.bround(legible * F.least(F.lit(1.0), F.length(bare) / F.lit(DENSE_AT)), 3)
    return F.when(F.length(bare) == 0, F.lit(0.0)).otherwise(value)


def strip_trailer(text: Column) -> Column:
    """T18. Without a last line ``Image labels: ...`` and white space at the end; possessive, so linear in the length."""
    body = F.regexp_replace(text, r"(?:\A|\n)[ \t]*+Image labels:[^\n]*+\s*+\z", "")
    return F.regexp_replace(body, rf"{SPACE}++\z", "")


def tokens(text: Column, ascii_only: bool = False) -> Column:
    """T22. Lower-case runs of letters, digits and private-use characters, without diacritics."""
    plain = F.coalesce(text, F.lit(""))
    folded = F.lower(plain) if ascii_only else F.lower(fold_marks(plain))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def normalise_rel_path(path: Column) -> Column:
    """T23. Forward slashes, no leading ``./`` or ``/``."""
    return F.regexp_replace(strip(F.translate(path, "\\", "/")), r"^(\./|/)+", "")


def normalise_verdict(verdict: Column) -> Column:
    """T24. Stripped, lower case, ``_`` for ``-``."""
    return F.translate(F.lower(strip(verdict)), "-", "_")


def clean_field(value: Column) -> Column:
    """T25. Stripped; empty is null."""
    bare = strip(value)
    return F.when(F.length(bare) > 0, bare)


def iso_gate(value: Column) -> Column:
    """T25. A field that has the shape of an ISO date, else null."""
    bare = clean_field(value)
    return F.when(bare.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), bare)

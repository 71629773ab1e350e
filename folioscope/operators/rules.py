"""Ordered rules over text: configuration, matching, dates and details."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import dates, text

DETAIL_LIMIT = 80


class ConfigError(ValueError):
    """A configuration that is not what it should be; the message names the key."""


@dataclass(frozen=True)
class Rule:
    """One rule.  A rule without ``all``, ``any`` and ``regex`` matches nothing."""

    id: str
    party: str | None = None
    doc_type: str | None = None
    detail: str | None = None
    folder: str | None = None
    tags: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    regex: str | None = None
    priority: int = 0
    date_regex: str | None = None
    date: str | None = None
    detail_regex: str | None = None


@dataclass(frozen=True)
class Taxonomy:
    """Rules in the order in which they are tried - priority falling, then id - and names of parties."""

    rules: tuple[Rule, ...] = ()
    parties: dict[str, str] = field(default_factory=dict)
    date_order: str = "dmy"

    @staticmethod
    def of(mapping: dict | None) -> Taxonomy:
        mapping = mapping or {}
        if not isinstance(mapping, dict):
            raise ConfigError("the taxonomy must be a table")
        rules: list[Rule] = []
        for k, raw in enumerate(_list(mapping, "rule", dict)):
            where = f"rule[{k}]"
            if not isinstance(raw.get("id"), str) or not raw["id"].strip():
                raise ConfigError(f"{where}.id must be a string")
            unknown = set(raw) - set(Rule.__dataclass_fields__)
            if unknown:
                raise ConfigError(f"{where}: unknown key {sorted(unknown)[0]}")
            values: dict = {}
            for key, value in raw.items():
                if key in ("tags", "all", "any", "none"):
                    values[key] = tuple(_list(raw, key, str, where))
                elif key == "priority":
                    if isinstance(value, bool) or not isinstance(value, int):
                        raise ConfigError(f"{where}.priority must be an integer")
                    values[key] = value
                elif not isinstance(value, str):
                    raise ConfigError(f"{where}.{key} must be a string")
                else:
                    values[key] = value
            if values.get("date") not in (None, "first", "last"):
                raise ConfigError(f"{where}.date must be first or last")
            if values.get("folder") and not safe_folder(values["folder"]):
                raise ConfigError(f"{where}.folder leaves the root")
            rules.append(Rule(**values))
        if len({r.id for r in rules}) < len(rules):
            raise ConfigError("rule ids must differ")
        order = mapping.get("date_order", "dmy")
        if order not in ("dmy", "mdy"):
            raise ConfigError("date_order must be dmy or mdy")
        parties = {}
        for key, party in (mapping.get("party") or {}).items():
            if not isinstance(party, dict):
                raise ConfigError(f"party.{key} must be a table")
            parties[key] = party.get("display") or key
        return Taxonomy(tuple(sorted(rules, key=lambda r: (-r.priority, r.id))), parties, order)

    @staticmethod
    def load(path: str) -> Taxonomy:
        """From a TOML file; a file that is not there is an empty taxonomy."""
        try:
            with open(path, "rb") as f:
                return Taxonomy.of(tomllib.load(f))
        except FileNotFoundError:
            return Taxonomy()
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from e


def _list(mapping: dict, key: str, kind: type, where: str = "") -> list:
    value = mapping.get(key, [])
    if not isinstance(value, list) or not all(isinstance(x, kind) for x in value):
        raise ConfigError(f"{where}.{key}".strip(".") + " must be a list")
    return value


def safe_folder(path: str) -> bool:
    """P9. Whether a folder stays below the root: relative, no drive, no ``..``."""
    parts = path.replace("\\", "/").split("/")
    return not path.startswith(("/", "\\")) and ":" not in parts[0] and ".." not in parts


class Literals:
    """T4. The words of all rules in one automaton, and which rules a text's words leave possible: all of ``all``, one of ``any``, none of ``none``."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.words: dict[str, int] = {}
        number = lambda term: self.words.setdefault(term.casefold(), len(self.words))
        self.rules = [(frozenset(map(number, r.all)), frozenset(map(number, r.any)), frozenset(map(number, r.none))) for r in rules]
        self.always = {k for w, k in self.words.items() if not w}  # every text has the empty word
        self.asking: dict[int, list[int]] = {}  # rules by one of the words that each cannot do without
        self.open: list[int] = []
        for k, (r, (all_, any_, _)) in enumerate(zip(rules, self.rules, strict=True)):
            if not (r.all or r.any or r.regex):
                continue
            for w in [min(all_)] if all_ else any_:
                self.asking.setdefault(w, []).append(k)
            if not all_ and not any_:
                self.open.append(k)
        self.automaton = ahocorasick.Automaton()
        for w, k in self.words.items():
            if w:
                self.automaton.add_word(w, k)
        if len(self.automaton):
            self.automaton.make_automaton()

    def possible(self, text: str) -> list[int]:
        """Rules whose words allow them, in order."""
        found = self.always | ({k for _, k in self.automaton.iter(text)} if len(self.automaton) else set())
        asked = {k for w in found for k in self.asking.get(w, ())}.union(self.open)
        return [k for k in sorted(asked) if self.rules[k][0] <= found and (not self.rules[k][1] or self.rules[k][1] & found) and not self.rules[k][2] & found]


_literals: dict[tuple[Rule, ...], Literals] = {}


def _possible(taxonomy: Taxonomy, haystack: Column) -> Column:
    """Places of the rules whose words a normalised text has: one pass over the text for the words of all rules."""
    rules = taxonomy.rules

    @F.arrow_udf("array<int>")
    def possible(texts: pa.Array) -> pa.Array:
        if rules not in _literals:
            _literals.clear()
            _literals[rules] = Literals(rules)
        own = _literals[rules]
        return pa.array([None if t is None else own.possible(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return possible(haystack)


def match_rule(taxonomy: Taxonomy, body: Column, ascii_only: bool = False) -> Column:
    """J12, W2. Struct of the first rule that matches: rule_id, party (display name), doc_type, detail, folder, tags; or null.

    An automaton tells which rules' words a text has, however many rules there are; the
    expressions of those that have one are tried on what is left.
    """
    if not taxonomy.rules:
        return F.lit(None)

    def value(rule: Rule) -> Column:
        party = taxonomy.parties.get(rule.party, rule.party) if rule.party else None
        plain = {"rule_id": rule.id, "party": party, "doc_type": rule.doc_type, "detail": rule.detail, "folder": rule.folder}
        tags = F.array(*map(F.lit, rule.tags)).cast("array<string>")
        return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in plain.items()], tags.alias("tags"))

    haystack = text.normalize_text(body, ascii_only)
    found = _possible(taxonomy, haystack)
    patterns = {k: "(?iU)" + r.regex.replace(r"\Z", r"\z") for k, r in enumerate(taxonomy.rules) if r.regex}
    if patterns:
        # normalised once, whatever the number of expressions
        def fits(k: Column, t: Column) -> Column:
            test = F.lit(True)
            for place, pattern in patterns.items():
                test = F.when(k == place, t.rlike(pattern)).otherwise(test)
            return test

        found = F.get(F.transform(F.array(F.struct(found.alias("found"), haystack.alias("text"))), lambda x: F.filter(x["found"], lambda k: fits(k, x["text"]))), F.lit(0))
    values = F.array(*map(value, taxonomy.rules))
    return F.get(F.transform(F.array(F.get(found, F.lit(0))), lambda k: F.when(k.isNotNull(), F.get(values, k))), F.lit(0))


def date_by_rule(taxonomy: Taxonomy, rule_id: Column, body: Column, current_year: int, ascii_only: bool = False) -> Column:
    """T11. (iso, source) by the rule of each row; without a rule the first date."""
    window = text.window(body, ascii_only)
    out = None
    special = [r for r in taxonomy.rules if r.date_regex or r.date]
    for rule in special:
        value = dates.date_for_rule(window, rule.date_regex, rule.date, taxonomy.date_order, current_year)
        out = F.when(rule_id == rule.id, value) if out is None else out.when(rule_id == rule.id, value)
    plain = dates.date_for_rule(window, None, None, taxonomy.date_order, current_year)
    return plain if out is None else out.otherwise(plain)


def usable_detail(capture: Column) -> Column:
    """A capture fit for a name: stripped, with a letter or digit, at most DETAIL_LIMIT long; else null."""
    bare = text.strip(capture)
    return F.when(bare.rlike("[A-Za-z0-9]"), F.substring(bare, 1, DETAIL_LIMIT))


def detail_for_rule(rule: Rule, body: Column, ascii_only: bool = False) -> Column:
    """T12. (detail, source): the first usable capture of the rule's expression, else its own detail, else null."""
    static = F.struct(F.lit(rule.detail).alias("detail"), F.lit("rule").alias("source")) if rule.detail else F.lit(None)
    if not rule.detail_regex:
        return static
    captures = F.regexp_extract_all(text.window(body, ascii_only), F.lit("(?i)" + rule.detail_regex), F.lit(1))
    found = F.filter(F.transform(captures, usable_detail), lambda c: c.isNotNull())
    return F.when(F.size(found) > 0, F.struct(F.get(found, F.lit(0)).alias("detail"), F.lit("rule-regex").alias("source"))).otherwise(static)


def detail_by_rule(taxonomy: Taxonomy, rule_id: Column, body: Column, ascii_only: bool = False) -> Column:
    """T12 by the rule of each row."""
    out = None
    for rule in taxonomy.rules:
        if rule.detail or rule.detail_regex:
            value = detail_for_rule(rule, body, ascii_only)
            out = F.when(rule_id == rule.id, value) if out is None else out.when(rule_id == rule.id, value)
    return F.lit(None) if out is None else out

"""Quality rules whose thresholds bound the risk of rejecting good documents.

Each rule rejects documents beyond a cutoff of one statistic.  Cutoffs are chosen
per stratum (language) on labelled documents that pass the base rule:

* A fixed share of the good ones, by hash of the id, and the bad ones lay out a path:
  from no rejections on, one cutoff of one rule becomes a grid step stricter each time,
  first where fewest good and then where most bad documents are rejected.
* The other good ones test the path in its order.  A step holds if the rate at which
  all rules together reject good documents is bounded by ``risk`` with an exact
  (Clopper-Pearson) binomial bound at level ``delta`` over strata; the first step that
  does not hold ends the path.  The path does not depend on the documents that test it,
  so its steps need no further correction (fixed-sequence testing).
* Equal texts of a stratum are one trial, bad if any of them is: copies are not
  independent, and would make a bound look surer than it is.
* Strata with too few labels for any step are tested together, with one path.  If they
  are too few even so, nothing is rejected there; likewise where no good label is.

With probability 1 - ``delta`` all the bounds hold together: in every stratum that is
``guaranteed``, and in the strata tested together as a whole, at most ``risk`` of good
documents are rejected.  No single one of the latter has that guarantee, which the
column ``guaranteed`` tells.

A map over whole texts computes the statistics (hashes of words and lines by numpy);
counts for the thresholds are one aggregate over all labelled documents, of no more
values than strata that have labels and combinations of grid steps.

Null and empty texts have no words and fail the base rule; a null language is a
stratum; documents without a label are judged, not used; conflicting labels of a
document count as bad; repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.llm.scratch import materialize, unused
from folioscope.llm.words import Text, distinct, slices

#: Statistics: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Rules (name, statistic, side on which it rejects) and the grid of cutoffs of each.
RULES = (
    ("symbols_per_word", "n_symbols / n_words", ">", (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0)),
    ("repeat_share", "n_repeat_words / n_words", ">", (0.01, 0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18)),
    ("dup_lines_per_100_words", "100 * n_dup_lines / n_words", ">", (0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0)),
    ("chars_per_word_low", "word_chars / n_words", "<", (1.5, 2.0, 2.5, 3.0, 3.5, 4.0)),
    ("chars_per_word_high", "word_chars / n_words", ">", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0)),
)
RISK, DELTA = 0.02, 0.05
#: One of so many labelled good documents lays out the path; the others test it.
PATH_PART = 5


def statistics(text: Text) -> list[np.ndarray]:
    """The five counts of each document of a slice."""
    line_doc, line_hash, solid = text.lines()
    line_doc, line_hash = line_doc[solid > 0], line_hash[solid > 0]
    own, _, _ = distinct(line_doc, line_hash)
    dup_lines = np.bincount(line_doc, minlength=text.n) - np.bincount(own, minlength=text.n)
    doc, at, key = text.shingles()
    order = np.lexsort((key, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = at[order[again]]
    edge = np.zeros(len(text.starts) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    covered = np.cumsum(edge[:-1]) > 0
    repeat = np.bincount(text.doc[covered], minlength=text.n)
    return [text.counts, text.word_chars(), text.symbols(), dup_lines, repeat]


def measure(docs: DataFrame, text_col: str, keep: list[str], digest: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs``, the text's digest under the name ``digest`` where asked, and the five counts."""
    held = unused("text__", keep)
    rows = docs.select(*[docs[c] for c in keep], *([F.md5(docs[text_col].cast("binary")).alias(digest)] if digest else []), docs[text_col].alias(held))
    keep = rows.columns[:-1]
    schema = StructType(rows.drop(held).schema.fields + StructType.fromDDL(COUNTS).fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [statistics(t) for _, _, t in slices(batch.column(len(keep)))]
            counts = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + counts, names=names)

    return rows.mapInArrow(run, schema)


def upper_bound(rejected: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which at most ``rejected`` of ``n`` has probability ``level``."""
    if n == 0 or rejected >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(rejected + 1)]

    def tail(p: float) -> float:
        x = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)]
        top = max(x)
        return math.exp(top) * sum(math.exp(v - top) for v in x)

    lo, hi = rejected / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid < 1 and tail(mid) > level else (lo, mid)
    return hi


def holds(rejected: int, n: int, level: float, risk: float) -> bool:
    """Whether ``upper_bound`` is at most ``risk``: whether so few rejections have probability ``level`` at most at that rate.

    The sum runs from its largest term down and ends where terms no longer count.
    """
    if n == 0 or rejected >= risk * n:
        return False
    k, term, total = rejected, 1.0, 0.0
    while k >= 0 and term > 1e-18 * total:
        total += term
        term *= k / (n - k + 1) * (1 - risk) / risk
        k -= 1
    first = math.lgamma(n + 1) - math.lgamma(rejected + 1) - math.lgamma(n - rejected + 1) + rejected * math.log(risk) + (n - rejected) * math.log1p(-risk)
    return first + math.log(total) <= math.log(level)


def _rejects(statistic: str, side: str, cutoff: float):
    return F.expr(f"n_words > 0 AND try_divide(1.0D * ({statistic.split('/')[0]}), n_words) {side} {cutoff}D")


def _rejected(levels: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Which rows of levels (cutoffs of each rule that reject, of its whole grid) are rejected at so many steps from the loosest."""
    return (levels + steps > np.array([len(r[3]) for r in RULES])).any(axis=1)


def path(good: np.ndarray, n_good: np.ndarray, bad: np.ndarray, n_bad: np.ndarray) -> Iterator[np.ndarray]:
    """Steps of all rules, ever stricter, by the levels of good and bad documents and how many have them; ends where no more bad ones are to be had."""
    now = np.zeros(len(RULES), np.int64)
    while True:
        options = []
        had = n_bad[_rejected(bad, now)].sum()
        for i, (_, _, _, grid) in enumerate(RULES):
            costs, gain = [], 0
            for k in range(now[i] + 1, len(grid) + 1):
                then = now.copy()
                then[i] = k
                costs.append(n_good[_rejected(good, then)].sum())
                if costs[-1] > costs[0] and gain:
                    break
                gain = max(gain, n_bad[_rejected(bad, then)].sum() - had)
            if gain:
                options.append((costs[0], -gain, i))
        if not options:
            return
        now[min(options)[2]] += 1
        yield now.copy()


def cutoffs(steps: np.ndarray) -> list[float | None]:
    """Cutoff of each rule, None at no step."""
    return [sorted(grid, reverse=side == ">")[k - 1] if k else None for (_, _, side, grid), k in zip(RULES, steps, strict=True)]


def chosen(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA, trial: str = "doc_id") -> tuple[dict[str | None, list[float | None]], set[str | None]]:
    """Cutoff of every rule, or None, for each stratum, and the strata whose own bound holds; all labelled documents that pass the base rule count.

    ``labels`` has (doc_id, quality); documents of one ``trial`` and stratum count once.
    Collected are counts for each stratum with labels and combination of levels.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).select(F.col("doc_id").alias("known__"), F.when(F.col("q") == 1, 1).otherwise(0).alias("good__"))
    held = measured.join(known, F.col("doc_id") == F.col("known__")).filter(~base_failed())
    levels = [sum((_rejects(s, side, c).cast("int") for c in grid), F.lit(0)).alias(f"l{i}") for i, (_, s, side, grid) in enumerate(RULES)]
    names = [f"l{i}" for i in range(len(RULES))]
    trials = held.select(F.col(stratum).alias("stratum"), F.col(trial).alias("trial"), "good__", *levels).groupBy("stratum", "trial", *names).agg(F.min("good__").alias("good__"))
    part = F.when(F.col("good__") == 0, "bad").when(F.pmod(F.xxhash64("trial"), F.lit(PATH_PART)) == 0, "path").otherwise("test").alias("part")
    rows = trials.select("stratum", part, *names).groupBy("stratum", "part", *names).count().collect()
    counts: dict[str | None, dict[str, list[tuple]]] = {}
    for row in rows:
        counts.setdefault(row["stratum"], {"bad": [], "path": [], "test": []})[row["part"]].append((*row[2:-1], row[-1]))
    counts = {s: x for s, x in counts.items() if x["path"] or x["test"]}
    level = delta / max(1, len(counts))
    few = [s for s, x in counts.items() if not holds(0, sum(c[-1] for c in x["test"]), level, risk)]
    out: dict[str | None, list[float | None]] = {}
    for names in [[s] for s in counts if s not in few] + ([few] if few else []):
        part_ = {k: [c for s in names for c in counts[s][k]] for k in ("bad", "path", "test")}
        # without bad documents of its own, a stratum takes its path by those of all
        part_["bad"] = part_["bad"] or [(*row[2:-1], row[-1]) for row in rows if row["part"] == "bad"]
        (bad, n_bad), (good, n_good), (test, n_test) = ((np.array([c[:-1] for c in part_[k]], np.int64).reshape(-1, len(RULES)), np.array([c[-1] for c in part_[k]], np.int64)) for k in ("bad", "path", "test"))
        last = np.zeros(len(RULES), np.int64)
        for steps in path(good, n_good, bad, n_bad):
            if not holds(int(n_test[_rejected(test, steps)].sum()), int(n_test.sum()), level, risk):
                break
            last = steps
        out |= {s: cutoffs(last) for s in names}
    return out, set(counts) - set(few)


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA, trial: str = "doc_id") -> dict[str | None, list[float | None]]:
    """The cutoffs of ``chosen``."""
    return chosen(measured, labels, stratum, risk, delta, trial)[0]


def base_failed():
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the stratum, the five counts, base_failed, rule (first that rejects, or null), kept, guaranteed (whether the stratum's own bound holds)."""
    measured = materialize(measure(docs, text_col, ["doc_id", stratum], "digest__"), "quality-counts")
    cut, sure = chosen(measured, labels, stratum, risk, delta, "digest__")
    rule = F.lit(None).cast("string")
    for i in reversed(range(len(RULES))):
        name, statistic, side, grid = RULES[i]
        for c in sorted({x[i] for x in cut.values() if x[i] is not None}):
            names = [s for s, x in cut.items() if x[i] == c]
            inside = F.col(stratum).isin([s for s in names if s is not None]) & F.col(stratum).isNotNull()
            inside = inside | F.col(stratum).isNull() if None in names else inside
            rule = F.when(inside & _rejects(statistic, side, c), F.lit(name)).otherwise(rule)
    out = measured.drop("digest__").withColumn("base_failed", base_failed()).withColumn("rule", rule)
    named = F.col(stratum).isin([s for s in sure if s is not None]) & F.col(stratum).isNotNull()
    named = named | F.col(stratum).isNull() if None in sure else named
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).withColumn("guaranteed", named)

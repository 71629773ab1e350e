"""Cutoffs of the quality rules on small strata."""

from folioscope.llm import quality_rules


def measured(spark, strata):
    """Documents and labels of (stratum, good, good with symbols, bad); bad ones have a symbol for each word."""
    docs, labels = [], []
    for name, good, odd, bad in strata:
        for k in range(good + bad):
            symbols = 100 if k >= good or k < odd else 0
            docs.append((f"{name}-{k}", name, 100, 500, symbols, 0, 0))
            labels.append((f"{name}-{k}", int(k < good)))
    return spark.createDataFrame(docs, f"doc_id string, lang string, {quality_rules.COUNTS}"), spark.createDataFrame(labels, "doc_id string, quality int")


def test_small_strata_reject_bad_documents(spark):
    docs, labels = measured(spark, [("de", 400, 0, 40), ("fr", 400, 0, 0), ("it", 130, 0, 9), ("pt", 140, 0, 9), ("xx", 400, 40, 40)])
    cut = quality_rules.thresholds(docs, labels, "lang")
    # below 1.0, one in ten good documents of xx would go; it and pt are too few even together; fr has no bad ones of its own
    assert {s: c[0] for s, c in cut.items()} == {"de": 0.75, "fr": 0.75, "it": None, "pt": None, "xx": 1.0}
    docs, labels = measured(spark, [("de", 400, 0, 40), ("it", 160, 0, 9), ("pt", 170, 0, 9)])
    assert {s: c[0] for s, c in quality_rules.thresholds(docs, labels, "lang").items()} == {"de": 0.75, "it": 0.75, "pt": 0.75}


def test_no_labels(spark):
    docs, labels = measured(spark, [("de", 20, 0, 2)])
    assert quality_rules.thresholds(docs, labels.filter("false"), "lang") == {}
    assert quality_rules.thresholds(docs, labels, "lang") == {"de": [None] * 5}


def by_a_loop(docs, labels, risk=quality_rules.RISK, delta=quality_rules.DELTA, trial=lambda d: d.doc_id, part=None):
    """Cutoffs by walking the path of every stratum with plain sums; the bound by summing the binomial distribution."""
    import math

    quality = {}
    for r in labels:
        quality[r.doc_id] = min(quality.get(r.doc_id, 1), r.quality)
    value = {"symbols_per_word": lambda d: d.n_symbols / d.n_words, "repeat_share": lambda d: d.n_repeat_words / d.n_words, "dup_lines_per_100_words": lambda d: 100 * d.n_dup_lines / d.n_words}
    value |= dict.fromkeys(["chars_per_word_low", "chars_per_word_high"], lambda d: d.word_chars / d.n_words)
    trials = {}
    for d in docs:
        if d.doc_id in quality and d.n_words >= 10 and 100 * d.n_repeat_words <= 20 * d.n_words:
            key = (d.lang, trial(d))
            trials[key] = (d, min(quality[d.doc_id], trials.get(key, (d, 1))[1]))

    def rejected(d, steps):
        for (name, _, side, grid), k in zip(quality_rules.RULES, steps, strict=True):
            cuts = sorted(grid, reverse=side == ">")[:k]
            if cuts and (value[name](d) > cuts[-1] if side == ">" else value[name](d) < cuts[-1]):
                return True
        return False

    def sure(bad, n, level):
        return n > 0 and bad < risk * n and sum(math.comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(bad + 1)) <= level

    groups = {}
    for (lang, t), (d, good) in trials.items():
        groups.setdefault(lang, {"bad": [], "path": [], "test": []})["bad" if not good else "path" if part(t) else "test"].append(d)
    every = [d for g in groups.values() for d in g["bad"]]
    groups = {s: g for s, g in groups.items() if g["path"] or g["test"]}
    level = delta / max(1, len(groups))
    alone = [s for s, g in groups.items() if sure(0, len(g["test"]), level)]
    out = {}
    for names in [[s] for s in alone] + [[s for s in groups if s not in alone]]:
        bad, path, test = ([d for s in names for d in groups[s][k]] for k in ("bad", "path", "test"))
        bad, steps, best = bad or every, [0] * len(quality_rules.RULES), [0] * len(quality_rules.RULES)
        count = lambda rows, at: sum(rejected(d, at) for d in rows)
        while True:
            options = []
            for i, (_, _, _, grid) in enumerate(quality_rules.RULES):
                at = lambda k, i=i: [*steps[:i], k, *steps[i + 1 :]]
                later = range(steps[i] + 1, len(grid) + 1)
                cost = [count(path, at(k)) for k in later]
                if not cost:
                    continue
                gains = [count(bad, at(k)) - count(bad, steps) for k in later]
                upto = next((j for j in range(len(cost)) if cost[j] > cost[0] and max(gains[:j], default=0)), len(cost))
                if max(gains[:upto], default=0):
                    options.append((cost[0], -max(gains[:upto]), i))
            if not options:
                break
            steps[min(options)[2]] += 1
            if not sure(count(test, steps), len(test), level):
                break
            best = list(steps)
        out |= dict.fromkeys(names, quality_rules.cutoffs(best))
    return out, set(alone)


def test_cutoffs_against_a_loop(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(12)
    docs, labels = [], []
    for lang, n in (("de", 420), ("en", 700), ("it", 90), (None, 120), ("nl", 3)):
        for k in range(n):
            bad = rng.random() < 0.15
            words = rng.choice([5, 80, 200, 333])
            docs.append((f"{lang}{k}", lang, words, int(words * rng.uniform(3.2, 9.5)), int(words * rng.random() ** (1 if bad else 6)), rng.randint(0, 6) * bad, int(words * rng.random() * (0.25 if bad else 0.05)), f"{lang}{k % (n - 20 if n > 20 else n)}"))
            labels += [(f"{lang}{k}", int(not bad))] * rng.choice([0, 1, 1, 1, 2])
    rows = {d[7]: d for d in docs}
    docs = [(d[0], d[1], *rows[d[7]][2:]) for d in docs]  # those of one text have its counts
    table = spark.createDataFrame(docs, f"doc_id string, lang string, {quality_rules.COUNTS}, digest string")
    said = spark.createDataFrame(labels, "doc_id string, quality int")
    paths = {r.digest for r in table.filter(F.pmod(F.xxhash64("digest"), F.lit(quality_rules.PATH_PART)) == 0).collect()}
    expect = by_a_loop(table.collect(), said.collect(), trial=lambda d: d.digest, part=paths.__contains__)
    assert quality_rules.chosen(table, said, "lang", trial="digest") == expect
    assert expect[1] and expect[1] != set(expect[0]) and any(any(c) for c in expect[0].values())


def test_copies_are_one_trial(spark):
    good = [(k, " ".join(f"word{k}x{j}" for j in range(40)), "en") for k in range(12) for _ in range(100)]
    docs = [(1000 + k, text, lang) for k, (_, text, lang) in enumerate(good)] + [(1, "# " * 40, "en")]
    labels = spark.createDataFrame([(d[0], int(d[0] >= 1000)) for d in docs], "doc_id long, quality int")
    judged = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).collect()
    assert all(r.rule is None and not r.guaranteed for r in judged)  # twelve texts bound nothing

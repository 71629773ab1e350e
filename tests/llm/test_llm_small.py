"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing names and no rows."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import bpe, embed_dedup, html_extract, minhash, mixing, quality_classifier, quality_rules, scratch, sharding, substring_dedup, url_filter, words

SCHEMA = "doc_id long, text string, lang string, source string, size int, kept string, KEY string"


def rows(*texts, source="s"):
    return [(k, t, "en", source, 1, "x", "y") for k, t in enumerate(texts)]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "one", "one", "one two three", prose(rng, 20_000), "same " * 400]
    base = prose(rng, 120)
    passage = prose(rng, 60)
    texts += [base, base, base.replace(base.split()[60], "edited", 1), base + " tail"]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(3)]
    texts += [prose(rng, rng.randint(5, 80)) for _ in range(40)]
    out = [(k, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], 1, "x", "y") for k, t in enumerate(texts)]
    return out + [out[8], (None, "no id " * 8, "en", "a", 1, "x", "y")]


# 1


def test_mix(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    found = mixing.schedule(docs).collect()
    assert len(found) == len(corpus)
    sizes, taken, target, biggest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in found:
        assert r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        sizes[r.source_size] += r["size"]
        taken[r.target] += r.taken
        biggest[r.target] = max(biggest[r.target], r["size"])
        target[r.source_size] = r.target
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for t in taken:
        assert abs(taken[t] - t) <= 2 * biggest[t] + 1
    again = mixing.schedule(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in found)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = collections.Counter({str(r.doc_id): 0 for r in mixing.schedule(docs).collect()})
    for r in mixing.schedule(docs).collect():
        want[str(r.doc_id)] += r.copies
    assert collections.Counter(str(r.doc_id) for r in mixed.collect()) == +want
    assert mixing.schedule(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_targets_against_a_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        sizes = [(f"s{k:02d}", rng.choice([0, 1, 50, 400, 5000])) for k in range(9)] + [(None, 30)]
        cap = [3 * n for _, n in sizes]
        w = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
        total, fixed = sum(n for _, n in sizes), set()
        while True:
            left, weight = total - sum(cap[k] for k in fixed), sum(w[k] for k in range(len(w)) if k not in fixed)
            new = {k for k in range(len(w)) if k not in fixed and left * w[k] / weight > cap[k]}
            if not new:
                break
            fixed |= new
        want = [cap[k] if k in fixed else left * w[k] / weight for k in range(len(w))]
        df = spark.createDataFrame([(str(s), s, n) for s, n in sizes], "key string, source string, source_size long")
        got = {r.key: r.target for r in mixing.targets(df).collect()}
        assert [got[str(s)] for s, _ in sizes] == pytest.approx(want)


def test_mix_null_and_hot_ids(spark):
    """Documents of no id or one id are told apart and spread; further columns stay, whatever their names."""
    rows = [(None, f"word {k} of {k % 7} many", "a", k, k) for k in range(400)] + [(5, "copy of it", "b", 1, 1)] * 300 + [(6, None, "c", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row__ int, key__ int")
    plan = mixing.schedule(docs.select("doc_id", "text", "source"))
    assert plan.count() == len(rows)
    got = collections.Counter(mixing.mix(docs).collect())
    taken = {"a": 0, "b": 0}
    for r, n in got.items():
        assert tuple(r) in rows and r.text is not None
        taken[r.source] += n * len(r.text.split())
    goal = {r.target for r in plan.select("target").distinct().collect()}
    assert all(min(abs(t - g) for g in goal) <= 10 for t in taken.values())


def test_numbered(spark):
    counted = spark.createDataFrame([("a", 10), ("b", 1), ("c", 4)], "k string, same long")
    for span in (3, 1 << 16):
        got = sorted((r.k, r.n) for r in scratch.numbered(counted, "same", "n", span).collect())
        assert got == [("a", k) for k in range(1, 11)] + [("b", 1)] + [("c", k) for k in range(1, 5)]


# 2


def test_shards(spark, corpus, tmp_path):
    import zlib

    docs = spark.createDataFrame(corpus, SCHEMA)
    found = sharding.place(docs, 7).collect()
    assert len(found) == len(corpus)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((str(k), len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for k, t, *_ in corpus)
    assert collections.Counter((str(r.doc_id), r["size"], r.text_crc32) for r in found) == want
    key = lambda x: sorted((str(r.doc_id), r.shard, r.slot) for r in x)
    assert key(sharding.place(docs.repartition(5), 7).collect()) == key(found)
    sharding.write(docs, str(tmp_path / "out"), 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(corpus)
    odd = docs.withColumnsRenamed({"lang": "row__", "source": "shard"}).union(docs.limit(3))
    sharding.write(odd, str(tmp_path / "odd"), 3)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert back.columns == [*odd.columns, "shard_"]
    assert collections.Counter(map(str, back.drop("shard_").collect())) == collections.Counter(map(str, odd.collect()))
    assert sharding.place(docs.limit(0), 7).count() == 0


def test_shards_hot_key(spark):
    docs = spark.createDataFrame([(5, "copy")] * 3000 + [(k, "x") for k in range(10)], "doc_id long, text string")
    shards = collections.Counter(r.shard for r in sharding.place(docs, 10).filter("doc_id = 5").collect())
    assert len(shards) == 10 and min(shards.values()) > 200


# 3


def _shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_minhash_against_all_pairs(spark, corpus):
    rng = random.Random(9)
    more, base = list(corpus), prose(rng, 200).split()
    for k in range(40):  # a group of near copies around one text
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(200)] = "new" + str(rng.randrange(10**6))
        more.append((1000 + k, " ".join(copy), "en", "a", 1, "x", "y"))
    docs = spark.createDataFrame(more, SCHEMA)
    found = minhash.classes(docs).collect()
    assert len(found) == len(more)
    of = {(r.doc_id, bytes(r.key)): r.class_id for r in found}
    assert len(of) == len({(k, t) for k, t, *_ in more})
    import hashlib

    key = lambda t: b"\0" if t is None else hashlib.md5(t.encode()).digest()
    for i, (a, t, *_) in enumerate(more):
        for b, u, *_ in more[i + 1 :]:
            x, y = _shingles(t), _shingles(u)
            same = t == u
            like = len(x & y) / max(1, len(x | y))
            joined = of[(a, key(t))] == of[(b, key(u))]
            if same or like >= 0.88:
                assert joined, (a, b, like)
            if like < 0.2 and not same and not (x and y):
                assert not joined, (a, b)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({r.class_id for r in found}) and ids.count(8) == 1
    assert minhash.classes(docs.limit(0)).count() == 0


def test_weighted_similarity():
    weights = np.ones(minhash.SLOTS, np.float32)
    text = "a b c d e f g h"
    assert minhash.similarity(text.encode(), text.encode(), weights) == 1
    assert minhash.similarity(b"", b"", weights) == 0
    x, y = _shingles(text), _shingles(text + " i")
    assert minhash.similarity(text.encode(), (text + " i").encode(), weights) == pytest.approx(len(x & y) / len(x | y))


def test_sampler_agrees_as_often_as_texts_are_alike():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    hits = []
    for seed in range(20):
        w = rng.random(300) + 0.5
        v = np.where(np.arange(300) < 240, w, 0)
        s = minhash.Sampler(seed)
        a = s.sample(np.zeros(300, int), np.sort(keys), w, 1)
        b = s.sample(np.zeros(240, int), np.sort(keys)[:240], v[:240], 1)
        hits.append(((a == b).mean(), v.sum() / w.sum()))
    assert abs(np.mean([h - j for h, j in hits])) < 0.04


# 4

URLS = [None, "no scheme", "http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/1?x", "http://example.net/EN/", "http://notexample.net/en/", "http://x.example.com/de/", "http://example.com/dex", "ftp://b.org/fr/#t", "a://b://c.net/x", "http://ünï.example.com/de/1", "http://a b.net/en", "http://example.net#en/"]


def test_urls(spark):
    rules = [url_filter.parse(r) for r in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")]
    data = [(k, u, "z", "z") for k, u in enumerate(URLS)] + [(3, "http://a.net/", "z", "z")] * 3
    pages = spark.createDataFrame(data, "page_id long, url string, rule string, host string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_pages(pages, rules).collect())

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    assert got == collections.Counter((k, *judge(u)) for k, u, *_ in data)
    assert url_filter.filter_pages(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_pages(pages, []).collect()} == {"allow"}


# 5


def links_by_a_loop(x):
    """(links, component, kept) of each vector by all pairs."""
    ok = [v is not None and None not in v and bool(np.isfinite(v).all()) and any(v) for v in x]
    link = collections.defaultdict(set)
    for size in {len(v) for v, o in zip(x, ok, strict=True) if o}:
        at = [k for k in range(len(x)) if ok[k] and len(x[k]) == size]
        u = np.array([x[k] for k in at], float)
        u /= np.sqrt((u * u).sum(axis=1))[:, None]
        for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True):
            if i != j:
                link[at[i]].add(at[j])
    out = {}
    for a in range(len(x)):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (len(link[a]), min(seen), min(seen) == a)
    return out


@pytest.mark.parametrize("centres", [4096, 25])
@pytest.mark.parametrize("block_rows", [50, 4096])
def test_vectors(spark, monkeypatch, centres, block_rows):
    monkeypatch.setattr(embed_dedup, "CENTRES", centres)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    x = [(v + rng.normal(size=8) * s).tolist() for v in base for s in (0, 0.05, 0.2, 0.4)]
    x += [x[0]] * 50 + [(np.array(x[0]) * 3).tolist(), [0.0] * 8, None, [float("nan")] * 8, [1.0, 2.0], [1.0, 2.1], [float("inf")] * 8, [None] * 8]
    x += [(base[1] + rng.normal(size=8) * 0.02).tolist() for _ in range(160)]  # one dense group, larger than a block
    x += [(base[k % 5] + rng.normal(size=8) * 0.3).tolist() for k in range(150)]
    df = spark.createDataFrame([(k, v, 7) for k, v in enumerate(x)], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, block_rows=block_rows).collect()}
    assert got == links_by_a_loop(x)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_one_id(spark):
    x = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [0.0, 2.0]), (None, [-1.0, 0.0]), (1, [1.0, 0.0]), (1, None)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == collections.Counter(
        [(1, 1, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (1, 0, 1, True)]
    )


def test_clusters_are_not_sent(spark):
    """What the pairs of blocks read grows with the vectors where these lie in clusters."""
    rng = np.random.default_rng(4)
    sent = []
    for n in (2000, 8000):
        base = rng.normal(size=(n // 100, 32))
        x = np.repeat(base, 100, axis=0) + rng.normal(size=(n, 32)) * 0.05
        rows = spark.createDataFrame([(k, 1, v.tolist(), 32) for k, v in enumerate(x)], "key long, weight long, x array<double>, dim int")
        held, cells = embed_dedup.cover(rows, {32: n}, np.sqrt(0.2), 256)
        sent.append(embed_dedup.meet(embed_dedup.send(held, cells, np.sqrt(0.2), 0.9), 256, np.sqrt(0.2) / 2).count() / n)
    assert sent[1] < 1.3 * sent[0] < 3


# 6

PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body class="x"><nav><a href=x>Menu</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>First  one<br><p>Two&nbsp;&lt;x&gt; <i>in</i>side</p><!-- no --><section class="comments"><p>reader</p></section><form>f</form></article><footer>&copy; x</footer>'


def test_html(spark):
    plain = "<div id=top>Same on all</div><div><p>Only %d here</p></div>"
    pages = [(k, f"http://h{k % 2}.x/{k}", PAGE) for k in range(4)] + [(10 + k, f"http://p.x/{k}", plain % k) for k in range(6)]
    pages += [(20, None, None), (21, "http://q.x/", ""), (22, "http://q.x/", "just text"), (23, "http://p.x/9", "<p>un<p>closed <b>tag"), (24, "x", "<" * 50 + "a b"), (25, "x", "<p a='" * 2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(df).collect()}
    want = "A & B\nFirst one\nTwo <x> inside"
    assert all(got[k] == (want, len(want)) for k in range(4))
    assert [got[10 + k][0] for k in range(6)] == [f"Only {k} here" for k in range(6)]
    assert got[20] == ("", 0) and got[21] == ("", 0) and got[22][0] == "just text" and got[23][0] == "un\nclosed tag"
    assert html_extract.main_text(df.limit(0)).count() == 0


# 7


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_counts_against_a_model(spark, corpus):
    extra = ["a b\na b\n\n\nc", "é中 x|y <z>\r\n a", "x y z u v x y z u v", "\x0b\x0c a\x1fb  c", "line\nline\nline", "a\n" * 5]
    data = corpus + [(500 + k, t, None, None, 1, "x", "y") for k, t in enumerate(extra)]
    df = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 3) for k in range(30)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, lang int")
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(df, labels).collect())
    assert got == collections.Counter((k, *counts(t)) for k, t, *_ in data)
    for r in quality_rules.judge(df, labels).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge(df.limit(0), labels).count() == 0 and quality_rules.judge(df, labels.limit(0)).count() == len(data)


def test_bound():
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality_rules.upper_bound(3, 50, 0.05) == pytest.approx(0.1478, abs=2e-3)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1 and quality_rules.upper_bound(0, 0, 0.05) == 1
    for n in (0, 1, 149, 150, 300, 4000):
        for rejected in range(0, min(n, 90) + 1, 3):
            for level in (0.0125, 0.05):
                assert quality_rules.holds(rejected, n, level, 0.02) == (quality_rules.upper_bound(rejected, n, level) <= 0.02), (rejected, n)
    assert quality_rules.holds(190_000, 10**7, 0.01, 0.02) and not quality_rules.holds(200_000, 10**7, 0.01, 0.02)


# 8


def test_passages(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA)
    out = substring_dedup.deduplicate(df, report=True).collect()
    assert len(out) == len(corpus)
    text, before = {(r.doc_id, k): r for k, r in enumerate(out)}, {k: t for k, t, *_ in corpus}
    by = {r.doc_id: r for r in text.values()}
    assert by[0].text is None and by[1].text == "" and by[2].text == " \n\t "
    assert by[8].text == before[8] and by[9].text == "" and by[12].text == before[12]
    for k in (13, 14):  # the passage goes but for what shares a chunk with the text around it
        assert 25 <= by[k].removed_words__ <= 75 and by[k].firsts__ == [12]
        assert by[k].text.startswith(before[k][:100]) and by[k].text.endswith(before[k][-100:])
    assert len(by[7].text) < 500
    for k in range(15, 55):
        assert by[k].text == before[k] and by[k].removed_words__ == 0
    for r in out:
        if r.removed__:
            old = before.get(r.doc_id)
            left, at = [], 0
            for a, b in r.removed__:
                left.append(old[at:a])
                at = b
            assert "".join([*left, old[at:]]) == r.text
    assert substring_dedup.deduplicate(df.limit(0)).count() == 0


def test_chunks_resist_shifts():
    rng = random.Random(5)
    body = prose(rng, 300)
    a = substring_dedup.chunks(words.text_of([body.encode()]))[3][0]
    b = substring_dedup.chunks(words.text_of([("some new words " + body).encode()]))[3][0]
    assert len(set(a.tolist()) & set(b.tolist())) >= len(a) - 2


# 9


def test_classifier(spark):
    rng = random.Random(8)
    data, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        text = prose(rng, rng.randint(20, 60))
        data.append((k, text.upper().replace(" ", "!! ") if bad else text, "en", rng.choice("ab"), 1, "x", "y"))
        if k < 300:
            labels.append((k, int(not bad), 0))
    data += [(None, None, None, None, 1, "x", "y"), (700, "", "en", "a", 1, "x", "y"), data[5]]
    df = spark.createDataFrame(data, SCHEMA)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.score(df, lab).collect()
    assert len(out) == len(data)
    held = [r for r in out if r.doc_id is not None and 300 <= r.doc_id < 600]
    assert sum(r.kept__ == (r.doc_id % 4 > 0) for r in held) / len(held) > 0.97
    kept = quality_classifier.score(df, lab, only_kept=True)
    assert kept.columns == df.columns and kept.count() == sum(r.kept__ for r in out)
    few = quality_classifier.score(df, lab, ids_only=True).collect()
    assert collections.Counter((r.doc_id, round(r.quality_score__, 9), r.kept__) for r in few) == collections.Counter((r.doc_id, round(r.quality_score__, 9), r.kept__) for r in out)
    assert quality_classifier.score(df, lab.limit(0)).filter("kept__").count() == len(data)
    assert quality_classifier.score(df.limit(0), lab).count() == 0
    odd = df.withColumnsRenamed({"size": "kept__", "KEY": "q", "kept": "id__"}).withColumn("quality_score__", F.lit("own"))
    found = quality_classifier.score(odd, lab)
    assert found.columns == [*odd.columns, "quality_score___", "kept___"] and found.filter("kept___").count() == kept.count()


def test_cotraining_helps(spark):
    """With few labels, what the views hand to each other makes up for words no label shows."""
    rng = random.Random(5)
    data, labels = [], []
    known = [[prose(rng, 1) for _ in range(300)] for _ in range(2)]  # words of good and of bad documents; labels show few of them
    for k in range(1500):
        bad = rng.random() < 0.5
        words_ = rng.sample(known[bad], 4) + [prose(rng, 1) for _ in range(16)]
        rng.shuffle(words_)
        data.append((k, " ".join(words_), "en", f"{'spam' if bad else 'site'}{rng.randrange(2)}", int(bad)))
        if k < 60:
            labels.append((k, int(not bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, truth int").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    feats = scratch.materialize(quality_classifier.features(df, "doc_id", "text", ["lang", "source"]), "t")
    rows = feats.orderBy("id").toArrow().to_batches()

    def right(model):
        p = np.concatenate([quality_classifier._probability(quality_classifier.odds(model, quality_classifier._batch_views(model, b), len(b))[0]) for b in rows])
        return np.mean([(x >= 0.5) == (d[4] == 0) for x, d in zip(p[60:], data[60:], strict=True)])

    alone, taught = (right(quality_classifier.fit(feats, lab, ["lang", "source"], rounds=n)) for n in (0, 3))
    assert taught > alone + 0.1, (alone, taught)


# 10


def test_bpe(spark, corpus):
    import hashlib

    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.default_path())
    texts = ["<|endoftext|>", "a<|endoftext|> b's DON'T we'll  \n x", "日本 ÀÉ ١٢ \u200b\u3000z", "a" * 3000, " " * 500 + "x", "\x00\x1c\x85"]
    data = corpus + [(800 + k, t, None, None, 1, "x", "y") for k, t in enumerate(texts)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, digests_only=True).collect()}
    want = set()
    for k, t, *_ in data:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False)
        want.add((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == want
    full = bpe.encode(df)
    assert {r.decoded for r in full.collect()} == {t or "" for _, t, *_ in data}
    assert bpe.encode(df.limit(0)).count() == 0


def test_bpe_random_texts():
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.load(bpe.default_path()))
    rng = random.Random(1)
    letters = " \n\t'abcdeghinorstlT<|endoftext|>éß中1234 \r"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert [x.tolist() for x in mine.encode_batch(texts)] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]

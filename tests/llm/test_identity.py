"""Texts that clash under weak hashes, and passages removed against a plain model."""

import datetime
import hashlib
import random
import re

from folioscope.llm import bpe, quality_rules, substring_dedup, words


def thue_morse(n, a="a", b="b"):
    """Two words of n letters that every polynomial modulo 2**64 confuses from 1,024 letters on."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_words_do_not_clash():
    for n in (1024, 2048):
        x, y = (s.encode() for s in thue_morse(n))
        found = words.text_of([x + b" " + y, x * 2, y * 2])
        assert len(set(found.word_hashes().tolist())) == 4
        assert len(set(found.hashes(found.starts, found.ends, 1).tolist())) == 4


def test_rules_tell_lines_apart(spark):
    x, y = thue_morse(1024)
    text = f"{x}\n{y}\n" + " ".join([x, y] * 8)
    docs = spark.createDataFrame([(1, text, "en"), (2, f"{x}\n{y}\n{x}", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got[1].n_dup_lines == 0 and got[2].n_dup_lines == 1 and got[1].n_repeat_words == 18


def test_bpe_tells_words_apart():
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.load(bpe.default_path()))
    texts = [*thue_morse(1024), *thue_morse(2048), "hello world"]
    for some in (texts[:2], texts, texts[::-1], texts[1:]):
        assert [x.tolist() for x in mine.encode_batch(some)] == [e.ids for e in theirs.encode_batch(some, add_special_tokens=False)]


def passages_by_a_loop(docs):
    """{(id, text): text without repeats} by dictionaries."""
    places = sorted({(k, t) for k, t in docs if t}, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(d[1].encode()).digest()))
    cut = {}
    for d in places:
        body = d[1].encode()
        _, begin, _, _ = substring_dedup.chunks(words.text_of([body]))
        ends = [*begin[1:].tolist(), len(body)]
        cut[d] = [body[a:b] for a, b in zip(begin.tolist(), ends, strict=False)] or [body]
    first = {}
    out = {}
    for d in places:
        keys = [c.strip(b" \t\n\v\f\r") for c in cut[d]]
        for k, c in enumerate(keys):
            first.setdefault(c, (d, k))
        repeated = [first[c] if first[c] != (d, k) and c else None for k, c in enumerate(keys)]
        gone, k = set(), 0
        while k < len(keys):
            if repeated[k] is None:
                k += 1
                continue
            end = k
            while end < len(keys) and repeated[end] is not None:
                end += 1
            groups = {}
            for j in range(k, end):
                origin, at = repeated[j]
                groups.setdefault((origin, "order", at - j), []).append(j)
                groups.setdefault((origin, "same", at), []).append(j)
            for hit in groups.values():
                if sum(len(re.findall(rb"[^\x20\x09-\x0D]+", cut[d][j])) for j in hit) >= substring_dedup.MIN_WORDS:
                    gone.update(range(hit[0], hit[-1] + 1))
            k = end
        out[d] = b"".join(c for j, c in enumerate(cut[d]) if j not in gone).decode()
    return out


def test_passages_against_a_loop(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdéfgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    known = [prose(rng.randint(20, 90)) for _ in range(12)]
    docs = []
    for k in range(300):
        parts = [prose(rng.randint(0, 60)) for _ in range(3)] + rng.sample(known, rng.randint(0, 3))
        rng.shuffle(parts)
        docs.append((rng.choice([None, k, k, 7]), rng.choice([" ", "\n", "\n\n"]).join(parts)))
    docs += [docs[3], docs[3], (900, None), (901, ""), (902, " \n"), (903, "word " * 300), (904, known[0]), (904, known[0] + " x"), (None, known[1]), (None, known[1]), *[(None, f"null {k} " + known[2]) for k in range(20)]]
    wanted = passages_by_a_loop(docs)
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(docs)], "doc_id long, text string, chunks__ int")
    got = substring_dedup.deduplicate(df.repartition(7), report=True)
    rows = got.collect()
    assert len(rows) == len(docs) and got.columns[:3] == df.columns
    changed = 0
    for r in rows:
        old = docs[r[2]]
        new = wanted.get(old, old[1])
        assert r.text == new, (old, new)
        changed += new != old[1]
        assert (r.removed_words__ > 0) == (new != old[1]) and r.removed_words__ == len((old[1] or "").split()) - len((new or "").split())
    assert changed > 100


def test_passages_with_clashing_names(spark):
    text = "a passage of quite some words " * 20
    names = "doc_id long, text string, id__ int, version__ int, chunks__ int, removed_words__ int, removed__ int, firsts__ int, own__ int, new__ int, n_chars int"
    df = spark.createDataFrame([(k, f"{text} {k}", *[k] * 9) for k in range(3)], names)
    found = substring_dedup.deduplicate(df, report=True)
    assert found.columns[:11] == df.columns and found.columns[11:] == ["removed_words___", "removed___", "firsts___"]
    assert all(r.id__ == r.removed_words__ == r.doc_id and r.n_chars == len(r.text) or r.doc_id == 0 for r in found.collect())


def test_rows_are_told_apart_by_nested_nulls(spark, tmp_path):
    from folioscope.llm import mixing, sharding

    kinds = "doc_id long, text string, source string, x array<int>, y struct<a: int, b: int>, z array<struct<t: timestamp, m: map<string, int>>>, ids_sha256 string"
    stamps = [datetime.datetime(2020, 1, 1, 0, 0, 0, k) for k in (1, 2)]
    rows = [(1, "one text of words", "s", x, y, [(t, m)], None) for x in ([1, None], [1], [None, 1]) for y in ((1, None), (None, 1)) for t in stamps for m in ({"a": 1}, {"a": None}, None)]
    docs = spark.createDataFrame(rows, kinds)
    spell = lambda table: sorted(str(r) for r in table.select(*docs.columns).collect())
    wanted = spell(docs)
    assert len(set(wanted)) == len(rows)
    assert spell(mixing.mix(docs, weights=(1,), max_repeats=1)) == wanted
    sharding.write(docs, str(tmp_path / "out"), shards=3)
    assert spell(spark.read.schema(docs.schema).parquet(str(tmp_path / "out"))) == wanted


def test_encoding_keeps_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, ids_sha256 string, N_TOKENS int")
    got = bpe.encode(docs, digests_only=True)
    assert got.columns == ["doc_id", "ids_sha256", "N_TOKENS", "n_tokens_", "ids_sha256_", "decoded_sha256"]
    assert got.first().ids_sha256 == "mine" and got.first().N_TOKENS == 7 and got.first().n_tokens_ == 2

"""Operators of the index on small literal tables."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope import store
from folioscope.functions import text as tx
from folioscope.operators import duplicates, ingest, moves, plan, reading, rules, search, workflow
from folioscope.sources import listing

NOW = "cast('2026-01-01 00:00:00' as timestamp)"


def _pages(spark, docs):
    rows = [(d, k, f"{h & (2**64 - 1):016x}", "phash8") for d, pages in docs.items() for k, h in enumerate(pages)]
    return duplicates.page_arrays(spark.createDataFrame(rows, "document_id long, page_no int, phash string, algo string"))


def test_near_and_subset(spark):
    arrays = _pages(spark, {1: [0b0000, 0b1000], 2: [0b0001, 0b1001], 3: [1 << 60, 7], 4: [0b0000, 0b1000, 1 << 50]})
    near = {(r.document_a, r.document_b): r.score for r in duplicates.near_matches(arrays, 1).collect()}
    assert list(near) == [(1, 2)] and near[(1, 2)] == pytest.approx(1 - 1 / 64)
    assert duplicates.near_matches(arrays, 0).count() == 0
    subset = [(r.document_a, r.document_b, round(r.score, 3)) for r in duplicates.subset_matches(arrays, 0).collect()]
    assert subset == [(1, 4, 0.667)]


def test_each_page_is_used_once(spark):
    arrays = _pages(spark, {1: [1, 1], 2: [1, 0xFF00]})
    assert duplicates.near_matches(arrays, 1).count() == 0


def test_budget(spark):
    arrays = _pages(spark, {k: [5] for k in range(4)})
    assert duplicates.near_matches(arrays, 0, max_pairs=2).count() == 2
    assert duplicates.truncated(duplicates.near_matches(arrays, 0), 2)


def _noisy(rng, hash_, bits):
    for at in rng.sample(range(64), bits):
        hash_ ^= 1 << at
    return hash_


def test_documents_that_share_blank_pages_are_no_candidates(spark):
    """10,000 documents with a blank page, each scanned a little differently, and a page of their own."""
    rng = random.Random(8)
    docs = {k: [_noisy(rng, 0, rng.randint(0, 3)), rng.getrandbits(64)] for k in range(10_000)}
    docs[10_000] = [docs[5][0], _noisy(rng, docs[5][1], 4)]
    arrays = _pages(spark, docs)
    assert duplicates.candidates(arrays, 6, F.expr("a < b AND n_a = n_b")).count() < 10_000
    assert [(r.document_a, r.document_b) for r in duplicates.near_matches(arrays).collect()] == [(5, 10_000)]


def test_near_and_subset_against_all_pairs(spark):
    rng = random.Random(9)
    forms = [rng.getrandbits(64) for _ in range(6)]
    docs = {k: [_noisy(rng, rng.choice(forms), rng.randint(0, 4)) for _ in range(rng.randint(1, 4))] for k in range(120)}

    def pairs_up(a, b):
        free = list(b)
        for page in a:
            nearest = min(free, key=lambda other: (page ^ other).bit_count())
            if (page ^ nearest).bit_count() > 6:
                return False
            free.remove(nearest)
        return True

    wanted = sorted((a, b) for a in docs for b in docs if a < b and len(docs[a]) == len(docs[b]) and pairs_up(docs[a], docs[b]))
    within = sorted((a, b) for a in docs for b in docs if len(docs[a]) < len(docs[b]) and pairs_up(docs[a], docs[b]))
    arrays = _pages(spark, docs)
    assert sorted((r.document_a, r.document_b) for r in duplicates.near_matches(arrays).collect()) == wanted and len(wanted) > 50
    assert sorted((r.document_a, r.document_b) for r in duplicates.subset_matches(arrays).collect()) == within and len(within) > 50


def test_budget_takes_the_first_pairs(spark):
    arrays = _pages(spark, {3 * k: [k // 40, 1 << 40] for k in range(400)}).withColumn("sha256", (F.col("document_id") % 2).cast("string"))
    wanted = F.expr("a < b AND n_a = n_b AND sha256_a <> sha256_b")
    every = sorted((r.a, r.b) for r in duplicates.candidates(arrays, 0, wanted).collect())
    for most in (1, 100, len(every), len(every) + 5):
        assert sorted((r.a, r.b) for r in duplicates.candidates(arrays, 0, wanted, most).collect()) == every[:most]
    assert duplicates.candidates(arrays.limit(0), 0, wanted, 5).count() == 0


def test_review_queue_keeps_verdicts_and_is_idempotent(spark):
    kinds = "kind STRING, document_a BIGINT, document_b BIGINT, score DOUBLE, detail STRING, status STRING, created_at TIMESTAMP, resolved_at TIMESTAMP"
    found = spark.createDataFrame([("near", 2, 1, 0.9, "x"), ("subset", 5, 4, 0.5, "y")], "kind string, document_a long, document_b long, score double, detail string")
    first, new = duplicates.queue(spark.createDataFrame([], kinds), found, F.expr(NOW))
    assert new.count() == 2 and {(r.document_a, r.document_b) for r in first.collect()} == {(1, 2), (5, 4)}
    labels = spark.createDataFrame([], "kind STRING, document_a BIGINT, document_b BIGINT, verdict STRING, source STRING, labelled_at TIMESTAMP")
    said = spark.createDataFrame([("near", 2, 1, "Not-Dup", "human")], "kind string, document_a long, document_b long, verdict string, source string")
    labels, reviewed = duplicates.label(labels, first, said, F.expr(NOW))
    again, new = duplicates.queue(reviewed, found.withColumn("score", F.lit(0.1)), F.expr(NOW))
    assert new.count() == 0 and labels.count() == 1
    assert {(r.kind, r.status, r.score) for r in again.collect()} == {("near", "not_dup", 0.1), ("subset", "pending", 0.1)}


def test_scan_diff(spark):
    old = spark.createDataFrame([("a.pdf", 1.0, 5, None), ("b.pdf", 1.0, 5, None), ("c.pdf", 1.0, 5, datetime(2026, 1, 1))], "rel_path string, mtime double, size_bytes long, missing_since timestamp")
    new = spark.createDataFrame([("a.pdf", 5, 1.0), ("b.pdf", 5, 2.0), ("c.pdf", 5, 1.0), ("d.pdf", 1, 1.0)], "rel_path string, size_bytes long, mtime double")
    assert {r.rel_path: r.state for r in ingest.classify(new, old).collect()} == {"a.pdf": "unchanged", "b.pdf": "changed", "c.pdf": "changed", "d.pdf": "new"}
    names = ["foo (1).pdf", "notes - conflicted copy 2024-01-02.pdf", "Report (final).pdf", "invoice.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(ingest.conflict_kind(F.col("n")).alias("k")).collect()
    assert [r.k for r in rows] == ["drive_numbered", "drive_conflicted_copy", None, None]


def test_store_ingest_snapshot(spark, tmp_path):
    from folioscope.streaming.ingest import absorb

    st = store.Store(spark, str(tmp_path / "index"))
    assert not st.exists()
    assert len(st.migrate()) == 11 and st.migrate() == []
    rows = lambda *x: spark.createDataFrame(list(x), "rel_path string, size_bytes long, mtime double, sha256 string")
    absorb(st, rows(("a.pdf", 1, 1.0, "aa"), ("b (1).pdf", 1, 1.0, "aa"), ("c.pdf", 2, 1.0, "bb")), 1, full=True)
    assert st.read("document").count() == 2 and st.read("occurrence").count() == 3
    shot = st.snapshot(str(tmp_path / "shots"), datetime(2026, 1, 1))
    absorb(st, rows(("a.pdf", 1, 1.0, "aa"), ("c.pdf", 3, 2.0, "cc")), 2, full=True)
    got = {r.rel_path: (r.document_id, r.missing_since is None, r.last_scan_id) for r in st.read("occurrence").collect()}
    assert got["b (1).pdf"][1:] == (False, 1) and got["a.pdf"][1:] == (True, 2) and got["c.pdf"][0] == 3
    assert st.restore(shot, dry_run=True)["occurrence"] == 3 and st.read("document").count() == 3
    st.restore(shot)
    assert st.read("document").count() == 2 and {r.table_name: r.n for r in st.counts().collect()}["occurrence"] == 3
    with pytest.raises(store.StoreError):
        st.snapshot(str(tmp_path / "shots"), datetime(2026, 1, 1))


def test_listing(spark, tmp_path):
    for name in ("_inbox/a.PDF", "_inbox/b.txt", ".hidden/c.pdf", "d.png", "~$e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = listing.hashed(listing.listing(spark, str(tmp_path)), str(tmp_path))
    rows = {r.rel_path: r for r in files.collect()}
    assert set(rows) == {"_inbox/a.PDF", "d.png"} and rows["d.png"].mime == "image/png" and len(rows["d.png"].sha256) == 64
    df = spark.createDataFrame([("x/.git/a.pdf",), ("x/a.pdf",), ("~$x.pdf",)], "p string")
    assert [r.e for r in df.select(listing.path_excluded(F.col("p")).alias("e")).collect()] == [True, False, True]


TAX = {"rule": [{"id": "b", "all": ["Invoice"], "any": ["north", "south"], "none": ["draft"], "priority": 1}, {"id": "a", "regex": r"acct-\d+", "detail": "d", "detail_regex": r"acct-(\S+)"}, {"id": "c"}]}


def test_rules(spark):
    tax = rules.Taxonomy.of(TAX)
    texts = ["INVOICE North acct-7", "invoice north draft", "ACCT-12", "invoice", None, "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(rules.match_rule(tax, F.col("t"))["rule_id"].alias("r"), rules.detail_for_rule(tax.rules[1], F.col("t")).alias("d")).collect()
    assert [r.r for r in got] == ["b", None, "a", None, None, None]
    assert got[2].d.detail == "12" and got[3].d.source == "rule"
    for bad in ({"rule": [{"id": "x", "folder": "../up"}]}, {"rule": [{"id": "x"}, {"id": "x"}]}, {"rule": [{"id": 3}]}, {"rule": [{"id": "x", "priority": True}]}, {"date_order": "ymd"}):
        with pytest.raises(rules.ConfigError):
            rules.Taxonomy.of(bad)


def test_render_name(spark):
    cases = [(("2026-02-03", "Northwind", "invoice", "camden"), "2026-02-03_Northwind_invoice_camden"), (("2026-02-03", "Northwind", "invoice", None), "2026-02-03_Northwind_invoice"), (("2026-02-03", None, "invoice", "camden"), "2026-02-03_invoice_camden"), ((None, None, "invoice", None), "invoice"), ((None,) * 4, "")]
    df = spark.createDataFrame([(*f, w) for f, w in cases], "doc_date string, party string, doc_type string, detail string, want string")
    fields = {c: F.col(c) for c in ("doc_date", "party", "doc_type", "detail")}
    assert all(r.got == r.want for r in df.select("want", plan.render_name(plan.DEFAULT_TEMPLATE, fields).alias("got")).collect())
    with pytest.raises(rules.ConfigError):
        plan.render_name("{nope}", fields)


def test_paths(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), (".bashrc",), ("x",), ("../x",), ("a/../b",), ("/x",), ("a/../../b",)], "p string")
    rows = df.select(plan.suffix(F.col("p")).alias("s"), plan.inside_root(F.col("p")).alias("i")).collect()
    assert [r.s for r in rows][:3] == [".gz", "", ""]
    assert [r.i for r in rows] == [True, True, True, False, True, False, False]


def test_claims_fold_and_window(spark):
    rng = random.Random(5)
    places = [(rng.choice(["f", "g"]), rng.choice("abc")) for _ in range(60)]
    disk = {("f", "a"), ("g", "c")}  # f/a.pdf is document 7 itself
    rows = [(k, f"{rng.getrandbits(256):064x}", f"in/{k}.pdf", *p, p in disk, False) for k, p in enumerate(places)]
    rows[7] = (7, None, "f/a.pdf", "f", "a", True, False)
    df = spark.createDataFrame(rows, "document_id long, sha256 string, rel_path string, folder string, party string, on_disk boolean, suffixed_on_disk boolean")
    targets = plan.targets(df.withColumns({c: F.lit(None).cast("string") for c in ("doc_date", "doc_type", "detail")}), "{party}")
    said = lambda df: sorted((r.document_id, r.status, r.final_path, r.claimed_by) for r in df.collect())
    fold = said(plan.fold(targets))
    assert said(plan.claims(targets)) == fold
    # a plain name that is a suffixed one of the same folder, before and after it
    met = rows + [(100, rows[9][1], "in/100.pdf", "g", f"{places[20][1]}_{rows[20][1][:6]}", False, False), (5, "e" * 64, "in/5b.pdf", "g", f"{places[30][1]}_{rows[30][1][:6]}", False, False)]
    odd = plan.targets(spark.createDataFrame(met, df.schema).withColumns({c: F.lit(None).cast("string") for c in ("doc_date", "doc_type", "detail")}), "{party}")
    assert said(plan.claims(odd)) == said(plan.fold(odd))
    window = sorted((r.document_id, r.status, r.final_path, r.claimed_by) for r in plan.first_pass(targets).collect())
    assert [(a, b, c) for a, b, c, _ in fold] == [(a, b, c) for a, b, c, _ in window]
    paths = [p for _, s, p, _ in fold if p]
    assert len(paths) == len(set(paths))


def test_plan_apply_undo(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.pdf").write_text("x")
    entries = spark.createDataFrame([(1, "a.pdf", "new/n.pdf", "move", "rule"), (2, "a.pdf", "../evil.pdf", "move", "rule"), (3, "z.pdf", "q.pdf", "noop", "rule")], "document_id long, rel_path string, final_path string, status string, provenance string")
    path = str(tmp_path / "plan.json")
    plan.write(entries, path, str(root), "plan-1")
    with pytest.raises(ValueError):
        plan.write(entries, str(root / "plan.json"), str(root), "plan-1")
    log, now = moves.Log(str(tmp_path / "log")), datetime(2026, 1, 1)
    read = moves.read_plan(path)
    assert moves.histogram(moves.apply(read, str(root), log, now, dry_run=True))["moved"] == 1 and (root / "a.pdf").exists()
    assert moves.histogram(moves.apply(read, str(root), log, now)) == {"moved": 1, "skipped": 1, "ignored": 1, "reversed": 0}
    assert (root / "new/n.pdf").exists()
    assert moves.histogram(moves.undo("plan-1", str(root), log, now))["reversed"] == 1 and (root / "a.pdf").exists()
    assert moves.undo("plan-1", str(root), log, now) == []


def test_resume(spark):
    cases = [(None, None, None, 0), ("local", "skipped", "tesseract_missing", 0), ("local", "skipped", None, 1), ("vision", "pending_vision", None, 1), ("vision", "pending_vision", "drive_not_found", 3), ("drive", "pending_drive", None, 1), ("gone", "skipped", None, 0)]
    df = spark.createDataFrame(cases, "rung string, status string, note string, want int")
    rows = df.select("want", reading.resume_index(F.col("rung"), F.col("status"), F.col("note")).alias("got")).collect()
    assert [r.got for r in rows] == [c[3] for c in cases]


def test_tsv_and_rollup(spark):
    tsv = "level\tconf\ttext\n5\t-1\t\n5\t91.0\tInvoice\nbad\n5\tx\tno\n5\t90.0\t2026\n"
    row = spark.createDataFrame([(tsv,)], "t string").select(reading.tsv_words(F.col("t")).alias("r")).first().r
    assert (row.text, row.confidence) == ("Invoice 2026", 0.905)
    pages = spark.createDataFrame([(1, 2, "two", "drive"), (1, 1, "one", "local_text"), (1, 3, " \n", "vision"), (2, 1, None, "vision")], "document_id long, page_number int, text string, ocr_source string")
    assert sorted((r.document_id, r.ocr_text, r.ocr_source) for r in reading.roll_up(pages).collect()) == [(1, "one\n\ntwo", "vision"), (2, None, "vision")]


DOCS = [(1, "invoice and more"), (2, "invoice invoice invoice"), (3, "an invoice, invoice"), (4, None), (5, "café northern lights"), (6, "plain words here invoiced")]


def test_search(spark):
    docs = spark.createDataFrame(DOCS, "document_id long, ocr_text string")
    posts, lens = search.postings(docs).cache(), search.lengths(docs).cache()
    ids = lambda q, n=None: [r.document_id for r in search.find(q, posts, lens, n).collect()]
    assert ids("invoice") == [2, 3, 1] and ids("invoice", 1) == [2]
    assert ids("cafe") == [5] and ids("north*") == [5] and ids('"northern lights"') == [5]
    assert ids("invoice NOT more") == [2, 3] and ids("invoice OR cafe") and set(ids("invoice AND more")) == {1}
    assert ids("NEAR(plain invoiced, 2)") == [6] and ids("NEAR(plain invoiced, 1)") == []
    assert ids("NEAR(here words plain, 0)") == [6] and ids("NEAR(plain here invoiced, 0)") == [] and ids("NEAR(plain here invoiced, 1)") == [6]
    assert ids('"((("') == []
    for bad in ("  ", 'unclosed "quote AND', "a AND", "two-words AND x"):
        with pytest.raises(search.QueryError):
            ids(bad)
    assert search.escape('  o\'brien  ') == '"o\'brien"' and search.escape("north*") == "north*"
    shown = docs.select(search.snippet(F.col("ocr_text"), ["invoice"]).alias("s")).collect()
    assert shown[1].s == "[invoice] [invoice] [invoice]"


def test_retention(spark):
    from datetime import timedelta

    now = datetime(2026, 7, 1)
    stamps = [(f"s{k}", now - timedelta(days=3 * k)) for k in range(60)]
    df = spark.createDataFrame(stamps, "name string, stamp timestamp")
    kept = {r.name for r in store.retention(df, F.lit(now)).filter("keep").collect()}
    young = {n for n, s in stamps if s >= now - timedelta(days=14)}
    weeks = {}
    for n, s in stamps:
        if n not in young and s >= now - timedelta(weeks=12):
            weeks.setdefault(tuple(s.isocalendar())[:2], n)
    assert kept == young | set(weeks.values()) | {"s0"}


def test_workflow(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (4, 4), (7, 1), (3, 8)] + [(20 + k, 20 + (k + 1) % 6) for k in range(6)], "src int, dst int")
    assert sorted(r.path for r in workflow.cycles(edges).collect()) == ["1>2", "1>2>3", "20>21>22>23>24>25", "4"]
    pointers = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("l", "l")] + [(f"k{k:02}", f"k{k + 1:02}") for k in range(40)]
    found = {(r.doc, r.terminal) for r in workflow.terminal_superseders(spark.createDataFrame(pointers, "doc string, by string")).collect()}
    assert found == {("a", "c"), ("b", "c"), ("x", "z"), ("y", "z")} | {(f"k{k:02}", "k40") for k in range(40)}
    refs = spark.createDataFrame([("see #12, a#34 &#56 (#78) #1",)], "t string").select(workflow.issue_refs(F.col("t")).alias("r")).first().r
    assert refs == ["12", "78"]


def test_rules_by_one_automaton(spark):
    rng = random.Random(3)
    words = ["alpha", "alp", "phab", "beta", "b", "rate", "über", "a b", ""] + [f"w{k}" for k in range(20)]
    made = []
    for k in range(120):
        rule = {"id": f"r{k:03}", "priority": rng.randint(0, 3)} | {key: rng.sample(words, rng.randint(1, 2)) for key in ("all", "any", "none") if rng.random() < 0.45}
        made.append(rule | ({"regex": rng.choice(["w[3-5] b", "^alpha", "beta$"])} if rng.random() < 0.25 else {}))
    tax = rules.Taxonomy.of({"rule": made})
    bodies = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(300)] + [None, ""]

    def first(body):
        for r in tax.rules:
            t = tx_normal[body]
            has = lambda w: w.casefold() in t
            if (r.all or r.any or r.regex) and all(map(has, r.all)) and (not r.any or any(map(has, r.any))) and not any(map(has, r.none)) and (not r.regex or re.search(r.regex, t)):
                return r.id
        return None

    df = spark.createDataFrame([(b,) for b in bodies], "t string")
    rows = df.select("t", tx.normalize_text(F.col("t")).alias("n"), rules.match_rule(tax, F.col("t"))["rule_id"].alias("got")).collect()
    tx_normal = {r.t: r.n for r in rows}
    assert [(r.t, r.got) for r in rows if r.n is not None and r.got != first(r.t)] == []
    assert len({r.got for r in rows}) > 10
    assert df.select(rules.match_rule(rules.Taxonomy(), F.col("t")).alias("got")).distinct().collect()[0].got is None

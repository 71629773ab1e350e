"""The verbs end to end on a temporary folder."""

import json
import sys

import pytest
from pyspark import cloudpickle

from folioscope.cabinet import Cabinet
from folioscope.operators import classify
from folioscope.operators.rules import Taxonomy
from folioscope.sources import remote
from folioscope.sources.pages import Tools


def test_verbs(spark, tmp_path):
    root = tmp_path / "root"
    (root / "_inbox").mkdir(parents=True)
    for name, body in (("a.pdf", "alpha"), ("b.pdf", "alpha"), ("c.pdf", "beta")):
        (root / "_inbox" / name).write_text(body)
    box = Cabinet(spark, str(tmp_path / "index"), str(root))
    box.migrate()
    box.ingest()
    assert box.status()["documents"] == 2
    assert {r.state for r in box.ingest().collect()} == {"unchanged"}
    paths = {r.rel_path: r.document_id for r in box.store.read("occurrence").collect()}
    assert paths["_inbox/a.pdf"] == paths["_inbox/b.pdf"]
    assert box.dupes()["exact_documents"] == 2
    box.submit(paths["_inbox/a.pdf"], "vision", "Northwind invoice of 3 February 2026", page=1)
    box.submit(paths["_inbox/c.pdf"], "vision", "Northwind invoice of 2026-02-03 again", page=1)
    with pytest.raises(ValueError):
        box.submit(1, "vision", "no page")
    assert [r.document_id for r in box.find("invoice").collect()] and box.find("again").first().rel_path == "_inbox/c.pdf"
    tax = Taxonomy.of({"rule": [{"id": "n", "party": "Northwind", "doc_type": "invoice", "all": ["northwind"], "folder": "bills"}]})
    box.classify(paths["_inbox/c.pdf"], party="Other", doc_type="note", doc_date="2025-01-01", tags=["x"])
    entries = {r.rel_path: r for r in box.propose(tax, current_year=2026).collect()}
    assert entries["_inbox/a.pdf"].final_path == "bills/2026-02-03_Northwind_invoice.pdf"
    assert entries["_inbox/c.pdf"].final_path == "_inbox/2025-01-01_Other_note.pdf" and entries["_inbox/c.pdf"].date_source == "agent"
    plan_id = box.write_plan(box.propose(tax, current_year=2026), str(tmp_path / "plan.json"))
    assert json.loads((tmp_path / "plan.json").read_text())["summary"]["move"] == 2
    assert box.apply(str(tmp_path / "plan.json"), str(tmp_path / "log"))["moved"] == 2
    assert (root / "bills/2026-02-03_Northwind_invoice.pdf").exists()
    assert box.undo(plan_id, str(tmp_path / "log"))["reversed"] == 2
    docs, occ = box.store.read("document"), box.store.read("occurrence")
    assert classify.select_document(docs, occ, rel_path="_inbox/c.pdf") == paths["_inbox/c.pdf"]
    with pytest.raises(classify.SelectorError):
        classify.select_document(docs, occ, rel_path="c.pdf")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import tests

LETTER = "Northwind invoice number 17 of 3 February 2026, due within thirty days of receipt. " * 4


def tools(root):
    """Pages are the paragraphs of a file; a page that says scan has no layer, one that says broken cannot be rendered."""

    def read(path):
        with open(path, encoding="utf-8") as f:
            body = f.read()
        if "corrupt" in body:
            raise RuntimeError("not a document")
        return body.split("\n\n")

    def hashes(path):
        return [f"{hash_of(p):016x}" for p in read(path)]

    def hash_of(page):
        import hashlib

        return int(hashlib.md5(page.split("~")[0].encode()).hexdigest()[:16], 16) ^ (3 if "~" in page else 0)

    def recognise(path, page):
        body = read(path)[page - 1]
        return None if "broken" in body else (body.replace("scan:", ""), 0.9 if "clear" in body else 0.3)

    return Tools(count=lambda p: len(read(p)), hashes=hashes, layers=lambda p: ["" if "scan:" in x else x for x in read(p)], recognise=recognise)


class Drive:
    """A remote drive with one folder; ``down`` makes every call fail."""

    def __init__(self, down=False):
        self.down = down

    def children(self, folder, name):
        if self.down:
            raise remote.Failure(401)
        if folder == "root" and name == "_inbox":
            return [("f1", True, None)]
        return [(f"id-{name}", False, len(SCAN))] if name == "scan.pdf" and folder == "f1" else []

    def folders(self, name):
        return ["tmp"]

    def copy(self, file, folder):
        return f"copy-{file}"

    def export(self, copy):
        return "Text that the drive has read\nImage labels: [paper]\n"

    def delete(self, copy):
        pass


SCAN = "scan: dim\n\nscan: dim too\n\n" + LETTER


def test_pages_end_to_end(spark, tmp_path):
    root = tmp_path / "root"
    (root / "_inbox").mkdir(parents=True)
    files = {"a.pdf": LETTER, "a2.pdf": LETTER + "~", "long.pdf": LETTER + "\n\nscan: clear second page", "scan.pdf": SCAN, "bad.pdf": "corrupt", "broken.pdf": "scan: broken"}
    for name, body in files.items():
        (root / "_inbox" / name).write_text(body)
    box, own = Cabinet(spark, str(tmp_path / "index"), str(root)), tools(root)
    box.migrate()
    box.ingest(own)
    docs = {r.document_id: r for r in box.store.read("document").collect()}
    ids = {r.rel_path[7:]: r.document_id for r in box.store.read("occurrence").collect()}
    assert {docs[ids[n]].page_count for n in ("a.pdf", "long.pdf", "scan.pdf", "bad.pdf")} == {1, 2, 3, None} and docs[ids["a.pdf"]].mime == "application/pdf"
    found = box.dupes(tools=own)
    assert found["hashed_documents"] == 5 and found["near"] == 1 and found["subset"] >= 2 and box.hash_pages(own) == (0, 0)
    kinds = {(r.kind, r.document_a, r.document_b) for r in box.pending().collect()}
    assert ("near", *sorted((ids["a.pdf"], ids["a2.pdf"]))) in kinds and ("subset", ids["a.pdf"], ids["long.pdf"]) in kinds
    box.label("near", ids["a2.pdf"], ids["a.pdf"], "Dup")
    assert box.labels().count() == 1 and box.pending().count() == len(kinds) - 1

    first = box.ocr(own)
    assert (first["documents"], first["errors"], first["pages"]) == (5, 1, 8) and first["ok"] == 5 and first["pending_vision"] == 3 and first["degraded"] == 3
    page = lambda n: {r.page_number: r for r in box.store.read("page_ocr").filter(f"document_id = {ids[n]}").collect()}
    assert page("long.pdf")[2].ocr_source == "local_tesseract" and page("scan.pdf")[1].note == "rung_unavailable:drive" and page("scan.pdf")[1].text == " dim"
    assert [r.rel_path for r in box.find("thirty days", limit=9).collect()] and box.find("clear").first().snippet == "... receipt. \n\n [clear] second page" or "[clear]" in box.find("clear").first().snippet
    again = box.ocr(own, connect=lambda: Drive())
    assert again["pages"] == 3 and again["ok"] == 2
    assert page("scan.pdf")[1].text == "Text that the drive has read" and page("scan.pdf")[2].text == " dim too" and page("scan.pdf")[2].ocr_source == "drive"
    assert box.store.read("document").filter(f"document_id = {ids['scan.pdf']}").first().ocr_source == "drive"
    assert box.ocr(own, connect=lambda: Drive())["pages"] == 0 or page("broken.pdf")[1].note == "drive_not_found"
    assert box.find("drive").first().document_id == ids["scan.pdf"]
    assert box.submit(ids["broken.pdf"], "drive", "from an agent")["pages_marked"] == 1 and box.find("agent").first().document_id == ids["broken.pdf"]
    with pytest.raises(ValueError):
        box.submit(ids["scan.pdf"], "vision", "x", page=9)

    tax = Taxonomy.of({"rule": [{"id": "n", "party": "Northwind", "doc_type": "invoice", "all": ["northwind", "second page"], "folder": "bills"}]})
    plan_id = box.write_plan(box.propose(tax, current_year=2026), str(tmp_path / "plan.json"))
    assert box.apply(str(tmp_path / "plan.json"), str(tmp_path / "log"))["moved"] == 1
    assert {r.state for r in box.ingest(own).collect()} == {"unchanged"}
    assert box.store.read("document").filter("party = 'Northwind'").count() == 1 and box.store.read("move_log").filter("undone_at IS NULL").count() == 1
    assert box.undo(plan_id, str(tmp_path / "log"))["reversed"] == 1
    assert {r.state for r in box.ingest(own).collect()} == {"unchanged"} and box.store.read("move_log").filter("undone_at IS NOT NULL").count() == 1


def test_remote():
    from folioscope.sources.remote import Failure, Session, note_of, passing

    waits, calls = [], []

    class Flaky(Drive):
        def children(self, folder, name):
            calls.append(name)
            if len(calls) < 3:
                raise Failure(503)
            return super().children(folder, name)

    session = Session(Flaky(), sleep=waits.append)
    assert session.text([("_inbox/scan.pdf", len(SCAN))])[1] is None and len(waits) == 2 and 1 <= waits[0] <= 2 <= waits[1] <= 3
    assert session.text([("_inbox/scan.pdf", 1), ("../x", 3), ("_inbox/none.pdf", 3)]) == (None, "drive_not_found")
    down = Session(Drive(down=True), sleep=waits.append)
    assert down.text([("_inbox/scan.pdf", 3)]) == (None, "drive_unauthenticated") and down.tripped == "drive_unauthenticated"
    assert Session(None).text([("a", 1)]) == (None, "rung_unavailable:drive")
    cases = {Failure(403, ["userRateLimitExceeded"]): "drive_quota", Failure(403, ["authError"]): "drive_unauthenticated", Failure(403): "drive_convert_failed", Failure(404): "drive_not_found", Failure(429): "drive_quota", Failure(500): "drive_offline", Failure(400): "drive_convert_failed", OSError(): "drive_offline", KeyError(): "drive_convert_failed", Failure(500, expired=True): "drive_unauthenticated"}
    assert {note_of(e): n for e, n in cases.items()} == {n: n for n in cases.values()}
    assert [passing(e) for e in (Failure(429), Failure(404), OSError(), KeyError(), Failure(503, expired=True))] == [True, False, True, False, False]


def test_reading_is_taken_up_where_it_broke_off(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for k in range(9):
        (root / f"{k}.pdf").write_text(f"{LETTER} number {k}")
    box = Cabinet(spark, str(tmp_path / "index"), str(root))
    own, log = tools(root), str(tmp_path / "read.log")
    box.migrate()
    box.ingest(own)

    def layers(path):
        with open(log, "a") as f:
            f.write(path.rsplit("/", 1)[-1] + "\n")
        return own.layers(path)

    calls = []

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost")
        return real(*args)

    real = box._read_unit
    box._read_unit = dies
    with pytest.raises(RuntimeError):
        box.ocr(own, unit=3)
    kept = box.store.read("page_ocr").count()
    assert kept > 0 and box.find("northwind", 20).count() == kept  # what was read is committed and indexed
    total = box.ocr(Tools(count=own.count, hashes=own.hashes, layers=layers, recognise=own.recognise), unit=3)
    with open(log) as f:
        assert len(f.read().split()) == 9 - kept  # units that were done are not read again
    assert total["documents"] == 9 and total["pages"] == 9 and total["ok"] == 9 and len(calls) <= 4
    assert box.store.files.names(f"{box.store.path}/reading") == []

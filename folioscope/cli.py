"""Thin command line: ``python -m folioscope.cli --index DIR --root DIR VERB ...``; prints one JSON document."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from folioscope.cabinet import Cabinet
from folioscope.operators import classify
from folioscope.operators.rules import Taxonomy
from folioscope.sources.pages import Tools


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope")
    p.add_argument("--index", required=True)
    p.add_argument("--root", default=".")
    verbs = p.add_subparsers(dest="verb", required=True)
    p.add_argument("--tools", help="module:name of the page tools (folioscope.sources.pages.Tools)")
    for name in ("migrate", "status", "ingest", "labels"):
        verbs.add_parser(name)
    verbs.add_parser("dupes").add_argument("--max-distance", type=int, default=6)
    verbs.add_parser("pending").add_argument("--limit", type=int)
    label = verbs.add_parser("label")
    label.add_argument("kind")
    label.add_argument("a", type=int)
    label.add_argument("b", type=int)
    label.add_argument("verdict")
    ocr = verbs.add_parser("ocr")
    ocr.add_argument("--ladder", default="local,drive,vision")
    ocr.add_argument("--min-confidence", type=float, default=0.75)
    ocr.add_argument("--limit", type=int)
    ocr.add_argument("--client", help="module:name of a function that connects to the remote drive")
    ocr.add_argument("--root-folder", default="")
    submit = verbs.add_parser("submit")
    verdict = verbs.add_parser("classify")
    for verb in (submit, verdict):
        one = verb.add_mutually_exclusive_group(required=True)
        one.add_argument("--document", type=int)
        one.add_argument("--sha256")
        one.add_argument("--rel-path")
    submit.add_argument("--source", choices=("vision", "drive"), default="vision")
    submit.add_argument("--page", type=int)
    submit.add_argument("text_file", help="a file, or - for standard input")
    for field in ("party", "doc-type", "detail", "doc-date", "folder", "note"):
        verdict.add_argument(f"--{field}")
    verdict.add_argument("--tag", action="append", default=[])
    find = verbs.add_parser("find")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=20)
    propose = verbs.add_parser("propose")
    propose.add_argument("--taxonomy", required=True)
    propose.add_argument("--plan", required=True)
    apply = verbs.add_parser("apply")
    apply.add_argument("plan")
    apply.add_argument("--log", required=True)
    apply.add_argument("--dry-run", action="store_true")
    undo = verbs.add_parser("undo")
    undo.add_argument("plan_id")
    undo.add_argument("--log", required=True)
    verbs.add_parser("snapshot").add_argument("folder")
    restore = verbs.add_parser("restore")
    restore.add_argument("snapshot")
    restore.add_argument("--dry-run", action="store_true")
    return p


def _named(name: str | None):
    """What ``module:name`` names."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _document(box: Cabinet, args: argparse.Namespace) -> int:
    return classify.select_document(box.store.read("document"), box.store.read("occurrence"), args.document, args.sha256, args.rel_path)


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    box, tools = Cabinet(spark, args.index, args.root), _named(args.tools) or Tools()
    match args.verb:
        case "migrate":
            return {"applied": box.migrate()}
        case "status":
            return box.status()
        case "ingest":
            return {r["state"]: r["count"] for r in box.ingest(tools).groupBy("state").count().collect()}
        case "dupes":
            return box.dupes(args.max_distance, tools)
        case "labels":
            return {"labels": [r.asDict() for r in box.labels().collect()]}
        case "pending":
            return {"pending": [r.asDict() for r in box.pending(args.limit).collect()]}
        case "ocr":
            ladder = tuple(x.strip() for x in args.ladder.split(",") if x.strip())
            return box.ocr(tools, _named(args.client), ladder, args.min_confidence, args.limit, tuple(x for x in args.root_folder.split("/") if x))
        case "submit":
            if args.text_file == "-":
                body = sys.stdin.read()
            else:
                with open(args.text_file, encoding="utf-8", errors="replace") as f:
                    body = f.read()
            return box.submit(_document(box, args), args.source, body, args.page)
        case "classify":
            document = _document(box, args)
            box.classify(document, party=args.party, doc_type=args.doc_type, detail=args.detail, doc_date=args.doc_date, folder=args.folder, note=args.note, tags=args.tag)
            return {"document_id": document}
        case "label":
            box.label(args.kind, args.a, args.b, args.verdict)
            return {"labelled": 1}
        case "find":
            hits = [r.asDict() for r in box.find(args.query, args.limit or 20).collect()]
            return {"query": args.query, "count": len(hits), "hits": hits}
        case "propose":
            entries = box.propose(Taxonomy.load(args.taxonomy))
            return {"plan_id": box.write_plan(entries, args.plan)}
        case "apply":
            return box.apply(args.plan, args.log, args.dry_run)
        case "undo":
            return box.undo(args.plan_id, args.log)
        case "snapshot":
            return box.snapshot(args.folder)
        case _:
            return {"row_counts": box.restore(args.snapshot, args.dry_run)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("folioscope").config("spark.ui.enabled", "false").getOrCreate()
    try:
        print(json.dumps(run(args, spark), default=str))
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

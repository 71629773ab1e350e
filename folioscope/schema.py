"""Tables of the index, and the version of their schema."""

from __future__ import annotations

from folioscope.ranged import Layout

VERSION = 8

TABLES: dict[str, str] = {
    "document": "document_id BIGINT, sha256 STRING, size_bytes BIGINT, mime STRING, page_count INT, doc_date STRING, party STRING, doc_type STRING, detail STRING, ocr_text STRING, ocr_source STRING, first_seen_at TIMESTAMP, updated_at TIMESTAMP",
    "occurrence": "occurrence_id BIGINT, document_id BIGINT, rel_path STRING, mtime DOUBLE, size_bytes BIGINT, seen_at TIMESTAMP, missing_since TIMESTAMP, conflict_kind STRING, hashed_at TIMESTAMP, last_scan_id BIGINT",
    "scan": "scan_id BIGINT, started_at TIMESTAMP",
    "page_hash": "document_id BIGINT, page_no INT, phash STRING, algo STRING, computed_at TIMESTAMP",
    "dupe_review": "kind STRING, document_a BIGINT, document_b BIGINT, score DOUBLE, detail STRING, status STRING, created_at TIMESTAMP, resolved_at TIMESTAMP",
    "dupe_label": "kind STRING, document_a BIGINT, document_b BIGINT, verdict STRING, source STRING, labelled_at TIMESTAMP",
    "page_ocr": "document_id BIGINT, page_number INT, text STRING, confidence DOUBLE, rung STRING, ocr_source STRING, status STRING, note STRING, updated_at TIMESTAMP",
    "posting": "term STRING, block BIGINT, n BIGINT, max_tf INT, min_dl BIGINT, docs ARRAY<STRUCT<document_id: BIGINT, tf: INT, dl: BIGINT, epoch: BIGINT, positions: ARRAY<INT>>>",
    "doc_length": "document_id BIGINT, dl BIGINT, epoch BIGINT",
    "classification": "document_id BIGINT, party STRING, doc_type STRING, detail STRING, doc_date STRING, tags ARRAY<STRING>, folder STRING, provenance STRING, note STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "move_log": "move_id BIGINT, document_id BIGINT, plan_id STRING, root STRING, from_path STRING, to_path STRING, applied_at TIMESTAMP, undone_at TIMESTAMP",
}

#: How each table lies in files.
LAYOUTS: dict[str, Layout] = {
    "document": Layout(("document_id",), ("sha256",)),
    "occurrence": Layout(("rel_path",), ("occurrence_id",)),
    "scan": Layout(("scan_id",)),
    "page_hash": Layout(("document_id", "page_no")),
    "dupe_review": Layout(("document_a", "document_b", "kind")),
    "dupe_label": Layout(("document_a", "document_b", "kind")),
    "page_ocr": Layout(("document_id", "page_number")),
    "posting": Layout(("term", "block")),
    "doc_length": Layout(("document_id",), (), ("dl",)),
    "classification": Layout(("document_id",)),
    "move_log": Layout(("move_id",)),
}

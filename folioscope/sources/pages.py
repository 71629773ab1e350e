"""Pages of files, read on executors by injected tools.

A tool is a plain callable that executors can import or unpickle; a tool that is not
there is None.  Every file is opened below the root only; one that cannot be read gives
no rows, or one row with an error, and never fails the run.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

ALGORITHM = "phash8"


@dataclass(frozen=True)
class Tools:
    """``count`` pages of a path; ``hashes`` of its pages; ``layers``, its text page by page; ``recognise`` a page (from 1): (text, confidence), or None where it cannot be rendered."""

    count: Callable[[str], int | None] | None = None
    hashes: Callable[[str], list[str]] | None = None
    layers: Callable[[str], list[str]] | None = None
    recognise: Callable[[str, int], tuple[str, float] | None] | None = None


def inside(root: str, rel_path: str) -> str | None:
    """The file, if it lies below the root now; a link planted since the scan does not lead out of it."""
    top = os.path.realpath(root)
    full = os.path.realpath(os.path.join(top, rel_path))
    return full if full.startswith(top + os.sep) else None


def _call(tool: Callable, root: str, rel_path: str, *more):
    path = inside(root, rel_path)
    if path is None:
        raise OSError("outside the root")
    return tool(path, *more)


def counted(files: DataFrame, root: str, count: Callable[[str], int | None] | None) -> DataFrame:
    """S5. ``files`` with page_count; null where nothing tells."""
    names = [*files.columns, "page_count"]
    at = names.index("rel_path")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", page_count int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(at).to_pylist():
                try:
                    found.append(_call(count, root, path) if count else None)
                except Exception:  # tools raise types of their own
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=names)

    return files.mapInArrow(run, schema)


def hashes(pending: DataFrame, root: str, tool: Callable[[str], list[str]]) -> DataFrame:
    """Page hashes (document_id, page_no, phash, algo) of ``pending`` (document_id, rel_path); none for files that fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for document, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(document, k, h, ALGORITHM) for k, h in enumerate(_call(tool, root, path))]
                except Exception:  # tools raise types of their own
                    continue
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["document_id", "page_no", "phash", "algo"])

    return pending.select("document_id", "rel_path").mapInArrow(run, "document_id long, page_no int, phash string, algo string")


def layers(live: DataFrame, root: str, tool: Callable[[str], list[str]]) -> DataFrame:
    """(document_id, rel_path, page_number, layer_text) of ``live``; a file that fails has one row without a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for document, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(document, path, k, text or "") for k, text in enumerate(_call(tool, root, path), start=1)]
                except Exception:  # tools raise types of their own
                    rows.append((document, path, None, None))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["document_id", "rel_path", "page_number", "layer_text"])

    return live.select("document_id", "rel_path").mapInArrow(run, "document_id long, rel_path string, page_number int, layer_text string")


def recognised(pages: DataFrame, root: str, tool: Callable[[str, int], tuple[str, float] | None] | None) -> DataFrame:
    """``pages`` with ocr_text, ocr_confidence and rendered; read only where the column ``wanted`` says so."""
    names = pages.columns
    path, page, wanted = (names.index(c) for c in ("rel_path", "page_number", "wanted"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields) + ", ocr_text string, ocr_confidence double, rendered boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, n, want in zip(batch.column(path).to_pylist(), batch.column(page).to_pylist(), batch.column(wanted).to_pylist(), strict=True):
                try:
                    read = _call(tool, root, p, n) if tool and want else None
                except Exception:  # tools raise types of their own
                    read = None
                found.append((read[0], float(read[1]), True) if read else (None, None, False))
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "ocr_text", "ocr_confidence", "rendered"])

    return pages.mapInArrow(run, schema)

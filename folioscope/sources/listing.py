"""Listing of a document folder.

The driver walks the folder: Spark's own listing passes over names that begin with
``_`` or ``.``, and this decides what is passed over by itself.  Contents are hashed on
executors from the paths, in pieces, so a file of any size is hashed in bounded memory.
"""

from __future__ import annotations

import fnmatch
import hashlib
import mimetypes
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that are scanned, and names that are not.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "heic", "webp")
EXCLUDES = (".*", "~$*", "*.tmp", "*.part", "*.crdownload")
SCHEMA = "rel_path string, size_bytes long, mtime double"


def excluded(name: str, patterns: tuple[str, ...]) -> bool:
    """S3."""
    return any(fnmatch.fnmatch(name.lower(), p.lower()) for p in patterns)


def paths(root: str, extensions: tuple[str, ...] = EXTENSIONS, excludes: tuple[str, ...] = EXCLUDES) -> Iterator[tuple[str, int, float]]:
    """S1, S6. Files below a root, by path; links are not followed and what lies outside is left out."""
    top = os.path.realpath(root)
    for folder, names, files in os.walk(top, followlinks=False):
        names[:] = sorted(n for n in names if not excluded(n, excludes) and not os.path.islink(os.path.join(folder, n)))
        for name in sorted(files):
            full = os.path.join(folder, name)
            inside = os.path.realpath(full).startswith(top + os.sep)
            if inside and not excluded(name, excludes) and name.rpartition(".")[2].lower() in extensions and "." in name:
                stat = os.stat(full)
                yield os.path.relpath(full, top).replace(os.sep, "/"), stat.st_size, stat.st_mtime


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, excludes: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """S1. (rel_path, size_bytes, mtime)."""
    return spark.createDataFrame(list(paths(root, extensions, excludes)), SCHEMA)


def hashed(files: DataFrame, root: str, piece: int = 1 << 20) -> DataFrame:
    """S4, S5. ``files`` with sha256 and mime; an unreadable file has null."""
    names = [*files.columns, "sha256", "mime"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", sha256 string, mime string"
    at = files.columns.index("rel_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(at).to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        digests.append(hashlib.file_digest(f, "sha256").hexdigest())
                except OSError:
                    digests.append(None)
            kinds = [mimetypes.guess_type(p)[0] for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(kinds, pa.string())], names=names)

    return files.mapInArrow(run, schema)


def has_extension(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """S2."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)


def path_excluded(path: Column, patterns: tuple[str, ...] = EXCLUDES) -> Column:
    """S3 on a column: whether a part of a path fits a pattern, in any letter case."""
    rules = "|".join(fnmatch.translate(p.lower()).replace(r"\Z", "").replace(r"\z", "") for p in patterns)
    return F.exists(F.split(F.lower(path), "/"), lambda p: p.rlike(f"^(?:{rules})$"))

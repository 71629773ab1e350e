"""Text of documents from a remote drive that converts files, over an injected client.

A client has ``children(folder, name)`` giving entries (id, is_folder, size), ``copy(file,
folder)``, ``export(id)``, ``delete(id)``, ``folders(name)`` and ``create(name)`` for the
marked folder of temporary copies, and ``copies(folder)``.  It raises ``Failure`` with a
status and reasons, or the errors of the operating system.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# What is noted of a failure; the first three are of the environment and end all further calls.
UNAUTHENTICATED, OFFLINE, QUOTA = "drive_unauthenticated", "drive_offline", "drive_quota"
NOT_FOUND, FAILED, UNAVAILABLE = "drive_not_found", "drive_convert_failed", "rung_unavailable:drive"
ENVIRONMENT = (UNAUTHENTICATED, OFFLINE, QUOTA)
# Reasons that a 403 is given for.
QUOTA_REASONS = frozenset("ratelimitexceeded userratelimitexceeded dailylimitexceeded quotaexceeded storagequotaexceeded sharingratelimitexceeded rate_limit_exceeded resource_exhausted".split())
SCOPE_REASONS = frozenset("insufficientpermissions insufficientscopes access_token_scope_insufficient autherror".split())
ATTEMPTS, BASE_SECONDS, PLACES = 3, 1.0, 5
ROOT = "root"


class Failure(Exception):
    """An answer that is none: an HTTP status, 0 if there was none, and the machine-readable reasons."""

    def __init__(self, status: int = 0, reasons: Iterable[str] = (), expired: bool = False):
        super().__init__(f"status {status}")
        self.status, self.reasons, self.expired = status, {r.lower() for r in reasons}, expired


def note_of(error: BaseException) -> str:
    """M14. What a failure is noted as."""
    if not isinstance(error, Failure):
        return OFFLINE if isinstance(error, OSError) else FAILED
    if error.expired or error.status == 401:
        return UNAUTHENTICATED
    if error.status == 429 or (error.status == 403 and (error.reasons & QUOTA_REASONS or any("quota" in r for r in error.reasons))):
        return QUOTA
    if error.status == 403:
        return UNAUTHENTICATED if error.reasons & SCOPE_REASONS else FAILED
    if error.status == 404:
        return NOT_FOUND
    return OFFLINE if error.status >= 500 or error.status == 0 else FAILED


def passing(error: BaseException) -> bool:
    """M14. Whether the same call may succeed a moment later."""
    if isinstance(error, Failure):
        return not error.expired and error.status in (429, 500, 502, 503, 504)
    return isinstance(error, OSError)


class _Noted(Exception):
    """A failure, as its note."""


@dataclass
class Session:
    """One run's access.  A failure of the environment trips it: every later call answers with that note at once."""

    client: object | None
    top: tuple[str, ...] = ()
    temporary: str = "folioscope-tmp"
    sleep: Callable[[float], None] = time.sleep
    tripped: str | None = None
    left: int = 0
    _folders: dict[tuple[str, ...], str] = field(default_factory=dict)
    _temporary: str | None = None

    def call(self, name: str, *args):
        """I10. A call of the client, three times at most."""
        if self.tripped:
            raise _Noted(self.tripped)
        for attempt in range(ATTEMPTS):
            try:
                return getattr(self.client, name)(*args)
            except Exception as error:  # clients raise types of their own
                if attempt + 1 == ATTEMPTS or not passing(error):
                    note = note_of(error)
                    self.tripped = note if note in ENVIRONMENT else None
                    raise _Noted(note) from error
            self.sleep(BASE_SECONDS * 2**attempt + random.uniform(0, BASE_SECONDS))
        raise AssertionError

    def sweep(self) -> int:
        """Delete copies that a run before left in marked folders; never fails."""
        gone = 0
        try:
            for folder in self.call("folders", self.temporary) if self.client else ():
                for copy in self.call("copies", folder):
                    try:
                        self.call("delete", copy)
                        gone += 1
                    except _Noted as e:
                        if self.tripped:
                            raise e
                        self.left += 1
        except _Noted:
            pass
        return gone

    def text(self, places: Iterable[tuple[str, int | None]]) -> tuple[str | None, str | None]:
        """S11. (text, note): of the first of a document's places that is found, through a copy that is converted and deleted."""
        if self.client is None:
            return None, UNAVAILABLE
        try:
            file = next((f for f in (self._find(path, size) for path, size in list(places)[:PLACES]) if f), None)
            if file is None:
                return None, NOT_FOUND
            if self._temporary is None:
                folders = self.call("folders", self.temporary)
                self._temporary = folders[0] if folders else self.call("create", self.temporary)
            copy = self.call("copy", file, self._temporary)
            try:
                raw = self.call("export", copy)
            finally:
                try:
                    self.client.delete(copy)
                except Exception:  # swept by the next run
                    self.left += 1
        except _Noted as e:
            return None, str(e)
        return (raw if isinstance(raw, str) else bytes(raw or b"").decode("utf-8", errors="replace")), None

    def _find(self, path: str, size: int | None) -> str | None:
        """The one file at a path by names alone, of the recorded size; a name that is not unique is no match."""
        parts = [p for p in path.split("/") if p]
        if not parts or size is None or {".", ".."} & set(parts):
            return None
        here, at = ROOT, ()
        for name in (*self.top, *parts[:-1]):
            at = (*at, name)
            if at not in self._folders:
                found = [e for e in self.call("children", here, name) if e[1]]
                if len(found) != 1:
                    return None
                self._folders[at] = found[0][0]
            here = self._folders[at]
        files = [e for e in self.call("children", here, parts[-1]) if not e[1] and e[2] == size]
        return files[0][0] if len(files) == 1 else None


def texts(documents: DataFrame, connect: Callable[[], object] | None, top: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, answer, answer_note) of ``documents`` (document_id, places: array of rel_path and size_bytes); a session for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = Session(connect() if connect else None, top)
        for batch in batches:
            found = [session.text([(p["rel_path"], p["size_bytes"]) for p in places]) for places in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]], names=["document_id", "answer", "answer_note"])

    return documents.select("document_id", "places").mapInArrow(run, "document_id long, answer string, answer_note string")

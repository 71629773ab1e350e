"""The index as one object: a method for each verb."""

from __future__ import annotations

import hashlib
import json
import os
import secrets
from collections import Counter
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import classify, duplicates, index, moves, plan, reading, search
from folioscope.operators.rules import Taxonomy
from folioscope.schema import TABLES
from folioscope.scratch import rounds
from folioscope.sources import listing, pages, remote
from folioscope.sources.pages import Tools
from folioscope.store import Store, rotate
from folioscope.streaming import ingest as scans


#: Documents that are read and committed at once, about.
UNIT = 10_000


class Cabinet:
    """Documents below ``root`` and their index below ``path``."""

    def __init__(self, spark: SparkSession, path: str, root: str):
        self.spark, self.store, self.root = spark, Store(spark, path), root

    def migrate(self) -> list[str]:
        return self.store.migrate()

    def status(self) -> dict:
        """A11."""
        there = self.store.exists()
        return {"migrated": there, "documents": self.store.read("document").count() if there else 0}

    def ingest(self, tools: Tools = Tools(), **options) -> DataFrame:
        """Scan the folder: only new and changed files are hashed and probed; the states of all."""
        files = listing.listing(self.spark, self.root, **options)
        scan = 1 + (self.store.read("scan").agg(F.max("scan_id").alias("n")).first()["n"] or 0)
        known = scans.ingest.classify(files, self.store.read("occurrence"))
        with rounds(self.spark) as keep:
            fresh = listing.hashed(known.filter("state <> 'unchanged'").select(*files.columns), self.root).filter("sha256 IS NOT NULL")
            fresh = keep(pages.counted(fresh, self.root, tools.count))
            old = known.filter("state = 'unchanged'").select(*files.columns).withColumns({"sha256": F.lit(None).cast("string"), "mime": F.lit(None).cast("string"), "page_count": F.lit(None).cast("int")})
            states = keep(scans.absorb(self.store, fresh.unionByName(old), scan, full=True))
        change = self.store.change()
        change.append("scan", self.spark.createDataFrame([(scan, datetime.now(timezone.utc))], self.store.schema("scan")))
        change.commit()
        return states

    def hash_pages(self, tools: Tools, limit: int | None = None) -> tuple[int, int]:
        """J2. Page hashes of live documents of known page count that have none; (documents, pages) hashed."""
        if tools.hashes is None:
            return 0, 0
        stored = self.store.read("page_hash")
        pending = duplicates.pending_hash(self.store.read("document"), self.store.read("occurrence"), stored, limit)
        with rounds(self.spark) as keep:
            new = keep(pages.hashes(pending, self.root, tools.hashes).withColumn("computed_at", F.current_timestamp()))
        change = self.store.change()
        change.append("page_hash", new.select(*stored.columns))
        change.commit()
        row = new.agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("pages")).first()
        return row["documents"], row["pages"]

    def dupes(self, max_distance: int = duplicates.MAX_DISTANCE, tools: Tools = Tools()) -> dict:
        """All tiers, after a backfill of page hashes; near and contained pairs are queued for review."""
        hashed, n_pages = self.hash_pages(tools)
        arrays = duplicates.page_arrays(self.store.read("page_hash"))
        near = duplicates.near_matches(arrays, max_distance).select(F.lit("near").alias("kind"), "document_a", "document_b", "score", F.lit(None).cast("string").alias("detail"))
        subset = duplicates.subset_matches(arrays, max_distance).select(F.lit("subset").alias("kind"), "document_a", "document_b", "score", F.lit(None).cast("string").alias("detail"))
        merged, new = duplicates.queue(self.store.read("dupe_review"), near.unionByName(subset), F.current_timestamp())
        exact = duplicates.exact_totals(duplicates.exact_groups(self.store.read("occurrence"))).first().asDict()
        counts = exact | {"near": near.count(), "subset": subset.count(), "queued": new.count(), "hashed_documents": hashed, "hashed_pages": n_pages}
        self.store.commit({"dupe_review": merged})
        return counts

    def label(self, kind: str, a: int, b: int, verdict: str, source: str = "human") -> None:
        if kind not in duplicates.LABEL_KINDS:
            raise ValueError(f"unknown kind {kind}")
        said = self.spark.createDataFrame([(kind, a, b, verdict, source)], "kind string, document_a long, document_b long, verdict string, source string")
        labels, reviews = duplicates.label(self.store.read("dupe_label"), self.store.read("dupe_review"), said, F.current_timestamp())
        self.store.commit({"dupe_label": labels, "dupe_review": reviews})

    def labels(self) -> DataFrame:
        """W9. Labels in the order in which they were given."""
        return self.store.read("dupe_label").orderBy("labelled_at", *duplicates.REVIEW_KEY)

    def pending(self, limit: int | None = None) -> DataFrame:
        """W8."""
        found = duplicates.pending(self.store.read("dupe_review"))
        return found.limit(limit) if limit else found

    def ocr(self, tools: Tools, connect=None, ladder: tuple[str, ...] = reading.LADDER, least: float = reading.MIN_CONFIDENCE, limit: int | None = None, top: tuple[str, ...] = (), unit: int = UNIT) -> dict[str, int]:
        """I2-I7. Walk the ladder over every page of live documents that is neither done nor spent; counters of this run.

        The documents are dealt into units of about ``unit``.  Each is committed as it ends,
        and then marked as done with its counters, so a run that breaks off loses no page
        of a unit that was done.  The same call, over the same documents, takes the run up
        where it broke off: units that are marked are not read again, and count.
        """
        documents, occurrences = self.store.read("document"), self.store.read("occurrence")
        if tools.layers is None:
            return {"documents": 0, "skipped": documents.count()}
        live = occurrences.filter(F.col("missing_since").isNull())
        paths = documents.select("document_id").join(duplicates.first_path_min(live), "document_id")
        paths = paths.orderBy("document_id").limit(limit) if limit else paths
        with rounds(self.spark) as keep:
            paths = keep(paths)
            own = F.xxhash64("document_id", "rel_path").cast("decimal(38,0)")
            n, print_ = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(own), F.lit(0)).cast("string")).first()
            units = max(1, -(-n // unit))
            named = hashlib.sha256(json.dumps([ladder, least, limit, top, units, print_]).encode()).hexdigest()[:16]
            folder, total = f"{self.store.path}/reading/{named}", Counter()
            done = {x for x in self.store.files.names(folder) if x.endswith(".json")}
            for k in range(units):
                mark = f"{folder}/{k}.json"
                if f"{k}.json" in done:
                    total.update(json.loads(self.store.files.read(mark)))
                    continue
                mine = paths.filter(F.pmod(F.xxhash64("document_id"), F.lit(units)) == k) if units > 1 else paths
                counts = self._read_unit(mine, live, tools, connect, ladder, least, top)
                self.store.files.write(mark, json.dumps(counts))
                total.update(counts)
            self.store.files.delete(folder)
            return dict(total)

    def _read_unit(self, paths: DataFrame, live: DataFrame, tools: Tools, connect, ladder: tuple[str, ...], least: float, top: tuple[str, ...]) -> dict[str, int]:
        """Read some documents (document_id, rel_path) and commit what was read; the counters."""
        stamp = datetime.now(timezone.utc)
        _, stored = self.store.change().hold("page_ocr", paths, ["document_id"])
        with rounds(self.spark) as keep:
            read = keep(pages.layers(paths, self.root, tools.layers))
            known = stored.select("document_id", "page_number", *[F.col(c).alias(f"old_{c}") for c in ("confidence", "rung", "status", "note")])
            rows = read.filter("page_number IS NOT NULL").join(known, ["document_id", "page_number"], "left")
            start = reading.resume_index(F.col("old_rung"), F.col("old_status"), F.col("old_note"), ladder)
            rows = rows.withColumn("start", start).filter(~reading.is_done(F.col("old_confidence"), least) & (F.col("start") < len(ladder)))
            rows = rows.withColumn("layer_confidence", text.confidence_of(F.col("layer_text")))
            at = {name: ladder.index(name) if name in ladder else len(ladder) for name in reading.LADDER}
            rows = keep(pages.recognised(rows.withColumn("wanted", (F.col("start") <= at["local"]) & (F.col("layer_confidence") < least) & F.lit("local" in ladder)), self.root, tools.recognise))
            read_here = reading.local_result(F.col("layer_text"), F.col("layer_confidence"), F.col("ocr_text"), F.col("ocr_confidence"), F.lit(tools.recognise is not None), F.col("rendered"), least)
            sure = (F.col("start") <= at["local"]) & (F.col("local.confidence") >= least)
            rows = rows.withColumn("local", read_here).withColumn("asks", F.lit("drive" in ladder) & (F.col("start") <= at["drive"]) & ~F.coalesce(sure, F.lit(False)))
            places = F.array_sort(F.collect_list(F.struct("rel_path", "size_bytes")))
            asked = live.join(rows.filter("asks").select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(places.alias("places"))
            rows = rows.join(remote.texts(asked, connect, top), "document_id", "left")
            first = F.col("page_number") == F.min(F.when(F.col("asks"), F.col("page_number"))).over(Window.partitionBy("document_id"))
            rungs = {"local": F.col("local"), "drive": reading.drive_result(F.col("answer"), F.col("answer_note"), first), "vision": reading.vision_result()}
            results = F.array(*[rungs.get(name, reading.unknown_result(name)) for name in ladder])
            seed = F.when(F.startswith("old_note", F.lit("drive_")), F.col("old_note"))
            rows = rows.withColumn("out", reading.walk(F.slice(results, F.col("start") + 1, F.lit(len(ladder))), least, seed))
            new = rows.select("document_id", "page_number", *[F.col(f"out.{c}").alias(c) for c in ("text", "confidence", "rung", "ocr_source", "status", "note")], F.lit(stamp).alias("updated_at"))
            seen = read.agg(F.count_distinct(F.when(F.col("page_number").isNotNull(), F.col("document_id"))).alias("documents"), F.count_if(F.col("page_number").isNull()).alias("errors")).first().asDict()
            new = keep(reading.keep_earlier(new, stored))
            self._read(new)
            return reading.summary(new).first().asDict() | seen

    def _read(self, new: DataFrame) -> None:
        """Commit pages that were read, the texts rolled up of their documents, and the index of those that changed; files of others stay."""
        change = self.store.change()
        new = change.keep(new)
        touched = change.keep(new.select("document_id").distinct())
        held, pages = change.hold("page_ocr", touched, ["document_id"])
        rolled = reading.roll_up(reading.upsert_pages(pages, new)).select("document_id", F.col("ocr_text").alias("t__"), F.col("ocr_source").alias("s__"), F.lit(True).alias("hit__"))
        files, docs = change.hold("document", touched, ["document_id"])
        joined = docs.join(rolled, "document_id", "left")
        joined = joined.withColumns({"ocr_text": F.when(F.col("hit__"), F.col("t__")).otherwise(F.col("ocr_text")), "ocr_source": F.when(F.col("hit__"), F.col("s__")).otherwise(F.col("ocr_source"))})
        joined = joined.withColumn("updated_at", F.when(F.col("hit__"), F.current_timestamp()).otherwise(F.col("updated_at")))
        joined = change.keep(joined.select(*docs.columns))
        index.update(change, docs, joined)
        change.merge("page_ocr", ["document_id", "page_number"], new.select(*pages.columns), held=held)
        change.merge("document", ["document_id"], joined, held=files)
        change.commit()

    def submit(self, document_id: int, rung: str, body: str, page: int | None = None) -> dict:
        """I7, I8, S12. An agent's text: of a page at vision, or of a document at drive, which lands on its lowest waiting page."""
        row = self.store.read("document").filter(F.col("document_id") == document_id).first()
        if row is None:
            raise ValueError("no such document")
        empty = rung == "drive" and page is None and not body.strip()
        if not empty and (why := reading.submit_error(row.page_count, page, rung, body)) is not None:
            raise ValueError(why)
        stamp = datetime.now(timezone.utc)
        _, stored = self.store.change().hold("page_ocr", self.spark.createDataFrame([(document_id,)], "document_id long"), ["document_id"])
        if rung == "vision":
            self._read(self.spark.createDataFrame([(document_id, page, body, 1.0, rung, rung, "ok", None, stamp)], stored.schema))
            return {"document_id": document_id, "page": page, "chars": len(body)}
        waiting = stored.filter((F.col("document_id") == document_id) & F.col("status").isin("pending_drive", "pending_vision"))
        n = waiting.count()
        if n:
            first = F.col("page_number") == F.min("page_number").over(Window.partitionBy("document_id"))
            out = reading.drive_result(F.lit(body), F.lit(None), first)
            new = waiting.withColumn("out", out).select("document_id", "page_number", *[F.col(f"out.{c}").alias(c) for c in ("text", "confidence", "rung", "ocr_source", "status", "note")], F.lit(stamp).alias("updated_at"))
            with rounds(self.spark) as keep:
                self._read(keep(reading.keep_earlier(new, stored)))
        return {"document_id": document_id, "pages_marked": n, "empty": empty, "chars": len(body)}

    def find(self, query: str, limit: int = search.DEFAULT_LIMIT) -> DataFrame:
        """J7, W5. The best documents from the stored index, with what is shown of each."""
        state = self.store.state()
        docs, rows, lens = (self.store.read(t, state) for t in ("document", "posting", "doc_length"))
        tree = search.parse(search.escape(query))
        if limit and index.of_words(tree):
            found = index.best(query, rows, lens, limit, index.totals(self.store.entries("doc_length", state))).rows
        else:
            found = search.find(query, index.flat(rows, lens), lens, limit)
        words = sorted({w for leaf in search.leaves(tree) for p in (leaf.parts or (leaf,)) for w in p.words})
        shown = docs.join(F.broadcast(found.select("document_id")), "document_id", "left_semi") if limit and limit <= 10_000 else docs
        shown = shown.select("document_id", "sha256", "mime", "page_count", (search.snippet(F.col("ocr_text"), words) if words else F.lit("")).alias("snippet"))
        return search.hits(found, shown, self.store.read("occurrence", state))

    def classify(self, document_id: int, **verdict) -> None:
        schema, change = self.store.schema("classification"), self.store.change()
        row = {f.name: None for f in schema} | verdict | {"document_id": document_id, "provenance": "agent"}
        new = self.spark.createDataFrame([tuple(row[f.name] for f in schema)], schema)
        held, stored = change.hold("classification", new, ["document_id"])
        change.merge("classification", ["document_id"], change.keep(classify.upsert(stored, new, F.current_timestamp())), held=held)
        change.commit()

    def propose(self, taxonomy: Taxonomy, template: str = plan.DEFAULT_TEMPLATE, current_year: int | None = None) -> DataFrame:
        """Entries of a plan: every live document with its verdict, name and status."""
        year = current_year or datetime.now(timezone.utc).year
        rows = classify.plan_rows(self.store.read("document"), self.store.read("occurrence"), self.store.read("classification"))
        said = classify.verdicts(rows, taxonomy, year)
        known = plan.targets(said.filter("provenance IS NOT NULL"), template)
        there = listing.listing(self.spark, self.root).select(F.col("rel_path").alias("disk__"))
        known = known.join(there, F.col("target_path") == F.col("disk__"), "left").withColumn("on_disk", F.col("disk__").isNotNull()).drop("disk__")
        known = known.join(there, F.col("suffixed_path") == F.col("disk__"), "left").withColumn("suffixed_on_disk", F.col("disk__").isNotNull()).drop("disk__")
        planned = plan.claims(known)
        planned = planned.withColumn("status", F.when(plan.inside_root(F.col("target_path")), F.col("status")).otherwise("error"))
        return planned.unionByName(said.filter("provenance IS NULL").withColumn("status", F.lit("unclassified")), allowMissingColumns=True)

    def write_plan(self, entries: DataFrame, path: str, template: str = plan.DEFAULT_TEMPLATE) -> str:
        """M8."""
        plan_id = f"plan-{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{secrets.token_hex(3)}"
        plan.write(entries, path, self.root, plan_id, template)
        return plan_id

    def apply(self, plan_path: str, log: str, dry_run: bool = False) -> dict[str, int]:
        """The moves of a plan; the index follows: paths of moved files, the plan's fields, and the log."""
        planned = moves.read_plan(plan_path)
        done = moves.apply(planned, self.root, moves.Log(log), datetime.now(timezone.utc), dry_run)
        if not dry_run:
            self._follow([o for o in done if o.status == "moved"], log, {e["document_id"]: e for e in planned["entries"]})
        return moves.histogram(done)

    def undo(self, plan_id: str, log: str) -> dict[str, int]:
        done = moves.undo(plan_id, self.root, moves.Log(log), datetime.now(timezone.utc))
        self._follow([o for o in done if o.status == "reversed"], log, {})
        return moves.histogram(done)

    def _follow(self, moved: list[moves.Outcome], log: str, entries: dict[int, dict]) -> None:
        """K13. Point occurrences at where files are now; a path that is indexed already is left to the next scan."""
        if not moved:
            return
        rows = []
        for o in moved:
            stat = os.stat(os.path.join(self.root, o.to_path))
            fields = entries.get(o.document_id)
            rows.append((o.document_id, o.from_path, o.to_path, stat.st_mtime, stat.st_size, fields is not None, *[(fields or {}).get(c) for c in ("doc_date", "party", "doc_type", "detail")]))
        kinds = "document_id long, from_path string, to_path string, new_mtime double, new_size long, told boolean, doc_date string, party string, doc_type string, detail string"
        landed = self.spark.createDataFrame(rows, kinds)
        change = self.store.change()
        _, taken = change.hold("occurrence", landed.select(F.col("to_path").alias("rel_path")), ["rel_path"])
        held, occurrences = change.hold("occurrence", landed.select(F.col("from_path").alias("rel_path")), ["rel_path"])
        files, documents = change.hold("document", landed, ["document_id"])
        go = landed.join(taken.select(F.col("rel_path").alias("to_path")), "to_path", "left_anti").select(F.col("document_id").alias("d__"), "from_path", "to_path", "new_mtime", "new_size")
        joined = occurrences.join(go, (F.col("document_id") == F.col("d__")) & (F.col("rel_path") == F.col("from_path")))
        at = {"rel_path": "to_path", "mtime": "new_mtime", "size_bytes": "new_size"}
        gone = change.keep(joined.select("rel_path"))
        moved_ = change.keep(joined.select(*[F.col(at.get(c, c)).alias(c) for c in occurrences.columns]))
        told = landed.filter("told").select(F.col("document_id").alias("d__"), "told", *[text.clean_field(F.col(c)).alias(f"new_{c}") for c in ("party", "doc_type", "detail")], text.iso_gate(F.col("doc_date")).alias("new_doc_date"))
        joined = documents.join(told, F.col("document_id") == F.col("d__"), "left")
        new = {c: F.when(F.col("told"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("doc_date", "party", "doc_type", "detail")} | {"updated_at": F.when(F.col("told"), F.current_timestamp()).otherwise(F.col("updated_at"))}
        documents = change.keep(joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in documents.columns]))
        change.merge("occurrence", ["rel_path"], moved_, gone, held)
        change.merge("document", ["document_id"], documents, held=files)
        change.replace("move_log", self.spark.createDataFrame(moves.Log(log).rows(), TABLES["move_log"]))
        change.commit()

    def snapshot(self, folder: str) -> dict:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        made = {"snapshot": self.store.snapshot(folder, now), "rotated": rotate(folder, now, self.spark)}
        self.store.clean()
        return made

    def restore(self, snapshot: str, dry_run: bool = False) -> dict[str, int]:
        return self.store.restore(snapshot, dry_run)

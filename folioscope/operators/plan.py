"""Proposed names and places of documents."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import casefold, sanitize_component
from folioscope.operators.rules import ConfigError
from folioscope.scratch import rounds

PLAN_VERSION = 2
DEFAULT_TEMPLATE = "{doc_date}_{party}_{doc_type}_{detail}"
STATUSES = ("move", "noop", "unclassified", "collision", "error")


def render_name(template: str, fields: Mapping[str, Column], ascii_only: bool = False) -> Column:
    """T14. A template over sanitised fields; '' if all are empty.

    An empty field goes with the literal before it; the literal before the first field
    that is there goes too; the literal at the end stays if any field is there.
    """
    if not template.strip():
        raise ConfigError("template must not be empty")
    pieces = re.split(r"\{(\w+)\}", template)
    for name in pieces[1::2]:
        if name not in fields:
            raise ConfigError(f"template: unknown field {{{name}}}")
    if any(c in p for p in pieces[0::2] for c in "/\\"):
        raise ConfigError("template renders a path, not a file name")
    parts = [F.struct(F.lit(literal).alias("before"), sanitize_component(fields[name], ascii_only).alias("value")) for literal, name in zip(pieces[0::2], pieces[1::2], strict=False)]
    if not parts:
        return F.lit("")

    def add(out: Column, part: Column) -> Column:
        between = F.when(F.length(out) > 0, part["before"]).otherwise("")
        return F.when(F.length(part["value"]) > 0, F.concat(out, between, part["value"])).otherwise(out)

    return F.trim(F.aggregate(F.array(*parts), F.lit(""), add, lambda out: F.when(F.length(out) > 0, F.concat(out, F.lit(pieces[-1]))).otherwise("")))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last suffix of a file name; a name that only begins with a dot has none."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"(?s)^.*[^.].*?(\.[^./]+)$|^[^.]+(\.[^./]+)$", 1)


def collision_suffix(sha: Column) -> Column:
    """T15. First six hex digits, or null if there are fewer."""
    digits = F.regexp_replace(F.lower(sha), "[^0-9a-f]", "")
    return F.when(F.length(digits) >= 6, F.substring(digits, 1, 6))


def inside_root(path: Column) -> Column:
    """P9. Whether a relative path stays below the root, by its text alone."""
    deep = F.aggregate(
        F.split(F.translate(path, "\\", "/"), "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda s, p: F.struct(
            (s["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(s["least"], s["at"] + F.when(p == "..", -1).otherwise(0)).alias("least"),
        ),
    )
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & (deep["least"] >= 0)


def targets(rows: DataFrame, template: str = DEFAULT_TEMPLATE, ascii_only: bool = False) -> DataFrame:
    """T16. Adds name, target_path, target_key and collision suffix to rows with rel_path, sha256, folder and the four fields."""
    name = render_name(template, {c: F.col(c) for c in ("doc_date", "party", "doc_type", "detail")}, ascii_only)
    rows = rows.withColumn("name", name)
    place = F.coalesce(F.when(F.length("folder") > 0, F.col("folder")), parent(F.col("rel_path")))
    place = F.when(place == ".", "").otherwise(place)
    under = lambda n: F.when(F.length("place") > 0, F.concat_ws("/", "place", n)).otherwise(n)
    end = F.coalesce(suffix(F.col("rel_path")), F.lit(""))
    out = rows.withColumn("place", place).withColumn("end__", end)
    out = out.withColumn("target_path", under(F.concat("name", "end__")))
    out = out.withColumn("suffix6", collision_suffix(F.col("sha256"))).withColumn("suffixed_path", under(F.concat("name", F.lit("_"), "suffix6", "end__")))
    return out.withColumn("target_key", F.lower("target_path")).drop("end__")


def first_pass(planned: DataFrame) -> DataFrame:
    """W4. status, claimed_by and final_path by a window over equal targets.

    The first claimer of a target keeps it - documents in order of id; one that stays
    where it is claims too, one whose target is on disk (column ``on_disk``) does not.
    Equal to ``claims`` unless a suffixed target is another document's plain target.
    """
    claims = F.when((F.col("target_path") == F.col("rel_path")) | ~F.col("on_disk"), F.col("document_id"))
    before = Window.partitionBy("target_key").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)
    out = planned.withColumn("claimed_by", F.min(claims).over(before))
    taken, stays = F.col("claimed_by").isNotNull(), F.col("target_path") == F.col("rel_path")
    status = (
        F.when(F.length("name") == 0, "error")
        .when(stays, "noop")
        .when(taken & F.col("suffix6").isNull(), "collision")
        .when(taken & (F.col("suffixed_path") == F.col("rel_path")), "noop")
        .when(~taken & F.col("on_disk"), "collision")
        .otherwise("move")
    )
    out = out.withColumn("status", status)
    moved = F.when(taken & ~stays & F.col("suffix6").isNotNull(), F.col("suffixed_path")).otherwise(F.col("target_path"))
    return out.withColumn("final_path", F.when(F.col("status").isin("move", "noop"), moved))


def _clashes(planned: DataFrame, keep) -> DataFrame:
    """(target_key, clash): targets whose claims meet those of another target, under the least of all that hang together.

    Two targets meet where a suffixed path of one is the other or a suffixed path of the other.
    """
    own = planned.select("target_key", F.col("target_key").alias("key__"))
    more = planned.filter("suffixed_path IS NOT NULL").select("target_key", casefold(F.col("suffixed_path")).alias("key__"))
    met = own.unionByName(more).groupBy("key__").agg(F.min("target_key").alias("a"), F.max("target_key").alias("b"))
    met = keep(met.filter("a <> b").select("key__"))  # few, of a size that the planner then knows
    edges = keep(own.unionByName(more).join(met, "key__").select("key__", "target_key").distinct())
    label = keep(edges.select("target_key", F.col("target_key").alias("clash")).distinct())
    while True:
        least = edges.join(label, "target_key").groupBy("key__").agg(F.min("clash").alias("clash"))
        now = keep(edges.join(least, "key__").groupBy("target_key").agg(F.min("clash").alias("clash")))
        if not now.join(label, ["target_key", "clash"], "left_anti").limit(1).count():
            return now
        label = now


def claims(planned: DataFrame) -> DataFrame:
    """H3. status, final_path and claimed_by of every document, in order of id.

    Windows over equal targets decide, except in folders where a suffixed target is there
    already, on disk or as another document's plain or suffixed target: only these are
    folded, document by document.
    """
    passed = first_pass(planned).withColumn("folder__", F.lower("place"))
    suffixed = passed.filter("claimed_by IS NOT NULL AND suffix6 IS NOT NULL AND target_path <> rel_path AND suffixed_path <> rel_path")
    suffixed = suffixed.select("folder__", F.lower("suffixed_path").alias("key__"), F.coalesce("suffixed_on_disk", F.lit(False)).alias("there__"))
    twice = suffixed.groupBy("folder__", "key__").agg(F.count(F.lit(1)).alias("n__"), F.max("there__").alias("there__"))
    plain = planned.select(F.lower("place").alias("folder__"), F.col("target_key").alias("key__")).distinct().withColumn("plain__", F.lit(True))
    odd = twice.join(plain, ["folder__", "key__"], "left").filter("n__ > 1 OR there__ OR plain__").select("folder__").distinct()
    kept = [*planned.columns, "status", "final_path", "claimed_by"]
    easy = passed.join(odd, "folder__", "left_anti").select(*kept)
    return easy.unionByName(_folded(planned.withColumn("folder__", F.lower("place")).join(odd, "folder__", "left_semi").withColumnRenamed("folder__", "clash__")).select(*kept))


def fold(planned: DataFrame) -> DataFrame:
    """H3. The exact order of claims: a fold by id over the documents of each target, and of targets that suffixed paths tie together.

    Adds status, final_path, claimed_by.  ``on_disk`` and ``suffixed_on_disk`` tell what is there.
    """
    with rounds(planned.sparkSession) as keep:
        planned = keep(planned)
        tied = planned.join(_clashes(planned, keep), "target_key", "left")
        return keep(_folded(tied.withColumn("clash__", F.coalesce("clash", "target_key", F.lit(""))).drop("clash")))


def _folded(tied: DataFrame) -> DataFrame:
    """The fold by ``clash__``; a task streams its documents and holds the paths that were taken of one group."""
    fields = [f for f in tied.schema.fields if f.name != "clash__"]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", status string, final_path string, claimed_by long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[str, int] = {}
        group = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.select(["clash__", "document_id", "name", "rel_path", "target_path", "target_key", "suffixed_path", "on_disk", "suffixed_on_disk"]).to_pylist():
                if row["clash__"] != group:
                    taken, group = {}, row["clash__"]
                id_, key, path = row["document_id"], row["target_key"], row["suffixed_path"]
                if not row["name"]:
                    out.append(("error", None, None))
                elif row["target_path"] == row["rel_path"]:
                    taken.setdefault(key, id_)
                    out.append(("noop", row["target_path"], None))
                elif key in taken:
                    by = taken[key]
                    if path is None:
                        out.append(("collision", None, by))
                    elif path == row["rel_path"]:
                        taken.setdefault(path.casefold(), id_)
                        out.append(("noop", path, by))
                    elif path.casefold() in taken or row["suffixed_on_disk"]:
                        out.append(("collision", None, by))
                    else:
                        taken.setdefault(path.casefold(), id_)
                        out.append(("move", path, by))
                elif row["on_disk"]:
                    out.append(("collision", None, None))
                else:
                    taken.setdefault(key, id_)
                    out.append(("move", row["target_path"], None))
            said = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *said], [*names, "status", "final_path", "claimed_by"])

    dealt = tied.repartition("clash__").sortWithinPartitions("clash__", "document_id")
    return dealt.mapInArrow(run, schema)


def summary(entries: DataFrame) -> DataFrame:
    """A6. One row: documents, one counter for each status, and one for each provenance."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    by = [F.count_if(F.col("provenance") == p).alias(f"by_{p}") for p in ("agent", "rule")] if "provenance" in entries.columns else []
    return entries.agg(F.count(F.lit(1)).alias("documents"), *counts, *by)


def write(entries: DataFrame, path: str, root: str, plan_id: str, template: str = DEFAULT_TEMPLATE) -> None:
    """K9. One JSON file, complete or not at all; refused below the root.

    A plan is for a person to review, so its entries are written by the driver, one at
    a time.
    """
    full, top = os.path.realpath(path), os.path.realpath(root)
    if full == top or full.startswith(top + os.sep):
        raise ValueError("a plan may not lie below the document root")
    head = {"plan_version": PLAN_VERSION, "plan_id": plan_id, "root": top, "template": template, "summary": summary(entries).first().asDict()}
    with open(f"{full}.part", "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "entries": [')
        for k, row in enumerate(entries.orderBy("document_id").toJSON().toLocalIterator()):
            f.write(("," if k else "") + "\n" + row)
        f.write("\n]}\n")
    os.replace(f"{full}.part", full)

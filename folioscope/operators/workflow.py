"""Analytics over issue records: lanes, claims, digests, duplicates, dependencies.

An issue is (number, state, created_at, labels, blocked_by, blocking): labels are names,
edges are structs (number, state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import graph

# Words that say nothing about a title.
STOPWORDS = "a an and or of to in on for is it with by as at be this that from into over per the when via not no so if but are was has can".split()
# Labels that park an issue, the label that locks one, and those that tell of its readiness.
HOLD, NEEDS_HUMAN, WIP, BLOCKED, READY = "sdlc:hold", "sdlc:needs-human", "sdlc:wip", "blocked", "ready"
# Stages in order, and the stages that each may go to.
STEPS = {
    "intake": ("design", "queued", "verify"), "design": ("queued", "intake"), "queued": ("build", "design"), "build": ("verify", "queued", "design", "intake"),
    "verify": ("audit", "build"), "audit": ("ship", "build"), "ship": ("build",),
}
STAGES = tuple(STEPS)
# Priorities, best first; stages that a conflict sends back to build.
PRIORITIES = ("critical", "medium", "future")
BOUNCED = ("verify", "audit", "ship")
#: Buckets of issues that cannot run, in order of precedence.
INELIGIBLE = ("hold", "needs-human", "wip", "blocked")


def stages(labels: Column) -> Column:
    """M16. Stage names among the labels."""
    return F.transform(F.filter(labels, lambda x: x.startswith("stage:")), lambda x: F.substring(x, 7, 1000))


def edges(raw: Column) -> Column:
    """T32. Edges that name an issue; one without a state is open."""
    named = F.filter(F.coalesce(raw, F.array().cast("array<struct<number:bigint,state:string>>")), lambda e: e.isNotNull() & e["number"].isNotNull())
    return F.transform(named, lambda e: F.struct(e["number"].cast("bigint").alias("number"), F.upper(F.coalesce(e["state"], F.lit("OPEN"))).alias("state")))


def open_blockers(blocked_by: Column) -> Column:
    """T32. Numbers of the blockers that are open, rising."""
    still = F.filter(edges(blocked_by), lambda e: e["state"] == "OPEN")
    return F.array_sort(F.transform(still, lambda e: e["number"]))


def priority_rank(labels: Column) -> Column:
    """W13. Rank of the best ``priority:`` label; none is last."""
    out = F.lit(len(PRIORITIES))
    for rank, name in reversed(list(enumerate(PRIORITIES))):
        out = F.when(F.array_contains(labels, f"priority:{name}"), F.lit(rank)).otherwise(out)
    return out


def reasons(labels: Column, blocked_by: Column) -> Column:
    """M17. All reasons why an issue cannot run, in order of precedence."""
    tests = (F.array_contains(labels, HOLD), F.array_contains(labels, NEEDS_HUMAN), F.array_contains(labels, WIP), F.size(open_blockers(blocked_by)) > 0)
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in zip(INELIGIBLE, tests, strict=True)]))


def _laned(issues: DataFrame) -> DataFrame:
    """Issues by each of their stages that the pipeline has, with the first reason against them."""
    state = F.coalesce(F.get(reasons(F.col("labels"), F.col("blocked_by")), F.lit(0)), F.lit("eligible"))
    return issues.withColumn("lane_state", state).withColumn("lane", F.explode(stages(F.col("labels")))).filter(F.col("lane").isin(*STAGES))


def lane_summary(issues: DataFrame) -> DataFrame:
    """A15. Depth of every lane, empty ones too, and how many issues are eligible or, by one reason each, are not."""
    count = lambda s: F.count_if(F.col("lane_state") == s).alias(s.replace("-", "_"))
    found = _laned(issues).groupBy("lane").agg(F.count(F.lit(1)).alias("depth"), *[count(s) for s in ("eligible", *INELIGIBLE)])
    every = issues.sparkSession.createDataFrame([(s,) for s in STAGES], "lane string")
    return every.join(found, "lane", "left").fillna(0)


def lane_order(issues: DataFrame) -> DataFrame:
    """W13. (lane, place, number) of eligible issues: by priority, then first come, then number.

    Places are those within a day and priority of a lane, after what comes before the day: no lane is sorted in one task.
    """
    rows = _laned(issues).filter("lane_state = 'eligible'").select("lane", priority_rank(F.col("labels")).alias("rank"), F.to_date("created_at").alias("day"), "created_at", "number")
    before = Window.partitionBy("lane").orderBy("rank", "day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("lane", "rank", "day").agg(F.count(F.lit(1)).alias("n")).select("lane", "rank", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    days = days.select(F.col("lane").alias("lane_"), F.col("rank").alias("rank_"), F.col("day").alias("day_"), "base")
    within = F.row_number().over(Window.partitionBy("lane", "rank", "day").orderBy("created_at", "number"))
    placed = rows.withColumn("within", within).join(days, (F.col("lane") == F.col("lane_")) & (F.col("rank") == F.col("rank_")) & F.col("day").eqNullSafe(F.col("day_")))
    return placed.select("lane", (F.col("base") + F.col("within")).cast("int").alias("place"), "number")


def integrity(issues: DataFrame) -> DataFrame:
    """M16. Issues with several stages, or with none although they are flagged."""
    n = F.size(stages(F.col("labels")))
    flagged = F.array_contains("labels", WIP) | F.array_contains("labels", NEEDS_HUMAN)
    return issues.filter((n > 1) | ((n == 0) & flagged)).select("number", stages(F.col("labels")).alias("stages"))


def stalled(issues: DataFrame, lane: str) -> DataFrame:
    """M18. Locked issues of a lane, rising."""
    return issues.filter(F.array_contains("labels", f"stage:{lane}") & F.array_contains("labels", WIP)).select("number").orderBy("number")


def claim_winner(comments: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """W14. (issue, run_id) of the earliest claim after the last outcome; ties go to the lower run.

    ``boundaries`` (issue, at): when the lock was last taken off; claims up to then are settled.
    """
    outcome = F.col("body").rlike(r"^(sdlc:emit\s|ADVANCE|BOUNCE|PARK|CONTINUE|sdlc-dispatch: reaped)")
    last = comments.filter(outcome).groupBy("issue").agg(F.max("pos").alias("last"))
    run = F.regexp_extract("body", r"^sdlc:claim\s+(\S+)", 1)
    live = comments.withColumn("run_id", run).filter("run_id <> ''").join(last, "issue", "left").filter("last IS NULL OR pos > last")
    if boundaries is not None:
        live = live.join(boundaries.select("issue", "at"), "issue", "left").filter("at IS NULL OR created_at > at")
    return live.groupBy("issue").agg(F.min(F.struct("created_at", "run_id"))["run_id"].alias("run_id"))


def bounces(comments: DataFrame) -> DataFrame:
    """A16. (from_stage, to_stage, n) of comments that begin with a bounce, most first.

    The stage it came from is the last part of the run's name, ``?`` if that is no stage; ``?`` too where no target is named.
    """
    marker = r"^sdlc:emit\s+(\S+)\s+BOUNCE(?:\s+(?:→|->)\s*stage:(\S+))?"
    line = F.substring_index("body", "\n", 1)
    rows = comments.filter(line.rlike(marker)).select(F.regexp_extract(line, marker, 1).alias("run"), F.regexp_extract(line, marker, 2).alias("to"))
    lane = F.substring_index("run", "-", -1)
    rows = rows.select(F.when(lane.isin(*STAGES), lane).otherwise("?").alias("from_stage"), F.when(F.col("to") == "", "?").otherwise(F.col("to")).alias("to_stage"))
    return rows.groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_stage", "to_stage")


def latest_label(events: DataFrame) -> DataFrame:
    """A17. Last time each label was put on or taken off an issue."""
    return events.filter(F.col("event").isin("labeled", "unlabeled")).groupBy("issue", "label", "event").agg(F.max("created_at").alias("at"))


def digest_diff(before: DataFrame, after: DataFrame, key: str = "number") -> DataFrame:
    """G1. (key, change): arrived or departed between two snapshots."""
    gone = before.select(key).join(after.select(key), key, "left_anti").select(key, F.lit("departed").alias("change"))
    new = after.select(key).join(before.select(key), key, "left_anti").select(key, F.lit("arrived").alias("change"))
    return new.unionByName(gone).distinct()


def baseline_compare(baseline: DataFrame, current: DataFrame, key: str = "rule") -> DataFrame:
    """J15, G2. Counts of both sides over the union of keys, and whether one grew."""
    b, c = baseline.select(key, F.col("n").alias("was")), current.select(key, F.col("n").alias("now"))
    out = b.join(c, key, "full_outer").select(key, F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    return out.withColumn("grew", F.col("now") > F.col("was"))


def rule_counts(files: DataFrame) -> DataFrame:
    """A14. (rule, n) of errors, severity 2, in reports with messages; no rule is a fatal error."""
    message = files.select(F.explode("messages").alias("m")).filter("m.severity = 2")
    return message.groupBy(F.coalesce("m.rule", F.lit("fatal")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) >= 2 and t not in STOPWORDS))


def dup_candidates(query: str, issues: DataFrame, title: int = 3, body: int = 1, label: int = 1, limit: int | None = 10, exclude: int | None = None) -> DataFrame:
    """T29, W15. (number, score): each term of the query counts in the title, else in the body; in a label on top.

    A text is cut into words once, however many terms there are.
    """
    terms = F.array(*map(F.lit, query_terms(query))).cast("array<string>")
    found = lambda c: F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), terms)
    in_title, in_body, in_label = found(F.col("title")), found(F.col("body")), found(F.array_join("labels", " "))
    score = title * F.size(in_title) + body * F.size(F.array_except(in_body, in_title)) + label * F.size(in_label)
    rows = issues if exclude is None else issues.filter(F.col("number") != exclude)
    # Exploded, as a filter by the score would be pushed down and cut the texts once more.
    some = F.explode(F.filter(F.array("score"), lambda s: s > 0)).alias("score")
    out = rows.select("number", score.alias("score")).select("number", some).orderBy(F.desc("score"), "number")
    return out.limit(limit) if limit else out


def readiness(issues: DataFrame) -> DataFrame:
    """G6. (number, verdict, add, remove, reason) of every issue: what its edges make of it, and the label edit that follows.

    blocked by an open blocker; ready if there are edges and all are closed; without edges a
    label that says blocked is ``label_only``, for a person to look at; the rest is free.
    """
    blockers = open_blockers(F.col("blocked_by"))
    verdict = F.when(F.size(blockers) > 0, "blocked").when(F.size(edges(F.col("blocked_by"))) > 0, "ready").when(F.array_contains("labels", BLOCKED), "label_only").otherwise("free")
    has = lambda x: F.array_contains("labels", x)
    v = F.col("verdict")
    add = F.when((v == "blocked") & ~has(BLOCKED), BLOCKED).when((v == "ready") & ~has(READY), READY)
    remove = F.when((v == "blocked") & has(READY), READY).when((v == "ready") & has(BLOCKED), BLOCKED)
    named = F.concat(F.when(F.size(blockers) == 1, "open blocker #").otherwise("open blockers #"), F.array_join(blockers.cast("array<string>"), ", #"))
    edited = F.col("add").isNotNull() | F.col("remove").isNotNull()
    reason = F.when(edited & (v == "blocked"), named).when(edited, F.lit("every blocker closed"))
    return issues.withColumn("verdict", verdict).withColumn("add", add).withColumn("remove", remove).select("number", "verdict", "add", "remove", reason.alias("reason"))


def sweep(closed: DataFrame, open_issues: DataFrame, swept: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """J14, G7. (closed, number, blocked, remaining, flip): open issues that a closed one blocked, by edges still told to be open.

    Closed issues that are swept already, or closed at or before ``since``, are passed over.
    flip: nothing open blocks the issue any more; remaining: what does; blocked: its label says so.
    """
    rows = closed
    if swept is not None:
        rows = rows.join(swept.select("number"), "number", "left_anti")
    if since is not None:
        rows = rows.filter(F.col("closed_at").isNull() | (F.col("closed_at") > since))
    edge = rows.select(F.col("number").alias("closed"), F.explode(edges(F.col("blocking"))).alias("e")).filter("e.state = 'OPEN'").select("closed", F.col("e.number").alias("number")).distinct()
    blockers = open_blockers(F.col("blocked_by"))
    state = open_issues.select(F.col("number"), F.array_contains("labels", BLOCKED).alias("blocked"), blockers.alias("remaining"), (F.size(blockers) == 0).alias("flip"))
    return edge.join(state, "number").select("closed", "number", "blocked", "remaining", "flip")


def swept_next(closed: DataFrame, swept: DataFrame, since: Column | None = None) -> DataFrame:
    """G7. (number, new) of the next marker: swept ones that are still listed, and all closed after ``since``; new: marked now."""
    inside = closed if since is None else closed.filter(F.col("closed_at") > since)
    before = swept.select("number").distinct().withColumn("had", F.lit(True))
    kept = closed.select("number").join(before, "number", "left_semi").select("number")
    marked = kept.unionByName(inside.select("number")).distinct()
    return marked.join(before, "number", "left").select("number", F.col("had").isNull().alias("new"))


def blocking_edges(issues: DataFrame) -> DataFrame:
    """(src, dst): open blockers dst of open issues src, if dst is in the snapshot itself."""
    rows = issues.select(F.col("number").cast("bigint").alias("src"), F.explode(open_blockers(F.col("blocked_by"))).alias("dst")).distinct()
    return rows.join(issues.select(F.col("number").cast("bigint").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def cycles(edges: DataFrame) -> DataFrame:
    """G3. (path, length) of all simple cycles of (src, dst), each from its lowest member, of any length.

    Walks are looked for inside strongly connected components only, and between places
    where ways part or meet; see ``folioscope.operators.graph``.
    """
    found = graph.simple_cycles(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")))
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.size("path").alias("length"))


def terminal_superseders(pointers: DataFrame) -> DataFrame:
    """G4. (doc, terminal): the ends of all chains of (doc, by); chains may fork, join and circle."""
    steps = pointers.filter("doc IS NOT NULL AND by IS NOT NULL").select(F.col("doc").alias("src"), F.col("by").alias("dst"))
    return graph.ends(steps).select(F.col("node").alias("doc"), F.col("end").alias("terminal"))


def citation_violations(citations: DataFrame, terminals: DataFrame) -> DataFrame:
    """G5. (source, doc): what is cited is superseded, and none of its terminals is cited beside it."""
    stale = citations.join(terminals.select("doc").distinct(), "doc", "left_semi")
    near = citations.select("source", F.col("doc").alias("terminal"))
    fine = stale.join(terminals, "doc").join(near, ["source", "terminal"], "left_semi").select("source", "doc")
    return stale.select("source", "doc").join(fine.distinct(), ["source", "doc"], "left_anti").distinct()


def two_hop(mentions: DataFrame) -> DataFrame:
    """G8. (entity, via, class_id, n_links): entities that share an identifier are a class, known by its lowest; an extension.

    n_links: the others of the class, two hops away over the identifier.  Pairs are not listed:
    two entities are linked via an identifier if they are in one class.
    """
    rows = mentions.select("entity", F.col("identifier").alias("via")).distinct()
    shared = rows.groupBy("via").agg(F.min("entity").alias("class_id"), (F.count(F.lit(1)) - 1).alias("n_links")).filter("n_links > 0")
    return rows.join(shared, "via").select("entity", "via", "class_id", "n_links")


# What a line that declares dependencies begins with: list marks, a box, emphasis, a label, then a lead word.
_LEAD = r"(?i)^\s*(?:[-*+]\s+|\d+[.)]\s+)?(?:\[[ x]\]\s+)?[*_~`\s]*(?:dependenc(?:y|ies)[*_~`\s]*:?[*_~`\s]*)?(?:depends\s+on|blocked\s+by|blocked\s+on|requires|after)\b[*_~`]*\s*:?\s*(.*)$"
# References in a row, each behind a separator and at most one other word.
_ROW = r"(?i)^(?:\s*(?:,|and|&|/)?\s*(?:[^\s#,]+\s+)?#\d+)+"


def prose_dependencies(issues: DataFrame) -> DataFrame:
    """T30. (number, blocker): numbers that lead a line like ``- Blocked by: #3, #4 and K.3b #5``, but the issue itself."""
    line = issues.select("number", F.explode(F.split(F.coalesce("body", F.lit("")), "\r?\n")).alias("line"))
    row = F.regexp_extract(F.regexp_extract("line", _LEAD, 1), _ROW, 0)
    found = line.select("number", F.explode(F.regexp_extract_all(row, F.lit(r"#(\d+)"), F.lit(1))).alias("b"))
    return found.select("number", F.col("b").try_cast("bigint").alias("blocker")).filter("blocker IS NOT NULL AND blocker <> number").distinct()


def issue_refs(text: Column) -> Column:
    """T31. Numbers of two to six digits after ``#``, not within a word or an entity."""
    return F.regexp_extract_all(text, F.lit(r"(^|[^\w&.])#(\d{2,6})(?!\w)"), F.lit(2))


def migrations(issues: DataFrame, known: DataFrame) -> DataFrame:
    """M21. (number, blocker, action, state): prose dependencies that are no edge yet: ``add`` if the issue is known, else ``skip``."""
    native = issues.select(F.col("number"), F.explode(edges(F.col("blocked_by"))).alias("e")).select("number", F.col("e.number").alias("blocker")).distinct()
    rows = prose_dependencies(issues).join(native, ["number", "blocker"], "left_anti")
    there = known.select(F.col("number").cast("bigint").alias("blocker"), F.col("state"), F.lit(True).alias("known"))
    return rows.join(there, "blocker", "left").select("number", "blocker", F.when(F.col("known"), "add").otherwise("skip").alias("action"), "state")


def transition(labels: Column, to: Column) -> Column:
    """M15. Struct (from, remove, add, error) of a move to stage ``to``: the label edit, or why it is refused."""
    found = stages(labels)
    at = F.get(found, F.lit(0))
    legal = F.lit(False)
    for stage, following in STEPS.items():
        legal = legal | ((at == stage) & to.isin(*following))
    error = (
        F.when(F.size(found) == 0, "no stage").when(F.size(found) > 1, "several stages").when(~at.isin(*STAGES), "unknown stage")
        .when(~F.coalesce(to.isin(*STAGES), F.lit(False)), "unknown target").when(at == to, "already there").when(~legal, "illegal step")
    )
    remove = F.array_compact(F.array(F.concat(F.lit("stage:"), at), F.when(F.array_contains(labels, WIP), WIP)))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(error.isNull(), at).alias("from"), F.when(error.isNull(), remove).otherwise(none).alias("remove"),
        F.when(error.isNull(), F.array(F.concat(F.lit("stage:"), to))).otherwise(none).alias("add"), error.alias("error"),
    )


def emit(labels: Column, outcome: Column, to: Column) -> Column:
    """M15. Struct (remove, add, close, error) of a worker's outcome: ADVANCE, BOUNCE, PARK, CONTINUE or CLOSE."""
    unlock, none = F.when(F.array_contains(labels, WIP), F.array(F.lit(WIP))).otherwise(F.array().cast("array<string>")), F.array().cast("array<string>")
    made = lambda remove, add, close, error: F.struct(remove.alias("remove"), add.alias("add"), F.lit(close).alias("close"), error.cast("string").alias("error"))
    fine = F.lit(None)
    step = transition(labels, to)
    last = (outcome == "ADVANCE") & (F.size(stages(labels)) == 1) & F.array_contains(labels, "stage:ship")
    return (
        F.when(outcome.isin("ADVANCE", "BOUNCE") & to.isNotNull(), made(step["remove"], step["add"], False, step["error"]))
        .when(last, made(F.concat(F.array(F.lit("stage:ship")), unlock), none, False, fine))
        .when(outcome.isin("ADVANCE", "BOUNCE"), made(none, none, False, F.lit("a target is needed")))
        .when(outcome == "PARK", made(unlock, F.array(F.lit(NEEDS_HUMAN)), False, fine))
        .when(outcome == "CONTINUE", made(unlock, none, False, fine))
        .when(outcome == "CLOSE", made(unlock, none, True, fine))
        .otherwise(made(none, none, False, F.lit("unknown outcome")))
    )


def branch_deletable(upstream_gone: Column, pr_state: Column, local_tip: Column, merged_tip: Column) -> Column:
    """M20. Whether a squash-merged branch may go: upstream gone, merged, and nothing local beyond what was merged."""
    return F.coalesce(upstream_gone & (pr_state == "MERGED") & (F.length(local_tip) > 0) & (local_tip == merged_tip), F.lit(False))


def worktree_removable(clean: Column, branch_gone: Column, issue_closed: Column) -> Column:
    """M19. Struct (remove, reason)."""
    done = F.concat_ws(", ", F.when(branch_gone, "branch gone/merged"), F.when(issue_closed, "issue closed"))
    over = branch_gone | issue_closed
    reason = F.when(~over, "active (branch present, issue open)").when(~clean, F.concat(F.lit("dirty — "), done, F.lit(" but uncommitted changes present"))).otherwise(done)
    return F.struct((clean & over).alias("remove"), reason.alias("reason"))


def focus(issues: DataFrame, wanted: DataFrame) -> DataFrame:
    """M17. (number, verdict, lane, reasons, blockers, stages) of the issues ``wanted`` (number).

    Verdicts: not-open, no-stage, multi-stage, queued, unknown-stage, ineligible, eligible.
    """
    here = issues.select("number", stages(F.col("labels")).alias("stages"), reasons(F.col("labels"), F.col("blocked_by")).alias("reasons"), open_blockers(F.col("blocked_by")).alias("blockers"), F.lit(True).alias("here"))
    rows = wanted.select("number").join(here, "number", "left")
    one = F.get("stages", F.lit(0))
    verdict = (
        F.when(F.col("here").isNull(), "not-open").when(F.size("stages") == 0, "no-stage").when(F.size("stages") > 1, "multi-stage").when(one == "queued", "queued")
        .when(~one.isin(*STAGES), "unknown-stage").when(F.size("reasons") > 0, "ineligible").otherwise("eligible")
    )
    rows = rows.withColumn("verdict", verdict)
    told = F.col("verdict").isin("ineligible", "eligible", "queued")
    return rows.select(
        "number", "verdict", F.when(told, one).alias("lane"), F.when(F.col("verdict") == "ineligible", F.col("reasons")).alias("reasons"),
        F.when(F.col("verdict") == "ineligible", F.col("blockers")).alias("blockers"), F.when(F.col("verdict").isin("multi-stage", "unknown-stage"), F.col("stages")).alias("stages"),
    )


def focus_line(row: DataFrame) -> DataFrame:
    """M23. (number, line): the verdict of ``focus`` for a person."""
    blockers = F.concat(F.lit("blocked by #"), F.array_join(F.col("blockers").cast("array<string>"), ", #"))
    why = F.array_join(F.transform("reasons", lambda r: F.when(r == "blocked", blockers).otherwise(r)), ", ")
    named = F.array_join("stages", ", ")
    v = F.col("verdict")
    said = (
        F.when(v == "eligible", F.concat(F.lit("eligible in "), "lane"))
        .when(v == "ineligible", F.concat(F.lit("ineligible in "), "lane", F.lit(" ("), why, F.lit(")")))
        .when(v == "queued", "queued (human gate)")
        .when(v == "no-stage", "no stage label")
        .when(v == "multi-stage", F.concat(F.lit("multiple stage labels ("), named, F.lit(")")))
        .when(v == "unknown-stage", F.concat(F.lit("unknown stage label ("), named, F.lit(")")))
        .otherwise("not open (closed or nonexistent)")
    )
    return row.select("number", F.concat(F.lit("focus #"), F.col("number").cast("string"), F.lit(": "), said).alias("line"))


def breakdown(counts: dict[str, Column]) -> Column:
    """M23. ``(name n, ...)`` of the counts that are not zero, or nothing."""
    parts = F.concat_ws(", ", *[F.when(c > 0, F.concat(F.lit(f"{n} "), c.cast("string"))) for n, c in counts.items()])
    return F.when(parts == "", "").otherwise(F.concat(F.lit("("), parts, F.lit(")")))


def conflicts(pulls: DataFrame, issues: DataFrame, base: str, updated: Column | None = None) -> DataFrame:
    """M22. (pull, issue, action, reason, stage, to) of pull requests into ``base`` that conflict, for each linked issue.

    comment, and a way back to build from later stages; or skip, with the reason: no linked
    issue, an issue that is closed, locked or parked, or one that was told since ``updated``.
    ``pulls``: number, head, base, mergeable, issues; ``issues``: number, state, labels, comments (body, created_at).
    """
    rows = pulls.filter((F.col("mergeable") == "CONFLICTING") & (F.col("base").isNull() | (F.col("base") == base)))
    rows = rows.select(F.col("number").alias("pull"), "head", F.explode_outer("issues").alias("issue"))
    known = issues.select(F.col("number").alias("issue_"), "state", "labels", "comments")
    body = F.concat(F.lit("sdlc-dispatch: branch "), F.col("head"), F.lit(f" conflicts with {base} — needs a merge"))
    told = F.exists("comments", lambda c: c["body"].startswith(body) & (F.lit(True) if updated is None else c["created_at"] >= updated))
    barred = F.arrays_overlap("labels", F.array(*map(F.lit, (WIP, NEEDS_HUMAN, HOLD))))
    reason = (
        F.when(F.col("issue").isNull(), "no linked issue").when(F.col("state").isNull() | (F.col("state") == "CLOSED"), "linked issue closed or not found")
        .when(barred, "issue is wip/needs-human/hold").when(F.coalesce(told, F.lit(False)), f"conflict comment already posted since last {base} update")
    )
    found = stages(F.col("labels"))
    stage = F.when((F.size(found) == 1) & F.get(found, F.lit(0)).isin(*STAGES), F.get(found, F.lit(0)))
    out = rows.join(known, F.col("issue") == F.col("issue_"), "left").withColumn("reason", reason)
    go = F.col("reason").isNull()
    out = out.withColumn("stage", F.when(go, stage))
    return out.select("pull", "issue", F.when(go, "comment").otherwise("skip").alias("action"), "reason", "stage", F.when(F.col("stage").isin(*BOUNCED), "build").alias("to"))


def stale_locks(locks: DataFrame, now: Column, hours: float = 2.0) -> DataFrame:
    """I11. Locks that are ``hours`` old or older."""
    return locks.filter(F.unix_timestamp(now) - F.unix_timestamp("taken_at") >= hours * 3600)

"""Workflow analytics over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import workflow
from folioscope.plans import adapters as ad


def lane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.lane_summary(ad.issues(spark, sf_dir))


def lane_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.lane_order(ad.issues(spark, sf_dir))


def lane_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.integrity(ad.issues(spark, sf_dir)).withColumn("stages", F.array_join("stages", ","))


def stalled_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.stalled(ad.issues(spark, sf_dir), "build")


def _focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every issue, and of numbers that no open issue has."""
    i = ad.issues(spark, sf_dir)
    wanted = i.select("number").union(i.select((F.col("number") + 10_000_000).alias("number")))
    return workflow.focus(i, wanted)


def focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _focus(spark, sf_dir)
    return found.select("number", "verdict", "lane", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("reasons", "blockers", "stages")])


def focus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.focus_line(_focus(spark, sf_dir))


def lane_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = workflow.lane_summary(ad.issues(spark, sf_dir))
    return lanes.select("lane", workflow.breakdown({n: F.col(n.replace("-", "_")) for n in workflow.INELIGIBLE}).alias("line"))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.readiness(ad.issues(spark, sf_dir))


def claim_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.claim_winner(ad.comments(spark, sf_dir), ad.unlocked(spark, sf_dir))


def bounces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.bounces(ad.comments(spark, sf_dir))


def stage_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue moved to a stage by its number."""
    i = ad.issues(spark, sf_dir)
    to = F.get(F.array(*map(F.lit, (*workflow.STAGES, "nowhere"))), (F.col("number") % 8).cast("int"))
    return i.select("number", workflow.transition(F.col("labels"), to).alias("t")).select("number", F.col("t.from").alias("source"), F.array_join("t.remove", ",").alias("remove"), F.array_join("t.add", ",").alias("add"), F.col("t.error").alias("error"))


def emit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each issue's worker ends in one of all outcomes, with and without a target."""
    i = ad.issues(spark, sf_dir)
    outcome = F.get(F.array(*map(F.lit, ("ADVANCE", "BOUNCE", "PARK", "CONTINUE", "CLOSE", "STOP"))), (F.col("number") % 6).cast("int"))
    to = F.when(F.col("number") % 4 < 3, F.get(F.array(*map(F.lit, workflow.STAGES)), (F.col("number") % 7).cast("int")))
    return i.select("number", workflow.emit(F.col("labels"), outcome, to).alias("e")).select("number", F.array_join("e.remove", ",").alias("remove"), F.array_join("e.add", ",").alias("add"), F.col("e.close").alias("close"), F.col("e.error").alias("error"))


def stale_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("lock"), F.col("ts").alias("taken_at"))
    return workflow.stale_locks(e, F.lit("2024-01-20 12:00:00").cast("timestamp"), 48.0).select("lock")


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as branches and worktrees."""
    p = ad.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tip = F.when(k % 11 > 0, F.md5(k.cast("string")))
    merged = F.when(k % 4 == 0, F.md5((k + 1).cast("string"))).otherwise(F.md5(k.cast("string")))
    tree = workflow.worktree_removable(k % 2 == 0, k % 3 == 0, k % 5 == 0)
    gone = F.when(k % 7 > 0, k % 2 == 1)
    return p.select(k.alias("branch"), workflow.branch_deletable(gone, F.when(k % 3 > 0, "MERGED").otherwise("OPEN"), tip, merged).alias("deletable"), tree["remove"].alias("remove"), tree["reason"].alias("reason"))


def conflict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pull requests of orders."""
    p, i = ad.table(spark, sf_dir, "part"), ad.issues(spark, sf_dir)
    k = F.col("p_partkey").cast("bigint")
    linked = F.when(k % 5 > 0, F.array(k * 2, k * 3 + 1, k + 100_000_000)).otherwise(F.array().cast("array<bigint>"))
    pulls = p.select(k.alias("number"), F.concat(F.lit("b"), k.cast("string")).alias("head"), F.when(k % 9 > 0, F.when(k % 4 == 0, "main").otherwise("dev")).alias("base"), F.when(k % 3 == 0, "MERGEABLE").otherwise("CONFLICTING").alias("mergeable"), linked.alias("issues"))
    n = F.col("number")
    body = F.concat(F.lit("sdlc-dispatch: branch b"), F.floor(n / 2).cast("string"), F.lit(" conflicts with dev — needs a merge, again"))
    said = F.when(n % 6 == 0, F.array(F.struct(body.alias("body"), F.col("created_at").cast("timestamp").alias("created_at")))).otherwise(F.array().cast("array<struct<body:string,created_at:timestamp>>"))
    issues = i.select("number", F.when(n % 17 == 0, "CLOSED").otherwise("OPEN").alias("state"), "labels", said.alias("comments"))
    return workflow.conflicts(pulls, issues, "dev", F.lit("1995-01-01").cast("timestamp"))


def prose_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), F.when(F.col("c_custkey") % 2 == 0, "OPEN").otherwise("CLOSED").alias("state"))
    return workflow.migrations(ad.prose(spark, sf_dir), known)


def issue_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ad.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("#"), k, F.lit(" x#12 &#34; (#"), k, F.lit(") .#56 #7 #1234567 #89a end #42"))
    return o.select(F.col("o_orderkey").alias("number"), F.array_join(workflow.issue_refs(text), ",").alias("refs"))


def latest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    event = F.when(F.col("event_type") == "click", "labeled").when(F.col("event_type") == "view", "unlabeled").otherwise("other")
    return workflow.latest_label(e.select(F.col("user_id").alias("issue"), F.lit("wip").alias("label"), event.alias("event"), F.col("ts").alias("created_at"))).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


def digest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("number"), "event_type", "value")
    return workflow.digest_diff(e.filter("event_type = 'view' AND value > 30"), e.filter("event_type = 'click' AND value > 30"))


def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.table(spark, sf_dir, "part")
    count = lambda df: df.groupBy(F.col("p_brand").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return workflow.baseline_compare(count(p.filter("p_type = 'ECONOMY'")), count(p.filter("p_type = 'STANDARD'")))


def lint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "conversations")
    message = F.struct(F.when(F.col("turn") < 4, F.lit(2)).otherwise(F.lit(1)).alias("severity"), F.when(F.col("turn") > 0, F.col("role")).alias("rule"))
    return workflow.rule_counts(c.groupBy("conv_id").agg(F.collect_list(message).alias("messages")))


def dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten for a title: a top-k, which is the operator."""
    d = ad.table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("number"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.array(F.col("lang"), F.col("source")).alias("labels"))
    return workflow.dup_candidates("The idiot and the trash rights in src1 en", rows)


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as closed issues that blocked others."""
    k = F.col("c_custkey").cast("bigint")
    edge = lambda n, state: F.struct(n.alias("number"), state.cast("string").alias("state"))
    blocking = F.array(edge(k * 3, F.lit("OPEN")), edge(k * 5, F.when(k % 2 == 0, "CLOSED")), edge(k * 7 + 1, F.lit("open")), edge(k + 100_000_000, F.lit("OPEN")))
    at = F.when(k % 8 > 0, F.timestamp_seconds(F.lit(1704067200) + (k % 60) * 86400))
    return ad.table(spark, sf_dir, "customer").select(k.alias("number"), at.alias("closed_at"), blocking.alias("blocking"))


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "part").filter("p_partkey % 6 = 0").select(F.col("p_partkey").cast("bigint").alias("number"))


def _since():
    return F.timestamp_seconds(F.lit(1704067200 + 20 * 86400))


def close_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workflow.sweep(_closed(spark, sf_dir), ad.issues(spark, sf_dir), _swept(spark, sf_dir), _since())
    return found.withColumn("remaining", F.array_join(F.col("remaining").cast("array<string>"), ","))


def sweep_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.swept_next(_closed(spark, sf_dir), _swept(spark, sf_dir), _since())


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as issues that block each other: a ring of eleven, rings that share nodes, closed and foreign blockers, long chains."""
    k = F.col("s_suppkey").cast("bigint")
    edge = lambda n, state: F.struct(n.cast("bigint").alias("number"), state.cast("string").alias("state"))
    also = F.when(k % 9 == 4, k - 2).when(k < 3, k)
    blocked_by = F.array(edge(k * 3 % 23, F.when(k % 31 == 30, "CLOSED")), edge(also, F.lit("open")), edge(k + 1_000_000, F.lit("OPEN")))
    return ad.table(spark, sf_dir, "supplier").select(k.alias("number"), blocked_by.alias("blocked_by"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.cycles(workflow.blocking_edges(_graph(spark, sf_dir)))


def _pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of suppliers by tens, up to ten long, some forked, some circling, and one through all parts."""
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("doc"))
    chain = s.filter("doc % 10 <> 9").select("doc", (F.col("doc") + 1).alias("by"))
    fork = s.filter("doc % 10 = 4").select("doc", (F.col("doc") + 5_000).alias("by"))
    ring = s.filter("doc % 10 = 7").select("doc", (F.col("doc") - 2).alias("by"))
    closed = s.filter("doc % 30 = 8").select("doc", F.col("doc").alias("by"))
    long = ad.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 0 + 100_000).cast("bigint").alias("at")).distinct().select(F.explode(F.sequence(F.col("at"), F.col("at") + 69)).alias("doc"))
    return chain.union(fork).union(ring).union(closed).union(long.select("doc", (F.col("doc") + 1).alias("by")))


def terminal_superseders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.terminal_superseders(_pointers(spark, sf_dir))


def citation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("doc")).distinct()
    return workflow.citation_violations(cites, workflow.terminal_superseders(_pointers(spark, sf_dir)))


def entity_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ad.table(spark, sf_dir, "supplier")
    return workflow.two_hop(s.select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("identifier")))


def prose_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.prose_dependencies(ad.prose(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    lane_summary, lane_order, lane_integrity, lane_breakdown, stalled_locks, focus, focus_lines, readiness, claim_winner, bounces, stage_moves, emit_outcomes, stale_locks, branches, conflict_scan, latest_label, digest_diff,
    baseline_compare, lint_counts, dup_candidates, close_sweep, sweep_marker, cycles, terminal_superseders, citation_violations, entity_two_hop, prose_dependencies, prose_migration, issue_refs,
)}

_GRAPH = """e AS (SELECT src, dst FROM (SELECT s_suppkey::BIGINT AS src, s_suppkey * 3 % 23 AS dst FROM supplier WHERE s_suppkey % 31 <> 30 UNION SELECT s_suppkey, s_suppkey - 2 FROM supplier WHERE s_suppkey % 9 = 4 UNION SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey < 3 AND s_suppkey % 9 <> 4)
    WHERE dst IN (SELECT s_suppkey FROM supplier))"""
_POINTERS = """p AS (SELECT s_suppkey::BIGINT AS doc, s_suppkey::BIGINT + 1 AS nxt FROM supplier WHERE s_suppkey % 10 <> 9 UNION SELECT s_suppkey, s_suppkey + 5000 FROM supplier WHERE s_suppkey % 10 = 4
    UNION SELECT s_suppkey, s_suppkey - 2 FROM supplier WHERE s_suppkey % 10 = 7 UNION SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 30 = 8 UNION SELECT 100000 + i, 100001 + i FROM range(70) t(i))"""
_WALK = "walk AS (SELECT doc, nxt AS node FROM p UNION SELECT w.doc, p.nxt FROM walk w JOIN p ON p.doc = w.node)"
_TERMINAL = "t AS (SELECT DISTINCT doc, node AS terminal FROM walk WHERE node NOT IN (SELECT doc FROM p))"
_FOCUS = f"""{ad.ISSUES}, wanted AS (SELECT number FROM issues UNION ALL SELECT number + 10000000 FROM issues),
    f AS (SELECT w.number, CASE WHEN j.number IS NULL THEN 'not-open' WHEN len(stages) = 0 THEN 'no-stage' WHEN len(stages) > 1 THEN 'multi-stage' WHEN stages[1] = 'queued' THEN 'queued' WHEN stages[1] NOT IN (SELECT lane FROM names) THEN 'unknown-stage'
      WHEN len(reasons) > 0 THEN 'ineligible' ELSE 'eligible' END AS verdict, stages, reasons, blockers FROM wanted w LEFT JOIN judged j ON j.number = w.number)"""
_CLOSED = """closed AS (SELECT c_custkey::BIGINT AS number, CASE WHEN c_custkey % 8 > 0 THEN c_custkey % 60 END AS day, unnest([{n: c_custkey * 3, s: 'OPEN'}, {n: c_custkey * 5, s: CASE WHEN c_custkey % 2 = 0 THEN 'CLOSED' ELSE 'OPEN' END}, {n: c_custkey * 7 + 1, s: 'OPEN'}]) AS e FROM customer),
    swept AS (SELECT p_partkey AS number FROM part WHERE p_partkey % 6 = 0)"""
_LEGAL = "[('intake', 'design'), ('intake', 'queued'), ('intake', 'verify'), ('design', 'queued'), ('design', 'intake'), ('queued', 'build'), ('queued', 'design'), ('build', 'verify'), ('build', 'queued'), ('build', 'design'), ('build', 'intake'), ('verify', 'audit'), ('verify', 'build'), ('audit', 'ship'), ('audit', 'build'), ('ship', 'build')]"


def _step(to: str) -> str:
    """What refuses a step to ``to``, and the labels to be taken off."""
    return f"""CASE WHEN len(stages) = 0 THEN 'no stage' WHEN len(stages) > 1 THEN 'several stages' WHEN stages[1] = 'mystery' THEN 'unknown stage' WHEN {to} = 'nowhere' THEN 'unknown target'
      WHEN stages[1] = {to} THEN 'already there' WHEN NOT list_contains({_LEGAL}, (stages[1], {to})) THEN 'illegal step' END AS refused, 'stage:' || stages[1] || CASE WHEN list_contains(labels, 'sdlc:wip') THEN ',sdlc:wip' ELSE '' END AS off"""


ORACLES = {
    "lane_summary": f"""WITH {ad.ISSUES} SELECT n.lane, count(l.number) AS depth, count_if(st = 'eligible')::BIGINT AS eligible, count_if(st = 'hold')::BIGINT AS hold, count_if(st = 'needs-human')::BIGINT AS needs_human,
        count_if(st = 'wip')::BIGINT AS wip, count_if(st = 'blocked')::BIGINT AS blocked FROM names n LEFT JOIN laned l USING (lane) GROUP BY 1""",
    "lane_order": f"""WITH {ad.ISSUES} SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY CASE WHEN list_contains(labels, 'priority:critical') THEN 0 WHEN list_contains(labels, 'priority:medium') THEN 1 WHEN list_contains(labels, 'priority:future') THEN 2 ELSE 3 END,
        created_at, number)::INT AS place, number::BIGINT AS number FROM laned WHERE st = 'eligible'""",
    "lane_integrity": f"WITH {ad.ISSUES} SELECT number::BIGINT AS number, list_aggregate(stages, 'string_agg', ',') AS stages FROM staged WHERE len(stages) > 1 UNION ALL SELECT number, '' FROM staged WHERE len(stages) = 0 AND (list_contains(labels, 'sdlc:wip') OR list_contains(labels, 'sdlc:needs-human'))",
    "lane_breakdown": f"""WITH {ad.ISSUES}, c AS (SELECT n.lane, st, count(number) AS n FROM names n LEFT JOIN laned l USING (lane) GROUP BY 1, 2)
        SELECT lane, coalesce('(' || string_agg(st || ' ' || n, ', ' ORDER BY list_position(['hold', 'needs-human', 'wip', 'blocked'], st)) FILTER (WHERE st <> 'eligible') || ')', '') AS line FROM c GROUP BY 1""",
    "stalled_locks": f"WITH {ad.ISSUES} SELECT number::BIGINT AS number FROM staged WHERE list_contains(stages, 'build') AND list_contains(labels, 'sdlc:wip')",
    "focus": f"""WITH {_FOCUS} SELECT number::BIGINT AS number, verdict, CASE WHEN verdict IN ('eligible', 'ineligible', 'queued') THEN stages[1] END AS lane, CASE WHEN verdict = 'ineligible' THEN array_to_string(reasons, ',') END AS reasons,
        CASE WHEN verdict = 'ineligible' THEN array_to_string(blockers, ',') END AS blockers, CASE WHEN verdict IN ('multi-stage', 'unknown-stage') THEN array_to_string(stages, ',') END AS stages FROM f""",
    "focus_lines": f"""WITH {_FOCUS} SELECT number::BIGINT AS number, 'focus #' || number || ': ' || CASE verdict WHEN 'eligible' THEN 'eligible in ' || stages[1]
        WHEN 'ineligible' THEN 'ineligible in ' || stages[1] || ' (' || replace(array_to_string(reasons, ', '), 'blocked', 'blocked by #' || array_to_string(blockers, ', #')) || ')' WHEN 'queued' THEN 'queued (human gate)' WHEN 'no-stage' THEN 'no stage label'
        WHEN 'multi-stage' THEN 'multiple stage labels (' || array_to_string(stages, ', ') || ')' WHEN 'unknown-stage' THEN 'unknown stage label (' || array_to_string(stages, ', ') || ')' ELSE 'not open (closed or nonexistent)' END AS line FROM f""",
    "readiness": f"""WITH {ad.ISSUES}, v AS (SELECT *, CASE WHEN len(blockers) > 0 THEN 'blocked' WHEN n_edges > 0 THEN 'ready' WHEN list_contains(labels, 'blocked') THEN 'label_only' ELSE 'free' END AS verdict FROM issues),
        w AS (SELECT *, CASE WHEN verdict IN ('blocked', 'ready') AND NOT list_contains(labels, verdict) THEN verdict END AS a, CASE WHEN verdict = 'blocked' AND list_contains(labels, 'ready') THEN 'ready' WHEN verdict = 'ready' AND list_contains(labels, 'blocked') THEN 'blocked' END AS r FROM v)
        SELECT number::BIGINT AS number, verdict, a AS add, r AS remove, CASE WHEN a IS NULL AND r IS NULL THEN NULL WHEN verdict = 'blocked' THEN 'open blocker #' || blockers[1] ELSE 'every blocker closed' END AS reason FROM w""",
    "claim_winner": f"""WITH {ad.COMMENTS}, o AS (SELECT issue, max(pos) AS last FROM comments WHERE outcome GROUP BY 1)
        SELECT issue, arg_min(claim, (created_at, claim)) AS run_id FROM comments LEFT JOIN o USING (issue) LEFT JOIN unlocked USING (issue) WHERE claim IS NOT NULL AND (last IS NULL OR pos > last) AND (unlocked."at" IS NULL OR created_at > unlocked."at") GROUP BY 1""",
    "bounces": f"WITH {ad.COMMENTS} SELECT CASE kind WHEN 2 THEN 'verify' WHEN 3 THEN 'ship' ELSE '?' END AS from_stage, CASE kind WHEN 4 THEN '?' ELSE 'build' END AS to_stage, count(*) AS n FROM comments WHERE kind IN (2, 3, 4) GROUP BY 1, 2",
    "stage_moves": f"""WITH {ad.ISSUES}, t AS (SELECT *, (['intake', 'design', 'queued', 'build', 'verify', 'audit', 'ship', 'nowhere'])[number % 8 + 1] AS goal FROM staged), r AS (SELECT *, {_step('goal')} FROM t)
        SELECT number::BIGINT AS number, CASE WHEN refused IS NULL THEN stages[1] END AS source, CASE WHEN refused IS NULL THEN off ELSE '' END AS remove, CASE WHEN refused IS NULL THEN 'stage:' || goal ELSE '' END AS add, refused AS error FROM r""",
    "emit_outcomes": f"""WITH {ad.ISSUES}, t AS (SELECT *, (['ADVANCE', 'BOUNCE', 'PARK', 'CONTINUE', 'CLOSE', 'STOP'])[number % 6 + 1] AS outcome, CASE WHEN number % 4 < 3 THEN (['intake', 'design', 'queued', 'build', 'verify', 'audit', 'ship'])[number % 7 + 1] END AS goal FROM staged),
        r AS (SELECT *, {_step('goal')}, CASE WHEN list_contains(labels, 'sdlc:wip') THEN 'sdlc:wip' ELSE '' END AS lock, outcome IN ('ADVANCE', 'BOUNCE') AND goal IS NOT NULL AS step, outcome = 'ADVANCE' AND goal IS NULL AND stages = ['ship'] AS done FROM t)
        SELECT number::BIGINT AS number, CASE WHEN step THEN CASE WHEN refused IS NULL THEN off ELSE '' END WHEN done THEN off WHEN outcome IN ('PARK', 'CONTINUE', 'CLOSE') THEN lock ELSE '' END AS remove,
        CASE WHEN step AND refused IS NULL THEN 'stage:' || goal WHEN outcome = 'PARK' THEN 'sdlc:needs-human' ELSE '' END AS add, outcome = 'CLOSE' AS close,
        CASE WHEN step THEN refused WHEN done THEN NULL WHEN outcome IN ('ADVANCE', 'BOUNCE') THEN 'a target is needed' WHEN outcome = 'STOP' THEN 'unknown outcome' END AS error FROM r""",
    "stale_locks": "SELECT event_id AS lock FROM events WHERE epoch(TIMESTAMP '2024-01-20 12:00:00') - floor(epoch(ts)) >= 172800",
    "branches": """SELECT p_partkey AS branch, coalesce(p_partkey % 7 > 0 AND p_partkey % 2 = 1 AND p_partkey % 3 > 0 AND p_partkey % 11 > 0 AND p_partkey % 4 > 0, false) AS deletable, p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AS remove,
        CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN 'active (branch present, issue open)' ELSE CASE WHEN p_partkey % 2 = 1 THEN 'dirty — ' ELSE '' END || CASE WHEN p_partkey % 15 = 0 THEN 'branch gone/merged, issue closed' WHEN p_partkey % 3 = 0 THEN 'branch gone/merged' ELSE 'issue closed' END
        || CASE WHEN p_partkey % 2 = 1 THEN ' but uncommitted changes present' ELSE '' END END AS reason FROM part""",
    "conflict_scan": f"""WITH {ad.ISSUES}, pulls AS (SELECT p_partkey::BIGINT AS pull, CASE WHEN p_partkey % 5 > 0 THEN [p_partkey::BIGINT * 2, p_partkey::BIGINT * 3 + 1, p_partkey::BIGINT + 100000000] ELSE [NULL::BIGINT] END AS l FROM part WHERE p_partkey % 3 > 0 AND (p_partkey % 9 = 0 OR p_partkey % 4 > 0)),
        x AS (SELECT pull, unnest(l) AS issue FROM pulls),
        r AS (SELECT x.*, stages, CASE WHEN issue IS NULL THEN 'no linked issue' WHEN s.number IS NULL OR s.number % 17 = 0 THEN 'linked issue closed or not found' WHEN list_has_any(labels, ['sdlc:wip', 'sdlc:needs-human', 'sdlc:hold']) THEN 'issue is wip/needs-human/hold'
          WHEN issue % 6 = 0 AND issue // 2 = pull AND created_at >= TIMESTAMP '1995-01-01' THEN 'conflict comment already posted since last dev update' END AS reason FROM x LEFT JOIN staged s ON s.number = issue),
        g AS (SELECT *, CASE WHEN reason IS NULL AND len(stages) = 1 AND stages[1] <> 'mystery' THEN stages[1] END AS stage FROM r)
        SELECT pull, issue, CASE WHEN reason IS NULL THEN 'comment' ELSE 'skip' END AS action, reason, stage, CASE WHEN stage IN ('verify', 'audit', 'ship') THEN 'build' END AS "to" FROM g""",
    "latest_label": "SELECT user_id AS issue, 'wip' AS label, CASE event_type WHEN 'click' THEN 'labeled' ELSE 'unlabeled' END AS event, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 3",
    "digest_diff": """WITH b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 30), a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 30)
        SELECT user_id AS number, 'arrived' AS change FROM a WHERE user_id NOT IN (FROM b) UNION ALL SELECT user_id, 'departed' FROM b WHERE user_id NOT IN (FROM a)""",
    "baseline_compare": """WITH b AS (SELECT p_brand AS rule, count(*) AS was FROM part WHERE p_type = 'ECONOMY' GROUP BY 1), c AS (SELECT p_brand AS rule, count(*) AS now FROM part WHERE p_type = 'STANDARD' GROUP BY 1)
        SELECT rule, coalesce(was, 0) AS was, coalesce(now, 0) AS now, coalesce(now, 0) > coalesce(was, 0) AS grew FROM b FULL JOIN c USING (rule)""",
    "lint_counts": "SELECT CASE WHEN turn > 0 THEN role ELSE 'fatal' END AS rule, count(*) AS n FROM conversations WHERE turn < 4 GROUP BY 1",
    "dup_candidates": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+') AS t, regexp_extract_all(lower(text), '[a-z0-9]+') AS b, [lang, source] AS l FROM documents),
        s AS (SELECT doc_id AS number, list_sum(list_transform(['idiot', 'trash', 'rights', 'src1', 'en'], lambda x: CASE WHEN list_contains(t, x) THEN 3 WHEN list_contains(b, x) THEN 1 ELSE 0 END + CASE WHEN list_contains(l, x) THEN 1 ELSE 0 END))::INT AS score FROM d)
        SELECT * FROM s WHERE score > 0 ORDER BY score DESC, number LIMIT 10""",
    "close_sweep": f"""WITH {ad.ISSUES}, {_CLOSED} SELECT DISTINCT c.number AS closed, i.number::BIGINT AS number, list_contains(labels, 'blocked') AS blocked, array_to_string(blockers, ',') AS remaining, len(blockers) = 0 AS flip
        FROM closed c JOIN issues i ON i.number = c.e.n WHERE c.e.s = 'OPEN' AND (day IS NULL OR day > 20) AND c.number NOT IN (FROM swept)""",
    "sweep_marker": f"""WITH {_CLOSED}, c AS (SELECT DISTINCT number, day FROM closed) SELECT number, number NOT IN (FROM swept) AS new FROM c WHERE day > 20 OR number IN (FROM swept)""",
    "cycles": f"""WITH RECURSIVE {_GRAPH}, w AS (SELECT src AS start, dst AS node, [src] AS path FROM e WHERE dst >= src UNION ALL SELECT w.start, e.dst, list_append(w.path, w.node) FROM w JOIN e ON e.src = w.node
        WHERE w.node <> w.start AND NOT list_contains(w.path, w.node) AND e.dst >= w.start) SELECT array_to_string(path, '>') AS path, len(path)::INT AS length FROM w WHERE node = start""",
    "terminal_superseders": f"WITH RECURSIVE {_POINTERS}, {_WALK}, {_TERMINAL} SELECT * FROM t",
    "citation_violations": f"""WITH RECURSIVE {_POINTERS}, {_WALK}, {_TERMINAL}, c AS (SELECT DISTINCT l_orderkey AS source, l_suppkey AS doc FROM lineitem)
        SELECT source, doc FROM c WHERE doc IN (SELECT doc FROM t) AND NOT EXISTS (SELECT 1 FROM t JOIN c x ON x.doc = t.terminal WHERE t.doc = c.doc AND x.source = c.source)""",
    "entity_two_hop": """WITH m AS (SELECT DISTINCT s_suppkey AS entity, s_nationkey AS via FROM supplier), g AS (SELECT via, min(entity) AS class_id, count(*) - 1 AS n_links FROM m GROUP BY 1 HAVING count(*) > 1)
        SELECT entity, via, class_id, n_links FROM m JOIN g USING (via)""",
    "prose_dependencies": f"WITH {ad.PROSE} SELECT DISTINCT number, blocker FROM prose WHERE blocker <> number",
    "prose_migration": f"""WITH {ad.PROSE} SELECT DISTINCT number, blocker, CASE WHEN c_custkey IS NULL THEN 'skip' ELSE 'add' END AS action, CASE WHEN c_custkey % 2 = 0 THEN 'OPEN' WHEN c_custkey % 2 = 1 THEN 'CLOSED' END AS state
        FROM prose LEFT JOIN customer ON c_custkey = blocker WHERE blocker <> number AND blocker <> edge""",
    "issue_refs": "SELECT o_orderkey AS number, CASE WHEN o_orderkey BETWEEN 10 AND 999999 THEN o_orderkey || ',' || o_orderkey || ',42' ELSE '42' END AS refs FROM orders",
}

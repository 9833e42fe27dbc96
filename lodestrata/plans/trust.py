"""Queries of grounding, sessions, event feeds and traceability."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import federation, grounding, lint, metrics, relocation, rollups, sessions, variants
from ..durable import durable, shared_folder
from ..sources import append_log
from ..sources import events as feeds
from ..streaming import machines, sync
from ._bind import Fixture, micros, table

ANCHORS = Fixture("anchor_id string, target_path string, line_start int, line_end int, stored_hash string", [("a1", "x.py", 1, 5, "h1"), ("a2", "x.py", 6, 9, "old"), ("a3", "y.py", 1, 2, "h9"), ("a4", "gone.py", 1, 2, "zz"), ("a5", "locked.py", 1, 2, "zz"), ("a6", "x.py", 50, 60, "zz"), ("a7", "x.py", 6, 9, "h1")], "SELECT 'o' || o_orderkey AS anchor_id, 'f' || (o_orderkey % 500) AS target_path, CAST(o_orderkey % 500 % 9 * 10 + 1 AS INT) AS line_start, CAST(o_orderkey % 500 % 9 * 10 + 5 AS INT) AS line_end, CASE o_orderkey % 4 WHEN 0 THEN 'h' || (o_orderkey % 500) WHEN 1 THEN 'h' || (o_orderkey % 77) ELSE 'none' || o_orderkey END AS stored_hash FROM {orders}")
SPANS = Fixture("path string, line_start int, line_end int, span_hash string", [("x.py", 1, 5, "h1"), ("x.py", 6, 9, "h2"), ("z.py", 3, 4, "h9")], "SELECT 'f' || p_partkey AS path, CAST(p_partkey % 9 * 10 + 1 AS INT) AS line_start, CAST(p_partkey % 9 * 10 + 5 AS INT) AS line_end, 'h' || p_partkey AS span_hash FROM {part} WHERE p_partkey % 13 <> 0")
FILES = Fixture("path string, readable boolean, n_lines int", [("x.py", True, 40), ("y.py", True, 10), ("z.py", True, 9), ("locked.py", False, 5)], "SELECT 'f' || p_partkey AS path, p_partkey % 7 <> 0 AS readable, p_size + 20 AS n_lines FROM {part} WHERE p_partkey % 11 <> 0")
CITATIONS = Fixture("answer_id long, pos long, path string, line_start int, line_end int, state string", [(1, 1, "x.py", 1, 5, "live"), (1, 2, "y.py", 2, 2, "live"), (2, 1, "x.py", 1, 99, "live"), (2, 2, "x.py", 1, 2, "stale"), (3, 1, "gone.py", 1, 1, "live"), (4, 1, "x.py", 9, 3, "live"), (4, 2, "x.py", 3, 9, None)], "SELECT user_id + 100 AS answer_id, event_id AS pos, 'f' || (event_id % 300) AS path, CAST(event_id % 45 - 1 AS INT) AS line_start, CAST(event_id % 45 - 2 + event_id % 5 AS INT) AS line_end, CASE event_id % 6 WHEN 0 THEN 'stale' WHEN 1 THEN NULL ELSE 'live' END AS state FROM {events}")
SENTENCES = Fixture("answer_id long, pos long, n_citations long, n_ok long", [(1, 1, 2, 2), (1, 2, 0, 0), (2, 1, 2, 1), (3, 1, 1, 0), (3, 2, 0, 0)], "SELECT conv_id + 100 AS answer_id, turn AS pos, length(text) % 4 AS n_citations, least(length(text) % 4, length(text) % 3) AS n_ok FROM {conversations}")
EVIDENCE = Fixture("answer_id long, project_id string, source_id string, citation string, commit_sha string, session_id string, confidence double, type string, label string", [(1, "p1", "s1", "x.py:1-5", "c1", None, 0.9, "code", "gate"), (1, "p2", "s2", "y.md:2", "c1", "e1", 0.7, "doc", "guide"), (1, "p1", "s1", "x.py:1-5", "c2", "e1", 0.8, "code", "gate"), (2, "p1", "s3", None, None, None, 1.0, "note", "memo")], "SELECT user_id + 100 AS answer_id, 'p' || (event_id % 5) AS project_id, 's' || (event_id % 9) AS source_id, CASE WHEN event_id % 4 <> 0 THEN 'f' || (event_id % 12) || '.py:' || (event_id % 3) END AS citation, CASE WHEN event_id % 3 = 0 THEN 'c' || (event_id % 10) END AS commit_sha, CASE WHEN event_id % 2 = 0 THEN 'e' || (event_id % 6) END AS session_id, (event_id % 97 + 1) * 0.01 AS confidence, event_type AS type, 'l' || (event_id % 3) AS label FROM {events}")
DRIFT = Fixture("item_id long, authority double, recency double, agreement double", [(k, (k % 7) / 7, (k % 5) / 5, (k % 3 + 1) / 3) for k in range(20)], "SELECT l_orderkey * 10 + l_linenumber + 1000 AS item_id, l_discount * 10 AS authority, l_tax * 12 AS recency, l_quantity * 0.02 AS agreement FROM {lineitem}")
WEIGHTS = Fixture("feature string, weight double", [("authority", 1.0), ("recency", 1.0), ("agreement", 1.0)])
FRESH = Fixture("project_id string, head string, recorded string, dirty boolean, ownership string, changed boolean", [("p1", "a", "a", False, "owned", True), ("p2", "b", "a", False, "foreign", True), ("p3", "a", "a", True, "supplemental", True), ("p4", "a", None, False, "owned", False), ("p5", None, "a", False, "unknown", True)], "SELECT 'c' || c_custkey AS project_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 's' || (c_custkey % 4) END AS head, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 's' || (c_custkey % 3) END AS recorded, c_custkey % 5 = 0 AS dirty, CASE c_custkey % 4 WHEN 0 THEN 'owned' WHEN 1 THEN 'foreign' WHEN 2 THEN 'supplemental' ELSE 'unknown' END AS ownership, c_custkey % 6 <> 0 AS changed FROM {customer}")
PLANS = Fixture("doc_id long, text string", [(1, "# Plan\n## Phase 1\n- [x] build gate §4.1 §4.2\n- [ ] test it §5\n## Phase 2\n* [X] ship\nnotes"), (2, "just prose"), (3, "- [ ] orphan task")], "SELECT doc_id + 100 AS doc_id, CASE doc_id % 3 WHEN 0 THEN text ELSE '## Phase ' || source || chr(10) || '- [x] start §' || (doc_id % 9) || chr(10) || '- [ ] ' || replace(text, chr(10), chr(10) || '* [X] §' || (doc_id % 9) || '.' || (doc_id % 4) || ' ') END AS text FROM {documents} WHERE text IS NOT NULL")
ACTIONS = Fixture("action string", [(a,) for a in ("read", "draft", "edit_owned", "edit_foreign", "push", "launch")], "SELECT CASE event_id % 8 WHEN 0 THEN 'read' WHEN 1 THEN 'search' WHEN 2 THEN 'draft' WHEN 3 THEN 'edit_owned' WHEN 4 THEN 'run_tests' WHEN 5 THEN 'edit_foreign' WHEN 6 THEN 'push' ELSE event_type END AS action FROM {events}")
SPEC = Fixture("doc_id string, text string", [("arch", "§4 Gate\n§4.1 detail and §4.3\nLESSONS §9\nsee #gate-rules and §5"), ("brief", "§4.1 §7 #gate-rules"), ("tests", "spec(§4.3)\nspec(§5)\nspec(#gate-rules)")], "SELECT CASE doc_id % 3 WHEN 0 THEN 'arch' WHEN 1 THEN 'brief' ELSE 'tests' END AS doc_id, '§' || (doc_id % 40) || '.' || (doc_id % 5) || ' and §' || (doc_id % 23) || ' #rule-' || source || chr(10) || 'LESSONS §99.' || doc_id || chr(10) || text AS text FROM {documents} WHERE text IS NOT NULL")
PHASES = Fixture("phase long, anchor string", [(1, "§4"), (1, "§4.1"), (2, "§5"), (2, "§6"), (2, "#gate-rules"), (3, "§7")], "SELECT DISTINCT p_partkey % 3 + 10 AS phase, CASE WHEN p_partkey % 2 = 0 THEN '§' || (p_partkey % 46) ELSE '§' || (p_partkey % 46) || '.' || (p_partkey % 6) END AS anchor FROM {part}")
WAIVERS = Fixture("anchor string", [("§6",)], "SELECT DISTINCT '§' || (p_partkey % 46) AS anchor FROM {part} WHERE p_partkey % 46 > 40")
COMMANDS = Fixture("command string", [(c,) for c in ("git push --force", "git push origin main", "git push origin topic", "git reset --hard HEAD~1", "git reset HEAD", "git status", "git clean -fd", "git checkout -- x", "ls")], "SELECT CASE event_id % 8 WHEN 0 THEN 'git push --force origin b' WHEN 1 THEN 'git push origin main' WHEN 2 THEN 'git push origin b' WHEN 3 THEN 'git reset --hard HEAD~' WHEN 4 THEN 'git status ' WHEN 5 THEN 'git clean -fd d' WHEN 6 THEN '  git checkout -- f' ELSE 'ls ' END || event_id AS command FROM {events}")
PATHS = Fixture("path string", [(p,) for p in ("core/a.py", "core", "corelib/x", "docs/a.md", "app/b")], "SELECT CASE page_id % 5 WHEN 0 THEN 'core/' WHEN 1 THEN 'corelib/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'core' ELSE 'x/core/' END || page_id AS path FROM {pages}")
SOURCES = Fixture("path string, source string", [("a.py", "import os\nos.remove('x')\nopen('y')\n"), ("ok.py", "open('z')"), ("bad.py", "def (")], """SELECT 'd' || doc_id || '.py' AS path, CASE WHEN doc_id % 5 = 0 THEN text ELSE 'import os' || chr(10) || 'os.remove("' || source || '")' || chr(10) || 'x.write_text("y")' || chr(10) || '# ' || replace(text, chr(10), ' ') || chr(10) END AS source FROM {documents} WHERE text IS NOT NULL""")
TEAM = Fixture("ts long, event string, session string, task string", [(1, "TeammateIdle", "s1", "t1"), (2, "TaskCompleted", "s1", "t1"), (3, "TeammateIdle", "s1", "t1"), (4, "TeammateIdle", "s2", None), (5, "TaskCompleted", "s2", None), (6, "TeammateIdle", "s3", "t9")], "SELECT event_id + 100 AS ts, CASE event_type WHEN 'click' THEN 'TeammateIdle' WHEN 'purchase' THEN 'TaskCompleted' ELSE event_type END AS event, 'u' || user_id AS session, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 't' || (event_id % 4) END AS task FROM {events}")
OUTBOX = Fixture("event_id string, seq long, type string, payload string", [("e1", 2, "indexed", "b"), ("e1", 1, "indexed", "a"), ("e2", 3, "novel", "c"), ("e3", 4, "removed", "d")], "SELECT 'o' || (event_id % 3000) AS event_id, event_id + 10 AS seq, CASE event_type WHEN 'click' THEN 'indexed' WHEN 'view' THEN 'removed' ELSE event_type END AS type, props AS payload FROM {events}")


def anchor_revalidate(spark, sf_dir):
    return grounding.revalidate(ANCHORS.frame(spark, sf_dir), SPANS.frame(spark, sf_dir), FILES.frame(spark, sf_dir)).select("anchor_id", "state")


def _edited(lines):
    """Lines (doc_id, line, said) as somebody has edited them since: some deleted, two swapped, some moved to the end of the next document."""
    kept = lines.where("(doc_id * 31 + line) % 11 <> 0")
    swapped = F.when(F.col("line") % 20 == 8, F.col("line") + 1).when(F.col("line") % 20 == 9, F.col("line") - 1).otherwise(F.col("line"))
    moves = F.expr("line % 50 between 5 and 8 and doc_id % 3 = 0")
    rows = kept.select(F.when(moves, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("doc_id"), moves.cast("int").alias("part"), swapped.alias("place"), "said")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "place", "said"))), lambda x: x["said"]), "\n").alias("text"))


def span_relocation(spark, sf_dir):
    """Anchors of every document, stored, and looked for in an edited copy; some documents are gone there and some can't be read."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    path = F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "said")).withColumn("line", F.col("line") + 1)
    start = F.explode(F.expr("transform(sequence(0, (size(split(text, '\n', -1)) - 1) div 3), k -> named_struct('s', 1 + 3 * k, 'm', 1 + k % 4))"))
    anchors = docs.select("doc_id", path, F.size(F.split("text", "\n", -1)).alias("n"), start.alias("a")).where("a.s + a.m - 1 <= n")
    anchors = anchors.select(F.concat_ws(":", "path", F.col("a.s").cast("string")).alias("anchor_id"), "path", F.col("a.s").cast("long").alias("line_start"), F.expr("cast(a.s + a.m - 1 as bigint)").alias("line_end"))
    edited = _edited(lines).where("doc_id % 13 <> 5").select(path, "text", (F.col("doc_id") % 17 != 3).alias("readable"))
    stored = relocation.fingerprinted(anchors, docs.select(path, "text"))
    return relocation.relocate(stored, edited).select("anchor_id", "state", "new_path", "new_line")


def grounding_citations(spark, sf_dir):
    return grounding.check_citations(CITATIONS.frame(spark, sf_dir), FILES.frame(spark, sf_dir)).select("answer_id", "pos", "status")


def grounding_gate(spark, sf_dir):
    return grounding.gate_answers(grounding.check_citations(CITATIONS.frame(spark, sf_dir), FILES.frame(spark, sf_dir)), strict=True)


def citation_quality(spark, sf_dir):
    return grounding.citation_quality(grounding.check_citations(CITATIONS.frame(spark, sf_dir), FILES.frame(spark, sf_dir)))


def trust_metrics(spark, sf_dir):
    """Users' citations against those that every third event would have cited, and sentences that nothing supports."""
    e = table(spark, sf_dir, "events")
    gold = e.where("event_id % 3 = 0").select((F.col("user_id") + 100).alias("answer_id"), F.concat(F.lit("f"), (F.col("event_id") % 300).cast("string")).alias("path"))
    told = grounding.sentence_actions(SENTENCES.frame(spark, sf_dir))
    claims = told.select("answer_id", "pos", (F.col("n_ok") > 0).alias("supported"), (F.col("action") != "keep").alias("flagged"))
    return grounding.trust_metrics(grounding.check_citations(CITATIONS.frame(spark, sf_dir), FILES.frame(spark, sf_dir)), gold, claims)


def sentence_actions(spark, sf_dir):
    return grounding.sentence_actions(SENTENCES.frame(spark, sf_dir))


def provenance_packet(spark, sf_dir):
    p = grounding.provenance_packets(EVIDENCE.frame(spark, sf_dir))
    lists = [F.array_join(c, ",").alias(c) for c in ("project_ids", "source_ids", "citations", "commit_shas", "session_ids")]
    return p.select("answer_id", *lists, "confidence", F.size("evidence").cast("long").alias("n_evidence"))


def drift_rank(spark, sf_dir):
    return grounding.drift_rank(DRIFT.frame(spark, sf_dir), WEIGHTS.frame(spark, sf_dir), "item_id").select("item_id", "score")


def freshness_and_refresh(spark, sf_dir):
    return FRESH.frame(spark, sf_dir).select("project_id", grounding.freshness(F.col("head"), F.col("recorded"), F.col("dirty")).alias("freshness"), grounding.refresh_action(F.col("ownership"), F.col("changed")).alias("action"))


def episode_cards(spark, sf_dir):
    cards = sessions.episode_cards(table(spark, sf_dir, "conversations"))
    return cards.select("session_id", "n_turns", "n_intents", F.sha2("first_intent", 256).alias("intent_hash"), F.sha2("outcome_summary", 256).alias("outcome_hash"))


def transcript_deltas(spark, sf_dir):
    """Turns stand for a transcript's edits: a role is a path, and its last text is what an edit replaces."""
    turns = table(spark, sf_dir, "conversations")
    last = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    lines = turns.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.lit("edit").alias("kind"), F.col("role").alias("path"), last.alias("old_text"), F.col("text").alias("new_text"))
    return feeds.transcript_deltas(lines)


def user_event_counts(spark, sf_dir):
    counts = metrics.counts_by_kind(table(spark, sf_dir, "events"), "user_id", "event_type")
    return counts.select("user_id", F.size("counts").cast("long").alias("n_kinds"), F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("told"))


def common_sources(spark, sf_dir):
    """Sources that have both long and labelled documents."""
    docs = table(spark, sf_dir, "documents")
    return federation.common(docs.where("length(text) > 8192"), docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "source")


def commit_link_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), "event_type", micros("ts").alias("ts_us"))
    edits = e.where("event_type = 'click'").select(F.col("event_id").alias("edit_id"), "path", "ts_us")
    commits = e.where("event_type = 'purchase'").select(F.col("event_id").alias("commit_id"), "path", "ts_us")
    return sessions.nearest_commit(edits, commits, 6 * 3600)


def plan_tasks(spark, sf_dir):
    return sessions.plan_tasks(PLANS.frame(spark, sf_dir))


def workflow_ready(spark, sf_dir):
    return sessions.workflow_readiness(table(spark, sf_dir, "conversations")).groupBy("template").agg(F.count("*").alias("n_sessions"), F.count_if("ready").alias("n_ready"))


def risk_levels(spark, sf_dir):
    return ACTIONS.frame(spark, sf_dir).select("action", sessions.risk(F.col("action")).alias("risk"), (sessions.risk(F.col("action")) == 0).alias("auto"))


def event_debounce_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), micros("ts").alias("ts_us"))
    return sync.bursts(e, 3600 * 1_000_000, "path", "ts_us")


def event_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return sync.dedup(e.unionByName(e)).groupBy("event_type").agg(F.count("*").alias("n_events"), F.sum("event_id").alias("sum_ids"))


def event_windows(spark, sf_dir):
    out = sync.windowed_counts(table(spark, sf_dir, "events"), "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def event_lag(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return metrics.lag_percentiles(e, "event_type", "value")


LEGAL = {("signup", "view"), ("view", "view"), ("view", "click"), ("click", "view"), ("click", "click"), ("click", "purchase"), ("purchase", "view")}
QUIET_US = 18 * 3600 * 1_000_000


def machine_events(spark, sf_dir):
    """Users' events as a stream in three increments, the query started anew for each; users who hear nothing for 18 hours become idle."""
    at = f"{shared_folder(spark)}/machine-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    end = spark.sql("SELECT -1L AS entity_id, timestamp'2100-01-01 00:00:00' AS ts, -1L AS seq, 'end' AS state")
    days = F.to_date("ts")
    for part in (e.where(days < "2024-01-11"), e.where((days >= "2024-01-11") & (days < "2024-01-21")), e.where(days >= "2024-01-21").unionByName(end)):
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{at}/in")
        machines.start_machine(machines.run_machine(stream, LEGAL, QUIET_US), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").where("entity_id >= 0")


def machine_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return machines.machine_batch(e, LEGAL, QUIET_US)


def append_log_events(spark, sf_dir):
    """Events as JSON lines that a stream takes by byte offsets, half of them after it has started once."""
    at = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).write.mode("append").json(f"{at}/log")
        rows = append_log.tail(spark, f"{at}/log", "event_id long, user_id long, event_type string", suffix=".json", rangeBytes="65536")
        rows.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type")


def observed_emit(spark, sf_dir):
    """Events written to the local sink, and what was observed of them on the way."""
    e = table(spark, sf_dir, "events")
    at = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    told = feeds.observed(e, {"n": F.count(F.lit(1)), "n_users": F.count("user_id"), "sum_ids": F.sum("event_id"), "last_us": F.max(micros("ts"))}, lambda rows: rows.write.json(at))
    return spark.createDataFrame([(told["n"], told["n_users"], told["sum_ids"], told["last_us"], spark.read.json(at).count())], "n long, n_users long, sum_ids long, last_us long, n_written long")


def usage_rollup(spark, sf_dir):
    """Daily sketches, stored, and merged by week: exact counts, and whether quantiles and distinct counts are as near as they promise."""
    e = table(spark, sf_dir, "events")
    days = durable(rollups.daily(e, F.col("event_type").isin("click", "purchase"), F.col("event_type") == "signup"))
    week = lambda day: F.floor(F.datediff(day, F.lit("2024-01-01").cast("date")) / 7).cast("long")
    spans = durable(rollups.merged(days, week(F.col("day"))))
    exact = e.groupBy(week(F.to_date("ts")).alias("span")).agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("event_type") == "signup", F.col("user_id"))).alias("opted"))
    out = spans.join(exact, "span")
    for at, q in (("p50", 0.5), ("p95", 0.95)):
        rank = rollups.rank_of(e, spans, week(F.to_date("ts")), "value", at).withColumnRenamed("rank", f"{at}_rank")
        out = out.join(rank, "span").withColumn(f"{at}_near", F.abs(F.col(f"{at}_rank") - q) <= 0.01)
    near = lambda a, b: F.abs(a - b) <= 0.03 * b
    return out.select("span", "n_events", "evidence_share", F.col("users").alias("n_users"), F.round(F.col("opted") / F.col("users"), 6).alias("opt_in_rate"), "p50_near", "p95_near", near(F.col("n_users"), F.col("users")).alias("users_near"), near(F.col("opt_in_rate"), F.col("opted") / F.col("users")).alias("opt_in_near"))


def event_props(spark, sf_dir):
    """The typed field of every event's JSON column, through a variant."""
    e = variants.parsed(table(spark, sf_dir, "events"), "props")
    return e.select("event_id", variants.field("variant", "$.k", "int").alias("k"), variants.field("variant", "$.absent", "string").alias("absent"))


def event_prop_schemas(spark, sf_dir):
    return variants.schema_by(variants.parsed(table(spark, sf_dir, "events"), "props"), "event_type")


def team_idle(spark, sf_dir):
    return lint.idle_without_completion(TEAM.frame(spark, sf_dir))


def outbox_once(spark, sf_dir):
    return feeds.outbox(OUTBOX.frame(spark, sf_dir), ("indexed", "removed"))


def spec_anchors(spark, sf_dir):
    return lint.anchors_of(SPEC.frame(spark, sf_dir))


def spec_anchor_coverage(spark, sf_dir):
    tagged = lint.anchors_of(SPEC.frame(spark, sf_dir).where("doc_id = 'tests'")).select("anchor")
    return lint.coverage_counts(lint.coverage(PHASES.frame(spark, sf_dir), tagged, WAIVERS.frame(spark, sf_dir)))


def brief_check(spark, sf_dir):
    every = lint.anchors_of(SPEC.frame(spark, sf_dir))
    return lint.brief_problems(every.where("doc_id = 'brief'").select("anchor"), every.where("doc_id = 'arch'").select("anchor"), PHASES.frame(spark, sf_dir).where("phase = 1").select("anchor"))


def git_guard(spark, sf_dir):
    return COMMANDS.frame(spark, sf_dir).select("command", lint.git_denied(F.col("command")).alias("denied"))


def territory_guard(spark, sf_dir):
    return PATHS.frame(spark, sf_dir).select("path", lint.path_denied(F.col("path"), ["core", "docs/"]).alias("denied"))


def mutation_tripwire(spark, sf_dir):
    return lint.mutation_tripwire(SOURCES.frame(spark, sf_dir), ["ok.py"])


QUERIES = {
    f.__name__: f
    for f in (anchor_revalidate, span_relocation, grounding_citations, grounding_gate, citation_quality, trust_metrics, sentence_actions, provenance_packet, drift_rank, freshness_and_refresh, episode_cards, transcript_deltas, user_event_counts, common_sources, commit_link_nearest, plan_tasks, workflow_ready, risk_levels, event_debounce_sessions, event_dedup, event_windows, event_lag, machine_events, machine_windows, append_log_events, observed_emit, usage_rollup, event_props, event_prop_schemas, team_idle, outbox_once, spec_anchors, spec_anchor_coverage, brief_check, git_guard, territory_guard, mutation_tripwire)
}

_PAIRS = ", ".join(f"'{a}>{b}'" for a, b in sorted(LEGAL))
_MACHINE = f"""WITH e AS (SELECT user_id AS entity_id, epoch_us(ts) AS us, event_id AS seq, event_type AS state FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT *, lag(us) OVER o AS last_us, lag(state) OVER o AS last_state, lead(us) OVER o AS next_us FROM e WINDOW o AS (PARTITION BY entity_id ORDER BY us, seq, state)),
p AS (SELECT *, CASE WHEN us - last_us <= {QUIET_US} THEN last_state END AS prev FROM w)
SELECT entity_id, us AS at_us, seq, prev AS prev_state, state, prev IS NULL OR prev || '>' || state IN ({_PAIRS}) AS accepted FROM p
UNION ALL SELECT entity_id, us + {QUIET_US}, NULL, state, '{machines.IDLE}', true FROM p WHERE next_us IS NULL OR next_us - us > {QUIET_US}"""
_STATUS = f"SELECT c.*, CASE WHEN line_start < 1 OR line_end < line_start THEN 'bad_span' WHEN n_lines IS NULL THEN 'missing_file' WHEN line_end > n_lines THEN 'out_of_range' WHEN state IS DISTINCT FROM 'live' THEN 'not_live' ELSE 'ok' END AS status FROM {CITATIONS.sql()} c LEFT JOIN {FILES.sql()} f USING (path)"
_ANCHORS = f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(said, '{lint.ANCHOR}')) AS anchor FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS said FROM {SPEC.sql()}) WHERE NOT contains(said, 'LESSONS')"
_COVERS = "(anchor = {w} OR starts_with(anchor, {w} || '.'))".format
_NEEDS = " UNION ALL ".join(f"SELECT '{k}' AS template, {list(v)} AS needs" for k, v in sessions.WORKFLOW_NEEDS.items())
ORACLES = {
    "transcript_deltas": "WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, role AS path, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS old FROM conversations) SELECT session_id, path, CAST(count(*) AS BIGINT) AS n_edits, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars_added, CAST(sum(length(coalesce(old, ''))) AS BIGINT) AS chars_removed, min(turn) AS first_seq, max(turn) AS last_seq FROM l WHERE path IS NOT NULL GROUP BY session_id, path",
    "user_event_counts": "SELECT user_id, CAST(count(*) AS BIGINT) AS n_kinds, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS told FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL) GROUP BY user_id",
    "common_sources": "SELECT source FROM documents WHERE length(text) > 8192 INTERSECT SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "anchor_revalidate": f"SELECT anchor_id, CASE WHEN s.span_hash = stored_hash THEN 'live' WHEN EXISTS (SELECT 1 FROM {SPANS.sql()} o WHERE o.span_hash = stored_hash) THEN 'moved' WHEN s.span_hash IS NOT NULL THEN 'stale' WHEN NOT f.readable THEN 'unknown' ELSE 'orphaned' END AS state FROM {ANCHORS.sql()} a LEFT JOIN {SPANS.sql()} s ON s.path = target_path AND s.line_start = a.line_start AND s.line_end = a.line_end LEFT JOIN {FILES.sql()} f ON f.path = target_path",
    "span_relocation": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS said FROM d),
k AS (SELECT *, line % 50 BETWEEN 5 AND 8 AND doc_id % 3 = 0 AS moves FROM ln WHERE (doc_id * 31 + line) % 11 <> 0),
m AS (SELECT CASE WHEN moves THEN doc_id + 1 ELSE doc_id END AS doc_id, CAST(moves AS INTEGER) AS part, CASE line % 20 WHEN 8 THEN line + 1 WHEN 9 THEN line - 1 ELSE line END AS place, said FROM k),
blank AS (SELECT doc_id, part, place, CASE WHEN trim(said) = '' THEN '' ELSE said END AS said FROM m),
new AS (SELECT doc_id, 'doc:' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, doc_id % 17 <> 3 AS readable, list(said ORDER BY part, place, said) AS l FROM blank WHERE doc_id % 13 <> 5 GROUP BY doc_id),
g AS (SELECT path, size, line, list_slice(l, line, line + size - 1) AS run FROM (SELECT path, l, size, unnest(range(1, len(l) - size + 2)) AS line FROM new, (VALUES (1), (2), (3), (4)) s(size) WHERE readable)),
own AS (SELECT path, size, run, min(line) AS line FROM g GROUP BY ALL), every AS (SELECT size, run, min((path, line)) AS at FROM g GROUP BY ALL),
a AS (SELECT 'doc:' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, 1 + 3 * k AS s, 1 + k % 4 AS size, list_transform(list_slice(l, 1 + 3 * k, 1 + 3 * k + k % 4), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END) AS run FROM (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 3 + 1)) AS k FROM d) WHERE 1 + 3 * k + k % 4 <= len(l)),
h AS (SELECT path, s, unnest(range(1, size - (size + 1) // 2 + 2)) AS i, (size + 1) // 2 AS half, run FROM a),
p AS (SELECT h.path, h.s, min(own.line) AS line FROM h JOIN own ON own.path = h.path AND own.size = half AND own.run = list_slice(h.run, i, i + half - 1) WHERE len(list_filter(list_slice(h.run, i, i + half - 1), lambda x: x <> '')) > 0 GROUP BY ALL),
t AS (SELECT a.path || ':' || a.s AS anchor_id, a.path, a.s, live.path IS NOT NULL AS live, own.line AS own_line, every.at AS other, new.readable, p.line AS part_line FROM a
  LEFT JOIN g live ON live.path = a.path AND live.size = a.size AND live.line = a.s AND live.run = a.run LEFT JOIN own ON own.path = a.path AND own.size = a.size AND own.run = a.run LEFT JOIN every ON every.size = a.size AND every.run = a.run
  LEFT JOIN new ON new.path = a.path LEFT JOIN p ON p.path = a.path AND p.s = a.s),
z AS (SELECT *, CASE WHEN live THEN 'live' WHEN other IS NOT NULL THEN 'moved' WHEN NOT coalesce(readable, true) THEN 'unknown' WHEN part_line IS NOT NULL THEN 'stale' ELSE 'orphaned' END AS state FROM t)
SELECT anchor_id, state, CASE WHEN state IN ('live', 'stale') OR state = 'moved' AND own_line IS NOT NULL THEN path WHEN state = 'moved' THEN other[1] END AS new_path,
  CAST(CASE WHEN state = 'live' THEN s WHEN state = 'stale' THEN part_line WHEN own_line IS NOT NULL AND state = 'moved' THEN own_line WHEN state = 'moved' THEN other[2] END AS BIGINT) AS new_line FROM z""",
    "grounding_citations": f"SELECT answer_id, pos, status FROM ({_STATUS})",
    "grounding_gate": f"SELECT answer_id, CAST(count(*) AS BIGINT) AS n_citations, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS n_ok, CASE WHEN bool_and(status = 'ok') THEN 'cited' ELSE 'refused' END AS verdict FROM ({_STATUS}) GROUP BY answer_id",
    "citation_quality": f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS good, round(count(*) FILTER (status = 'ok') / count(*)::DOUBLE, 6) AS precision, round(count(*) FILTER (state = 'live' AND status <> 'ok') / (count(*) FILTER (state = 'live'))::DOUBLE, 6) AS false_confidence FROM ({_STATUS})",
    "trust_metrics": f"""WITH s AS ({_STATUS}), g AS (SELECT DISTINCT user_id + 100 AS answer_id, 'f' || (event_id % 300) AS path FROM events WHERE event_id % 3 = 0), ok AS (SELECT DISTINCT answer_id, path FROM s WHERE status = 'ok'),
c AS (SELECT n_ok > 0 AS supported, n_citations = 0 OR n_ok <> n_citations AS flagged FROM {SENTENCES.sql()})
SELECT (SELECT round(count(*) FILTER (status = 'ok') / count(*)::DOUBLE, 6) FROM s) AS precision, (SELECT round(count(ok.path) / count(*)::DOUBLE, 6) FROM g LEFT JOIN ok USING (answer_id, path)) AS recall,
 (SELECT round(count(*) FILTER (flagged) / count(*)::DOUBLE, 6) FROM c WHERE NOT supported) AS grounding_correctness, (SELECT CAST(count(*) AS BIGINT) FROM c WHERE NOT supported AND NOT flagged) AS unflagged, (SELECT CAST(count(*) AS BIGINT) FROM c WHERE supported AND flagged) AS wrongly_flagged,
 (SELECT round(count(*) FILTER (state = 'live' AND status <> 'ok') / (count(*) FILTER (state = 'live'))::DOUBLE, 6) FROM s) AS false_confidence""",
    "sentence_actions": f"SELECT *, CASE WHEN n_citations = 0 THEN 'annotate' WHEN n_ok = n_citations THEN 'keep' ELSE 'strip_and_flag' END AS action, CASE WHEN max(n_ok) OVER (PARTITION BY answer_id) > 0 THEN 'answer' ELSE 'refuse' END AS answer_action FROM {SENTENCES.sql()}",
    "provenance_packet": "SELECT answer_id, " + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), ','), '') AS {c}s" for c in ("project_id", "source_id", "citation", "commit_sha", "session_id")) + f", round(min(confidence), 6) AS confidence, CAST(count(*) AS BIGINT) AS n_evidence FROM {EVIDENCE.sql()} GROUP BY answer_id",
    "drift_rank": f"SELECT item_id, round(authority * recency * agreement, 6) AS score FROM {DRIFT.sql()}",
    "freshness_and_refresh": f"SELECT project_id, CASE WHEN recorded IS NULL OR head IS NULL THEN 'unknown' WHEN dirty THEN 'dirty' WHEN head <> recorded THEN 'lagging' ELSE 'fresh' END AS freshness, CASE WHEN NOT changed THEN 'none' WHEN ownership = 'owned' THEN 'three_way_merge' WHEN ownership = 'foreign' THEN 'never_overwrite' WHEN ownership = 'supplemental' THEN 'write_namespaced' ELSE 'refuse' END AS action FROM {FRESH.sql()}",
    "commit_link_nearest": """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events), p AS (SELECT a.event_id AS edit_id, b.event_id AS commit_id, abs(a.us - b.us) AS gap, b.us AS cus FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND abs(a.us - b.us) <= 21600000000 WHERE a.event_type = 'click'),
b AS (SELECT *, row_number() OVER (PARTITION BY edit_id ORDER BY gap, cus, commit_id) AS n FROM p)
SELECT event_id AS edit_id, commit_id, round(1 - gap / 21600000000.0::DOUBLE, 6) AS confidence FROM e LEFT JOIN (SELECT * FROM b WHERE n = 1) ON edit_id = event_id WHERE event_type = 'click'""",
    "plan_tasks": f"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS said FROM {PLANS.sql()}),
p AS (SELECT *, last_value(CASE WHEN regexp_matches(said, '^## +\\S') THEN regexp_extract(said, '^## +(.*)$', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS phase FROM l),
t AS (SELECT doc_id, line, phase, regexp_matches(said, '^\\s*[-*] \\[[xX]\\] ') AS done, regexp_extract(said, '\\] +(.*)$', 1) AS task, array_to_string(regexp_extract_all(said, '§[0-9]+(?:\\.[0-9]+)*'), ',') AS anchors FROM p WHERE regexp_matches(said, '^\\s*[-*] \\[[ xX]\\] '))
SELECT * FROM t UNION ALL SELECT doc_id, 0, NULL, false, 'whole_file', '' FROM {PLANS.sql()} WHERE doc_id NOT IN (SELECT doc_id FROM t)""",
    "workflow_ready": f"WITH s AS (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id), n AS ({_NEEDS}) SELECT template, CAST(count(*) AS BIGINT) AS n_sessions, CAST(count(*) FILTER (list_has_all(roles, needs)) AS BIGINT) AS n_ready FROM s, n GROUP BY template",
    "risk_levels": f"SELECT action, CAST(r AS BIGINT) AS risk, r = 0 AS auto FROM (SELECT action, CASE action {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in sessions.RISK.items())} ELSE 4 END AS r FROM {ACTIONS.sql()})",
    "event_debounce_sessions": "WITH e AS (SELECT user_id AS path, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 3600000000 THEN 0 ELSE 1 END AS f FROM e WINDOW w AS (PARTITION BY path ORDER BY us)), i AS (SELECT *, sum(f) OVER (PARTITION BY path ORDER BY us) AS n FROM g) SELECT path, min(us) AS first_us, max(us) AS last_us, CAST(count(*) AS BIGINT) AS n_events FROM i GROUP BY path, n",
    "event_dedup": "SELECT event_type, CAST(count(*) AS BIGINT) AS n_events, CAST(sum(event_id) AS BIGINT) AS sum_ids FROM events GROUP BY event_type",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_lag": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "observed_emit": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(user_id) AS BIGINT) AS n_users, CAST(sum(event_id) AS BIGINT) AS sum_ids, max(epoch_us(ts)) AS last_us, CAST(count(*) AS BIGINT) AS n_written FROM events",
    "usage_rollup": "SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS BIGINT) AS span, CAST(count(*) AS BIGINT) AS n_events, round(count(*) FILTER (event_type IN ('click', 'purchase')) / count(*)::DOUBLE, 6) AS evidence_share, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users, round(count(DISTINCT user_id) FILTER (event_type = 'signup') / count(DISTINCT user_id)::DOUBLE, 6) AS opt_in_rate, true AS p50_near, true AS p95_near, true AS users_near, true AS opt_in_near FROM events GROUP BY 1",
    "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.absent') AS absent FROM events",
    "event_prop_schemas": "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (props IS NULL OR NOT json_valid(props)) AS BIGINT) AS n_invalid, CASE WHEN bool_and(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) THEN 'OBJECT<k: BIGINT>' END AS schema FROM events GROUP BY event_type",
    "machine_events": _MACHINE,
    "machine_windows": _MACHINE,
    "append_log_events": "SELECT event_id, user_id, event_type FROM events",
    "team_idle": f"SELECT i.ts, i.session, i.task FROM {TEAM.sql()} i WHERE event = 'TeammateIdle' AND NOT EXISTS (SELECT 1 FROM {TEAM.sql()} d WHERE d.event = 'TaskCompleted' AND d.session IS NOT DISTINCT FROM i.session AND d.task IS NOT DISTINCT FROM i.task AND d.ts > i.ts)",
    "outbox_once": f"SELECT event_id, seq, type, payload, type NOT IN ('indexed', 'removed') AS unknown_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS n FROM {OUTBOX.sql()}) WHERE n = 1",
    "spec_anchors": _ANCHORS,
    "spec_anchor_coverage": f"WITH t AS (SELECT anchor FROM ({_ANCHORS}) WHERE doc_id = 'tests') SELECT phase, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.anchor = p.anchor OR starts_with(t.anchor, p.anchor || '.')) OR anchor IN (SELECT anchor FROM {WAIVERS.sql()})) AS BIGINT) AS met FROM {PHASES.sql()} p GROUP BY phase",
    "brief_check": f"WITH a AS ({_ANCHORS}), c AS (SELECT anchor FROM a WHERE doc_id = 'brief') SELECT anchor, 'unknown' AS problem FROM c WHERE anchor NOT IN (SELECT anchor FROM a WHERE doc_id = 'arch') UNION ALL SELECT anchor, 'outside_phase' FROM c WHERE NOT EXISTS (SELECT 1 FROM {PHASES.sql()} p WHERE phase = 1 AND {_COVERS(w='p.anchor').replace('(anchor', '(c.anchor').replace('starts_with(anchor', 'starts_with(c.anchor')})",
    "git_guard": f"SELECT command, regexp_matches(command, '{lint.DENIED_GIT}') AS denied FROM {COMMANDS.sql()}",
    "territory_guard": f"SELECT path, NOT (path IN ('core', 'docs') OR starts_with(path, 'core/') OR starts_with(path, 'docs/')) AS denied FROM {PATHS.sql()}",
}

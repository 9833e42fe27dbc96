"""Session memory: cards, commit links, plans, workflows, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redaction import redact_engine

#: Risk by action; only 0 may run by itself, and an unknown action is the riskiest.
RISK = {"read": 0, "search": 0, "draft": 1, "edit_owned": 2, "run_tests": 2, "edit_foreign": 3, "push": 4, "delete": 4}
#: Slices of time that a horizon is cut into.
SLICES = 16
#: Readiness rules of workflow templates, by what must be there.
WORKFLOW_NEEDS = {"review": ("user", "assistant"), "guided": ("system", "user", "assistant"), "intake": ("user",)}


def episode_cards(turns: DataFrame, consent: Column | None = None) -> DataFrame:
    """One card per session (conv_id) from turns (turn, role, text).

    Thinking turns are left out and texts are redacted before anything else reads
    them; without consent there is no card.
    """
    rows = turns.where(~F.col("role").eqNullSafe("thinking"))
    if consent is not None:
        rows = rows.where(consent)
    rows = rows.withColumn("said", redact_engine(F.coalesce("text", F.lit(""))))
    first_ask = F.min(F.when(F.col("role") == "user", F.struct("turn", "said")))
    last_word = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "said")))
    return rows.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.count("*").alias("n_turns"),
        F.count_if(F.col("role") == "user").alias("n_intents"),
        first_ask["said"].alias("first_intent"),
        last_word["said"].alias("outcome_summary"),
        F.max(F.col("said") != F.coalesce("text", F.lit(""))).alias("privacy_redacted"),
    )


def nearest_commit(edits: DataFrame, commits: DataFrame, horizon_seconds: int = 3600) -> DataFrame:
    """edits (edit_id, path, ts_us) with the commit (commit_id, path, ts_us) to the same path nearest in time.

    Both sides stand in one table, dealt by path and a slice of time; two running
    windows over a slice tell each edit the last commit before it and the next one
    after it, and a slice begins and ends with what its neighbours know, which comes
    from one row a slice. So rows grow with both sides together and no pair is
    made, however busy a path or a slice is. Ties go to the earlier commit, then the
    smaller id. confidence falls from 1 to 0 over the horizon; an edit without a
    commit within it stays, unlinked.
    """
    width = horizon_seconds * 1_000_000
    at = F.floor(F.col("ts_us") * SLICES / width).alias("slice")
    kind = commits.schema["commit_id"].dataType
    e = edits.select("path", "ts_us", at, "edit_id", F.lit(None).cast(kind).alias("commit_id"), F.lit(True).alias("asks"))
    c = commits.groupBy("path", "ts_us").agg(F.min("commit_id").alias("commit_id")).select("path", "ts_us", at, F.lit(None).cast(edits.schema["edit_id"].dataType).alias("edit_id"), "commit_id", F.lit(False).alias("asks"))
    seen = F.struct("ts_us", "commit_id")
    per = c.groupBy("path", "slice").agg(F.min(seen).alias("first"), F.max(seen).alias("last"))
    every = e.unionByName(c)
    # an edit's slice need not have a commit, so slices of both sides are told what lies around them
    slices = every.groupBy("path", "slice").agg(F.lit(1).alias("one")).drop("one").join(per, ["path", "slice"], "left")
    around = Window.partitionBy("path")
    before = F.last("last", ignorenulls=True).over(around.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", ignorenulls=True).over(around.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("path", "slice", before.alias("before"), after.alias("after"))
    inside = Window.partitionBy("path", "slice")
    upto = lambda *order: inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    commit = F.when(~F.col("asks"), seen)
    told = every.withColumn("last", F.last(commit, ignorenulls=True).over(upto("ts_us", "asks"))).withColumn("next", F.last(commit, ignorenulls=True).over(upto(F.desc("ts_us"), "asks")))
    told = told.where("asks").join(slices, ["path", "slice"], "left")
    near = lambda place: F.when(F.col(place).isNotNull(), F.struct(F.abs(F.col("ts_us") - F.col(place)["ts_us"]).alias("gap"), F.col(place)["ts_us"].alias("at"), F.col(place)["commit_id"].alias("commit_id")))
    best = F.array_min(F.array_compact(F.array(*map(near, ("last", "next", "before", "after")))))
    best = F.when(best["gap"] <= width, best)
    return told.withColumn("b", best).select("edit_id", F.col("b.commit_id").alias("commit_id"), F.round(1 - F.col("b.gap") / width, 6).alias("confidence"))


def plan_tasks(plans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, phase, done, task, anchors) of check-box lines under `## ` phases; a plan without any is one whole-file row."""
    lines = plans.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "said"))
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("phase", F.last(F.when(F.col("said").rlike(r"^## +\S"), F.regexp_extract("said", r"^## +(.*)$", 1)), ignorenulls=True).over(upto))
    box = rows.where(F.col("said").rlike(r"^\s*[-*] \[[ xX]\] "))
    tasks = box.select(key, F.col("line").cast("long").alias("line"), "phase", F.col("said").rlike(r"^\s*[-*] \[[xX]\] ").alias("done"), F.regexp_extract("said", r"\] +(.*)$", 1).alias("task"), F.array_join(F.regexp_extract_all("said", F.lit(r"§[0-9]+(?:\.[0-9]+)*"), F.lit(0)), ",").alias("anchors"))
    whole = plans.join(tasks.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("line"), F.lit(None).cast("string").alias("phase"), F.lit(False).alias("done"), F.lit("whole_file").alias("task"), F.lit("").alias("anchors"))
    return tasks.unionByName(whole)


def workflow_readiness(turns: DataFrame) -> DataFrame:
    """(session_id, template, available, ready): a template is there for all, ready where each role it needs has spoken."""
    have = turns.groupBy(F.col("conv_id").alias("session_id")).agg(F.collect_set("role").alias("roles"))
    rules = F.array(*[F.struct(F.lit(k).alias("template"), F.array(*map(F.lit, v)).alias("needs")) for k, v in WORKFLOW_NEEDS.items()])
    return have.select("session_id", "roles", F.explode(rules).alias("r")).select("session_id", "r.template", F.lit(True).alias("available"), (F.size(F.array_except("r.needs", "roles")) == 0).alias("ready"))


def risk(action: Column) -> Column:
    level = F.lit(4)
    for name, r in RISK.items():
        level = F.when(action == name, r).otherwise(level)
    return level.cast("long")

"""Traceability and guard checks over text tables."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .chunking import parsed

ANCHOR = r"§[0-9]+(?:\.[0-9]+)*|#[a-z][a-z0-9-]{2,}"


def anchors_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, anchor), each once, from all lines but those that mention LESSONS."""
    lines = docs.select(key, F.explode(F.split(text, "\n", -1)).alias("said")).where(~F.contains("said", F.lit("LESSONS")))
    return lines.select(key, F.explode(F.regexp_extract_all("said", F.lit(ANCHOR), F.lit(0))).alias("anchor")).distinct()


def covers(wide: Column, narrow: Column) -> Column:
    """True if narrow is wide or one of its sub-anchors."""
    return (narrow == wide) | narrow.startswith(F.concat(wide, F.lit(".")))


def coverage(wanted: DataFrame, tagged: DataFrame, waived: DataFrame) -> DataFrame:
    """wanted (phase, anchor) with covered and waived: an anchor is covered by a tag on it or on a sub-anchor.

    Anchors are exploded to their prefixes, so the containment is an equi-join.
    """
    prefixes = tagged.select(F.explode(_prefixes(F.col("anchor"))).alias("anchor")).distinct().withColumn("covered", F.lit(True))
    excuse = waived.select("anchor").distinct().withColumn("waived", F.lit(True))
    out = wanted.join(prefixes, "anchor", "left").join(excuse, "anchor", "left")
    return out.select("phase", "anchor", F.coalesce("covered", F.lit(False)).alias("covered"), F.coalesce("waived", F.lit(False)).alias("waived"))


def _prefixes(anchor: Column) -> Column:
    parts = F.split(anchor, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def coverage_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("phase").agg(F.count("*").alias("total"), F.count_if(F.col("covered") | F.col("waived")).alias("met"))


def brief_problems(cited: DataFrame, known: DataFrame, phase: DataFrame, widened: bool = False) -> DataFrame:
    """(anchor, problem) of a brief's cited anchors: unknown to the design, or outside its phase unless it is widened."""
    unknown = cited.join(known, "anchor", "left_anti").select("anchor", F.lit("unknown").alias("problem"))
    inside = cited.select("anchor", F.explode(_prefixes(F.col("anchor"))).alias("wide")).join(phase.select(F.col("anchor").alias("wide")), "wide").select("anchor").distinct()
    outside = cited.join(inside, "anchor", "left_anti").select("anchor", F.lit("outside_phase").alias("problem"))
    return unknown if widened else unknown.unionByName(outside)


def path_denied(path: Column, territories: list[str]) -> Column:
    """True if the path lies in none of the territories."""
    ok = F.lit(False)
    for t in territories:
        ok |= (path == t.rstrip("/")) | path.startswith(t.rstrip("/") + "/")
    return ~ok


#: Commands that rewrite or publish history.
DENIED_GIT = r"^\s*git\s+(?:push\b.*(?:\s--force\b|\s-f\b)|reset\s+--hard\b|clean\s+-[a-z]*f|checkout\s+--\s|filter-branch\b|push\b.*\bmain\b)"


def git_denied(command: Column) -> Column:
    return command.rlike(DENIED_GIT)


#: Calls that change files or start processes.
MUTATORS = ("open", "remove", "unlink", "rmtree", "rename", "replace", "mkdir", "makedirs", "write_text", "write_bytes", "run", "Popen", "system")


@udtf(returnType="line: int, call: string")
class MutatingCalls:
    """Lines of a Python file that call a mutator; a file that doesn't parse is one row `unparsed`."""

    def eval(self, source: str) -> Iterator[tuple]:
        tree = parsed(source or "")
        if tree is None:
            yield 0, "unparsed"
            return
        for node in ast.walk(tree):
            if isinstance(node, ast.Call):
                name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", None)
                if name in MUTATORS:
                    yield node.lineno, name


def mutation_tripwire(files: DataFrame, allowed: list[str]) -> DataFrame:
    """(path, line, call) of mutating calls in files (path, source) outside the allowed ones."""
    spark = files.sparkSession
    spark.udtf.register("mutating_calls", MutatingCalls)
    files.where(~F.col("path").isin(*allowed)).select("path", "source").createOrReplaceTempView("files_for_tripwire")
    return spark.sql("SELECT path, m.* FROM files_for_tripwire, LATERAL mutating_calls(source) m")


def idle_without_completion(events: DataFrame) -> DataFrame:
    """Idle events (ts, event, session, task) with no completion of the same task in that session after them."""
    idle, done = events.where("event = 'TeammateIdle'"), events.where("event = 'TaskCompleted'").select("session", "task", F.col("ts").alias("done_ts"))
    last = done.groupBy("session", "task").agg(F.max("done_ts").alias("done_ts"))
    told = idle.join(last, idle["session"].eqNullSafe(last["session"]) & idle["task"].eqNullSafe(last["task"]), "left")
    return told.where(F.col("done_ts").isNull() | (F.col("done_ts") <= F.col("ts"))).select(idle["ts"], idle["session"], idle["task"])

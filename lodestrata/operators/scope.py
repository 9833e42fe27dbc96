"""What a caller may see and do: scopes, filters before search, capabilities, registers, joins between memory and graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def in_scope(rows: DataFrame, scope: str, project_id: str | None = None, project: str = "project_id") -> DataFrame:
    """One project's rows, or the whole portfolio's; on a table partitioned by project only its folder is read."""
    if scope not in schemas.SCOPES:
        raise ValueError(f"scope must be one of {schemas.SCOPES}")
    if scope == "portfolio":
        return rows
    if not project_id:
        raise ValueError("a project scope needs a project")
    return rows.where(F.col(project) == project_id)


#: Chips that narrow a search, and the column each one tests.
CHIPS = {"project": "project_id", "session": "session_id", "file": "source_path", "diff": "diff_id", "pull_request": "pr_id", "plan_task": "task_id", "team": "team_id"}


def with_chips(rows: DataFrame, chips: dict[str, list[str]]) -> DataFrame:
    """Rows that pass every chip; values of one chip are alternatives. The tests reach the scan before any search does."""
    for chip, values in chips.items():
        rows = rows.where(F.col(CHIPS[chip]).isin(*values))
    return rows


def authorize(intents: DataFrame, allowed: DataFrame) -> DataFrame:
    """intents (intent_id, capability) with `authorized`: only capabilities on the list are."""
    ok = allowed.select("capability").distinct().withColumn("__ok", F.lit(True))
    return intents.join(ok, "capability", "left").select(*intents.columns, F.coalesce("__ok", F.lit(False)).alias("authorized"))


def perform(intents: DataFrame, stamped: DataFrame, allowed: DataFrame) -> DataFrame:
    """(intent_id, status): an act needs its stamp, and its capability must still be on the list; both are checked anew."""
    stamp = stamped.where("authorized").select("intent_id").distinct().withColumn("stamp", F.lit(True))
    now = authorize(intents, allowed).join(stamp, "intent_id", "left")
    return now.select("intent_id", F.when(F.col("stamp").isNull(), "denied:no_stamp").when(~F.col("authorized"), "denied:not_allowed").otherwise("performed").alias("status"))


def in_register(chunks: DataFrame, register: str) -> DataFrame:
    """Chunks written plainly, or those that go deep."""
    if register not in schemas.REGISTER:
        raise ValueError(f"register must be one of {schemas.REGISTER}")
    return chunks.where(F.col("register") == register)


def anchors_to_nodes(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """anchors (anchor_id, target_symbol) with the graph node of that qualified name; those without one stay."""
    return anchors.join(nodes.select(F.col("qualified_name").alias("target_symbol"), F.col("id").alias("node_id")), "target_symbol", "left").select("anchor_id", "target_symbol", "node_id")


def undocumented(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Exported nodes that no document's anchor points to: the gaps in the documents."""
    return nodes.where("is_exported").join(anchors.select(F.col("target_symbol").alias("qualified_name")), "qualified_name", "left_anti").select("id", "qualified_name")


def contradicted(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims (claim_id, symbol, says) that the code's facts (symbol, says) hold no row for."""
    return claims.join(facts, ["symbol", "says"], "left_anti")


def live_only_cited(citations: DataFrame, state: Column) -> DataFrame:
    """citations with `served_as_cited`: true for live anchors only; the others stay, unserved."""
    return citations.withColumn("served_as_cited", F.coalesce(state == "live", F.lit(False)))

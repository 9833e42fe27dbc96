"""The five tools that an agent calls, each a checked request that gives a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import schemas
from ..functions import redaction, validators
from . import federation, graph, retrieval, scope


def _check(spark, value, problem, name: str) -> None:  # noqa: ANN001
    """Refuses a value; a row of literals is worked out while it is planned, so no job runs."""
    reason = spark.sql("VALUES (1)").select(problem(F.lit(value))).first()[0]
    if reason is not None:
        raise ValueError(f"{name}: {reason}")


def search(chunks: DataFrame, policies: DataFrame, query: str, top_k: int = schemas.DEFAULT_TOP_K, within: str = "project", project_id: str | None = None) -> DataFrame:
    """(chunk_id, project_id, score, rank, text) of the best chunks in scope; projects that aren't visible are left out before anything is scored, texts are redacted on the way out.

    chunks: chunk_id, project_id, text.
    """
    spark = chunks.sparkSession
    _check(spark, query, validators.query_problem, "query")
    _check(spark, top_k, validators.top_k_problem, "top_k")
    seen = scope.in_scope(chunks, within, project_id)
    seen = seen.join(policies.where("federation_visible").select("project_id"), "project_id", "left_semi")
    asked = spark.createDataFrame([(0, query.strip())], "query_id long, query string")
    best = retrieval.ranked(retrieval.bm25(seen, asked, "chunk_id"), "chunk_id", top_k)
    return best.join(seen, "chunk_id").select("chunk_id", "project_id", "score", "rank", redaction.redact_engine(F.col("text"), "mcp_egress").alias("text"))


def get_file(files: DataFrame, path: str, project_id: str | None = None) -> DataFrame:
    """(path, text) of one file, of one project if files have a project_id, redacted; paths that leave the tree are refused."""
    _check(files.sparkSession, path, validators.path_problem, "path")
    if "project_id" in files.columns:
        _check(files.sparkSession, project_id, validators.identity_problem, "project_id")
        files = files.where(F.col("project_id") == project_id)
    return files.where(F.col("path") == path).select("path", redaction.redact_engine(F.col("text"), "mcp_egress").alias("text"))


def ask_graph(edges: DataFrame, nodes: DataFrame, kind: str, symbol: str) -> DataFrame:
    """Rows of one query kind about one symbol."""
    if kind not in schemas.GRAPH_KINDS:
        raise ValueError(f"kind must be one of {schemas.GRAPH_KINDS}")
    _check(nodes.sparkSession, symbol, validators.identity_problem, "symbol")
    if kind == "search":
        return graph.find_nodes(nodes, symbol)
    if kind == "node":
        return nodes.where(F.col("id") == symbol)
    symbols = nodes.sparkSession.createDataFrame([(symbol,)], "symbol string")
    return {"callers": graph.callers, "callees": graph.callees, "explore": graph.explore}[kind](edges, nodes, symbols)


def list_projects(registry: DataFrame, policies: DataFrame) -> DataFrame:
    """Registered projects, each visible or a denied marker with its reason."""
    return federation.apply_policy(registry, policies).select("project_id", F.when(~F.col("denied"), F.col("last_indexed_sha")).alias("last_indexed_sha"), "denied", "denied_reason")


def status(registry: DataFrame, stamps: DataFrame, expected: DataFrame, heads: DataFrame) -> DataFrame:
    """(project_id, freshness, gate_reason) of each registered project; heads: project_id, head, dirty."""
    from .grounding import freshness

    gate = federation.stamp_gate(stamps, expected).select("project_id", F.col("reason").alias("gate_reason"))
    told = registry.join(heads, "project_id", "left").join(gate, "project_id", "left")
    return told.select("project_id", freshness(F.col("head"), F.col("last_indexed_sha"), F.coalesce("dirty", F.lit(False))).alias("freshness"), "gate_reason")


def stream_items(answer: DataFrame, *order: str) -> Iterator[Row]:
    """An answer's rows one after the other in order; the driver holds one partition at a time, and the next is made meanwhile."""
    yield from answer.orderBy(*order).toLocalIterator(prefetchPartitions=True)

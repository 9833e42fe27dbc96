"""Queries of scopes, capabilities, tools and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import providers, scope, tools
from ._bind import Fixture, table
from .contracts import POLICIES
from .store import EXPECTED, STAMPS

INTENTS = Fixture("intent_id long, capability string", [(1, "write"), (2, "delete"), (3, "read"), (4, "write")], "SELECT event_id + 1000 AS intent_id, CASE event_type WHEN 'click' THEN 'write' WHEN 'view' THEN 'read' WHEN 'error' THEN 'delete' ELSE event_type END AS capability FROM {events}")
ALLOWED = Fixture("capability string", [("write",), ("read",)])
STAMPED = Fixture("intent_id long, authorized boolean", [(1, True), (2, True), (3, False), (4, None)], "SELECT event_id + 1000 AS intent_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS authorized FROM {events} WHERE event_id % 9 <> 0")
ANCHORS = Fixture("anchor_id string, target_symbol string", [("a1", "core.gate"), ("a2", "core.gone"), ("a3", None), ("a4", "core.gate")], "SELECT 'e' || event_id AS anchor_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'part.' || (event_id % 400) END AS target_symbol FROM {events}")
NODES = Fixture("id string, qualified_name string, is_exported boolean", [("n1", "core.gate", True), ("n2", "core.other", True), ("n3", "core.hidden", False)], "SELECT 'p' || p_partkey AS id, 'part.' || p_partkey AS qualified_name, p_partkey % 3 <> 0 AS is_exported FROM {part}")
CLAIMS = Fixture("claim_id long, symbol string, says string", [(1, "gate", "async"), (2, "gate", "sync"), (3, "lost", "sync")], "SELECT event_id + 1000 AS claim_id, 'user' || user_id AS symbol, event_type AS says FROM {events}")
FACTS = Fixture("symbol string, says string", [("gate", "sync")], "SELECT DISTINCT 'user' || user_id AS symbol, event_type AS says FROM {events} WHERE event_id % 3 = 0")
REGISTRY = Fixture("project_id string, last_indexed_sha string", [(f"src{k}", None if k == 3 else f"sha{k}") for k in range(0, 16, 3)], "SELECT 'P' || source AS project_id, CASE WHEN min(doc_id) % 5 = 3 THEN NULL ELSE 'sha' || max(doc_id) END AS last_indexed_sha FROM {documents} GROUP BY source")
HEADS = Fixture("project_id string, head string, dirty boolean", [("src0", "sha0", False), ("src3", "sha9", False), ("src6", "sha7", False), ("src9", "sha9", True)], "SELECT 'P' || source AS project_id, 'sha' || CASE WHEN min(doc_id) % 2 = 0 THEN max(doc_id) ELSE min(doc_id) END AS head, min(doc_id) % 7 = 0 AS dirty FROM {documents} GROUP BY source HAVING min(doc_id) % 6 <> 5")


def retrieval_scope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "project_id")
    return scope.with_chips(scope.in_scope(docs, "project", "src3"), {"project": ["src3", "src4"]}).select("doc_id", "project_id")


def host_gate(spark, sf_dir):
    return scope.perform(INTENTS.frame(spark, sf_dir), STAMPED.frame(spark, sf_dir), ALLOWED.frame(spark, sf_dir))


def anchor_symbols(spark, sf_dir):
    return scope.anchors_to_nodes(ANCHORS.frame(spark, sf_dir), NODES.frame(spark, sf_dir))


def doc_gaps(spark, sf_dir):
    return scope.undocumented(NODES.frame(spark, sf_dir), ANCHORS.frame(spark, sf_dir))


def doc_conflicts(spark, sf_dir):
    return scope.contradicted(CLAIMS.frame(spark, sf_dir), FACTS.frame(spark, sf_dir)).select("claim_id", "symbol", "says")


def tool_list_projects(spark, sf_dir):
    return tools.list_projects(REGISTRY.frame(spark, sf_dir), POLICIES.frame(spark, sf_dir))


def tool_status(spark, sf_dir):
    return tools.status(REGISTRY.frame(spark, sf_dir), STAMPS.frame(spark, sf_dir), EXPECTED.frame(spark, sf_dir), HEADS.frame(spark, sf_dir))


def tool_search(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("project_id"), "text")
    return tools.search(chunks, POLICIES.frame(spark, sf_dir), "that with onthe", 10, "portfolio").select("chunk_id", "project_id", "score", "rank")


def tool_get_file(spark, sf_dir):
    """One file of one project, as an agent gets it."""
    files = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("p"), (F.col("item_id") % 3).cast("string")).alias("project_id"), F.concat(F.lit("items/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return tools.get_file(files, "items/7.txt", "p1").select("path", F.sha2("text", 256).alias("text_hash"))


def embed_provider(spark, sf_dir):
    v = providers.embed(table(spark, sf_dir, "benchmark"), providers.HashProvider(16), "item_id")
    return v.select("item_id", "embedding_model_version", F.posexplode("vector").alias("i", "x")).select("item_id", "embedding_model_version", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def late_chunks(spark, sf_dir):
    v = providers.late_chunks(table(spark, sf_dir, "benchmark"), providers.HashProvider(8), 16, "item_id")
    return v.select("item_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk_text", F.round(F.col("vector")[0], 6).alias("x0"))


QUERIES = {f.__name__: f for f in (retrieval_scope, host_gate, anchor_symbols, doc_gaps, doc_conflicts, tool_list_projects, tool_status, tool_search, tool_get_file, embed_provider, late_chunks)}

_W = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
_H = "CAST('0x' || substring(sha256({}), {}, 2) AS BIGINT) / 255.0::DOUBLE"
ORACLES = {
    "retrieval_scope": "SELECT doc_id, source AS project_id FROM documents WHERE source = 'src3'",
    "host_gate": f"SELECT intent_id, CASE WHEN NOT coalesce(s.authorized, false) THEN 'denied:no_stamp' WHEN capability NOT IN (SELECT capability FROM {ALLOWED.sql()}) THEN 'denied:not_allowed' ELSE 'performed' END AS status FROM {INTENTS.sql()} LEFT JOIN {STAMPED.sql()} s USING (intent_id)",
    "anchor_symbols": f"SELECT anchor_id, target_symbol, id AS node_id FROM {ANCHORS.sql()} LEFT JOIN {NODES.sql()} ON qualified_name = target_symbol",
    "doc_gaps": f"SELECT id, qualified_name FROM {NODES.sql()} n WHERE is_exported AND NOT EXISTS (SELECT 1 FROM {ANCHORS.sql()} WHERE target_symbol = n.qualified_name)",
    "doc_conflicts": f"SELECT * FROM {CLAIMS.sql()} c WHERE NOT EXISTS (SELECT 1 FROM {FACTS.sql()} f WHERE f.symbol = c.symbol AND f.says = c.says)",
    "tool_list_projects": f"SELECT project_id, CASE WHEN coalesce(federation_visible, false) THEN last_indexed_sha END AS last_indexed_sha, NOT coalesce(federation_visible, false) AS denied, CASE WHEN federation_visible IS NULL THEN 'no_policy' WHEN NOT federation_visible THEN 'not_visible' END AS denied_reason FROM {REGISTRY.sql()} LEFT JOIN {POLICIES.sql()} USING (project_id)",
    "tool_status": f"SELECT r.project_id, CASE WHEN last_indexed_sha IS NULL OR head IS NULL THEN 'unknown' WHEN dirty THEN 'dirty' WHEN head <> last_indexed_sha THEN 'lagging' ELSE 'fresh' END AS freshness, CASE WHEN s.project_id IS NULL THEN NULL WHEN s.schema_version IS NULL THEN 'no_stamp' WHEN s.schema_version <> 3 THEN 'schema_version_mismatch' WHEN s.embedding_model <> 'm1' THEN 'embedding_model_mismatch' WHEN s.dimension <> 64 THEN 'dimension_mismatch' END AS gate_reason FROM {REGISTRY.sql()} r LEFT JOIN {HEADS.sql()} h USING (project_id) LEFT JOIN {STAMPS.sql()} s ON s.project_id = r.project_id",
    "tool_search": f"""WITH d AS (SELECT doc_id, source, {_W.format('text')} AS words FROM documents WHERE source IN (SELECT project_id FROM {POLICIES.sql()} WHERE federation_visible)),
c AS (SELECT count(*) AS n_docs, avg(len(words)) AS mean_len FROM d), p AS (SELECT doc_id, source, term, len(words) AS dl, count(*) AS tf FROM (SELECT *, unnest(words) AS term FROM d) WHERE term IN ('that', 'with', 'onthe') GROUP BY doc_id, source, term, len(words)),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT doc_id AS chunk_id, source AS project_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 6) AS score FROM p JOIN f USING (term), c GROUP BY doc_id, source)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS BIGINT) AS rank FROM s) WHERE rank <= 10""",
    "tool_get_file": "SELECT 'items/7.txt' AS path, sha256(text) AS text_hash FROM benchmark WHERE item_id = 7",
    "embed_provider": f"SELECT item_id, 'hash-16' AS embedding_model_version, CAST(i AS BIGINT) AS i, round({_H.format('text', 'CAST(2 * i + 1 AS BIGINT)')}, 6) AS x FROM (SELECT item_id, text, unnest(range(16)) AS i FROM benchmark)",
    "late_chunks": f"WITH w AS (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark), u AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM w) SELECT item_id, CAST(i // 16 AS BIGINT) AS ordinal, string_agg(word, ' ' ORDER BY i) AS chunk_text, round(avg({_H.format('word', '1')}), 6) AS x0 FROM u GROUP BY item_id, i // 16",
}

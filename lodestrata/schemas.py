"""Closed table schemas and named alphabets; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

#: The named alphabets.
DOC_OR_CODE = ("doc", "code")
OWNERSHIP = ("owned", "foreign", "supplemental")
REGISTER = ("plain", "deep")
ANCHOR_STATES = ("live", "stale", "moved", "unknown", "orphaned")
SCOPES = ("project", "portfolio")
GRAPH_KINDS = ("explore", "node", "callers", "callees", "search")
SINKS = ("persist", "mcp_egress", "cloud_egress")
SECRET_CLASSES = ("prefix_token", "high_entropy_kv", "json_sensitive_value", "env_dump")
HOST_CAPABILITIES = ("own_store_write", "owned_doc_refresh", "consented_host_config")
RESIDUAL_CLASSES = ("git_sha_hex", "sub_20_char_json", "adversarial_short_split")

#: Bounds of the contracts.
MAX_TOP_K, DEFAULT_TOP_K, MAX_QUERY_LEN, MAX_RESPONSE_ITEMS, MAX_IDENTITY, MAX_TEXT = 100, 10, 4096, 500, 1024, 8192


def _schema(required: str, optional: str = "") -> T.StructType:
    """Fields of two DDL strings, the first without nulls."""
    return T.StructType([T.StructField(n, t, False) for n, t in _fields(required, " ")] + [T.StructField(n, t) for n, t in _fields(optional, " ")])


_PLAIN = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _fields(ddl: str, between: str) -> list[tuple[str, T.DataType]]:
    return [(n.strip(), _type(t)) for n, t in (part.split(between, 1) for part in (p.strip() for p in _top_level(ddl)) if part)]


def _top_level(ddl: str) -> list[str]:
    """Parts between commas that stand outside angle brackets."""
    parts, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _type(ddl: str) -> T.DataType:
    """A type by its DDL, without a session."""
    name, _, inner = ddl.strip().partition("<")
    if not inner:
        return _PLAIN[name]
    inner = inner[:-1]
    if name == "array":
        return T.ArrayType(_type(inner))
    if name == "map":
        return T.MapType(*map(_type, _top_level(inner)))
    return T.StructType([T.StructField(n, t) for n, t in _fields(inner, ":")])


def chunk() -> T.StructType:
    return _schema(
        "chunk_id string, project_id string, source_path string, doc_or_code string, producer string, doc_type string, ownership string, register string, text string, vector array<float>, anchor string, content_hash string, last_resolved_sha string, ingested_from_sha string, embedding_model_version string, generation int, tombstone boolean, created_at timestamp",
        "context_blurb string",
    )


def anchor() -> T.StructType:
    return _schema("anchor_id string, project_id string, source_file string, source_span string, target_path string, target_line_start int, target_line_end int, state string, last_resolved_sha string, confidence double", "target_symbol string")


def evidence() -> T.StructType:
    return _schema("type string, label string", "resource_ref string, confidence double")


def provenance() -> T.StructType:
    base = _schema("project_ids array<string>, source_ids array<string>, citations array<string>, commit_shas array<string>, session_ids array<string>, index_freshness string, confidence double, drift_markers array<string>", "recorded_sha string")
    return T.StructType([*base, T.StructField("evidence", T.ArrayType(evidence()), False)])


def manifest() -> T.StructType:
    return _schema("schemaVersion int, project_id string, source_repo string, ingestedFromSha string, embedding_model string, dimension int, chunker_version string, doc_format_spec_range string, artifacts array<struct<path:string,content_hash:string,doc_type:string,producer:string,ownership:string>>, staleness_pointer string, policy_path string, lance_version_tag string")


def registry_entry() -> T.StructType:
    return _schema("project_id string, db_path string, schema_version int, model_version string, codegraph_db_path string, last_indexed_sha string, policy string")


def store_stamp() -> T.StructType:
    return _schema("embedding_model string, dimension int, schema_version int, index_built_at timestamp, source_root_hash string")


def policy() -> T.StructType:
    return _schema("schema_version int, privacy string, providers map<string,string>, mcp_expose boolean, federation_visible boolean, sessions_consent boolean, brainignore array<string>")


def graph_nodes() -> T.StructType:
    return _schema(
        "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int, end_column int, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean",
        "docstring string, signature string, visibility string, decorators string, type_parameters string, updated_at long, return_type string",
    )


def graph_edges() -> T.StructType:
    return _schema("id long, source string, target string, kind string", "metadata string, line int, col int, provenance string")


def graph_files() -> T.StructType:
    return _schema("path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int", "errors string")


def unresolved_refs() -> T.StructType:
    return _schema("id long, from_node_id string, reference_name string, reference_kind string, line int, col int", "candidates string, file_path string, language string")


def episode_card() -> T.StructType:
    return _schema("episode_id string, session_id string, project_id string, tool string, start_ts timestamp, end_ts timestamp, user_intents array<string>, files_touched array<string>, key_decisions array<string>, errors_fixed array<string>, outcome_summary string, linked_commits array<struct<sha:string,confidence:double>>, linked_tasks array<string>, privacy_redacted boolean", "model string, branch string, worktree_path string")


def event() -> T.StructType:
    return _schema("name string, payload string")


def obs_event() -> T.StructType:
    return T.StructType([T.StructField("name", T.StringType(), False), T.StructField("attributes", T.ArrayType(_schema("k string, v string")), False)])


TABLES = {f.__name__: f for f in (chunk, anchor, evidence, provenance, manifest, registry_entry, store_stamp, policy, graph_nodes, graph_edges, graph_files, unresolved_refs, episode_card, event, obs_event)}

#: Transitions of the state machines; an edge that is not here is refused.
TRANSITIONS = {
    "generation": [("building", "reembedding"), ("reembedding", "validating"), ("validating", "swapping"), ("swapping", "active"), ("active", "retired"), ("retired", "gc_eligible"), ("gc_eligible", "purged")],
    "anchor": [(a, b) for a in ("stale", "moved", "unknown") for b in ("live", "orphaned")] + [("live", b) for b in ("stale", "moved", "unknown")] + [("orphaned", "live")],
    "project": [("added", "indexing"), ("indexing", "ready"), ("ready", "syncing"), ("syncing", "ready"), ("syncing", "drift_detected"), ("drift_detected", "reindexing"), ("reindexing", "ready"), ("reindexing", "index_failed"), ("indexing", "index_failed"), ("ready", "archived"), ("ready", "removed"), ("archived", "removed")],
    "worker": [("cold", "warm"), ("warm", "idle_evicted"), ("warm", "write_held"), ("write_held", "warm"), ("idle_evicted", "warm"), ("write_held", "crashed"), ("warm", "crashed"), ("crashed", "warm")],
    "episode": [("no_consent", "consent_granted"), ("consent_granted", "reading"), ("reading", "redacting"), ("redacting", "quarantined_unsafe"), ("redacting", "redacted"), ("redacted", "summarizing"), ("summarizing", "embedded"), ("embedded", "linked"), ("linked", "superseded")] + [(s, "consent_revoked") for s in ("consent_granted", "reading", "redacting", "redacted", "summarizing", "embedded", "linked", "quarantined_unsafe")],
}

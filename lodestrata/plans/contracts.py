"""Queries of the ingress and egress contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import validators as V
from ..operators import federation
from ._bind import Fixture, table

REQUESTS = Fixture(
    "request_id long, query string, top_k int, scope string, project_id string",
    [(1, "where is the gate?", 10, "project", "p1"), (2, "   ", 10, "project", "p1"), (3, None, 10, "project", "p1"), (4, "x", 0, "project", "p1"), (5, "x", 101, "portfolio", "p1"), (6, "x", 100, "galaxy", "p1"), (7, "x" * 4097, 1, "project", "p1"), (8, " " + "x" * 4096 + "\n", 1, "project", "p1"), (9, "x", 5, "portfolio", "a‮b"), (10, "x", 5, "portfolio", " ok "), (11, "x", None, None, "p1"), (12, "x", 5, "project", "")],
    "SELECT event_id + 1000 AS request_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN repeat('x', CAST(4090 + event_id % 13 AS INT)) ELSE ' where is ' || event_type || '?' END AS query, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 113 - 5 END AS top_k, CASE event_id % 5 WHEN 0 THEN 'galaxy' WHEN 1 THEN NULL WHEN 2 THEN 'portfolio' ELSE 'project' END AS scope, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'a‮b' ELSE ' p' || user_id || ' ' END AS project_id FROM {events}",
)
PATHS = Fixture("path string", [(p,) for p in ("a/b.md", "README", "", "/etc/passwd", "../x", "a/../b", "a/..b", "a b", "a\\b", "c:d", "a/b/", "~/x", "a\n", "ünï", "a／b", "..", "a/..", ".hidden", "-x", "a//b")] + [(None,)], "SELECT CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN '/' || page_id || '/x' WHEN 2 THEN page_id || '/../' || url WHEN 3 THEN page_id || ' y' WHEN 4 THEN NULL WHEN 5 THEN '' ELSE replace(replace(replace(replace(url, 'https://', ''), 'http://', ''), '?', '/'), '=', '.') END AS path FROM {pages}")
DIRS = Fixture("value string", [(v,) for v in (".codegraph", "graph", " graph ", "", "..", ".", "-rf", "a/b", "a b", "x.y_z-1", "g\n", "é")] + [(None,)], "SELECT CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN ' graph_' || c_custkey || ' ' WHEN 2 THEN '-' || c_custkey WHEN 3 THEN c_mktsegment || '/' || c_custkey WHEN 4 THEN NULL ELSE '.g' || c_custkey END AS value FROM {customer}")
POLICIES = Fixture("project_id string, federation_visible boolean", [(f"src{k}", k % 3 != 0) for k in range(12)], "SELECT 'P' || source AS project_id, min(doc_id) % 3 <> 0 AS federation_visible FROM {documents} GROUP BY source")
TEXTS = Fixture("text_id long, text string", [(1, "fine\ttext\nhere"), (2, "bell\x07"), (3, "  "), (4, None), (5, "y" * 8192), (6, "y" * 8193), (7, "del\x7f"), (8, "c1\x85x")], "SELECT page_id + 100 AS text_id, CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN url || chr(7) WHEN 2 THEN url || chr(127) || 'x' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE url END AS text FROM {pages}")


def ingress_validate(spark, sf_dir):
    checks = {"query": V.query_problem(F.col("query")), "top_k": V.top_k_problem(F.col("top_k")), "scope": V.member_problem(F.col("scope"), schemas.SCOPES), "project_id": V.identity_problem(F.col("project_id"))}
    return REQUESTS.frame(spark, sf_dir).select("request_id", V.first_problem(checks).alias("reason"))


def path_allowlist(spark, sf_dir):
    return PATHS.frame(spark, sf_dir).select("path", V.path_problem(F.col("path")).alias("reason"))


def codegraph_dir(spark, sf_dir):
    return DIRS.frame(spark, sf_dir).select("value", V.codegraph_dir(F.col("value")).alias("dir"))


def text_validate(spark, sf_dir):
    return TEXTS.frame(spark, sf_dir).select("text_id", V.text_problem(F.col("text")).alias("reason"))


def document_text_validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.coalesce(V.text_problem(F.col("text")), F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n_docs"))


def policy_filter(spark, sf_dir):
    told = federation.apply_policy(table(spark, sf_dir, "documents").withColumnRenamed("source", "project_id"), POLICIES.frame(spark, sf_dir))
    return told.select("doc_id", "project_id", "denied", "denied_reason")


def denied_marker(spark, sf_dir):
    told = federation.apply_policy(table(spark, sf_dir, "documents").withColumnRenamed("source", "project_id"), POLICIES.frame(spark, sf_dir))
    return federation.denied_markers(told).select("project_id", "denied_reason", "n_hidden", "denied")


QUERIES = {f.__name__: f for f in (ingress_validate, path_allowlist, codegraph_dir, text_validate, document_text_validate, policy_filter, denied_marker)}

_S = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')".format
_TEXT = f"CASE WHEN text IS NULL THEN 'missing' WHEN length({_S('text')}) < 1 THEN 'empty' WHEN length({_S('text')}) > 8192 THEN 'too_long' WHEN regexp_matches({_S('text')}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{80}}-\\x{{9F}}]') THEN 'control_character' END"
_POLICY = f"SELECT doc_id, source AS project_id, CASE WHEN federation_visible IS NULL THEN 'no_policy' WHEN NOT federation_visible THEN 'not_visible' END AS denied_reason FROM documents LEFT JOIN {POLICIES.sql()} p ON p.project_id = source"
ORACLES = {
    "ingress_validate": f"""SELECT request_id, CASE
 WHEN query IS NULL THEN 'query:missing' WHEN length({_S('query')}) < 1 THEN 'query:empty' WHEN length({_S('query')}) > 4096 THEN 'query:too_long'
 WHEN top_k IS NULL THEN 'top_k:missing' WHEN top_k < 1 OR top_k > 100 THEN 'top_k:out_of_range'
 WHEN scope IS NULL THEN 'scope:missing' WHEN scope NOT IN ('project', 'portfolio') THEN 'scope:not_a_member'
 WHEN project_id IS NULL THEN 'project_id:missing' WHEN length({_S('project_id')}) < 1 THEN 'project_id:empty' WHEN length({_S('project_id')}) > 1024 THEN 'project_id:too_long'
 WHEN regexp_matches({_S('project_id')}, '[\\p{{Cc}}\\p{{Cf}}\\p{{Zl}}\\p{{Zp}}]') THEN 'project_id:control_character' END AS reason FROM {REQUESTS.sql()}""",
    "path_allowlist": f"SELECT path, CASE WHEN path IS NULL OR path = '' THEN 'empty' WHEN NOT regexp_full_match(path, '[A-Za-z0-9._/-]+') THEN 'charset' WHEN starts_with(path, '/') THEN 'absolute' WHEN list_contains(string_split(path, '/'), '..') THEN 'traversal' END AS reason FROM {PATHS.sql()}",
    "codegraph_dir": f"SELECT value, CASE WHEN regexp_full_match({_S('value')}, '[A-Za-z0-9._-]+') AND {_S('value')} NOT IN ('.', '..') AND NOT starts_with({_S('value')}, '-') THEN {_S('value')} ELSE '.codegraph' END AS dir FROM {DIRS.sql()}",
    "text_validate": f"SELECT text_id, {_TEXT} AS reason FROM {TEXTS.sql()}",
    "document_text_validate": f"SELECT coalesce({_TEXT}, 'ok') AS verdict, CAST(count(*) AS BIGINT) AS n_docs FROM documents GROUP BY 1",
    "policy_filter": f"SELECT doc_id, project_id, denied_reason IS NOT NULL AS denied, denied_reason FROM ({_POLICY})",
    "denied_marker": f"SELECT project_id, denied_reason, CAST(count(*) AS BIGINT) AS n_hidden, true AS denied FROM ({_POLICY}) WHERE denied_reason IS NOT NULL GROUP BY project_id, denied_reason",
}

"""Queries over content: chunks, hashes, routes, headings, anchors, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import chunking, retrieval
from ..sources import discovery, versions
from ._bind import Fixture, table

_D = "concat('sha256:', sha256(text))"
MARKDOWN = Fixture(
    "doc_id long, text string",
    [(1, "Intro line\n# Title\nSummary.\n## Part A\nBody a\n### Deep\nBody d\n## Part B\n```\n# not a heading\n```\nend"), (2, "no headings\nat all"), (3, "# Only"), (4, "## Starts low\n# Then high\n### Skips a level\n#no heading")],
    "SELECT doc_id + 100 AS doc_id, CASE doc_id % 4 WHEN 0 THEN '# ' || replace(text, chr(10), chr(10) || '## ') WHEN 1 THEN 'intro' || chr(10) || '### ' || replace(text, chr(10), chr(10) || 'x') WHEN 2 THEN '```' || chr(10) || '# no' || chr(10) || '```' || chr(10) || '# ' || source || chr(10) || text ELSE text END AS text FROM {documents} WHERE text IS NOT NULL",
)
CITING = Fixture("doc_id long, text string", [(1, "see core/model/anchor.py:20-35 and docs/a.md:7, also x.py:9-3"), (2, "none here"), (3, "a.b:0 then lib/z.rs:12-12"), (4, None)], "SELECT doc_id + 100 AS doc_id, 'see src/' || source || '.py:' || doc_id || '-' || (doc_id + doc_id % 7 - 2) || ', docs/a.md:' || (doc_id % 3) || ' ' || text AS text FROM {documents}")
CONTEXTS = Fixture("chunk_id long, context string, chunk string", [(1, "From the guide", "Body"), (2, None, "Body"), (3, "", "Body")], "SELECT doc_id + 100 AS chunk_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'From ' || source END AS context, text AS chunk FROM {documents}")
PATHS = Fixture("path string", [("p/README.md",), ("p/docs/guide.md",), ("p/docs/adr/001.md",), ("p/CHANGELOG.rst",), ("p/vendor/x/README.md",), ("p/api/openapi.yaml",), ("p/nb/a.ipynb",), ("p/src/main.py",), ("p/docs/private/x.md",), ("p/CONTRIBUTING",)], "SELECT 'p' || page_id || CASE page_id % 10 WHEN 0 THEN '/README.md' WHEN 1 THEN '/docs/guide.md' WHEN 2 THEN '/docs/adr/001.md' WHEN 3 THEN '/CHANGELOG.rst' WHEN 4 THEN '/vendor/x/README.md' WHEN 5 THEN '/api/openapi.yaml' WHEN 6 THEN '/nb/a.ipynb' WHEN 7 THEN '/docs/private/x.md' WHEN 8 THEN '/CONTRIBUTING' ELSE '/src/main.py' END AS path FROM {pages}")
PYTHON = Fixture("path string, source string", [("a.py", "import os\n\nclass A:\n    def f(self):\n        def g():\n            pass\n        os.remove('x')\n\nasync def h():\n    open('y')\n"), ("bad.py", "def broken(:\n" + "x\n" * 50), ("empty.py", "")], """SELECT 'd' || doc_id || '.py' AS path, CASE WHEN doc_id % 5 = 0 THEN text ELSE 'import os' || chr(10) || 'class A' || doc_id || ':' || chr(10) || '    def f(self):' || chr(10) || '        return ' || doc_id || chr(10) || 'def g():' || chr(10) || '    open("x")' || chr(10) || '# ' || replace(text, chr(10), ' ') || chr(10) END AS source FROM {documents} WHERE text IS NOT NULL""")


#: Ignore rules at the root, and in every host's folder.
IGNORE, HOST_IGNORE = ["# languages", "", "**/es/*", "m.*/", "/blog.*/en/1?", "*9"], ["!/en/", "en/?5"]


def chunk_documents(spark, sf_dir):
    return chunking.sized_chunks(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "chunk_id", F.length("chunk_text").cast("long").alias("n_chars"), "content_hash")


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))


def token_route(spark, sf_dir):
    return retrieval.route(table(spark, sf_dir, "documents"), "source")


def source_root_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), hashing.content_hash(F.col("text")).alias("content_hash"))
    return hashing.source_root_hash(docs, "source", "path", "content_hash")


def fake_embed(spark, sf_dir):
    v = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(hashing.hash_embedding(F.col("text"), 40)).alias("i", "x"))
    return v.select("item_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def minted_ids(spark, sf_dir):
    """Events in the order of their ids, numbered by type."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("long").alias("ord"))
    return hashing.minted_ids(kinds).select("kind", "ord", "n", "minted_id")


def heading_sections(spark, sf_dir):
    return chunking.heading_sections(MARKDOWN.frame(spark, sf_dir)).select("doc_id", "section", "heading_path", "register", "n_lines", F.sha2("body", 256).alias("body_hash"))


def anchor_parse(spark, sf_dir):
    return chunking.parse_anchors(CITING.frame(spark, sf_dir))


def context_augment(spark, sf_dir):
    return CONTEXTS.frame(spark, sf_dir).select("chunk_id", chunking.with_context(F.col("context"), F.col("chunk")).alias("text"))


def manifest_projection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("source_path"), hashing.content_hash(F.col("text")).alias("content_hash"), F.lit("other").alias("doc_type"), F.lit("owned").alias("ownership"), F.sha1(F.col("doc_id").cast("string")).alias("sha"))
    return versions.manifests(docs).select("project_id", "ingestedFromSha", "n_artifacts", F.sha2("artifacts", 256).alias("artifacts_hash"))


def registry_rebuild(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.sha1(F.col("doc_id").cast("string")).alias("ingestedFromSha"), F.col("doc_id").alias("vid"))
    return versions.registry_of(docs)


def classify_files(spark, sf_dir):
    files = PATHS.frame(spark, sf_dir).where(F.col("path").rlike(discovery.DOC_PATTERN))
    return discovery.classify(discovery.without_ignored(files, ["docs/private/"])).select("path", "producer", "doc_type", "ownership")


def ignored_pages(spark, sf_dir):
    """Pages as files, host by host: rules at the root, and those of every host's own ignore file, the last of which takes some in again."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?].*$", "").alias("path")).distinct()
    hosts = pages.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).distinct()
    root = spark.createDataFrame([("", k, line) for k, line in enumerate(IGNORE)], "dir string, line_no int, line string")
    rules = root.unionByName(hosts.select("dir", F.explode(F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(x).alias("line")) for k, x in enumerate(HOST_IGNORE)])).alias("r")).select("dir", "r.line_no", "r.line"))
    return discovery.without_ignored_by(pages, discovery.ignore_patterns(rules))


def chunk_python_ast(spark, sf_dir):
    return chunking.python_scopes(PYTHON.frame(spark, sf_dir))


QUERIES = {f.__name__: f for f in (chunk_documents, content_hash, token_route, source_root_hash, fake_embed, minted_ids, heading_sections, anchor_parse, context_augment, manifest_projection, registry_rebuild, classify_files, ignored_pages, chunk_python_ast)}

_RULES = ", ".join(f"({p}, '{pattern}', '{a}', '{b}', '{c}')" for p, pattern, a, b, c in discovery.RULES)
_LINES = f"""lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS said FROM {MARKDOWN.sql()}),
f AS (SELECT *, starts_with(said, '```') OR sum(CASE WHEN starts_with(said, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS fenced FROM lines),
l AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(said, '^#{{1,3}} +\\S') THEN length(regexp_extract(said, '^(#{{1,3}}) ', 1)) END AS lvl, regexp_extract(said, '^#{{1,3}} +(.*)$', 1) AS title FROM f),
h AS (SELECT *, {', '.join(f"coalesce(last_value(CASE WHEN lvl = {k} THEN title WHEN lvl < {k} THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), '') AS h{k}" for k in (1, 2, 3))},
  CAST(count(lvl) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS section FROM l)"""
ORACLES = {
    "ignored_pages": """WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '') AS path FROM pages), q AS (SELECT path, substr(path, strpos(path, '/') + 1) AS rest FROM p),
d AS (SELECT path, CASE WHEN strpos(path, '/') > 0 AND regexp_matches(rest, '^en/[^/]5(/.*)?$') THEN true WHEN strpos(path, '/') > 0 AND regexp_matches(rest, '^en/.*$') THEN false
 ELSE regexp_matches(path, '^(?:.*/)?es/[^/]*(/.*)?$') OR regexp_matches(path, '^(?:.*/)?m[.][^/]*/.*$') OR regexp_matches(path, '^blog[.][^/]*/en/1[^/](/.*)?$') OR regexp_matches(path, '^(?:.*/)?[^/]*9(/.*)?$') END AS gone FROM q)
SELECT path FROM d WHERE NOT gone""",
    "chunk_documents": "WITH o AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS n FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, CAST(n AS BIGINT) AS ordinal, substring(text, n * 2000 + 1, 2000) AS piece FROM o) SELECT doc_id, ordinal, doc_id || '#' || ordinal AS chunk_id, CAST(length(piece) AS BIGINT) AS n_chars, 'sha256:' || sha256(piece) AS content_hash FROM p",
    "content_hash": f"SELECT doc_id, {_D} AS content_hash FROM documents",
    "token_route": "SELECT source, tokens, CASE WHEN tokens < 200000 THEN 'whole_corpus' ELSE 'retrieval' END AS route FROM (SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY source)",
    "source_root_hash": f"SELECT source, sha256(string_agg(doc_id || ':' || {_D}, chr(10) ORDER BY doc_id || ':' || {_D})) AS source_root_hash FROM documents GROUP BY source",
    "fake_embed": "WITH i AS (SELECT item_id, sha256(text) AS h, unnest(range(40)) AS i FROM benchmark) SELECT item_id, CAST(i AS BIGINT) AS i, round(CAST('0x' || substring(h, CAST(2 * (i % 32) + 1 AS BIGINT), 2) AS BIGINT) / 255.0, 6) AS x FROM i",
    "minted_ids": "SELECT kind, ord, n, 'fakeid-' || substring(sha256(kind || chr(0) || n), 1, 24) AS minted_id FROM (SELECT event_type AS kind, CAST(event_id AS BIGINT) AS ord, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS n FROM events)",
    "heading_sections": f"WITH {_LINES} SELECT doc_id, section, concat_ws(' > ', nullif(h1, ''), nullif(h2, ''), nullif(h3, '')) AS heading_path, CASE WHEN section <= 1 THEN 'plain' ELSE 'deep' END AS register, CAST(count(*) AS BIGINT) AS n_lines, sha256(string_agg(said, chr(10) ORDER BY line)) AS body_hash FROM h GROUP BY doc_id, section, h1, h2, h3",
    "anchor_parse": f"WITH a AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_./-]+\\.[A-Za-z0-9]+:[0-9]{{1,9}}(?:-[0-9]{{1,9}})?') AS s FROM {CITING.sql()}), u AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS pos, unnest(s) AS said FROM a), p AS (SELECT doc_id, pos, regexp_extract(said, '^(.*):', 1) AS target_path, CAST(regexp_extract(said, ':([0-9]+)', 1) AS INTEGER) AS line_start, TRY_CAST(nullif(regexp_extract(said, ':[0-9]+-([0-9]+)$', 1), '') AS INTEGER) AS e FROM u) SELECT doc_id, pos, target_path, line_start, coalesce(e, line_start) AS line_end, line_start >= 1 AND coalesce(e, line_start) >= line_start AS valid FROM p",
    "context_augment": f"SELECT chunk_id, concat_ws(chr(10) || chr(10), context, chunk) AS text FROM {CONTEXTS.sql()}",
    "registry_rebuild": "SELECT source AS project_id, arg_max(sha1(CAST(doc_id AS VARCHAR)), doc_id) AS last_indexed_sha, CAST(count(*) AS BIGINT) AS n_manifests FROM documents GROUP BY source",
    "manifest_projection": f"""WITH a AS (SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS path, {_D} AS h, sha1(CAST(doc_id AS VARCHAR)) AS sha FROM documents)
SELECT project_id, max(sha) AS "ingestedFromSha", CAST(count(*) AS BIGINT) AS n_artifacts, sha256('[' || string_agg('{{"path":"' || path || '","content_hash":"' || h || '","doc_type":"other","ownership":"owned"}}', ',' ORDER BY path, h) || ']') AS artifacts_hash FROM a GROUP BY project_id""",
    "classify_files": f"WITH r AS (SELECT * FROM (VALUES {_RULES}) t(priority, pattern, producer, doc_type, ownership)), p AS (SELECT path FROM {PATHS.sql()} WHERE regexp_matches(path, '{discovery.DOC_PATTERN}') AND NOT regexp_matches(path, '(^|/)docs/private/.*$')), b AS (SELECT path, arg_min(r, priority) AS r FROM p JOIN r ON regexp_matches(path, pattern) GROUP BY path) SELECT path, coalesce(b.r.producer, 'human') AS producer, coalesce(b.r.doc_type, 'other') AS doc_type, coalesce(b.r.ownership, 'owned') AS ownership FROM p LEFT JOIN b USING (path)",
}

"""Queries of the versioned store and of federation over inline catalogs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..durable import durable, shared_folder
from ..functions import hashing
from ..operators import federation, merkle, metrics
from ..sources import versions
from ..streaming import sync
from ._bind import Fixture, micros, table

CATALOG = Fixture("store_id long, vid long, sha_tag string", [(1, k, "abc" if k in (2, 7) else None) for k in range(1, 10)] + [(2, 1, None), (2, 2, "x"), (3, 5, "only")], "SELECT o_custkey + 100 AS store_id, o_orderkey AS vid, CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey END AS sha_tag FROM {orders}")
STAMPS = Fixture("project_id string, embedding_model string, dimension int, schema_version int", [("src0", "m1", 64, 3), ("src1", "m1", 64, 2), ("src2", "m2", 64, 3), ("src3", "m1", 32, 3), ("src4", None, None, None), ("src5", "m1", 64, 3)], "SELECT 'P' || source AS project_id, CASE WHEN min(doc_id) % 7 = 6 THEN NULL WHEN min(doc_id) % 4 = 1 THEN 'm2' ELSE 'm1' END AS embedding_model, CASE WHEN min(doc_id) % 7 = 6 THEN NULL WHEN min(doc_id) % 5 = 2 THEN 32 ELSE 64 END AS dimension, CASE WHEN min(doc_id) % 7 = 6 THEN NULL WHEN min(doc_id) % 6 = 3 THEN 2 ELSE 3 END AS schema_version FROM {documents} GROUP BY source")
EXPECTED = Fixture("embedding_model string, dimension int, schema_version int", [("m1", 64, 3)])
ASKED = Fixture("project_id string", [(f"src{k}",) for k in range(8)] + [("src1",)], "SELECT CASE WHEN doc_id % 10 = 0 THEN 'Q' || source ELSE 'P' || source END AS project_id FROM {documents}")
MODELS = Fixture("generation long, old_model string, new_model string, old_dim int, new_dim int", [(1, "a", "a", 64, 64), (2, "a", "b", 64, 64), (3, "a", "b", 64, 128), (4, "a", "a", 64, 32)], "SELECT vec_id + 100 AS generation, 'm' || (vec_id % 3) AS old_model, 'm' || (vec_id % 4) AS new_model, 64 AS old_dim, CASE WHEN vec_id % 5 = 0 THEN 128 ELSE 64 END AS new_dim FROM {embeddings}")
REFS = Fixture(
    "ref_id long, reference_name string, candidates string",
    [(1, "verifyToken", "[]"), (2, "PaymentGateway.charge", "[]"), (3, "billing.PaymentGateway.charge", None), (4, "validate", "[]"), (5, "src/auth/token.ts::verifyToken", "[]"), (6, "legacy.refresh", '["ghost_999"]'), (7, "lookup", '["app.users.repo.UserRepository.find_by_id"]'), (8, "Logger", '["core.log.Logger"]'), (9, "hidden", "[]"), (10, "", "[]")],
    """SELECT event_id + 1000 AS ref_id, CASE event_id % 5 WHEN 0 THEN 'Part' || (event_id % 900) WHEN 1 THEN 'mod' || (event_id % 31) || '::Part' || (event_id % 900) WHEN 2 THEN 'pkg' || (event_id % 7) || '/mod' || (event_id % 31) || '.py::Part' || (event_id % 900) WHEN 3 THEN 'absent' || event_id ELSE 'leaf' || (event_id % 3) END AS reference_name, CASE WHEN event_id % 9 = 0 THEN '["Part' || (event_id % 50) || '"]' WHEN event_id % 2 = 0 THEN '[]' END AS candidates FROM {events}""",
)
NODES = Fixture(
    "node_id string, qualified_name string, is_exported boolean",
    [("n1", "src/auth/token.ts::verifyToken", True), ("n2", "src/billing/gateway.ts::PaymentGateway.charge", True), ("n3", "app/forms.py::validate", True), ("n4", "core.rules.validate", True), ("n5", "app.users.repo.UserRepository.find_by_id", True), ("n6", "core.log.Logger", True), ("n7", "web/log.js::Logger", True), ("n8", "x.hidden", False)],
    "SELECT 'k' || p_partkey AS node_id, 'pkg' || (p_partkey % 7) || '.mod' || (p_partkey % 31) || CASE WHEN p_partkey % 20 = 0 THEN '.leaf' || (p_partkey % 3) ELSE '.Part' || p_partkey END AS qualified_name, p_partkey % 8 <> 0 AS is_exported FROM {part}",
)
CHANGES = Fixture("entity_id long, seq long, state string", [(1, 1, "building"), (1, 2, "reembedding"), (1, 3, "validating"), (1, 4, "active"), (2, 1, "building"), (2, 2, "building"), (3, 1, "active"), (3, 2, "retired"), (3, 3, "gc_eligible"), (3, 4, "purged")], "SELECT user_id + 100 AS entity_id, event_id AS seq, CASE event_id % 8 WHEN 0 THEN 'building' WHEN 1 THEN 'reembedding' WHEN 2 THEN 'validating' WHEN 3 THEN 'swapping' WHEN 4 THEN 'active' WHEN 5 THEN 'retired' WHEN 6 THEN 'gc_eligible' ELSE 'purged' END AS state FROM {events}")
RUNS = Fixture("run_id long, latency_ms double, ram_bytes long, disk_bytes long, unindexed long", [(1, 100.0, 1 << 30, 1 << 30, 0), (2, 5000.0, 2 << 30, 5 << 30, 0), (3, 5000.1, 1, 1, 0), (4, 1.0, (2 << 30) + 1, 1, 0), (5, 1.0, 1, 1, 3)], "SELECT o_orderkey + 100 AS run_id, o_totalprice * 0.0625 AS latency_ms, o_orderkey % 40 * 100000000 AS ram_bytes, o_custkey % 90 * 100000000 AS disk_bytes, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS unindexed FROM {orders}")
_PLACES = ("billing", "auth", "search", "ledger", "mail", "queue", "report")
_CLEAN = [f"{p}.{k.title()}{p.title()}.{verb}_{p}" for p in _PLACES for k, verb in (("main", "open"), ("side", "close"), ("late", "flush"))]
_HOMONYMS = ("validate", "connect", "Logger", "encode", "serialize", "init")
_SHARED = [f"{p}.{h}" for h in _HOMONYMS for p in ("core", "edge")]
#: 35 nodes, 34 of them exported: 21 with names of their own, 12 that share theirs with another, one behind a namespace and one hidden.
CORPUS_NODES = Fixture("node_id string, qualified_name string, is_exported boolean", [(f"n{k:02d}", name, name != "vault.internal_only") for k, name in enumerate([*_CLEAN, *_SHARED, "vendor.codec.v2.Packer", "vault.internal_only"])], "SELECT node_id || '_' || s_suppkey AS node_id, qualified_name || '_' || s_suppkey AS qualified_name, is_exported FROM {supplier} CROSS JOIN {rows}")
#: 56 references: 16 clean, 12 ambiguous, 14 without a match, 14 that write their separators and namespaces in other ways.
_ASKED = (
    [("clean", name.split(".", 1)[1] if k % 2 else name, None, name) for k, name in enumerate(_CLEAN[:16])]
    + [("ambiguous", h, None if k == 0 else '["ghost_17"]', None) for h in _HOMONYMS for k in (0, 1)]
    + [("nomatch", f"absent.Thing{k}.call", None, None) for k in range(12)]
    + [("nomatch", "vault.internal_only", None, None), ("nomatch", "internal_only", None, None)]
    + [("nsvar", name.replace(".", ("::", "/")[k % 2]), None, name) for k, name in enumerate(_CLEAN[8:20])]
    + [("nsvar", "src/vendor/codec.ts::Packer", '["vendor.codec.v2.Packer"]', "vendor.codec.v2.Packer"), ("nsvar", "codec.Packer", None, "vendor.codec.v2.Packer")]
)
CORPUS_REFS = Fixture("ref_id long, reference_name string, candidates string", [(k, said, listed) for k, (_, said, listed, _) in enumerate(_ASKED)], """SELECT ref_id + 1000 * (s_suppkey + 1) AS ref_id, reference_name || '_' || s_suppkey AS reference_name, replace(candidates, '"]', '_' || s_suppkey || '"]') AS candidates FROM {supplier} CROSS JOIN {rows}""")
CORPUS_TRUTH = Fixture("ref_id long, kind string, expected string", [(k, kind, name) for k, (kind, _, _, name) in enumerate(_ASKED)], "SELECT ref_id + 1000 * (s_suppkey + 1) AS ref_id, kind, expected || '_' || s_suppkey AS expected FROM {supplier} CROSS JOIN {rows}")


def version_gc(spark, sf_dir):
    return versions.plain_versions_to_remove(CATALOG.frame(spark, sf_dir), 2)


def index_stats(spark, sf_dir):
    """Documents with a label stand for the indexed rows."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("indexed", F.lit(True))
    docs = table(spark, sf_dir, "documents").join(known, "doc_id", "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))
    return versions.unindexed_stats(docs, "source")


def _store(spark, key):
    """A new versioned table in the shared folder."""
    return versions.VersionedTable(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", key)


def _chunks(spark, sf_dir, generation):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws(":", F.lit(f"g{generation}"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", "source", F.lit(generation).cast("long").alias("generation"))


def tombstone_replace(spark, sf_dir):
    """A source's rows are tombstoned and its new ones put beside them, in one version of a table."""
    t = _store(spark, "chunk_id")
    t.upsert(_chunks(spark, sf_dir, 1))
    t.replace_source("source", "src1", _chunks(spark, sf_dir, 2).where("source = 'src1'"))
    return t.read(with_tombstones=True).groupBy("source", "generation", "tombstone").agg(F.count("*").alias("n"))


def store_upsert(spark, sf_dir):
    """Every third document comes again in a second batch, and some new ones with it."""
    t = _store(spark, "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).cast("long").alias("generation"))
    t.upsert(docs)
    again = docs.where("doc_id % 3 = 0")
    t.upsert(again.unionByName(again.withColumn("doc_id", -F.col("doc_id") - 1)).withColumn("generation", F.lit(2).cast("long")))
    return t.read().groupBy("source", "generation").agg(F.count("*").alias("n"), F.sum("doc_id").alias("sum_ids"))


def store_versions(spark, sf_dir):
    """A table as of its first, tagged version, as of its second, restored, and optimised."""
    t = _store(spark, "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    t.upsert(docs.where("doc_id % 2 = 0"), sha_tag="abc")
    t.upsert(docs.withColumn("n_chars", F.lit(0).cast("long")))
    steps = [("first", t.read(sha_tag="abc")), ("second", t.read())]
    behind = t.index_stats()
    t.restore("abc")
    steps.append(("restored", t.read()))
    t.restore("abc")
    t.optimize()
    steps.append(("optimised", t.read()))
    stats = spark.createDataFrame([("before", behind["num_unindexed_rows"], behind["num_indexed_rows"]), ("after", t.index_stats()["num_unindexed_rows"], t.index_stats()["num_indexed_rows"])], "step string, n long, total long")
    for name, rows in steps:
        stats = stats.unionByName(rows.agg(F.lit(name).alias("step"), F.count("*").alias("n"), F.sum("n_chars").alias("total")))
    return stats


def generations_swap(spark, sf_dir):
    """A second generation that is valid is swapped in; a third that is not leaves it active."""
    g = versions.Generations(spark, f"{shared_folder(spark)}/generations-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    g.build(docs.where("doc_id % 5 = 0"), lambda rows: rows.count() > 0)
    g.build(docs, lambda rows: rows.where("doc_id is null").isEmpty())
    try:
        g.build(docs.limit(0), lambda rows: not rows.isEmpty())
    except ValueError:
        pass
    return g.read().groupBy("source").agg(F.count("*").alias("n"), F.lit(g.active()).cast("long").alias("generation"))


def hash_delta(spark, sf_dir):
    """Documents against their next state: those marked toxic are gone, numbers are masked, pages have come."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("path"), hashing.content_hash(F.col("html")).alias("content_hash"))
    next_docs = docs.join(toxic, "doc_id", "left_anti").select("path", hashing.content_hash(F.regexp_replace("text", "[0-9]+", "0")).alias("content_hash"))
    return versions.content_delta(docs.select("path", hashing.content_hash(F.col("text")).alias("content_hash")), next_docs.unionByName(pages))


def _two_states(spark, sf_dir):
    """Documents by source, and their next state: those marked toxic are gone, numbers are masked in two sources, pages have come."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    pages = table(spark, sf_dir, "pages").select(F.lit("web").alias("project_id"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("path"), hashing.content_hash(F.col("html")).alias("content_hash"))
    text = F.when(F.col("project_id").isin("src1", "src2"), F.regexp_replace("text", "[0-9]+", "0")).otherwise(F.col("text"))
    new = docs.join(toxic, "doc_id", "left_anti").select("project_id", "path", hashing.content_hash(text).alias("content_hash"))
    return docs.select("project_id", "path", hashing.content_hash(F.col("text")).alias("content_hash")), new.unionByName(pages)


def merkle_tree(spark, sf_dir):
    """Every node of each source's tree."""
    return merkle.tree(_two_states(spark, sf_dir)[0])


def merkle_delta(spark, sf_dir):
    """What differs between two states, from their trees' unequal leaves."""
    old, new = (durable(x) for x in _two_states(spark, sf_dir))
    return merkle.delta(old, new, merkle.tree(old), merkle.tree(new))


def embedding_cache_miss(spark, sf_dir):
    """Every document is wanted under a model; the cache has the texts of labelled ones, under the first model only."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), hashing.content_hash(F.col("text")).alias("content_hash"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model_version"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")).distinct()
    cache = docs.join(known, "chunk_id", "left_semi").select("content_hash", F.lit("m0").alias("model_version")).distinct()
    return versions.cache_misses(docs, cache).select("chunk_id", "content_hash", "model_version")


def stamp_gate(spark, sf_dir):
    return federation.stamp_gate(STAMPS.frame(spark, sf_dir), EXPECTED.frame(spark, sf_dir)).select("project_id", "reason")


def federation_envelope(spark, sf_dir):
    return federation.envelope(ASKED.frame(spark, sf_dir), federation.stamp_gate(STAMPS.frame(spark, sf_dir), EXPECTED.frame(spark, sf_dir)))


def federation_excluded(spark, sf_dir):
    told = federation_envelope(spark, sf_dir)
    return federation.excluded(ASKED.frame(spark, sf_dir), told.where("answered").select("project_id"))


def single_model_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("generation"), F.when(F.col("label") == 3, F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string"))).otherwise("m0").alias("model"), "embedding")
    return federation.one_model(rows, "generation", "model", "embedding")


def model_change(spark, sf_dir):
    return MODELS.frame(spark, sf_dir).select("generation", federation.model_change(*map(F.col, ("old_model", "new_model", "old_dim", "new_dim"))).alias("action"))


def segment_suffix_resolve(spark, sf_dir):
    return federation.resolve_names(REFS.frame(spark, sf_dir), NODES.frame(spark, sf_dir))


def resolution_metrics(spark, sf_dir):
    return federation.resolution_quality(federation.resolve_names(CORPUS_REFS.frame(spark, sf_dir), CORPUS_NODES.frame(spark, sf_dir)), CORPUS_TRUTH.frame(spark, sf_dir))


def resolution_side_by_side(spark, sf_dir):
    return federation.side_by_side(CORPUS_REFS.frame(spark, sf_dir), CORPUS_NODES.frame(spark, sf_dir))


def lru_evict(spark, sf_dir):
    """Users by their last event; the first hundred stay."""
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker_id"), micros("ts").alias("last_used"))
    return sync.lru_evictions(uses, 100)


def state_transition_check(spark, sf_dir):
    return sync.check_transitions(CHANGES.frame(spark, sf_dir), "generation")


def maintenance_gate(spark, sf_dir):
    return metrics.maintenance_gate(RUNS.frame(spark, sf_dir))


def first_seen_sources(spark, sf_dir):
    return metrics.first_seen(table(spark, sf_dir, "documents"), "source", "doc_id")


QUERIES = {f.__name__: f for f in (version_gc, index_stats, tombstone_replace, store_upsert, store_versions, generations_swap, hash_delta, merkle_tree, merkle_delta, embedding_cache_miss, stamp_gate, federation_envelope, federation_excluded, single_model_guard, model_change, segment_suffix_resolve, resolution_metrics, resolution_side_by_side, lru_evict, state_transition_check, maintenance_gate, first_seen_sources)}

_GATE = f"SELECT project_id, CASE WHEN p.schema_version IS NULL THEN 'no_stamp' WHEN p.schema_version <> e.schema_version THEN 'schema_version_mismatch' WHEN p.embedding_model IS DISTINCT FROM e.embedding_model THEN 'embedding_model_mismatch' WHEN p.dimension IS DISTINCT FROM e.dimension THEN 'dimension_mismatch' END AS reason FROM {STAMPS.sql()} p, {EXPECTED.sql()} e"
_ENVELOPE = f"SELECT a.project_id, CASE WHEN g.project_id IS NULL THEN 'not_registered' ELSE reason END AS reason FROM (SELECT DISTINCT project_id FROM {ASKED.sql()}) a LEFT JOIN ({_GATE}) g USING (project_id)"
_EXT = ", ".join(f"'{e}'" for e in federation.EXTENSIONS)


def _segs(x: str) -> str:
    parts = f"list_filter(regexp_split_to_array({x}, '::|\\.|/'), lambda s: s <> '')"
    kept = f"list_filter({parts}, lambda s: s NOT IN ({_EXT}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {parts} END"


_FITS = "len(want) > 0 AND len(want) <= len(have) AND have[len(have) - len(want) + 1:] = want"


def _resolved(refs, nodes):
    return f"""r AS (SELECT ref_id, unnest(list_distinct(list_append(coalesce(from_json(candidates, '["VARCHAR"]'), []), reference_name))) AS said FROM {refs.sql()}),
w AS (SELECT ref_id, {_segs('said')} AS want FROM r), h AS (SELECT node_id, qualified_name, {_segs('qualified_name')} AS have FROM {nodes.sql()} WHERE is_exported),
m AS (SELECT ref_id, count(DISTINCT node_id) AS n, min(qualified_name) AS only_one FROM w JOIN h ON {_FITS} GROUP BY ref_id)"""


_PARTS = ", ".join(f"sum(CAST('0x' || substr(own, {1 + 15 * k}, 15) AS BIGINT)) AS p{k}" for k in range(4))
_LEAVES = f"f AS (SELECT source AS project_id, 'doc:' || doc_id AS path, sha256('doc:' || doc_id || chr(0) || 'sha256:' || sha256(text)) AS own FROM documents), s AS (SELECT project_id, left(sha256(path), {merkle.DEPTH}) AS prefix, count(*) AS n_files, {_PARTS} FROM f GROUP BY ALL), l{merkle.DEPTH} AS (SELECT project_id, {merkle.DEPTH} AS level, prefix, sha256(concat_ws(':', n_files, p0, p1, p2, p3)) AS node_digest, n_files FROM s)" + "".join(
    f", l{k} AS (SELECT project_id, {k} AS level, left(prefix, {k}) AS prefix, sha256(string_agg(substr(prefix, {k + 1}, 1) || node_digest, '' ORDER BY prefix)) AS node_digest, sum(n_files) AS n_files FROM l{k + 1} GROUP BY project_id, left(prefix, {k}))" for k in range(merkle.DEPTH - 1, -1, -1)
)
_NODES = " UNION ALL ".join(f"SELECT project_id, level, prefix, node_digest, CAST(n_files AS BIGINT) AS n_files FROM l{k}" for k in range(merkle.DEPTH + 1))
ORACLES = {
    "version_gc": f"SELECT store_id, vid, sha_tag, sha_tag IS NULL AND row_number() OVER (PARTITION BY store_id, sha_tag IS NULL ORDER BY vid DESC) > 2 AS removed FROM {CATALOG.sql()}",
    "index_stats": "SELECT source, CAST(count(*) FILTER (NOT l) AS BIGINT) AS num_unindexed_rows, CAST(count(*) FILTER (l) AS BIGINT) AS num_indexed_rows FROM (SELECT source, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents) GROUP BY source",
    "tombstone_replace": "SELECT source, CAST(generation AS BIGINT) AS generation, tombstone, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, 1 AS generation, source = 'src1' AS tombstone FROM documents UNION ALL SELECT source, 2, false FROM documents WHERE source = 'src1') GROUP BY ALL",
    "store_upsert": "WITH again AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0), rows AS (SELECT doc_id, source, 1 AS generation FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, source, 2 FROM again UNION ALL SELECT -doc_id - 1, source, 2 FROM again) SELECT source, CAST(generation AS BIGINT) AS generation, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS sum_ids FROM rows GROUP BY ALL",
    "store_versions": "WITH h AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS total FROM documents WHERE doc_id % 2 = 0), a AS (SELECT CAST(count(*) AS BIGINT) AS n FROM documents) SELECT step, h.n, total FROM h, (VALUES ('first'), ('restored'), ('optimised')) s(step) UNION ALL SELECT 'second', n, 0 FROM a UNION ALL SELECT 'before', h.n + a.n, 0 FROM h, a UNION ALL SELECT 'after', 0, h.n FROM h",
    "generations_swap": "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(2 AS BIGINT) AS generation FROM documents GROUP BY source",
    "hash_delta": "WITH o AS (SELECT 'doc:' || doc_id AS path, 'sha256:' || sha256(text) AS h FROM documents), n AS (SELECT 'doc:' || doc_id AS path, 'sha256:' || sha256(regexp_replace(text, '[0-9]+', '0', 'g')) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'page:' || page_id, 'sha256:' || sha256(html) FROM pages) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path",
    "merkle_tree": f"WITH {_LEAVES} {_NODES}",
    "merkle_delta": "WITH o AS (SELECT source AS project_id, 'doc:' || doc_id AS path, 'sha256:' || sha256(text) AS h FROM documents), n AS (SELECT source AS project_id, 'doc:' || doc_id AS path, 'sha256:' || sha256(CASE WHEN source IN ('src1', 'src2') THEN regexp_replace(text, '[0-9]+', '0', 'g') ELSE text END) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'web', 'page:' || page_id, 'sha256:' || sha256(html) FROM pages) SELECT * FROM (SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path AND o.project_id = n.project_id) WHERE change IS NOT NULL",
    "embedding_cache_miss": "WITH d AS (SELECT doc_id AS chunk_id, 'sha256:' || sha256(text) AS content_hash, 'm' || (doc_id % 2) AS model_version FROM documents) SELECT * FROM d WHERE NOT (model_version = 'm0' AND content_hash IN (SELECT content_hash FROM d WHERE chunk_id IN (SELECT doc_id FROM labels)))",
    "stamp_gate": _GATE,
    "federation_envelope": f"SELECT project_id, reason IS NULL AS answered, reason FROM ({_ENVELOPE})",
    "federation_excluded": f"SELECT project_id FROM ({_ENVELOPE}) WHERE reason IS NOT NULL",
    "single_model_guard": "SELECT CAST(label AS BIGINT) AS generation, CAST(count(DISTINCT CASE WHEN label = 3 THEN 'm' || (vec_id % 2) ELSE 'm0' END) AS BIGINT) AS n_models, CAST(count(DISTINCT len(embedding)) AS BIGINT) AS n_dimensions, count(DISTINCT CASE WHEN label = 3 THEN 'm' || (vec_id % 2) ELSE 'm0' END) = 1 AND count(DISTINCT len(embedding)) = 1 AS uniform FROM embeddings GROUP BY label",
    "model_change": f"SELECT generation, CASE WHEN old_dim <> new_dim THEN 'rebuild' WHEN old_model <> new_model THEN 'reembed' ELSE 'keep' END AS action FROM {MODELS.sql()}",
    "segment_suffix_resolve": f"""WITH {_resolved(REFS, NODES)}
SELECT ref_id, CAST(coalesce(n, 0) AS BIGINT) AS n_candidates, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS status, CASE WHEN n = 1 THEN only_one END AS resolved FROM {REFS.sql()} LEFT JOIN m USING (ref_id)""",
    "resolution_metrics": f"""WITH {_resolved(CORPUS_REFS, CORPUS_NODES)}, told AS (SELECT t.*, CASE WHEN n = 1 THEN only_one END AS resolved FROM {CORPUS_TRUTH.sql()} t LEFT JOIN m USING (ref_id))
SELECT CAST(count(*) FILTER (resolved = expected) AS BIGINT) AS correct, CAST(count(resolved) AS BIGINT) AS picked, CAST(count(expected) AS BIGINT) AS resolvable, CAST(count(*) FILTER (resolved IS NOT NULL AND kind = 'ambiguous') AS BIGINT) AS forced_picks, round(count(*) FILTER (resolved = expected) / count(resolved)::DOUBLE, 3) AS precision, round(count(*) FILTER (resolved = expected) / count(expected)::DOUBLE, 3) AS recall FROM told""",
    "resolution_side_by_side": f"WITH {_resolved(CORPUS_REFS, CORPUS_NODES)} SELECT DISTINCT w.ref_id, 'AMBIGUOUS' AS status, qualified_name AS candidate FROM w JOIN h ON {_FITS} JOIN m USING (ref_id) WHERE n > 1",
    "lru_evict": "SELECT *, recency > 100 AS evicted FROM (SELECT worker_id, last_used, CAST(row_number() OVER (ORDER BY last_used DESC, worker_id) AS BIGINT) AS recency FROM (SELECT user_id AS worker_id, max(epoch_us(ts)) AS last_used FROM events GROUP BY user_id))",
    "state_transition_check": f"SELECT entity_id, seq, prev_state, state, prev_state IS NULL OR (prev_state || '>' || state) IN ('building>reembedding', 'reembedding>validating', 'validating>swapping', 'swapping>active', 'active>retired', 'retired>gc_eligible', 'gc_eligible>purged') AS accepted FROM (SELECT *, lag(state) OVER (PARTITION BY entity_id ORDER BY seq) AS prev_state FROM {CHANGES.sql()})",
    "maintenance_gate": f"SELECT *, latency_ms <= 5000 AND ram_bytes <= 2147483648 AND disk_bytes <= 5368709120 AND unindexed = 0 AS gate_pass FROM {RUNS.sql()}",
    "first_seen_sources": "SELECT source, min(doc_id) AS first_pos FROM documents GROUP BY source",
}

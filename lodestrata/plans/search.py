"""Queries of retrieval: lexical and dense legs, fusion, rerank, recall, boolean and phrase search, hydration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..durable import shared_folder
from ..operators import federation, retrieval
from ..sources.index import SearchIndex
from ..sources.versions import VersionedTable
from ._bind import table

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _lexical(spark, sf_dir, k):
    return retrieval.ranked(retrieval.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir)), "doc_id", k)


def _dense(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = _queries(spark, sf_dir).join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id").select("query_id", F.col("embedding").alias("query_vector"))
    return retrieval.ranked(retrieval.dense(vectors, asked, k, "doc_id"), "doc_id", k)


def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir, retrieval.FINAL).select("query_id", "doc_id", "score", "rank")


def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, retrieval.FINAL).select("query_id", "doc_id", "score", "rank")


def hybrid_rrf(spark, sf_dir):
    legs = [f(spark, sf_dir, retrieval.CANDIDATES) for f in (_lexical, _dense)]
    project = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("source").alias("project_id"))
    fused = retrieval.fuse(legs, "doc_id").join(project, "doc_id", "left").withColumn("project_id", F.coalesce("project_id", F.lit("")))
    return retrieval.total_order(fused, "project_id", "doc_id", retrieval.FINAL).select("query_id", "project_id", "doc_id", "rrf", "rank")


def federated_union_rrf(spark, sf_dir):
    """Each project answers on its own; the answers are united and ranked under one order."""
    docs = table(spark, sf_dir, "documents")
    scored = retrieval.bm25(docs, _queries(spark, sf_dir)).join(docs.select("doc_id", F.col("source").alias("project_id")), "doc_id")
    own = F.row_number().over(retrieval.Window.partitionBy("query_id", "project_id").orderBy(F.desc("score"), "doc_id"))
    legs = scored.withColumn("rank", own.cast("long")).where(F.col("rank") <= retrieval.CANDIDATES)
    fused = legs.select("query_id", "project_id", "doc_id", F.round(1.0 / (retrieval.RRF_K + F.col("rank")), 9).alias("rrf"))
    return retrieval.total_order(fused, "project_id", "doc_id", retrieval.FINAL).select("query_id", "project_id", "doc_id", "rrf", "rank")


def fake_rerank(spark, sf_dir):
    hits = _lexical(spark, sf_dir, retrieval.CANDIDATES).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc")), "doc_id").join(_queries(spark, sf_dir), "query_id")
    return retrieval.rerank(hits.select("query_id", F.col("rank").alias("pos"), "query", "doc", "doc_id")).select("query_id", "doc_id", "pos", "score", "rank")


def _gold(spark, sf_dir):
    return retrieval.holding(table(spark, sf_dir, "documents"), _queries(spark, sf_dir))


def recall_at_k(spark, sf_dir):
    return retrieval.recall_at_k(_lexical(spark, sf_dir, retrieval.FINAL), _gold(spark, sf_dir), "doc_id")


def benchmark_overlap(spark, sf_dir):
    return _gold(spark, sf_dir).groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_docs"))


def boolean_search(spark, sf_dir):
    return retrieval.boolean_search(table(spark, sf_dir, "documents"), ["the", "and"], ["der"], ["with", "was"])


def phrase_search(spark, sf_dir):
    return retrieval.phrase_search(table(spark, sf_dir, "documents"), "of the")


def phrase_punctuated(spark, sf_dir):
    return retrieval.phrase_search(table(spark, sf_dir, "documents"), "Released-under: the (MIT) License")


def hydrate_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = _lexical(spark, sf_dir, 3).select("query_id", "doc_id", "rank")
    return retrieval.hydrate(hits, docs, "doc_id").select("query_id", "doc_id", "rank", F.sha2("whole_text", 256).alias("text_hash"))


def response_cap(spark, sf_dir):
    items, told = federation.capped(_lexical(spark, sf_dir, retrieval.CANDIDATES).select("query_id", "doc_id", "rank"), ["query_id", "rank"])
    return items.agg(F.count("*").alias("n_items"), F.sum("rank").alias("sum_rank")).crossJoin(told)


def _indexed(spark, sf_dir):
    """The index of a table that documents came to in two increments: the second has the odd ids, and every fifth again."""
    index = SearchIndex(VersionedTable(spark, f"{shared_folder(spark)}/indexed-{uuid.uuid4().hex}", "doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    early = (F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 5 == 0)
    index.table.upsert(docs.where(early).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text"))))
    index.refresh()
    index.table.upsert(docs.where((F.col("doc_id") % 2 != 0) | (F.col("doc_id") % 5 == 0)))
    index.refresh()
    return index


def indexed_bm25(spark, sf_dir):
    """The lexical leg from the stored index, after two increments and a merge."""
    index = _indexed(spark, sf_dir)
    index.optimize()
    return index.bm25(_queries(spark, sf_dir), retrieval.FINAL)


def indexed_phrase(spark, sf_dir):
    """A phrase from stored positions of two segments, the second of which replaces rows of the first; one source's odd rows are hidden again."""
    index = _indexed(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").where("source = 'src1' and doc_id % 2 = 0").select("doc_id", "text", "source")
    index.table.replace_source("source", "src1", rows)
    index.refresh()
    return index.phrase("of the")


def indexed_boolean(spark, sf_dir):
    return _indexed(spark, sf_dir).boolean(["the", "and"], ["der"], ["with", "was"])


def search_index_stats(spark, sf_dir):
    """Rows that are indexed and not: after a third batch, after its segment, and after the merge."""
    index = _indexed(spark, sf_dir)
    index.table.upsert(table(spark, sf_dir, "documents").select("doc_id", "text", "source").where("doc_id % 3 = 0"))
    told = [("upserted", index.stats())]
    index.refresh()
    told.append(("refreshed", index.stats()))
    index.optimize()
    told.append(("merged", index.stats()))
    return spark.createDataFrame([(step, s["num_unindexed_rows"], s["num_indexed_rows"]) for step, s in told], "step string, num_unindexed_rows long, num_indexed_rows long")


QUERIES = {f.__name__: f for f in (bm25_topk, dense_topk, hybrid_rrf, federated_union_rrf, fake_rerank, recall_at_k, benchmark_overlap, boolean_search, phrase_search, phrase_punctuated, hydrate_hits, response_cap, indexed_bm25, indexed_phrase, indexed_boolean, search_index_stats)}

_BM25 = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark),
w AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents),
c AS (SELECT count(*) AS n_docs, avg(len(words)) AS mean_len FROM w),
p AS (SELECT doc_id, term, len(words) AS doc_len, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM w) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 6) AS score FROM p JOIN d USING (term) JOIN q USING (term), c GROUP BY query_id, doc_id),
lexical AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM scored)"""
_DENSE = """v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT item_id AS query_id, v.doc_id, round(list_dot_product(v.e, a.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(a.e, a.e))), 6) AS score FROM benchmark JOIN v a ON a.doc_id = item_id, v),
dense AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM near)"""
_GOLD = "gold AS (SELECT DISTINCT item_id AS query_id, doc_id FROM documents JOIN benchmark b ON contains(documents.text, b.text))"
ORACLES = {
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lexical WHERE rank <= 10",
    "indexed_bm25": f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lexical WHERE rank <= 10",
    "indexed_phrase": f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE source <> 'src1' OR doc_id % 2 = 0), p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM w), n AS (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS t2 FROM p) SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM n WHERE t = 'of' AND t2 = 'the' GROUP BY doc_id",
    "indexed_boolean": f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) SELECT doc_id FROM w WHERE list_has_all(w, ['the', 'and']) AND NOT list_contains(w, 'der') AND list_has_any(w, ['with', 'was'])",
    "search_index_stats": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 0 OR doc_id % 5 = 0) + count(*) FILTER (doc_id % 2 <> 0 OR doc_id % 5 = 0) AS two, count(*) FILTER (doc_id % 3 = 0) AS third FROM documents) SELECT 'upserted' AS step, CAST(third AS BIGINT) AS num_unindexed_rows, CAST(two AS BIGINT) AS num_indexed_rows FROM c UNION ALL SELECT 'refreshed', 0, two + third FROM c UNION ALL SELECT 'merged', 0, n FROM c",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 10",
    "hybrid_rrf": f"""WITH {_BM25}, {_DENSE},
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT query_id, doc_id, rank FROM lexical UNION ALL SELECT query_id, doc_id, rank FROM dense) WHERE rank <= 50 GROUP BY query_id, doc_id),
s AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id),
t AS (SELECT query_id, coalesce(source, '') AS project_id, doc_id, rrf FROM f LEFT JOIN s USING (doc_id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, project_id, doc_id) AS BIGINT) AS rank FROM t) WHERE rank <= 10""",
    "federated_union_rrf": f"""WITH {_BM25},
o AS (SELECT query_id, source AS project_id, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM scored JOIN documents USING (doc_id)),
f AS (SELECT query_id, project_id, doc_id, round(1.0::DOUBLE / (60 + r), 9) AS rrf FROM o WHERE r <= 50)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, project_id, doc_id) AS BIGINT) AS rank FROM f) WHERE rank <= 10""",
    "fake_rerank": f"""WITH {_BM25},
pairs AS (SELECT query_id, doc_id, rank AS pos, round(CAST('0x' || substring(sha256(b.text || chr(0) || documents.text), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE, 6) AS score FROM lexical JOIN documents USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE rank <= 50)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS BIGINT) AS rank FROM pairs) WHERE rank <= 10""",
    "recall_at_k": f"WITH {_BM25}, {_GOLD}, t AS (SELECT rank FROM gold LEFT JOIN (SELECT * FROM lexical WHERE rank <= 10) USING (query_id, doc_id)) SELECT CAST(k AS BIGINT) AS k, CAST(count(*) FILTER (rank <= k) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS relevant, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (rank <= k) / count(*)::DOUBLE, 6) END AS recall FROM t, (VALUES (1), (5), (10)) ks(k) GROUP BY k",
    "benchmark_overlap": f"WITH {_GOLD} SELECT query_id, CAST(count(*) AS BIGINT) AS n_docs FROM gold GROUP BY query_id",
    "boolean_search": f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) SELECT doc_id FROM w WHERE list_has_all(w, ['the', 'and']) AND NOT list_contains(w, 'der') AND list_has_any(w, ['with', 'was'])",
    "phrase_search": f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM w), n AS (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS t2 FROM p) SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM n WHERE t = 'of' AND t2 = 'the' GROUP BY doc_id",
    "phrase_punctuated": f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM p WHERE list_slice(w, i, i + 4) = ['released', 'under', 'the', 'mit', 'license'] GROUP BY doc_id",
    "hydrate_hits": f"WITH {_BM25} SELECT query_id, doc_id, rank, sha256(text) AS text_hash FROM lexical LEFT JOIN documents USING (doc_id) WHERE rank <= 3",
    "response_cap": f"WITH {_BM25}, o AS (SELECT query_id, rank FROM lexical WHERE rank <= 50 ORDER BY query_id, rank LIMIT 501), capped AS (SELECT * FROM o ORDER BY query_id, rank LIMIT 500) SELECT CAST((SELECT count(*) FROM capped) AS BIGINT) AS n_items, CAST((SELECT sum(rank) FROM capped) AS BIGINT) AS sum_rank, (SELECT count(*) FROM o) > 500 AS truncated",
}

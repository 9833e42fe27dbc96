"""Lexical and dense retrieval, fusion, reranking, routing and hydration, each under a total order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable, spread
from ..functions.hashing import pair_score, token_estimate

#: The constants that the design leaves open.
K1, B, RRF_K, CANDIDATES, FINAL, ROUTE_TOKENS = 1.2, 0.75, 60, 50, 10, 200_000
#: Bytes of queries that are broadcast at once, terms that are broadcast, and rows of vectors multiplied at once.
QUERY_BYTES, LISTED_TERMS, VECTOR_ROWS = 16 << 20, 1_000_000, 1024


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each distinct term of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def postings(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(key, term, tf, doc_len) of each document and each term in `wanted`, and one row with a null term that counts the document itself.

    doc_len counts all tokens. Documents are read and cut once; terms are kept
    before anything is shuffled, so what moves is one partial count for each
    document and term asked for.
    """
    words = spread(docs.select(key, text)).select(F.col(key), tokens(F.col(text)).alias("words"))
    rows = words.select(key, F.when(F.col("words").isNotNull(), F.size("words")).alias("doc_len"), F.explode(F.array_append(F.coalesce("words", F.array().cast("array<string>")), F.lit(None).cast("string"))).alias("term"))
    asked = wanted.select("term").distinct().withColumn("asked", F.lit(True))
    asked = F.broadcast(asked) if asked.count() <= LISTED_TERMS else asked
    kept = rows.join(asked, "term", "left").where("asked or term is null")
    return kept.groupBy(key, "term", "doc_len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score) of every document that shares a term with the query, scores to six places.

    Corpus size, document frequencies and scores all come from one written table
    of postings. That is dealt by document, so a document's score for a query is
    summed where its postings are. Up to LISTED_TERMS rows of terms are broadcast,
    with their weights, so that postings are not dealt by term first.
    """
    terms = query_terms(queries)
    few = F.broadcast if terms.count() <= LISTED_TERMS else lambda df: df
    post = durable(postings(docs, key, text, terms))
    size = post.where("term is null").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("doc_len") * F.col("tf")) / F.sum(F.when(F.col("doc_len").isNotNull(), F.col("tf")))).alias("mean_len"))
    post = post.where("term is not null")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("term", "mean_len", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("mean_len")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = post.join(few(idf), "term").select(key, "term", part.alias("part")).repartition(n, key)
    return dealt.join(few(terms), "term").groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a length is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def dense(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score) with each query's k best (query_id, query_vector) by cosine to six places, and more that some task had among its own.

    Queries travel in blocks of QUERY_BYTES, which are broadcast; a task multiplies
    its vectors with a block and gives back k rows a query, ties to smaller keys.
    Null vectors take no part; where a cosine has no value (a length of 0, a null or
    NaN component) the score is null and comes last. Lengths must agree.
    """
    kind = vectors.schema[key].dataType.simpleString()
    asked = durable(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("v")).where("v is not null"))
    fit = spread(vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0) // QUERY_BYTES))
    found = None
    for n in range(blocks):
        told = asked.where(F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)) == n).toArrow()
        one = fit.mapInArrow(_nearest(vectors.sparkSession.sparkContext.broadcast(_by_size(told.column("query_id"), told.column("v"))), k), "query_id long, key long, score double")
        found = one if found is None else found.unionByName(one)
    return found.select("query_id", F.col("key").cast(kind).alias(key), "score")


def _by_size(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: ids and vectors of length 1; what has no direction is NaN."""
    out: dict[int, list[tuple[int, list]]] = {}
    for i, v in zip(ids.to_pylist(), vectors.to_pylist(), strict=True):
        out.setdefault(len(v), []).append((i, v))
    return {d: (np.array([i for i, _ in rows]), _directions(np.array([v for _, v in rows], float).reshape(len(rows), d))) for d, rows in out.items()}


def _directions(m: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return m / np.sqrt((m * m).sum(1, keepdims=True))


def _nearest(shared, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                if d not in shared.value:
                    continue
                ids, m = shared.value[d]
                part = b.filter(pa.array(size == d))
                key, flat = part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for lo in range(0, len(flat), VECTOR_ROWS):
                    cos = np.round(m @ _directions(flat[lo : lo + VECTOR_ROWS]).T, 6)
                    score = np.where(np.isnan(cos), -np.inf, cos) + 0.0
                    own = np.broadcast_to(key[lo : lo + VECTOR_ROWS], score.shape)
                    if d in best:
                        own, score = np.concatenate([best[d][0], own], 1), np.concatenate([best[d][1], score], 1)
                    best[d] = _best_of_rows(own, score, k)
        for d, (own, score) in best.items():
            flat = score.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shared.value[d][0], own.shape[1])), pa.array(own.ravel()), pa.array(flat, mask=np.isinf(flat))], names=["query_id", "key", "score"])

    return run


def _best_of_rows(own: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best scores, ties to smaller keys; only what reaches the k-th best is sorted."""
    rows, width = score.shape
    if width > k:
        r, c = np.nonzero(score >= np.partition(score, width - k, axis=1)[:, width - k, None])
    else:
        r, c = np.divmod(np.arange(rows * width), max(width, 1))
    order = np.lexsort((own[r, c], -score[r, c], r))
    r, c = r[order], c[order]
    take = np.arange(len(r)) - np.searchsorted(r, r) < k
    return own[r[take], c[take]].reshape(rows, -1), score[r[take], c[take]].reshape(rows, -1)


def ranked(scored: DataFrame, key: str, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller key."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last("score"), key)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def fuse(legs: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(query_id, key, rrf) by reciprocal ranks over ranked legs."""
    rows = legs[0].select("query_id", key, "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", key, "rank"))
    return rows.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"))


def total_order(fused: DataFrame, project: str, key: str, k: int) -> DataFrame:
    """The k best of each query by score, then project, then key."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), project, key)
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def rerank(pairs: DataFrame, k: int = FINAL) -> DataFrame:
    """(query_id, pos, query, doc) scored and ordered by score; ties keep the order of pos."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return pairs.withColumn("score", F.round(pair_score(F.col("query"), F.col("doc")), 6)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def route(docs: DataFrame, project: str, text: str = "text", limit: int = ROUTE_TOKENS) -> DataFrame:
    """Per project its estimated tokens and whether the whole corpus fits the context."""
    out = docs.groupBy(project).agg(F.sum(token_estimate(F.col(text))).cast("long").alias("tokens"))
    return out.withColumn("route", F.when(F.col("tokens") < limit, "whole_corpus").otherwise("retrieval"))


def hydrate(hits: DataFrame, files: DataFrame, key: str, redact: Column | None = None) -> DataFrame:
    """Hits with the whole text of their file; it passes the redactor if one is given. Missing files stay, without text."""
    text = files.select(key, (redact if redact is not None else F.col("text")).alias("whole_text"))
    return hits.join(text, key, "left")


def boolean_search(docs: DataFrame, all_of: list[str], none_of: list[str] | None = None, any_of: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of documents that hold all of one list, none of another and, if given, one of a third."""
    words = tokens(F.col(text))
    keep = F.lit(True)
    for w in all_of:
        keep &= F.array_contains(words, w)
    for w in none_of or []:
        keep &= ~F.array_contains(words, w)
    if any_of:
        keep &= F.arrays_overlap(words, F.array(*map(F.lit, any_of)))
    return docs.where(keep).select(key)


def phrase_search(docs: DataFrame, phrase: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hits): documents that hold the phrase's tokens in a row, from positional postings; a phrase without a token is nowhere."""
    want = re.findall("[a-z0-9_]+", phrase.lower())
    if not want:
        return docs.where("false").select(key, F.lit(0).cast("long").alias("hits"))
    docs = spread(docs.select(key, text))
    at = docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term")).where(F.col("term").isin(*want))
    spots = F.array_compact(F.array(*[F.when(F.col("term") == w, F.col("pos") - k) for k, w in enumerate(want)]))
    return at.select(key, F.explode(spots).alias("start")).groupBy(key, "start").count().where(F.col("count") == len(want)).groupBy(key).agg(F.count("*").alias("hits"))


def holding(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key) of documents whose text holds the query's whole text; an empty query is in every text.

    Queries travel in blocks of QUERY_BYTES, each of which is broadcast as one
    automaton that a task walks once over each of its texts; nothing is shuffled.
    """
    spark = docs.sparkSession
    asked = durable(queries.where("query is not null").select(F.col("query_id").cast("string").alias("query_id"), "query"))
    size = asked.agg(F.sum(F.octet_length("query").cast("long") + 64)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    rows, schema = spread(docs.select(key, text).where(F.col(text).isNotNull())), f"query_id string, `{key}` {docs.schema[key].dataType.simpleString()}"
    found = None
    for n in range(blocks):
        told = asked.where(F.pmod(F.xxhash64("query", "query_id"), F.lit(blocks)) == n).toArrow()
        one = rows.mapInArrow(_holders(spark.sparkContext.broadcast(list(zip(told.column("query_id").to_pylist(), told.column("query").to_pylist(), strict=True)))), schema)
        found = one if found is None else found.unionByName(one)
    return found.select(F.col("query_id").cast(queries.schema["query_id"].dataType).alias("query_id"), key)


def _holders(shared):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list[str]] = {}
        for i, q in shared.value:
            of.setdefault(q, []).append(i)
        everywhere = of.pop("", [])
        machine = ahocorasick.Automaton()
        for q, ids in of.items():
            machine.add_word(q, (q, ids))
        if of:
            machine.make_automaton()
        for b in batches:
            ids, rows = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                met = {q: own for _, (q, own) in machine.iter(text)} if of else {}
                for own in (everywhere, *met.values()):
                    ids += own
                    rows += [k] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), b.column(0).take(pa.array(rows, pa.int64()))], names=["query_id", b.schema.names[0]])

    return run


def recall_at_k(found: DataFrame, gold: DataFrame, key: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, hits, relevant, recall) of ranked results against gold (query_id, key); no relevant row: 1."""
    told = gold.select("query_id", key).distinct().join(found.select("query_id", key, "rank"), ["query_id", key], "left")
    per = told.select("rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    out = per.groupBy("k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("hits"), F.count("*").alias("relevant"))
    return out.select(F.col("k").cast("long").alias("k"), "hits", "relevant", F.when(F.col("relevant") == 0, 1.0).otherwise(F.round(F.col("hits") / F.col("relevant"), 6)).alias("recall"))

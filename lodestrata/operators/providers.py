"""Pluggable models behind Arrow batches: embedding, late chunking, reranking, context. Deterministic stand-ins included."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    dimension: int
    model_version: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TokenEmbeddingProvider(Protocol):
    """For late chunking: one vector per word of a whole text."""

    dimension: int
    model_version: str

    def embed_words(self, words: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, docs: list[str]) -> list[float]: ...


class ContextStrategy(Protocol):
    def context(self, doc: str, chunk: str) -> str: ...


class HashProvider:
    """The stand-in: vectors from SHA-256."""

    def __init__(self, dimension: int = 32):
        if dimension < 1:
            raise ValueError("dimension must be at least 1")
        self.dimension, self.model_version = dimension, f"hash-{dimension}"

    def _one(self, text: str) -> list[float]:
        d = hashlib.sha256(text.encode()).digest()
        return [d[i % 32] / 255 for i in range(self.dimension)]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def embed_words(self, words: list[str]) -> np.ndarray:
        return np.array([self._one(w) for w in words]).reshape(len(words), self.dimension)


def embed(chunks: DataFrame, provider: EmbeddingProvider, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, vector, embedding_model_version) of each chunk, in Arrow batches; a provider that answers with another length is refused."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            v = provider.embed(p["t"].fillna("").tolist())
            if any(len(x) != provider.dimension for x in v):
                raise ValueError("a vector has another length than the model's")
            yield pd.DataFrame({key: p["k"], "vector": v, "embedding_model_version": provider.model_version})

    return chunks.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, vector array<double>, embedding_model_version string")


def late_chunks(docs: DataFrame, provider: TokenEmbeddingProvider, words_per_chunk: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, chunk_text, vector): the whole text is embedded word by word, then each slice is the mean of its words' vectors."""
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for k, t in zip(p["k"], p["t"].fillna(""), strict=True):
                words = t.split()
                if words:
                    v = provider.embed_words(words)
                    rows += [(k, n, " ".join(words[at : at + words_per_chunk]), v[at : at + words_per_chunk].mean(0).tolist()) for n, at in enumerate(range(0, len(words), words_per_chunk))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "chunk_text", "vector"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, ordinal int, chunk_text string, vector array<double>")


def rerank_with(pairs: DataFrame, model: Reranker) -> DataFrame:
    """pairs (query_id, pos, query, doc) with the model's score; NaN and infinite scores are refused. Order them with operators.retrieval.

    Pairs are scored where they are; a query's pairs need not meet in one batch.
    """
    kind = pairs.schema["query_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = p[["query_id", "pos"]].copy()
            out["score"] = 0.0
            for q, rows in p.groupby("query", sort=False):
                s = np.array(model.score(q, rows["doc"].tolist()), float)
                if not np.isfinite(s).all():
                    raise ValueError("a score is not finite")
                out.loc[rows.index, "score"] = s
            yield out

    return pairs.select("query_id", F.col("pos").cast("long").alias("pos"), "query", "doc").mapInPandas(run, f"query_id {kind}, pos long, score double")

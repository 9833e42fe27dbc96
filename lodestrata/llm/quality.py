"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text's terms are its words (lower case), trigrams over the classes of its
characters, in which a run of letters is one symbol, and how often words repeat
what stands before them; terms are hashed to DIMENSIONS columns. A bounded sample
of labelled documents gives the term weights and, by truncated singular value
decomposition, the latent space. The sample's vectors are broadcast (at most
SAMPLE * LATENT numbers); each document is multiplied with all of them in blocks,
exactly, and its NEIGHBOURS nearest vote, weighted by their similarity: the fourth
power of the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import carry_through, only

#: Documented bounds of the fit: labelled rows at most, and the space's sizes.
SAMPLE, DIMENSIONS, LATENT, NEIGHBOURS = 4096, 2048, 96, 25
#: Columns of hashed words, the last of DIMENSIONS, and what a word counts against a shape; rows whose counts are held at once.
WORDS, WORD_WEIGHT, ROWS = 1024, 0.5, 1024
#: Weight of the sample's share of label 1 against the votes.
PRIOR_WEIGHT = 0.5

_CLASS = np.zeros(256, np.uint8)
_CLASS[:] = 1  # bytes of letters beyond ASCII, and control bytes
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 5
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = 6 + _k
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_REPEATS = 16  # columns before the words for repetition


def features_of(batch: pa.RecordBatch, column: str | int = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(first row, term counts) of runs of rows; the counts are rows by DIMENSIONS."""
    hashed = DIMENSIONS - WORDS - _REPEATS
    held = None  # a long text's counts are the sums of its parts'
    for lo, hi, buf, offsets, part, last in _text.pieces(batch, column, rows=ROWS):
        n = hi - lo
        out = np.zeros((n, DIMENSIONS), np.float32)
        if len(buf):
            cls = _CLASS[buf]
            row = np.repeat(np.arange(n), np.diff(offsets))
            keep = np.ones(len(cls), bool)
            keep[1:] = (cls[1:] != cls[:-1]) | (cls[1:] > 3) | (row[1:] != row[:-1])
            c, r = cls[keep].astype(np.int64), row[keep]
            if len(c) > 2:
                same = r[2:] == r[:-2]
                gram = ((c[:-2] * 64 + c[1:-1]) * 64 + c[2:]) * 0x9E3779B1 % (1 << 32) * hashed >> 32
                cell = r[2:][same] * hashed + gram[same]
                out[:, :hashed] = np.bincount(cell, minlength=n * hashed).reshape(n, hashed)
            words, first = _text.word_hashes(_LOWER[buf], offsets)
            count = np.diff(first)
            if len(words):
                who = np.repeat(np.arange(n), count)
                for k in (1, 2, 3):
                    hit = np.zeros(len(words), bool)
                    hit[k:] = (words[k:] == words[:-k]) & (who[k:] == who[:-k])
                    out[:, hashed + k] = np.bincount(who, hit, n)
                own = who[1:] == who[:-1]  # pairs within a row
                pair, of = _text.mix(words[1:] * np.uint64(3) + words[:-1] * np.uint64(7))[own], who[1:][own]
                _, lead = np.unique(pair + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
                fresh = np.bincount(of[lead], minlength=n)
                out[:, hashed + 4] = np.maximum(count - 1 - fresh, 0)
                out[:, hashed + 5] = count
                cell = who * WORDS + (words >> np.uint64(32)).astype(np.int64) % WORDS
                out[:, DIMENSIONS - WORDS :] = WORD_WEIGHT * np.bincount(cell, minlength=n * WORDS).reshape(n, WORDS)
        if part:
            out += held
        held = out
        if last:
            yield lo, out


def _normalised(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Damped relative term frequencies, weighted, each row of length 1 (or 0)."""
    share = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True, dtype=np.float64), 1)) * weight
    return share / np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class NeighbourModel:
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        v = _normalised(counts, self.weight) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        """For each row the weighted share of label 1 among its nearest labelled vectors; of cosines equal to six places the first in order."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        v = self.latent(counts)
        out = np.empty(len(v))
        k, known, order = min(NEIGHBOURS, len(self.labels)), self.vectors.T, np.arange(len(self.labels)) * (0.5e-6 / SAMPLE)
        for lo in range(0, len(v), block):
            cos = np.round(v[lo : lo + block] @ known, 6)
            top = np.argpartition(order - cos, k - 1, axis=1)[:, :k]
            sim = np.maximum(np.take_along_axis(cos, top, 1), 0) ** 4
            vote = (sim * self.labels[top]).sum(1) + PRIOR_WEIGHT * self.prior
            out[lo : lo + block] = vote / (sim.sum(1) + PRIOR_WEIGHT)
        return np.clip(out, 0, 1)


def fit_neighbours(counts: np.ndarray, labels: np.ndarray) -> NeighbourModel:
    """The space and the labelled vectors; labels are 0 or 1. Without rows every score is 0.5."""
    if not len(counts):
        return NeighbourModel(np.ones(DIMENSIONS), np.zeros((DIMENSIONS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    found = (counts > 0).sum(0)
    weight = np.log((1 + len(counts)) / (1 + found)) + 1
    x = _normalised(counts, weight)
    _, vec = np.linalg.eigh(x.T @ x)
    basis = np.ascontiguousarray(vec[:, ::-1][:, :LATENT])
    v = x @ basis
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return NeighbourModel(weight, basis, v, labels.astype(np.float64), float(labels.mean()))


def fit_quality_of(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> NeighbourModel:
    """Fits on at most SAMPLE labelled rows, those first by a hash of the key.

    Rows without key, or with a label other than 0 and 1, take no part; a label
    that is there twice counts once, and of rows of docs with one key the smallest
    text counts. The sample is chosen from labels alone, and only then joined to
    texts, so no text is shuffled but the sample's.
    """
    known = only(labels, k=key, y=label).select("k", F.col("y").cast("int").alias("y")).where("k is not null and y in (0, 1)")
    ids = known.distinct().orderBy(F.xxhash64("k"), "k", "y").limit(SAMPLE)
    rows = only(docs, k=key, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    some = rows.join(F.broadcast(ids), "k").groupBy("k", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, x in features_of(b):
                part = b.slice(lo, len(x))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], names=["k", "y", "x"])

    got = some.mapInArrow(run, f"k {some.schema['k'].dataType.simpleString()}, y int, x binary").toArrow().sort_by([("k", "ascending"), ("y", "ascending")])
    if not got.num_rows:
        return fit_neighbours(np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    return fit_neighbours(np.stack([np.frombuffer(x, "<f4") for x in got.column("x").to_pylist()]), np.array(got.column("y").to_pylist()))


def score_quality(docs: DataFrame, model: NeighbourModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs, without the text, with score (0 to 1) and predicted of each whole text.

    Null and empty texts score like a document without terms: the prior. Repeated
    rows are kept; columns named like a result, in any case, are replaced, others
    pass whatever their names; an empty table gives an empty one. A long text is
    read in parts that end at white space; its terms are counted part by part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list]]:
        for lo, x in features_of(b, at):
            s = shared.value.scores(x)
            yield lo, lo + len(x), [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return carry_through(docs, text, "score double, predicted int", run, drop_text=True)

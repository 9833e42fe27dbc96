"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The index holds the benchmark, not the corpus: postings of each term in item
order, in blocks that know their largest contribution. Every passage of every
training document is a query. Contributions are divided by the item's score
against itself, so a score is the weighted share of the item that the passage
holds, and one threshold serves items of any length. WAND skips items whose
terms can't reach the threshold together, first by the lists' maxima, then by
the blocks'; it returns every item at or above it. For these the overlap is
verified: the shares of the question's and of the answer's word n-grams that the
document holds.

Passages are windows of twice the longest item's length, half overlapping, so
each item-long stretch of a text lies whole in one. Document frequencies, mean
and longest length are those of all items, however many indexes hold them.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import Workspace, only

#: BM25's constants, the share of an item's own score that is retrieved, and the verified overlaps.
K1, B, THRESHOLD, NGRAM, OVERLAP = 1.2, 0.75, 0.5, 3, 0.5
BLOCK_ITEMS = 16
#: Items in a block, and cells at most, of the table of bounds for many passages at once.
COARSE_ITEMS, COARSE_CELLS = 4, 2_000_000
#: Bytes of item texts in one index; a larger benchmark is split into several, each broadcast and searched in a pass of its own.
SHARD_BYTES = 16 << 20

#: Bytes of text that are searched at once.
PIECE_BYTES = 1 << 20

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def tokens_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of lower-case words of letters and digits, and each row's first; all punctuation separates."""
    sep = _SEPARATOR[buf]
    # general punctuation, and signs of Latin-1 that are no letters
    lead = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80)) if len(buf) > 2 else np.zeros(0, int)
    for k in range(3):
        sep[lead + k] = True
    two = np.flatnonzero((buf[:-1] == 0xC2) & (buf[1:] >= 0x80)) if len(buf) > 1 else np.zeros(0, int)
    for k in range(2):
        sep[two + k] = True
    starts, ends, first = _text.spans(~sep, offsets)
    return _text.span_hashes(buf, starts, ends), first


def _lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def words_of(texts: list[str]) -> list[np.ndarray]:
    buf, offsets = _lowered(texts)
    tok, first = tokens_of(buf, offsets)
    return [tok[a:b] for a, b in zip(first, first[1:], strict=False)]


@dataclass
class Posting:
    """A term's items in order, its contribution to each, and per block of BLOCK_ITEMS the last item and the largest."""

    items: list[int]
    share: list[float]
    block_last: list[int]
    block_max: list[float]
    most: float


@dataclass
class Statistics:
    """Of all items that have words: how many, their mean and greatest length, and in how many a term occurs."""

    items: int
    mean: float
    longest: int
    df: dict[int, int]

    @staticmethod
    def of(words: list[np.ndarray]) -> Statistics:
        df: dict[int, int] = {}
        for w in words:
            for t in np.unique(w).tolist():
                df[t] = df.get(t, 0) + 1
        return Statistics(len(words), float(np.mean([len(w) for w in words])) if words else 1.0, max(map(len, words), default=1), df)


class BenchmarkIndex:
    """Postings of some items; told holds the statistics of all, by default of these."""

    def __init__(self, item_ids: list[int], questions: list[str], answers: list[str], told: Statistics | None = None):
        halves = list(zip(words_of(questions), words_of(answers), strict=True))
        live = [k for k, (q, a) in enumerate(halves) if len(q) + len(a)]
        self.item_ids = [item_ids[k] for k in live]
        self.parts = [(_grams(halves[k][0]), _grams(halves[k][1])) for k in live]
        words = [np.concatenate(halves[k]) for k in live]
        told = told or Statistics.of(words)
        self.longest, mean, df = told.longest, told.mean, told.df
        n, all_items = len(words), told.items
        tf = [dict(zip(*(x.tolist() for x in np.unique(w, return_counts=True)), strict=True)) for w in words]
        self.vocabulary = np.array(sorted({t for counts in tf for t in counts}), np.uint64)
        place = {t: k for k, t in enumerate(self.vocabulary.tolist())}
        lists: list[list[tuple[int, float]]] = [[] for _ in place]
        for i, (w, counts) in enumerate(zip(words, tf, strict=True)):
            one = {t: math.log(1 + (all_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in counts.items()}
            own = math.fsum(one.values())
            for t, s in one.items():
                lists[place[t]].append((i, s / own))
        self.postings = []
        for rows in lists:
            items, share = [i for i, _ in rows], [s for _, s in rows]
            cuts = range(0, len(rows), BLOCK_ITEMS)
            self.postings.append(Posting(items, share, [items[min(k + BLOCK_ITEMS, len(rows)) - 1] for k in cuts], [max(share[k : k + BLOCK_ITEMS]) for k in cuts], max(share)))
        self.most = np.array([p.most for p in self.postings])
        # the blocks' maxima as a table, for many passages at once; a large index has coarser blocks here
        self.coarse = max(COARSE_ITEMS, -(-n * len(place) // COARSE_CELLS))
        self.block_most = np.zeros((len(place), -(-n // self.coarse)), np.float32)
        for t, p in enumerate(self.postings):
            np.maximum.at(self.block_most[t], np.array(p.items) // self.coarse, np.array(p.share, np.float32))

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of every item whose score reaches threshold; terms are distinct places in the vocabulary."""
        lists = [self.postings[t] for t in terms]
        at = [0] * len(lists)
        live = sorted(range(len(lists)), key=lambda k: lists[k].items[0])
        out = []
        while live:
            bound, pivot = 0.0, -1
            for n, k in enumerate(live):
                bound += lists[k].most
                if bound >= threshold - 1e-12:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            block, ends = 0.0, []
            for k in live[: pivot + 1]:
                p = lists[k]
                b = bisect.bisect_left(p.block_last, item)
                if b < len(p.block_last):
                    block += p.block_max[b]
                    ends.append(p.block_last[b])
            if block >= threshold - 1e-12:
                aligned = lists[live[0]].items[at[live[0]]] == item
                if aligned:
                    score = math.fsum(lists[k].share[at[k]] for k in live[: pivot + 1])
                    if score >= threshold - 1e-12:
                        out.append((item, score))
                for k in live[: pivot + 1]:
                    at[k] = bisect.bisect_left(lists[k].items, item + 1 if aligned else item, at[k])
            else:  # no item before the first block's end, or the next list's item, can reach it
                to = min(ends) + 1 if ends else item + 1
                if pivot + 1 < len(live):
                    to = min(to, lists[live[pivot + 1]].items[at[live[pivot + 1]]])
                to = max(to, item + 1)
                for k in live[: pivot + 1]:
                    at[k] = bisect.bisect_left(lists[k].items, to, at[k])
            live = sorted((k for k in live if at[k] < len(lists[k].items)), key=lambda k: lists[k].items[at[k]])
        return out

    def candidates(self, tok: np.ndarray, first: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
        """(row, item) -> the best passage's score, where that reaches threshold; first has each row's first word and the total."""
        if not len(tok) or not len(self.vocabulary):
            return {}
        place = np.minimum(np.searchsorted(self.vocabulary, tok), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[place] == tok)
        term = place[known]
        row = np.searchsorted(first, known, "right") - 1
        # windows of two strides; a token lies in the window that its stride begins and in the one before
        stride = self.longest
        count = np.diff(first)
        windows = np.maximum(1, -(-count // stride))
        base = np.cumsum(windows) - windows
        own = base[row] + (known - first[row]) // stride
        again = own > base[row]
        window = np.concatenate([own, own[again] - 1])
        term = np.concatenate([term, term[again]])
        total = int(windows.sum())
        # the first pivot of WAND for all passages at once: repeated terms only loosen this bound
        hopeful = np.bincount(window, self.most[term], total) >= threshold - 1e-12
        keep = hopeful[window]
        key = np.unique(window[keep] * np.int64(len(self.vocabulary)) + term[keep])
        window, term = key // len(self.vocabulary), key % len(self.vocabulary)
        # then the same with each block of items for itself
        reach = np.zeros(total, bool)
        for at in range(0, len(window), 1 << 17):
            end = min(len(window), at + (1 << 17))
            lead = np.flatnonzero(np.r_[True, window[at + 1 : end] != window[at : end - 1]])
            bound = np.add.reduceat(self.block_most[term[at:end]], lead, axis=0)
            if at and window[at] == window[at - 1]:  # its passage began in the last part
                reach[window[at]] = True
            if end < len(window) and window[end] == window[end - 1]:
                reach[window[end - 1]] = True
            reach[window[at:end][lead[(bound >= threshold - 1e-5).any(1)]]] = True
        lo, hi = np.searchsorted(window, np.flatnonzero(reach), "left"), np.searchsorted(window, np.flatnonzero(reach), "right")
        best: dict[tuple[int, int], float] = {}
        owner = np.searchsorted(base, np.flatnonzero(reach), "right") - 1
        for r, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for item, score in self.wand(term[a:b].tolist(), threshold):
                best[r, item] = max(score, best.get((r, item), 0.0))
        return best

    def overlaps(self, item: int, runs: list[np.ndarray]) -> list[float]:
        """The shares of the question's and of the answer's n-grams that runs of words (which share NGRAM - 1 words) hold."""
        shares = []
        for n, grams in self.parts[item]:
            wanted = np.fromiter(grams, np.uint64, len(grams))
            have = np.zeros(len(wanted), bool)
            for words in runs if n else ():
                have |= np.isin(wanted, _window_hashes(words, n))
            shares.append(float(have.mean()) if n else 1.0)
        return shares

    def contaminations(self, col: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of verified hits, the best passage's score."""
        stride = self.longest
        batch = pa.RecordBatch.from_arrays([col], names=["text"])
        for lo, hi, buf, offsets, part, last in _text.pieces(batch, 0, PIECE_BYTES):
            tok, first = tokens_of(*_lowered([bytes(buf[a:b]).decode("utf-8", "surrogatepass") for a, b in zip(offsets, offsets[1:], strict=False)]))
            if part == 0 and last:
                best = self.candidates(tok, first, threshold)
                for r, item in sorted(best):
                    shares = self.overlaps(item, [tok[first[r] : first[r + 1]]])
                    if min(shares) >= overlap:
                        yield lo + r, self.item_ids[item], best[r, item], *shares
                continue
            # a long text: passages of all parts, then the overlaps of what these found, part by part again
            if part == 0:
                held, found = tok[:0], {}
            held = np.concatenate([held, tok])
            whole = len(held) if last else max(0, len(held) // stride - 1) * stride
            for (_, item), score in (self.candidates(held[: whole if last else whole + stride], np.array([0, len(held) if last else whole + stride]), threshold) if whole else {}).items():
                found[item] = max(score, found.get(item, 0.0))
            held = held[whole:]
            if last and found:
                have = {item: [np.zeros(len(g), bool) for _, g in self.parts[item]] for item in found}
                wanted = {item: [np.fromiter(g, np.uint64, len(g)) for _, g in self.parts[item]] for item in found}
                carry = tok[:0]
                for _, _, own, at, _, _ in _text.pieces(batch.slice(lo, 1), 0, PIECE_BYTES):
                    words = np.concatenate([carry, tokens_of(*_lowered([bytes(own[at[0] : at[1]]).decode("utf-8", "surrogatepass")]))[0]])
                    for n in range(1, NGRAM + 1):
                        grams = _window_hashes(words, n)
                        for item in found:
                            for side in (0, 1):
                                if self.parts[item][side][0] == n:
                                    have[item][side] |= np.isin(wanted[item][side], grams)
                    carry = words[max(0, len(words) - NGRAM + 1) :]
                for item in sorted(found):
                    shares = [float(h.mean()) if len(h) else 1.0 for h in have[item]]
                    if min(shares) >= overlap:
                        yield lo, self.item_ids[item], found[item], *shares


def _window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(max(0, len(words) - n + 1))
    return _text.range_hash(words, at, at + n)


def _grams(words: np.ndarray) -> tuple[int, set[int]]:
    """The n-gram length used for a part (its own, if shorter than NGRAM) and its n-grams; no words: 0."""
    n = min(NGRAM, len(words))
    return n, set(_window_hashes(words, n).tolist()) if n else set()


_PART = re.compile(r"\S+")


def question_and_answer(text: str) -> tuple[str, str]:
    """An item that is one text: the first half of its words asks, the rest answers."""
    words = list(_PART.finditer(text))
    if len(words) < 2:
        return text, ""
    cut = words[(len(words) + 1) // 2].start()
    return text[:cut], text[cut:]


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", question: str | None = None, answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), one row per contaminated document row and item.

    items has a text, which is halved, or question and answer columns. Null and
    empty items, those without a word and those without a key take no part; a
    repeated item comes back under each of its keys, a repeated row once per row,
    a null doc_id as null. Null and empty documents hold nothing. Other columns
    are not read, whatever their names. An empty table on either side gives an
    empty result. A long text is read in parts, so memory doesn't grow with it.

    No corpus statistic is needed, so documents pass through in one map, without
    a shuffle, once for each shard of at most SHARD_BYTES of items, which is
    broadcast. Weights and passages come from all items, so the rows are the same
    for any SHARD_BYTES.
    """
    spark = docs.sparkSession
    names = {"p0": question, "p1": answer} if question and answer else {"p0": "text"}
    rows = only(items, id=item_key, **names).where("id is not null").select(F.col("id").cast("long").alias("id"), *[F.coalesce(p, F.lit("")).alias(p) for p in names])
    size = sum((F.octet_length(p) for p in names), F.lit(0))
    shards = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // SHARD_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", *names), F.lit(shards)))
    src = only(docs, key=key, text=text).select(F.col("key").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    with Workspace() as w:
        terms = w.kept(rows.select("shard", *names).mapInArrow(_terms, "shard long, term long, words long"))
        told = terms.where("words > 0").agg(F.count("*"), F.sum("words"), F.max("words")).first()
        df = w.kept(terms.where("words = 0").groupBy("term").agg(F.count("*").alias("df")))
        for shard in range(shards):
            part = sorted(rows.where(F.col("shard") == shard).drop("shard").collect())
            halves = [question_and_answer(r.p0) if len(names) == 1 else (r.p0, r.p1) for r in part]
            own = df.join(terms.where((F.col("shard") == shard) & (F.col("words") == 0)).select("term").distinct(), "term").toArrow()
            counts = dict(zip(own.column("term").to_numpy().view(np.uint64).tolist(), own.column("df").to_pylist(), strict=True))
            index = BenchmarkIndex([r.id for r in part], [q for q, _ in halves], [a for _, a in halves], Statistics(told[0], (told[1] or 0) / max(1, told[0]), told[2] or 1, counts))
            one = src.mapInArrow(_matcher(spark.sparkContext.broadcast(index), threshold, overlap), schema)
            found = one if found is None else found.union(one)
    return found


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, 0) for each term of each item, and (shard, null, words) for each item with words."""
    for b in batches:
        texts = list(zip(*(b.column(k).to_pylist() for k in range(1, b.num_columns)), strict=True))
        halves = [question_and_answer(t[0]) if len(t) == 1 else t for t in texts]
        for shard, q, a in zip(b.column(0).to_pylist(), words_of([q for q, _ in halves]), words_of([a for _, a in halves]), strict=True):
            term = np.unique(np.concatenate([q, a]))
            if len(term):
                n = len(term)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * (n + 1), pa.int64()), pa.array([*term.view(np.int64).tolist(), None], pa.int64()), pa.array([0] * n + [len(q) + len(a)], pa.int64())], names=["shard", "term", "words"])


def _matcher(shared, threshold: float, overlap: float):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
        for b in batches:
            hits = list(shared.value.contaminations(b.column(1), threshold, overlap))
            if hits:
                keys = b.column(0).to_pylist()
                rows = [(keys[r], *rest) for r, *rest in hits]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return run

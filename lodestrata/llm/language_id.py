"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises its substrings.
A document is parsed greedily into the longest phrases that occur in that text;
the fewer phrases it takes, the closer the language. With c phrases over n
symbols and N labelled symbols the cross-parsing entropy is c * log2(N) / n bits
a symbol, and the language with the smallest one wins.

Each automaton becomes a flat transition table in which a failed step already
holds the restart from the root (where tables would be too large, a hash table
of its transitions, and one row of restarts), so thousands of blocks of text walk
through all languages in lockstep with a few array operations a symbol. Each
block is first parsed as if a phrase began with it; then the phrase that truly
reaches into it is followed until it ends where one of the block's own ends, from
where on both parses are the same. The count is that of one parse of the whole
text, of any length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import Workspace, carry_through, only

#: Bounds of the labelled sample: documents and characters a language, and characters of all languages, which share these evenly.
DOCS_PER_LANGUAGE, CHARS_PER_LANGUAGE, SAMPLE_CHARS = 80, 24_000, 768_000
#: Keys of chosen rows that are broadcast; more are joined.
LISTED_KEYS = 100_000
#: Symbols of a block, and of a longer text that are parsed at once.
BLOCK, STRETCH = 512, 1 << 20
_SEP, _UNKNOWN, _PAD = 0, 1, 2
CODE_POINTS = 0x110000
#: Cells of the transition tables of all languages; further ones are kept as hash tables of their transitions.
DENSE_CELLS = 1 << 24
#: Characters of a text that are read at once.
CHARS = 1 << 20
#: Bits by which a rival must be worse for its weight in the score to halve, inverted.
SHARPNESS = 6.0


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return step


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(CODE_POINTS, np.uint32)
    for c in range(CODE_POINTS):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, each run of anything else as one 0."""
    parts, ended = [], False
    for at in range(0, len(text), CHARS):
        low = _lower_letters()[np.frombuffer(text[at : at + CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
        keep[0] = not (ended and low[0] == 0)
        ended = low[-1] == 0
        parts.append(low[keep])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Dense:
    """Transitions as a table; a failed step holds the inverse of its restart."""

    def __init__(self, step: list[dict[int, int]], size: int):
        self.size = size
        flat = np.zeros((len(step), size), np.int32)
        for c, to in step[0].items():
            flat[:, c] = to
        flat = ~flat
        for s, edges in enumerate(step):
            for c, to in edges.items():
                flat[s, c] = to
        flat[:, _PAD] = 0
        flat[:, _UNKNOWN] = ~np.int32(0)
        self.table = flat.ravel()

    def __call__(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        s *= self.size
        s += c
        return self.table[s]

    def one(self, s: int, c: int) -> int:
        return int(self.table[s * self.size + c])


class Sparse:
    """The same by open addressing, for alphabets of any size."""

    def __init__(self, step: list[dict[int, int]], size: int):
        self.size = size
        self.restart = np.full(size, ~np.int32(0), np.int32)
        for c, to in step[0].items():
            self.restart[c] = ~np.int32(to)
        self.restart[_PAD], self.restart[_UNKNOWN] = 0, ~np.int32(0)
        edges = [(s * size + c, to) for s, e in enumerate(step) for c, to in e.items() if c not in (_PAD, _UNKNOWN)]
        key, to = (np.array([e[k] for e in edges], t) for k, t in ((0, np.int64), (1, np.int32)))
        bits = max(4, (2 * len(edges)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left = self.slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.to[at[first]] = key[first], to[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            at[left] = (at[left] + (self.keys[at[left]] != key[left])) & self.last

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = s.astype(np.int64) * self.size + c
        at = self.slot(key)
        have = self.keys[at]
        out = np.where(have == key, self.to[at], self.restart[c])
        left = np.flatnonzero((have != key) & (have != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            have = self.keys[at[left]]
            hit = left[have == key[left]]
            out[hit] = self.to[at[hit]]
            left = left[(have != key[left]) & (have != -1)]
        return out

    def one(self, s: int, c: int) -> int:
        return int(self(np.array([s], np.int32), np.array([c], np.int32))[0])


class CrossParser:
    """Automata of all languages; sample is a tuple of (language, labelled text)."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        self.languages = [lang for lang, _ in sample]
        read = [letters_of(text)[:] for _, text in sample]
        seen = Counter(c for r in read for c in r.tolist() if c)
        self.alphabet = {c: k + 3 for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
        size = len(self.alphabet) + 3
        self.map = np.full(CODE_POINTS, _UNKNOWN, np.int32)
        self.map[0] = _SEP
        for c, k in self.alphabet.items():
            self.map[c] = k
        self.automata = []
        cells = 0
        for r in read:
            step = suffix_automaton(self.symbols(r).tolist())
            cells += len(step) * size
            self.automata.append((Dense if cells <= DENSE_CELLS else Sparse)(step, size))
        self.bits = np.array([math.log2(max(2, len(r))) for r in read])

    def symbols(self, letters: np.ndarray) -> np.ndarray:
        return self.map[letters]

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """How many phrases each row of symbols (none empty) takes under each language."""
        out = np.zeros((len(rows), len(self.automata)), np.int64)
        short = [i for i, r in enumerate(rows) if len(r) <= STRETCH]
        if short:
            grid, first = _blocks([rows[i] for i in short])
            for k, to in enumerate(self.automata):
                out[short, k] = _parse(to, grid, first, np.array([len(rows[i]) for i in short]), None)[0]
        for i in (i for i, r in enumerate(rows) if len(r) > STRETCH):
            for k, to in enumerate(self.automata):
                state = None
                for at in range(0, len(rows[i]), STRETCH):
                    part = rows[i][at : at + STRETCH]
                    n, state = _parse(to, *_blocks([part]), np.array([len(part)]), state)
                    out[i, k] += n[0]
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits a symbol of each text (none empty) under each language."""
        return self._bits([self.symbols(letters_of(t)) for t in texts])

    def _bits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.phrases(rows) * self.bits / np.array([len(r) for r in rows])[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of each text; no letter: und and 0. Ties go to the language first in order."""
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if self.languages:
            read = [(i, letters_of(t)) for i, t in enumerate(texts) if t]
            live = [(i, self.symbols(r)) for i, r in read if r.any()]
            if live:
                e = self._bits([r for _, r in live])
                best = e.argmin(1)
                share = 1 / np.exp2(np.maximum(-60, -(e - e.min(1)[:, None]) * SHARPNESS)).sum(1)
                for (i, _), b, s in zip(live, best.tolist(), share.tolist(), strict=True):
                    lang[i], score[i] = self.languages[b], s
        return lang, score


def _blocks(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows cut into blocks of BLOCK symbols, padded, and each row's first block (and the total last)."""
    first = np.r_[0, np.cumsum([-(-len(r) // BLOCK) for r in rows])]
    grid = np.full((int(first[-1]), BLOCK), _PAD, np.int32)
    for r, at, end in zip(rows, first, first[1:], strict=False):
        grid[at:end].ravel()[: len(r)] = r
    return grid, first


def _parse(to: Dense | Sparse, grid: np.ndarray, first: np.ndarray, size: np.ndarray, carried: int | None) -> tuple[np.ndarray, int]:
    """(phrases of each row, the state in which the last row ends).

    carried is the state in which the (only) row's earlier part ended, whose last
    phrase is then counted already.
    """
    cut = np.zeros(grid.shape, bool)  # where a phrase begins if one begins with each block
    end = np.zeros(len(grid), np.int32)
    filled = (grid != _PAD).sum(1)
    order = np.argsort(filled, kind="stable")  # blocks of like length walk together
    for lo in range(0, len(order), 4096):
        own = order[lo : lo + 4096]
        steps = int(filled[own[-1]])
        s = np.zeros(len(own), np.int32)
        if carried is not None:
            s[own == 0] = carried
        begun = np.zeros((steps, len(own)), bool)
        for c, b in zip(np.ascontiguousarray(grid[own, :steps].T), begun, strict=True):
            v = to(s, c)
            np.less(v, 0, out=b)
            np.bitwise_xor(v, v >> 31, out=s)
        cut[own, :steps] = begun.T
        end[own] = s
    start = np.ones(len(grid), bool)
    start[0] = carried is None
    unknown = cut[first[:-1], 0] & start[first[:-1]]  # a text that begins with an unknown letter: an empty phrase stands before it
    cut[:, 0] |= start
    count = np.add.reduceat(cut.sum(1), first[:-1]) + unknown
    # what truly reaches into a block is followed until a phrase begins in both parses
    lane = np.flatnonzero(~np.isin(np.arange(len(grid)), first))
    last = int(end[-1])
    if not len(lane):
        return count, last
    row = np.searchsorted(first, lane, "right") - 1
    stop_at = (first[row] * BLOCK + size[row]).astype(np.int64)
    flat, begins = grid.ravel(), cut.ravel()
    at, state = lane * BLOCK, end[lane - 1]
    more, live = np.zeros(len(lane), np.int64), np.arange(len(lane))
    for _ in range(2 * BLOCK):
        v = to(state[live], flat[at[live]])
        new, spoken = v < 0, begins[at[live]]
        state[live] = v ^ (v >> 31)
        more[live] += new.astype(np.int64) - spoken
        at[live] += 1
        live = live[~(new & spoken) & (at[live] < stop_at[live])]
        if not len(live):
            break
    # rows with a phrase that reached over a whole block: one after the other, the blocks it went past have no say
    open_ = np.zeros(len(lane), bool)
    open_[live] = True
    far = open_ | (at > (lane + 1) * BLOCK)
    odd = np.isin(row, np.unique(row[far]))
    np.add.at(count, row[~odd], more[~odd])
    past = -1
    for k in np.flatnonzero(odd).tolist():
        if lane[k] * BLOCK < past and row[k] == of:
            continue
        of, p, s, n = row[k], int(at[k]), int(state[k]), int(more[k])
        joined = not open_[k] and p < stop_at[k]
        while open_[k] and p < stop_at[k]:
            v, spoken = to.one(s, int(flat[p])), bool(begins[p])
            n += (v < 0) - spoken
            s, p = v if v >= 0 else ~v, p + 1
            if v < 0 and spoken:
                joined = True
                break
        count[of] += n
        past = p
        if p == stop_at[-1] and not joined:
            last = s
    if not odd[-1] and at[-1] == stop_at[-1]:
        last = int(state[-1])
    return count, last


@lru_cache(maxsize=2)
def parser(sample: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(sample)


def fit_language_sample(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, labelled text) for each language, from a bounded sample of rows.

    Of each language at most DOCS_PER_LANGUAGE rows are taken, in the order of a
    hash of the key, until they hold its characters: CHARS_PER_LANGUAGE, or an even
    share of SAMPLE_CHARS if languages are many; the last row is cut there. Rows
    without text, language or key take no part; of rows with one key and language
    the smallest text counts. Other columns are not read. A language column may hold
    very many values; each then gives its even share, a character at least.
    """
    rows = only(labelled, k=key, l=lang, t=text).where("k is not null and l is not null and length(t) > 0")
    # the first of each language are among the first of its parts, so no task sees more than the parts' firsts
    keys, order = rows.select("k", "l", F.pmod(F.xxhash64("l", "k"), F.lit(64)).alias("part")).distinct(), [F.xxhash64("k"), "k"]
    for by in (["l", "part"], ["l"]):
        keys = keys.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"r <= {DOCS_PER_LANGUAGE}").drop("r")
    with Workspace() as w:
        return _sample(rows, w.kept(keys.select("k", "l")), order)


def _sample(rows: DataFrame, chosen: DataFrame, order: list) -> tuple[tuple[str, str], ...]:
    """The texts of the chosen keys, cut; the keys are sent to all tasks only while they are few enough for that."""
    n = chosen.agg(F.count("*").alias("rows"), F.count_distinct("l").alias("languages")).first()
    share = max(1, min(CHARS_PER_LANGUAGE, SAMPLE_CHARS // max(1, n.languages)))
    cut = rows.join(F.broadcast(chosen) if n.rows <= LISTED_KEYS else chosen, ["k", "l"]).groupBy("l", "k").agg(F.min("t").alias("t")).select("l", "k", F.substring("t", 1, share).alias("t"))
    before = F.coalesce(F.sum(F.length("t")).over(Window.partitionBy("l").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts = cut.withColumn("h", F.xxhash64("k")).withColumn("before", before).where(f"before < {share}")
    out: dict[str, list[str]] = {}
    for r in sorted(texts.select("l", "h", "k", F.expr(f"substring(t, 1, cast({share} - before as int))").alias("t")).collect(), key=lambda r: (r.l, r.h, r.k)):
        out.setdefault(r.l, []).append(r.t)
    return tuple((k, "\n".join(v)) for k, v in sorted(out.items()))


def identify_language(docs: DataFrame, sample: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """docs with lang_pred and score of each whole text.

    Null texts, empty ones and those without a letter are `und` with score 0.
    Without any labelled text all are `und`. Of languages that need equally few
    phrases the first by name wins. A long text is parsed as a whole, in blocks that
    walk in step, with memory for its characters and a few numbers for each. Columns of docs named like a result,
    in any case, are replaced, others pass whatever their names; repeated rows are
    kept; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list]]:
        p = parser(shared.value)
        for lo, hi in _text.row_runs(b.column(at)):
            lang, score = p.predict(b.column(at).slice(lo, hi - lo).to_pylist())
            yield lo, hi, [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return carry_through(docs, text, "lang_pred string, score double", run)

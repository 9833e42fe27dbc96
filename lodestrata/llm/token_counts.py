"""Token counts of a piece vocabulary by rank-synchronous array merging.

A piece model of the byte-pair kind merges, again and again, the adjacent
symbols whose concatenation is the best-ranked piece, leftmost first. Here a
batch of distinct pre-tokens lies in one ragged numpy array of symbol ids. In
each round every pre-token applies its own lowest-rank pair at once; the count
is the number of symbols that survive, a symbol outside the vocabulary counting
its UTF-8 bytes (byte fallback).

All occurrences of a sequence's pair are merged in one round only if no pair
that this creates ranks as low as it; else only the leftmost is, which is the
library's order in every case.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from ._spark import carry_through
from ._text import row_runs

#: Pre-tokens, and characters of them, kept per Python worker; past either the table starts anew.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 8_000_000
#: Longer pre-tokens are first cut where no piece can span; what is longer still is merged by a heap, one at a time.
LONG = 200
_NEVER = np.int32(2**31 - 1)
SPACE = "▁"


class PieceMerger:
    """Counts of a sentencepiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in score.items()}
        self.ids = {p: k for k, p in enumerate(self.rank)}
        for p in list(self.rank):
            for c in p:
                self.ids.setdefault(c, len(self.ids))
        n = len(self.ids)
        left, right, to, rank = [], [], [], []
        for p, r in self.rank.items():
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    left.append(self.ids[p[:k]])
                    right.append(self.ids[p[k:]])
                    to.append(self.ids[p])
                    rank.append(r)
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        at = np.argsort(key)
        self.n, self.key = n, key[at]
        self.to, self.pair_rank = np.array(to, np.int32)[at], np.array(rank, np.int32)[at]
        self.size = np.array([1 if p in self.rank else len(p.encode()) for p in self.ids], np.int64)
        self.most_spaces = max((len(p) for p in self.rank if set(p) == {SPACE}), default=1)
        self.inside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.cache: dict[str, int] = {}
        self.cached_chars = 0
        # what _PRE and the line feeds' count of one rely on
        odd = [p for p in self.rank if "\n" in p or " " in p or SPACE in p.lstrip(SPACE)]
        probes = ("a", "\uff21 \ufb01", " a  b ", "x\ny", "\t\u00a0\u0301e")
        if odd or any(sp.normalize(x) != SPACE + x.replace(" ", SPACE) for x in probes) or len(sp.encode("x\n\nx")) != 4 or sp.encode(""):
            raise ValueError(f"{model_file} normalises its input, puts no blank before it, or has pieces that span blanks or line feeds")

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each adjacent pair; a negative id never merges."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], _NEVER), np.where(hit, self.to[at], -1)

    def count_arrays(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token (none empty)."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, inverse = np.unique(code, return_inverse=True)
        ids = np.array([self.ids.get(chr(c), -1) for c in chars], np.int32)
        nbytes = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in chars], np.int64)
        sym = ids[inverse]
        length = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), length)
        out = np.bincount(owner, np.where(sym < 0, nbytes[inverse], 0), len(words)).astype(np.int64)
        while len(sym):
            same = owner[:-1] == owner[1:]
            rank, to = self.pairs(np.where(same, sym[:-1], -1), sym[1:])
            first = np.flatnonzero(np.r_[True, ~same])
            rank = np.append(rank, _NEVER)  # each sequence's last place has no pair
            best = np.minimum.reduceat(rank, first)
            live = best != _NEVER
            done = ~live
            if done.any():  # finished sequences leave the arrays
                per = np.diff(np.append(first, len(sym)))
                gone = np.repeat(done, per)
                ended = sym[gone]
                out += np.bincount(owner[gone], np.where(ended >= 0, self.size[ended], 0), len(words)).astype(np.int64)
                keep = ~gone
                sym, owner = sym[keep], owner[keep]
                if not len(sym):
                    break
                rank, to = rank[keep], np.append(to, -1)[keep]
                best, per = best[live], per[live]
                first = np.cumsum(per) - per
            else:
                per = np.diff(np.append(first, len(sym)))
                to = np.append(to, -1)
            low = np.repeat(best, per)
            at = np.flatnonzero(rank == low)
            # leftmost of each sequence, and all others that share its product and do not overlap
            lead = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            group = np.cumsum(lead) - 1
            lead_at = at[lead]
            alike = to[at] == to[lead_at][group]
            alike &= (sym[at] == sym[lead_at][group]) & (sym[at + 1] == sym[lead_at + 1][group])
            all_at = at[alike]
            run = np.r_[0, np.cumsum(all_at[1:] != all_at[:-1] + 1)] if len(all_at) else np.zeros(0, int)
            begin = np.r_[0, np.flatnonzero(np.diff(run)) + 1] if len(all_at) else np.zeros(0, int)
            take = all_at[((np.arange(len(all_at)) - begin[run]) % 2) == 0] if len(all_at) else all_at
            unsafe = np.zeros(len(words), bool)
            unsafe[owner[at[~alike]]] = True  # another pair of the same rank
            multi = np.bincount(owner[take], minlength=len(words)) > 1
            if multi.any():
                # pairs that a merge creates: with the left neighbour, and with the right one as it is or as it will be
                new = sym.copy()
                new[take] = to[take]
                nxt = take + 2
                inside = nxt < len(sym)
                same_right = np.zeros(len(take), bool)
                same_right[inside] = owner[nxt[inside]] == owner[take[inside]]
                nxt = np.minimum(nxt, len(sym) - 1)
                same_left = np.zeros(len(take), bool)
                has = take > 0
                same_left[has] = owner[take[has] - 1] == owner[take[has]]
                prev = np.maximum(take - 1, 0)
                merged_before = np.r_[False, take[1:] == take[:-1] + 2]
                left_sym = np.where(merged_before, np.r_[-1, to[take[:-1]]], sym[prev])
                lim = low[take]
                for a, b, ok in ((left_sym, to[take], same_left), (to[take], sym[nxt], same_right), (to[take], new[nxt], same_right)):
                    r, _ = self.pairs(np.where(ok, a, -1), b)
                    bad = ok & (r <= lim)
                    unsafe[owner[take[bad]]] = True
            one = unsafe[owner[take]] & ~np.isin(take, lead_at)
            take = take[~one]
            sym[take] = to[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sym, owner = sym[keep], owner[keep]
        return out

    def count_long(self, word: str) -> int:
        """The same by a heap of (rank, place), for a pre-token of any length."""
        part: list[str | None] = list(word)
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def add(i: int) -> None:
            j = nxt[i]
            if j < len(part) and (r := self.rank.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        for i in range(len(part) - 1):
            add(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if part[i] is not None else len(part)
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[i] < len(part):
                prv[nxt[i]] = i
            if prv[i] >= 0:
                add(prv[i])
            add(i)
        return sum(1 if p in self.rank else len(p.encode("utf-8", "surrogatepass")) for p in part if p is not None)

    def learn(self, words: set[str]) -> None:
        """Puts the counts of these pre-tokens (spaces as blanks) into the cache."""
        short, long = [], []
        for w in words:
            (short if len(w) <= LONG else long).append(w)
        for w in long:
            p = w.replace(" ", SPACE)
            runs = len(p) - len(p.lstrip(SPACE))
            # the leftmost blanks of a long run always end up as whole pieces of the longest kind
            k = max(0, (runs - 1 - 2 * self.most_spaces) // self.most_spaces)
            rest = p[k * self.most_spaces :]
            cuts = [0, *(i for i in range(1, len(rest)) if rest[i - 1 : i + 1] not in self.inside), len(rest)]
            parts = [rest[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            few = [x for x in parts if len(x) <= LONG]
            own = sum(self.count_long(x) for x in parts if len(x) > LONG)
            self.cache[w] = k + own + sum(int(self.count_arrays(few[at : at + 20_000]).sum()) for at in range(0, len(few), 20_000))
        for at in range(0, len(short), 20_000):
            some = short[at : at + 20_000]
            self.cache.update(zip(some, self.count_arrays([w.replace(" ", SPACE) for w in some]).tolist(), strict=True))
        self.cached_chars += sum(map(len, words))


#: A pre-token is blanks and what follows them, up to a blank or a line feed; no piece spans these.
_PRE = re.compile(r" +[^ \n]*|[^ \n]+")


@lru_cache(maxsize=2)
def merger(model_file: str) -> PieceMerger:
    return PieceMerger(model_file)


def count_tokens_of(texts: list[str], model_file: str) -> list[int]:
    m = merger(model_file)
    if len(m.cache) > CACHE_ENTRIES or m.cached_chars > CACHE_CHARS:
        m.cache.clear()
        m.cached_chars = 0
    cut = [_PRE.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
    missing: set[str] = set()
    for c in cut:
        missing.update(filterfalse(m.cache.__contains__, c))
    if missing:
        m.learn(missing)
    get = m.cache.__getitem__
    return [sum(map(get, c)) + t.count("\n") for c, t in zip(cut, texts, strict=True)]


def count_tokens(docs: DataFrame, model_file: str, max_tokens: int = 4096, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit of each whole text.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted
    each. Columns of docs named like a result, in any case, are replaced, others
    pass whatever their names. An empty table gives an empty result. A long
    text comes alone in its run and is held with its pieces, a few times its size. model_file must be readable at that path on each executor.
    """

    def run(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list]]:
        col = b.column(at).fill_null("")
        for lo, hi in row_runs(col, 1 << 20):
            some = col.slice(lo, hi - lo)
            n = count_tokens_of(some.to_pylist(), model_file)
            yield lo, hi, [pa.compute.binary_length(some).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())]

    return carry_through(docs, text, "n_bytes long, n_tokens long, over_limit boolean", run, drop_text=True)

"""Removal of long repeated passages by recompression.

Rounds of recompression rename a text's words into fewer and longer symbols: a
round first names each maximal run of one symbol, then each adjacent pair whose
left symbol is of the round's left kind and whose right one is of its right
kind. Names are fingerprints of what they stand for, so they agree over the
whole corpus without a table of names being kept or shuffled. Whether a symbol
forms depends on a few words around it only (its context), so two equal
substrings have the same symbols wherever the context lies inside.

Spark then works in rounds, from long symbols to short ones. (1) The symbols of
the last level are joined up to each one whose name ends in zero bits; two such
long symbols in a row are shuffled by the fingerprint of their words, and where
a smaller document has them too, all windows inside are settled. That is most of
what copies and near copies repeat. (2) Every other window of WINDOW words has a
core that its words alone decide: of the symbols whose context it holds, the one
whose name, taken with the context's words, is largest (a word itself, if no
symbol fits). Cores are shuffled by name, and those in one document only are
dropped with their windows. (3) The windows of shared cores are verified by
128-bit fingerprints of all their words, and the smallest document of each is
its owner. (4) The words of windows that a smaller document owns are removed.

A settled window need not be matched again by others: the smaller document that
settled it holds it as well, and matches them instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text
from ._spark import Workspace, numbered, only, place_of, release_shuffles

WINDOW, ROUNDS = 13, 2
#: Rounds of which the symbols can be cores: a higher level's context leaves a window few of them.
CORE_ROUNDS = 1
#: Parts of the hash space, one matched after the other, so that shuffles hold a part of the rows at a time.
PASSES = 3
#: Of this many symbols one, on average, begins a long symbol.
LONG_SYMBOLS = 10
_RUN, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _recompress(sym: np.ndarray, row: np.ndarray, rounds: int) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The symbols that each round made, and the last level.

    Made symbols are (name, context's first word, context's end), the last level
    is (name, row, first word). A context that would need to know what lies beyond a row's edge is given as
    reaching over it by more words than a row can have.
    """
    beg = np.arange(len(sym))
    lo, hi = beg.copy(), beg + 1
    far = 1 << 40
    sets = []
    for r in range(rounds):
        if len(sym) < 2:
            break
        made = np.zeros(len(sym), bool)
        joined = row[1:] == row[:-1]
        # a symbol's part in a run depends on both neighbours
        left = np.r_[-far, np.where(joined, lo[:-1], -far)]
        right = np.r_[np.where(joined, hi[1:], far), far]
        first = np.flatnonzero(np.r_[True, ~(joined & (sym[1:] == sym[:-1]))])
        last = np.r_[first[1:], len(sym)] - 1
        size = last - first + 1
        run = size > 1
        beg = beg[first]
        lo, hi = np.minimum(lo[first], left[first]), np.maximum(hi[last], right[last])
        sym, row = np.where(run, _text.mix(sym[first] * _RUN + size.astype(np.uint64)), sym[first]), row[first]
        made = run
        # pairs of a left and a right symbol; the kinds are a bit of the name that differs by round
        kind = (_text.mix(sym + np.uint64((r + 1) * 0x9FB21C651E98DF25 % (1 << 64))) & np.uint64(1)).astype(bool)
        joined = row[1:] == row[:-1]
        pair = np.r_[joined & ~kind[:-1] & kind[1:], False]
        second = np.r_[False, pair[:-1]]
        nxt_hi = np.r_[np.where(joined, hi[1:], far), far]
        prev_lo = np.r_[-far, np.where(joined, lo[:-1], -far)]
        new_hi = np.where(pair | ~kind, np.maximum(hi, nxt_hi), hi)
        new_lo = np.where(kind, np.minimum(lo, prev_lo), lo)
        at = np.flatnonzero(pair)
        new_lo[at] = np.minimum(lo[at], lo[at + 1])
        new_hi[at] = np.maximum(hi[at], hi[at + 1])
        name = sym.copy()
        name[at] = _text.mix(sym[at] * _PAIR + _text.mix(sym[at + 1] + _RUN))
        made = made | pair
        keep = ~second
        sym, row, beg, lo, hi, made = name[keep], row[keep], beg[keep], new_lo[keep], new_hi[keep], made[keep]
        sets.append((sym[made], lo[made], hi[made]))
    return sets, (sym, row, beg)


def long_pairs(words: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of each two long symbols in a row, or of a row's only one; shorter than a window: left out."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, (name, row, beg) = _recompress(words, row, rounds)
    if not len(name):
        return beg, beg, beg
    cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]] | (name % LONG_SYMBOLS == 0))
    row, beg = row[cut], beg[cut]
    end = np.minimum(np.r_[beg[1:], len(words)], first[row + 1])
    has_next = np.r_[row[1:] == row[:-1], False]
    has_last = np.r_[False, row[1:] == row[:-1]]
    take = np.flatnonzero(has_next | ~has_last)  # the last of several is the second of a pair already
    end = np.where(has_next, np.r_[end[1:], 0], end)[take]
    row, beg = row[take], beg[take]
    enough = end - beg >= window
    return row[enough], beg[enough], end[enough]


def cores_of(words: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = CORE_ROUNDS, settled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, row, first window, number of windows) of each core; windows are numbered by their first word in the row.

    Windows that begin at a word where settled is true have none.
    """
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    ends = np.repeat(first[1:], count)
    place = np.arange(len(words))
    is_window = place + window <= ends
    if settled is not None:
        is_window &= ~settled
    best = np.full(len(words), -1, np.int64)
    sets, _ = _recompress(words, row, rounds)
    if sets:
        name, lo, hi = (np.concatenate(c) for c in zip(*sets, strict=True))
        fits = (hi - lo <= window) & (lo >= 0)
        name, lo, hi = name[fits], lo[fits], hi[fits]
        name = _text.mix(name + _text.range_hash(words, lo, hi))  # all windows that hold the symbol's context hold these words
        order = np.argsort(name, kind="stable")
        name, lo, hi = name[order], lo[order], hi[order]
        for k in range(window):
            p = lo - k
            ok = (hi <= p + window) & (p >= 0)
            p = np.where(ok, p, 0)
            ok &= is_window[p] & (row[p] == row[lo])
            best[p[ok]] = np.flatnonzero(ok)  # later ones have priority
        keys = name
    else:
        keys = np.zeros(0, np.uint64)
    bare = np.flatnonzero(is_window & (best < 0))
    if len(bare):  # a window without a symbol of its own: its word of the largest fingerprint, leftmost
        inside = bare[:, None] + np.arange(window)
        at = inside[np.arange(len(bare)), words[inside].argmax(1)]
        best[bare] = len(keys) + at
    keys = np.concatenate([keys, words])
    has = np.flatnonzero(is_window)
    if not len(has):
        return np.zeros(0, np.uint64), has, has, has
    core = best[has]
    lead = np.flatnonzero(np.r_[True, (core[1:] != core[:-1]) | (has[1:] != has[:-1] + 1)])
    return keys[core[lead]], row[has[lead]], has[lead] - first[row[has[lead]]], np.diff(np.r_[lead, len(has)])


def window_hashes(words: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each window."""
    return _text.range_hash(words, starts, starts + window, 0), _text.range_hash(words, starts, starts + window, 1)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _pack(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two numbers of up to 31 bits in one."""
    return start.astype(np.int64) << 32 | n.astype(np.int64)


def _unpacked(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, second) of all numbers in a column of lists of packed ones; null is empty."""
    size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    packed = part.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), packed >> 32, packed & 0x7FFFFFFF


def _inside(told: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of stretches (row, word number, length), cut to the words at hand and counted from the first of these."""
    row, start, n = told
    count = np.diff(first)[row]
    lo, hi = np.clip(start - base, 0, count), np.clip(start - base + n, 0, count)
    some = hi > lo
    return row[some], lo[some] + first[row[some]], hi[some] + first[row[some]]


def _covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of size places lie in a stretch."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _find_long(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, doc = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, words, first, base in _text.word_runs(b, 2, window - 1):
                row, beg, end = long_pairs(words, first, window)
                h1, h2 = (_text.range_hash(words, beg, end, k) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([_long(h1), _long(h2), _long(doc[lo:hi][row]), _long(uid[lo:hi][row]), _long(_pack(base + beg - first[row], end - beg))], names=["h1", "h2", "doc", "uid", "at"])

    return run


def _find_cores(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, words, first, base in _text.word_runs(b, 1, window - 1):
                row, start, n = _unpacked(b.column(2).slice(lo, hi - lo))
                _, start, end = _inside((row, start, n - window + 1), first, base)
                name, row, start, n = cores_of(words, first, window, settled=_covered(len(words), start, end))
                if len(name):
                    once = np.zeros(len(name), bool)
                    once[np.unique(_text.mix(name) + row.astype(np.uint64), return_index=True)[1]] = True
                    yield pa.RecordBatch.from_arrays([_long(name), _long(uid[lo:hi][row]), _long(_pack(base + start, n)), pa.array(once)], names=["core", "uid", "at", "first"])

    return run


def _find_windows(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, doc = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, words, first, base in _text.word_runs(b, 2, window - 1):
                _, start, end = _inside(_unpacked(b.column(3).slice(lo, hi - lo)), first, base)
                asked = np.flatnonzero(_covered(len(words), start, end))
                row = np.searchsorted(first, asked, "right") - 1
                whole = asked + window <= first[row + 1]  # the next part of a long row has the others
                asked, row = asked[whole], row[whole]
                h1, h2 = window_hashes(words, asked, window)
                yield pa.RecordBatch.from_arrays([_long(h1), _long(h2), _long(doc[lo:hi][row]), _long(uid[lo:hi][row]), pa.array((base + asked - first[row]).astype(np.int32))], names=["h1", "h2", "doc", "uid", "start"])

    return run


def kept_texts(batch: pa.RecordBatch, text: int, gone: int) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """(first row, end row, [kept text, words, removed words]); column gone lists each row's packed stretches."""
    parts: list[bytes] = []
    total = removed = 0
    for lo, hi, buf, offsets, part, last in _text.pieces(batch, text):
        starts, ends, first = _text.spans(~_text.ASCII_SPACE[buf], offsets)
        if part == 0:
            parts, total, removed = [], 0, 0
        _, s, e = _inside(_unpacked(batch.column(gone).slice(lo, hi - lo)), first, total)
        out = _covered(len(starts), s, e)
        keep = np.flatnonzero(~out)
        row_first = np.searchsorted(keep, first)
        size = (ends - starts)[keep] + 1  # with a space, but for each row's last
        final = row_first[1:][row_first[1:] > row_first[:-1]] - 1
        size[final] -= 1
        at = np.r_[0, np.cumsum(size)]
        data = buf[np.minimum(np.repeat(starts[keep] - at[:-1], size) + np.arange(int(at[-1])), max(0, len(buf) - 1))]
        spaces = np.ones(len(keep), bool)
        spaces[final] = False
        data[at[1:][spaces] - 1] = 0x20
        words, lost = np.diff(first), np.add.reduceat(np.r_[out, False], first[:-1], dtype=np.int64) * (np.diff(first) > 0)
        if part == 0 and last:
            kept = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(at[row_first].astype(np.int32)), pa.py_buffer(data.tobytes()))
            yield lo, hi, [kept, pa.array(words.astype(np.int64)), pa.array(lost)]
            continue
        total, removed = total + len(starts), removed + int(out.sum())
        if len(data):
            parts.append(data.tobytes())
        if last:
            whole = b" ".join(parts)
            kept = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(whole)], np.int32)), pa.py_buffer(whole))
            yield lo, hi, [kept, pa.array([total], pa.int64()), pa.array([removed], pa.int64())]


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, doc, at): of each row of docs (uid, doc, text), the stretches (first word, length) that a smaller doc has too.

    A null doc is smaller than none and owns nothing.
    """
    spark = docs.sparkSession
    rows = docs.where("doc is not null and text is not null")
    with Workspace() as w:
        long = w.kept(rows.mapInArrow(_find_long(window), "h1 long, h2 long, doc long, uid long, at long"))
        settled = _late(w, long, "at")
        w.drop(long)
        release_shuffles(spark)
        told = rows.join(settled.withColumnRenamed("items", "settled"), ["uid", "doc"], "left").select("uid", "text", "settled")
        cores = w.kept(told.mapInArrow(_find_cores(window), "core long, uid long, at long, first boolean"))
        release_shuffles(spark)
        wanted = []
        for k in range(PASSES):
            some = cores.where(F.pmod("core", F.lit(PASSES)) == k)
            # written by itself: the shuffle of the counts goes before the next one comes, and a hot core's join can be split
            shared = w.kept(some.where("first").groupBy("core").count().where("count > 1").select("core"))
            release_shuffles(spark)
            wanted.append(w.kept(some.join(shared, "core").groupBy("uid").agg(F.collect_set("at").alias("at"))))
            w.drop(shared)
            release_shuffles(spark)
        w.drop(cores)
        asked = _united(wanted).groupBy("uid").agg(F.flatten(F.collect_list("at")).alias("at"))
        found = w.kept(rows.join(asked, "uid").select("uid", "doc", "text", "at").mapInArrow(_find_windows(window), "h1 long, h2 long, doc long, uid long, start int"))
        w.drop(*wanted)
        release_shuffles(spark)
        late = _late(w, found, "start")
        w.drop(found)
        release_shuffles(spark)
        packed = late.select("uid", "doc", F.transform("items", lambda x: F.shiftleft(x.cast("long"), 32) + F.lit(window)).alias("at"))
        out = w.kept(settled.withColumnRenamed("items", "at").unionByName(packed).groupBy("uid", "doc").agg(F.flatten(F.collect_list("at")).alias("at")))
        return w.hand_out(out)


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _late(w: Workspace, found: DataFrame, item: str) -> DataFrame:
    """(uid, doc, items): of each row, what a smaller doc has too by both fingerprints; a row may come once for each pass."""
    out = []
    for k in range(PASSES):
        some = found.where(F.pmod("h1", F.lit(PASSES)) == k)
        owned = w.kept(some.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").select("h1", "h2", "owner"))
        release_shuffles(found.sparkSession)
        out.append(w.kept(some.join(owned, ["h1", "h2"]).where("doc > owner").groupBy("uid", "doc").agg(F.collect_set(item).alias("items"))))
        w.drop(owned)
        release_shuffles(found.sparkSession)
    return _united(out).groupBy("uid", "doc").agg(F.flatten(F.collect_list("items")).alias("items"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with kept_text, n_words and n_removed.

    A word goes if a window of `window` consecutive words that covers it also
    starts in a row with a smaller key; windows are judged on the input. Words are
    runs of anything but ASCII white space, kept as they are and joined by one
    space. Null and empty texts have no words. Rows with equal keys don't remove
    from each other; repeated rows come back each. Keys are longs, or cast to
    them; one that can't be cast fails. A row with a null key keeps all. Columns named like a result, in any case, are replaced, others pass
    whatever their names; an empty table gives an empty one. Texts of any length
    are read in parts, so memory grows with a text's bytes only as far as the
    text itself must be held.

    Two different windows are taken for one with a chance of 2**-64 for each word
    at which they differ (two words of one fingerprint), or less than 2**-120.
    """
    added = "kept_text string, n_words long, n_removed long"
    new = {c.split()[0] for c in added.split(", ")}
    at = place_of(docs.columns, text)
    own = [f"c{k}" for k, c in enumerate(docs.columns) if c.lower() not in new]
    slim = only(docs, key=key, text=text)
    uid, doc = F.xxhash64("key", "text").alias("uid"), F.col("key").cast("long").alias("doc")
    repeats = repeated_windows(slim.select(uid, doc, "text"), window)
    by = F.col(f"c{place_of(docs.columns, key)}")
    full = numbered(docs).select(F.xxhash64(by, f"c{at}").alias("uid"), by.cast("long").alias("doc"), *own, F.col(f"c{at}").alias("said"))
    told = full.join(repeats, ["uid", "doc"], "left").select(*own, "said", "at")
    schema = StructType([*told.schema.fields[: len(own)], *StructType.fromDDL(added).fields])
    names, n = schema.names, len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, arrays in kept_texts(b, n, n + 1):
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:n], *arrays], names=names)

    return told.mapInArrow(run, schema).toDF(*[docs.columns[int(c[1:])] for c in own], *names[n:])

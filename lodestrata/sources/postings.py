"""Arrays of the stored index: words of texts, numbers in few bytes, and blocks of postings, each for a whole batch at once.

A row of blocks is (term, block, n, max_tf, min_len, min_tf, max_len, keys, tfs,
lens, gaps): n postings of one term by key. The four lists are bytes, seven bits of
a number in each, the lowest first and the last one below 128; keys and places are
differences, and a posting has as many places as its tf says. Keys that are no
longs stay an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The columns of a row of blocks but its keys, and what these are for keys of a kind.
HEADER, LISTS = ["term", "block", "n", "max_tf", "min_len", "min_tf", "max_len"], ["keys", "tfs", "lens", "gaps"]
SCHEMA = "term string, block long, n int, max_tf int, min_len int, min_tf int, max_len int, keys {}, tfs binary, lens binary, gaps binary"
_LETTER = np.zeros(256, bool)
_LETTER[np.frombuffer(b"0123456789_abcdefghijklmnopqrstuvwxyz", np.uint8)] = True


#: Rows that are dealt hold blocks of several rare terms that begin alike, one after the other: their terms, with blanks between, and their n. Term is what they are dealt by.
PACKED = ["term", "block", "max_tf", "min_len", "terms", "ns", *LISTS]
PACKED_SCHEMA = "term string, block long, max_tf int, min_len int, terms string, ns binary, keys {}, tfs binary, lens binary, gaps binary"


def listed(kind: str) -> str:
    """The type of a block's keys."""
    return "binary" if kind == "bigint" else f"array<{kind}>"


def slices(batches: Iterator[pa.RecordBatch], size_of, limit: int) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The rows of batches, in batches of at most limit bytes (as size_of tells them for each row) or of one row; small ones are joined."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends, at = np.cumsum(size_of(b), dtype=np.int64), 0
        while at < len(b):
            done = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, done + limit - size, "right"))
            if end == at and not held:
                end = at + 1
            if end > at:
                held.append(b.slice(at, end - at))
                size += int(ends[end - 1]) - done
                at = end
            if at < len(b):
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def spans(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of n entries from each start on."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]) if len(columns[0]) else np.zeros(0, np.int64)


def words_of(text: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many words [a-z0-9_]+ each text has, and all of them."""
    text = pc.fill_null(text.cast(pa.string()), "")
    if not len(text):
        return np.zeros(0, np.int64), pa.array([], pa.string()).dictionary_encode()
    off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    letter = _LETTER[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    some = off[:-1][off[:-1] < off[1:]]  # where a text begins and ends, so does a word
    first[some] = letter[some]
    some = off[1:][off[:-1] < off[1:]] - 1
    last[some] = letter[some]
    begin = np.flatnonzero(first)
    ends = np.cumsum(np.flatnonzero(last) - begin + 1)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[letter]))
    return np.diff(np.searchsorted(begin, off)), words.dictionary_encode()


def by_code(code: np.ndarray, codes: int) -> np.ndarray:
    """A stable order by small numbers, sixteen bits at a time, which are sorted by counting."""
    order = np.argsort(code.astype(np.uint16), kind="stable")
    for shift in range(16, max(codes - 1, 1).bit_length(), 16):
        order = order[np.argsort((code[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def shrunk(values: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Numbers (of 64 bits without sign) in as few bytes as they need, cut into lists at starts."""
    long = np.flatnonzero(values >= 128)
    if not len(long):
        data, ends = values.astype(np.uint8), np.arange(1, len(values) + 1)
    else:
        rest = values[long] >> np.uint64(7)
        more = np.ones(len(long), np.int64)  # bytes after the first
        for k in range(1, 9):
            over = rest >= np.uint64(1 << 7 * k)
            if not over.any():
                break
            more += over
        size = np.ones(len(values), np.int64)
        size[long] += more
        ends = np.cumsum(size)
        data, at = np.empty(int(ends[-1]), np.uint8), ends - size
        low = values.astype(np.uint8) & 127
        low[long] |= 128
        data[at] = low
        at = at[long] + 1
        while len(at):
            on = more > 1
            data[at] = (rest & np.uint64(127)).astype(np.uint8) | (on.astype(np.uint8) << 7)
            rest, more, at = rest[on] >> np.uint64(7), more[on] - 1, at[on] + 1
    offsets = np.append(np.append(0, ends)[starts], len(data)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def grown(lists: pa.BinaryArray) -> np.ndarray:
    """The numbers of all lists, one list after the other."""
    if not len(lists):
        return np.zeros(0, np.uint64)
    off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.uint64)
    at = np.append(0, ends[:-1] + 1)
    size = ends + 1 - at
    out = (data[at] & 127).astype(np.uint64)
    longer, k = np.flatnonzero(size > 1), 1
    while len(longer):
        out[longer] |= (data[at[longer] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        k += 1
        longer = longer[size[longer] > k]
    return out


def summed(steps: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums of differences that begin anew at starts."""
    total = np.cumsum(steps)
    return total - np.repeat(np.where(starts > 0, total[starts - 1], 0) if len(starts) else starts, n)


def stepped(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences that begin anew at starts."""
    steps = np.diff(values, prepend=values[:1])
    steps[starts] = values[starts]
    return steps


def arrays(b: pa.RecordBatch, wanted: tuple[str, ...] = ("tfs", "lens", "gaps")) -> dict:
    """n, starts and key of the postings of rows of blocks, and the lists wanted."""
    n = grown(b.column("ns")).astype(np.int64) if "ns" in b.schema.names else b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(n) - n
    keys = b.column("keys")
    key = pa.array(summed(grown(keys).view(np.int64), starts, n)) if pa.types.is_binary(keys.type) else keys.flatten()
    return {"n": n, "starts": starts, "key": key} | {c: grown(b.column(c)).view(np.int64) for c in wanted}


def encoded(key: pa.Array, tf: np.ndarray, size: np.ndarray, gaps: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """LISTS of postings in order, cut into rows at starts."""
    if pa.types.is_int64(key.type):
        keys = shrunk(stepped(key.to_numpy(), starts).view(np.uint64), starts)
    else:
        keys = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), key)
    places = np.append(0, np.cumsum(tf))[starts]
    return [keys, *(shrunk(c.astype(np.int64).view(np.uint64), at) for c, at in ((tf, starts), (size, starts), (gaps, places)))]


def blocked(terms: pa.Array, code: np.ndarray, key: pa.Array, tf: np.ndarray, size: np.ndarray, gaps: np.ndarray, weight: np.ndarray, number: int, block: int, places: int | None = None) -> pa.RecordBatch:
    """Postings, those of a term side by side, as rows of blocks: by term, then falling weight, at most so many postings (and places, but one posting) a row, by key within.

    code has each posting's place in terms; blocks are numbered from number on.
    """
    order = np.argsort((code.astype(np.int64) << 31) | np.round((1 - weight) * (1 << 30)).astype(np.int64))
    code = code[order]
    head = heads(code)
    inside = np.arange(len(code)) - np.repeat(head, np.diff(np.append(head, len(code))))
    first = inside % block == 0
    if places:
        own = np.cumsum(tf[order]) - tf[order]
        part = (own - np.repeat(own[head], np.diff(np.append(head, len(code))))) // places
        first |= np.append(True, part[1:] != part[:-1])
    starts, which = np.flatnonzero(first), np.cumsum(first) - 1
    rank = (key.to_numpy() if pa.types.is_int64(key.type) else pc.rank(key, tiebreaker="first").to_numpy().astype(np.int64))[order]
    low, wide = int(rank.min()), int(rank.max()) - int(rank.min()) + 1
    inner = np.argsort(which * wide + (rank - low)) if len(starts) * wide < 1 << 62 else np.lexsort((rank, which))
    order = order[inner]
    at = np.cumsum(tf) - tf
    tf, size, at = tf[order], size[order], at[order]
    bounds = [f.reduceat(c, starts).astype(np.int32) for f, c in ((np.maximum, tf), (np.minimum, size), (np.minimum, tf), (np.maximum, size))]
    n = np.diff(np.append(starts, len(order))).astype(np.int32)
    lists = encoded(key.take(pa.array(order)), tf, size, gaps[spans(at, tf)], starts)
    return pa.RecordBatch.from_arrays([terms.take(pa.array(code[starts])), *map(pa.array, (np.arange(number, number + len(starts)), n, *bounds)), *lists], names=[*HEADER, *LISTS])


def packed(b: pa.RecordBatch, rare: int, front: int, most: int) -> pa.RecordBatch:
    """Rows of blocks as PACKED: blocks of at most rare postings whose terms begin with the same front letters share a row of at most about most postings."""
    few = pc.less_equal(b.column("n"), rare)
    by = pc.if_else(few, pc.utf8_slice_codeunits(b.column("term"), 0, front), b.column("term"))
    order = pc.sort_indices(pa.table([by, pc.invert(few)], names=["by", "own"]), [("by", "ascending"), ("own", "ascending")])
    b, by, few = b.take(order), by.take(order), few.take(order).to_numpy(zero_copy_only=False)
    n = b.column("n").to_numpy().astype(np.int64)
    code = by.dictionary_encode().indices.to_numpy()
    new = np.append(True, (code[1:] != code[:-1]) | (few[1:] != few[:-1])) | ~few
    head = np.flatnonzero(new)
    own = np.cumsum(n) - n
    part = (own - np.repeat(own[head], np.diff(np.append(head, len(n))))) // most
    new |= np.append(True, part[1:] != part[:-1])
    starts = np.flatnonzero(new)
    cut = np.append(starts, len(n))
    lists = []
    for c in (b.column(name) for name in LISTS):
        offsets = pa.py_buffer(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1][cut].copy())
        lists.append(pa.BinaryArray.from_buffers(c.type, len(starts), [None, offsets, c.buffers()[2]]) if pa.types.is_binary(c.type) else pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(cut), [None, offsets]), c.values))
    terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), b.column("term")), " ")
    at = pa.array(starts)
    return pa.RecordBatch.from_arrays([by.take(at), *(b.column(c).take(at) for c in ("block", "max_tf", "min_len")), terms, shrunk(n.view(np.uint64), starts), *lists], names=PACKED)

"""Vectorised text primitives: Arrow text columns in, numpy arrays out, in memory that a text's length doesn't raise.

A text column is read through its Arrow buffers, so no Python string is made
per word. A text longer than CHUNK_BYTES comes in parts that end at white space.

Word identity is a 64-bit fingerprint: the sum, over a word's bytes, of a random
number for each pair of place and byte, finished by a mixer. Fingerprints of
longer ranges combine those of their halves by a multiplication and the mixer
again. Neither is a polynomial, so no family of strings collides by structure;
for the numbers drawn, two different words have a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes hashed at once, and places of a word with a table of their own.
STEP, PLACES = 1 << 18, 48
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_LENGTH, _FAR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Multipliers of the left half, one for each of two independent fingerprints.
_LEFT = (np.uint64(0xA24BAED4963EE407), np.uint64(0x8CB92BA72F3D8DD7))
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, (PLACES << 8), dtype=np.uint64)

#: The white space of the word pattern [^\x20\x09-\x0D]+.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S33
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of buf[s:e] of ascending spans that don't overlap."""
    total = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(buf), STEP):
        hi = min(lo + STEP, len(buf))
        i, j = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
        if i == j:
            continue
        s, e = np.maximum(starts[i:j], lo), np.minimum(ends[i:j], hi)
        begin, end = int(s[0]), int(e[-1])
        place = np.arange(begin, end) - np.repeat(starts[i:j], np.append(s[1:], end) - s)
        code = (place << 8) + buf[begin:end]
        value = _TABLE[np.minimum(code, len(_TABLE) - 1)]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            value[far] = mix(code[far].astype(np.uint64) * _FAR)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        total[i:j] += sums[e - begin] - sums[s - begin]
    return mix(total + (ends - starts).astype(np.uint64) * _LENGTH)


def _joined(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    return mix(a * _LEFT[which] + b)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprints of values[s:e] for each s, e; equal ranges have equal fingerprints.

    A range is the join of its first and its last power of two of values, which
    may overlap, and of its length; those are joins of halves.
    """
    size = ends - starts
    out = np.zeros(len(size), np.uint64)
    level = np.frexp(size.astype(np.float64))[1] - 1  # -1: empty
    now = values
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = _joined(now[starts[here]], now[ends[here] - (1 << k)], which)
        if len(now) > 1 << k:
            now = _joined(now[: -(1 << k)], now[1 << k :], which)
    return mix(out + size.astype(np.uint64) * _LENGTH)


def pieces(batch: pa.RecordBatch, column: str | int = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, bool]]:
    """(first row, end row, bytes, row offsets into them, part, last) of runs of rows of about limit bytes; null is empty.

    A longer row comes alone, in parts from 0 on that end at white space where
    there is any; last is false for all but its last one.
    """
    col = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, at + rows, max(end, at + 1))
        lo, hi = int(offsets[at]), int(offsets[end])
        if hi - lo <= 2 * limit:
            yield at, end, buf[lo:hi], offsets[at : end + 1] - offsets[at], 0, True
        else:
            part = 0
            while lo < hi or part == 0:
                to = _next_space(buf, lo + limit, hi)
                yield at, end, buf[lo:to], np.array([0, to - lo]), part, to == hi
                lo, part = to, part + 1
        at = end


def _next_space(buf: np.ndarray, at: int, end: int) -> int:
    while at < end:
        found = np.flatnonzero(ASCII_SPACE[buf[at : min(end, at + 4096)]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return end


def spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are True) of each row, and each row's first word (and the total last)."""
    n = len(word)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word
    now = np.zeros(n + 1, bool)
    now[:n] = word
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of every word, and for each row the index of its first word (and the total last)."""
    starts, ends, first = spans(~is_sep[buf], offsets)
    return span_hashes(buf, starts, ends), first


def word_runs(batch: pa.RecordBatch, column: str | int, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, word fingerprints, each row's first word and the total last, number of the first word in its row).

    The last is 0 but for further parts of a long row, which begin with overlap words of the part before.
    """
    carry, done = np.zeros(0, np.uint64), 0
    for lo, hi, buf, offsets, part, last in pieces(batch, column):
        words, first = word_hashes(buf, offsets)
        if part == 0:
            carry, done = words[:0], 0
        base = done - len(carry)
        if part:
            words = np.concatenate([carry, words])
            first = np.array([0, len(words)])
        yield lo, hi, words, first, base
        if not last:
            done = base + len(words)
            carry = words[max(0, len(words) - overlap) :]


def row_runs(col: pa.Array, limit: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about limit bytes of text."""
    import pyarrow.compute as pc

    total = np.cumsum(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(total):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield at, end
        at = end

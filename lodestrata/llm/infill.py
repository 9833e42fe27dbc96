"""Fill-in-middle transformation by overlapping chunks.

A text's units are runs of ASCII letters and single other characters. A unit
begins at every character but a letter that follows a letter, so whether one
begins at a place is said by two adjacent characters. Texts are laid out in
chunks that overlap by one byte; the boundaries of all chunks are counted side by
side, prefix sums over the counts give each text's units and the chunk that owns
each cut's rank, and only these chunks are read again, to find the cut in them.

The prefix ends at one cut, the middle at the other; the suffix is the rest. The
output is either the plain text or its parts behind marks, from which the text is
rebuilt exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import carry_through, place_of

#: Bytes of a chunk, and bytes whose predicates are evaluated at once.
CHUNK, STRIP = 4096, 1 << 20
#: The marks of the three parts, percent of texts that stay plain, percent of the others that begin with the suffix.
PREFIX, SUFFIX, MIDDLE, PLAIN_FROM, SUFFIX_FIRST = "<P>", "<S>", "<M>", 90, 20
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def begins(buf: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each byte of buf[lo:hi], whether a unit begins there, if the byte before belongs to the same text."""
    letter = _LETTER[buf[max(lo - 1, 0) : hi]]
    before = letter[:-1] if lo else np.append(False, letter[:-1])
    now = letter[1:] if lo else letter
    return ~(before & now) & ((buf[lo:hi] & 0xC0) != 0x80)


def chunk_counts(buf: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk starts and the end last, units that begin in each, first chunk of each text and the total last).

    A text has a chunk for each `chunk` bytes of it; an empty one has none. A
    text's first character always begins a unit.
    """
    size = np.diff(offsets)
    n = -(-size // chunk)
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], n)
    starts = np.append(np.repeat(offsets[:-1], n) + place * chunk, offsets[-1])
    counts = np.zeros(int(first[-1]), np.int64)
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + STRIP, "right")) - 1)
        lo, hi = int(starts[at]), int(starts[end])
        hit = begins(buf, lo, hi)
        heads = offsets[:-1][size > 0]
        hit[heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)] - lo] = True
        counts[at:end] = np.add.reduceat(hit, starts[at:end] - lo, dtype=np.int64)
        at = end
    return starts, counts, first


def cut_places(buf: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, chunked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each text and each of its ranks (a row of ranks), the byte at which that many of its units have ended."""
    starts, counts, first = chunked
    total = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(ranks.shape, np.int64)
    for row, wanted in enumerate(ranks):
        for col, rank in enumerate(wanted.tolist()):
            goal = int(total[first[row]]) + rank
            if goal >= total[first[row + 1]]:
                out[row, col] = offsets[row + 1]
                continue
            owner = int(np.searchsorted(total, goal, "right")) - 1
            lo, hi = int(starts[owner]), int(starts[owner + 1])
            hit = begins(buf, lo, hi)
            hit[0] |= lo == offsets[row]
            out[row, col] = lo + int(np.flatnonzero(hit)[goal - int(total[owner])])
    return out


def draws(key: object) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that a text's key fixes; a null key counts as an empty one."""
    hexed = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(hexed[k : k + 8], 16) for k in range(0, 32, 8))


def form_of(text: bytes, h3: int, h4: int) -> str:
    if not text or h3 % 100 >= PLAIN_FROM or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain"
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm"


def _transformed(keys: list, buf: np.ndarray, offsets: np.ndarray) -> tuple[list, ...]:
    chunked = chunk_counts(buf, offsets)
    total = np.concatenate([[0], np.cumsum(chunked[1])])
    units = total[chunked[2][1:]] - total[chunked[2][:-1]]
    drawn = [draws(k) for k in keys]
    ranks = np.array([sorted((h[0] % (n + 1), h[1] % (n + 1))) for h, n in zip(drawn, units.tolist(), strict=True)], np.int64).reshape(-1, 2)
    data = buf.tobytes()
    texts = [data[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    forms = [form_of(t, h[2], h[3]) for t, h in zip(texts, drawn, strict=True)]
    cuts = cut_places(buf, offsets, ranks, chunked) - offsets[:-1, None]
    prefix, middle, output = [], [], []
    for text, form, (a, b) in zip(texts, forms, cuts.tolist(), strict=True):
        if form == "plain":
            prefix.append(None)
            middle.append(None)
            output.append(text.decode())
            continue
        p, m, s = text[:a].decode(), text[a:b].decode(), text[b:].decode()
        prefix.append(len(p))
        middle.append(len(m))
        head = PREFIX + p + SUFFIX + s if form == "psm" else SUFFIX + s + PREFIX + p
        output.append(head + MIDDLE + m)
    return units.tolist(), forms, prefix, middle, output


def infill(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    Both cuts, and whether a text is rearranged, are drawn from its key alone, so a
    task that runs again gives the same. Null and empty texts are plain, as are
    texts that hold a mark; a null key draws like an empty one; rows with equal keys
    and repeated rows come back each, ties of the two cuts give an empty middle.
    Columns named like a result, in any case, are replaced, others pass whatever
    their names (the key must have another name); an empty table gives an empty one. No row moves: a text stays in
    its task, in runs of about a megabyte or alone, with a byte or so of memory for
    each of its own beside its parts.
    """
    new = {c.split()[0] for c in RESULT.split(", ")}
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in new]
    if place_of(docs.columns, key) not in kept:
        raise ValueError(f"the key {key!r} has a result's name")
    place = kept.index(place_of(docs.columns, key))

    def run(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list]]:
        for lo, hi, buf, offsets in runs_of(batch.column(at)):
            n, form, prefix, middle, output = _transformed(batch.column(place).slice(lo, hi - lo).to_pylist(), buf, offsets)
            yield lo, hi, [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]

    return carry_through(docs, text, RESULT, run)


def runs_of(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about limit bytes; a longer row comes alone; null is empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    col = col.fill_null("") if col.null_count else col
    if not len(col):
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = min(len(col), max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, end, buf[int(offsets[at]) : int(offsets[end])], offsets[at : end + 1] - offsets[at]
        at = end


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone: parts hold no mark, so the marks part them."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def oracle() -> str:
    """DuckDB SQL for the query's rows over documents."""
    n = "[A-Za-z]+|[^A-Za-z]"
    h = ", ".join(f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    joined = lambda a, b: f"array_to_string(list_slice(u, {a}, {b}), '')"
    marked = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '{n}') AS u, {h} FROM a),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
  CASE WHEN t = '' OR {marked} OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, {joined('1', 'lo')} AS p, {joined('lo + 1', 'hi')} AS m, {joined('hi + 1', 'len(u)')} AS s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""

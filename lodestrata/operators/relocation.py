"""Where the text of an anchor has gone: spans of lines found again in changed files.

An anchor stores a fingerprint of its span, and one of every run of half as many
lines in it. Current files are read once for each block of fingerprints: a task
computes, for each length that is asked for, the fingerprint of the run that
begins at each line (runs of any length are joins of two runs of a power of two of
lines), and gives back only what is asked for, once a file. So no text and no
line is shuffled. The whole span at its place: live. The whole span elsewhere:
moved. At least half of it in a row, still in its file: stale. Else orphaned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import Workspace, spread

#: Bytes of fingerprints that are broadcast at once, and lines that are looked at together.
WANTED_BYTES, LINES = 16 << 20, 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LEFT, _SIZE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
STORED = "n_lines int, span_hash long, runs array<long>"


def line_hashes(text: Column) -> Column:
    """A number for each line; lines of white space only are all 0."""
    return F.transform(F.split(text, "\n", -1), lambda said: F.when(F.trim(said) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(said)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def run_hashes(lines: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, fingerprint of lines[k : k + size] for every k) for ascending sizes; not for those longer than lines."""
    level, at = _mix(lines + _SIZE), 0
    for size in sizes:
        if size > len(lines):
            return
        k = size.bit_length() - 1
        while at < k:
            level = _mix(level[: -(1 << at)] * _LEFT + level[1 << at :])
            at += 1
        n = len(lines) - size + 1
        yield size, _mix(level[:n] * _LEFT + level[size - (1 << k) : size - (1 << k) + n] + np.uint64(size))


def fingerprinted(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """anchors (anchor_id, path, line_start, line_end, ...) with what is stored of the text in files (path, text): STORED.

    Lines count from 1. A span that its file doesn't hold, or whose file isn't
    there, has nulls. runs has the fingerprints of all runs of half the span's
    lines, rounded up, but for those of blank lines only.
    """
    at = files.select(F.col("path").alias("__path"), line_hashes(F.col("text")).alias("__lines"))
    inside = (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & (F.col("line_end") <= F.size("__lines"))
    span = F.when(inside, F.slice("__lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)).alias("__span")
    told = anchors.join(at, anchors["path"] == at["__path"], "left").select(*anchors.columns, span)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema) + f", {STORED}"
    return told.mapInArrow(_stored, schema)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, whole, runs = [], [], []
        for span in b.column(b.num_columns - 1):
            if not span.is_valid:
                for c in (n, whole, runs):
                    c.append(None)
                continue
            lines = span.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            half = -(-len(lines) // 2)
            told = dict(run_hashes(lines, sorted({half, len(lines)})))
            blank = np.convolve(lines == 0, np.ones(half, int), "valid") == half
            n.append(len(lines))
            whole.append(int(told[len(lines)].view(np.int64)[0]))
            runs.append(np.unique(told[half][~blank].view(np.int64)))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32()), pa.array(whole, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "n_lines", "span_hash", "runs"])


def occurrences(files: DataFrame, wanted: DataFrame, w: Workspace) -> DataFrame:
    """(size, hash, path, line): of each wanted (size, hash) and each file that holds it, the first line where it begins."""
    asked = w.kept(wanted.where("hash is not null").select(F.col("size").cast("int").alias("size"), "hash").distinct())
    blocks = max(1, -(-asked.count() * 16 // WANTED_BYTES))
    kind = files.schema["path"].dataType.simpleString()
    rows = spread(files.where(F.col("text").isNotNull()).select("path", line_hashes(F.col("text")).alias("lines")))
    found = None
    for k in range(blocks):
        told = asked.where(F.pmod(F.xxhash64("size", "hash"), F.lit(blocks)) == k).toArrow()
        size, value = told.column("size").to_numpy(), told.column("hash").to_numpy().view(np.uint64)
        by_size = {int(s): np.sort(value[size == s]) for s in np.unique(size)}
        one = rows.mapInArrow(_finder(files.sparkSession.sparkContext.broadcast(by_size)), f"size int, hash long, path {kind}, line int")
        found = one if found is None else found.unionByName(one)
    return w.kept(found)


def _finder(shared):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for b in batches:
            long = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(long), 0
            while at < len(b):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINES, "right")))
                part, n = b.slice(at, stop - at), long[at:stop]
                at = stop
                lines = part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                row = np.repeat(np.arange(len(n)), n)
                first, end = np.repeat(np.cumsum(n) - n, n), np.repeat(np.cumsum(n), n)
                for size, told in run_hashes(lines, sorted(wanted)):
                    listed = wanted[size]
                    place = np.searchsorted(listed, told)
                    hit = np.flatnonzero((listed[np.minimum(place, len(listed) - 1)] == told) & (np.arange(len(told)) + size <= end[: len(told)]))
                    # of each file and fingerprint the first place
                    once = np.unique(np.stack([row[hit], place[hit]]), axis=1, return_index=True)[1] if len(hit) else hit
                    hit = hit[once]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), size, np.int32)), pa.array(told[hit].view(np.int64)), part.column(0).take(pa.array(row[hit])), pa.array((hit - first[hit] + 1).astype(np.int32))], names=["size", "hash", "path", "line"])

    return run


def relocate(stored: DataFrame, files: DataFrame) -> DataFrame:
    """stored (anchor_id, path, line_start, line_end, and STORED) with state, new_path and new_line by current files (path, text[, readable]).

    live: the span stands at its place. moved: it stands elsewhere, the first place
    in its own file, else the first file by name. unknown: nothing is stored, or
    the file is there and can't be read. stale: a run of at least half its lines
    stands in its file; new_line is where the first such run by line stands. orphaned:
    none of these, also if the file is gone. anchor_id must be unique; rows are
    marked, never dropped. An empty table of either kind is allowed.
    """
    readable = F.coalesce("readable", F.lit(True)) if "readable" in files.columns else F.lit(True)
    now = files.select("path", F.when(readable, F.col("text")).alias("text"), readable.alias("readable"))
    half = F.ceil(F.col("n_lines") / 2).cast("int")
    with Workspace() as w:
        stored = w.kept(stored.select("anchor_id", "path", "line_start", "line_end", "n_lines", "span_hash", "runs"))
        runs = stored.where("span_hash is not null").select("anchor_id", "path", half.alias("size"), F.explode("runs").alias("hash"))
        whole = stored.where("span_hash is not null").select("anchor_id", "path", "line_start", F.col("n_lines").alias("size"), F.col("span_hash").alias("hash"))
        found = occurrences(now, whole.select("size", "hash").unionByName(runs.select("size", "hash")), w)
        keys = stored.where("span_hash is not null").select("anchor_id", "path", "line_start", "line_end", F.col("span_hash").alias("was"))
        here = fingerprinted(keys, now).where("was = span_hash").select("anchor_id", F.lit(True).alias("here")).distinct()
        own = whole.join(found, ["size", "hash", "path"]).groupBy("anchor_id").agg(F.min("line").alias("own_line"))
        elsewhere = found.groupBy("size", "hash").agg(F.min(F.struct("path", "line")).alias("other"))
        other = whole.join(elsewhere, ["size", "hash"]).select("anchor_id", "other")
        part = runs.join(found, ["size", "hash", "path"]).groupBy("anchor_id").agg(F.min("line").alias("part_line"))
        known = now.groupBy("path").agg(F.min("readable").alias("readable"))
        told = stored.join(known, "path", "left")
        for more in (here, own, other, part):
            told = told.join(more, "anchor_id", "left")
        state = (
            F.when(F.col("here"), "live")
            .when(F.col("other").isNotNull(), "moved")
            .when(F.col("span_hash").isNull() | ~F.coalesce("readable", F.lit(True)), "unknown")
            .when(F.col("part_line").isNotNull(), "stale")
            .otherwise("orphaned")
        )
        told = told.withColumn("state", state)
        place = F.when(F.col("state") == "live", F.struct("path", F.col("line_start").cast("int").alias("line"))).when((F.col("state") == "moved") & F.col("own_line").isNotNull(), F.struct("path", F.col("own_line").alias("line"))).when(F.col("state") == "moved", F.col("other"))
        place = place.when(F.col("state") == "stale", F.struct("path", F.col("part_line").alias("line")))
        out = told.withColumn("place", place).select("anchor_id", "path", "line_start", "line_end", "state", F.col("place.path").alias("new_path"), F.col("place.line").cast("long").alias("new_line"))
        return w.hand_out(w.kept(out))

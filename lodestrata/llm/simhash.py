"""SimHash near-duplicates with BK-trees.

Whole texts become 64-bit fingerprints; equal fingerprints are one item from
then on. Two fingerprints that differ in at most RADIUS bits agree on at least
two of RADIUS + 2 blocks of bits, so each distinct fingerprint goes to one shard
for each two blocks, keyed by their values. A shard's fingerprints form a BK-tree,
children keyed by their Hamming distance to the parent, and each fingerprint
searches it along the edges within the radius only. A shard reports a spanning
forest of its links, not all pairs; connected components join the shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import Workspace, only, release_shuffles
from .components import connected_components

RADIUS = 2
SEED = 42
#: Rows of a part of a shard; a larger shard is compared part by part, in one cell for each two parts.
HOT_ROWS = 16_384
#: Hot shards that are listed in a broadcast; more are joined.
LISTED = 100_000
#: Pairs of query and node that a search holds at once.
FRONTIER = 2_000_000
#: Rows of a large cell that all others are compared with first.
LEADERS = 4
#: Min-wise hashes: bands that key shards, hashes in a band, places of the sketch, of which two bits each are kept.
BANDS, BAND_HASHES, PLACES = 16, 3, 128
_rng = np.random.Generator(np.random.PCG64(77))
_FACTORS = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(words: list[bytes], shingle: int, seed: int) -> list[bytes]:
    """XXH64 of every shingle of words, as big-endian bytes."""
    from xxhash import xxh64_digest as xx

    n = len(words) - shingle + 1
    if n < 1:
        return []
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    return [xx(flat[s:e], seed) for s, e in zip([0, *[e + 1 for e in ends[: n - 1]]], ends[shingle - 1 :], strict=True)]


def shingle_hashes(texts: list[str | None], shingle: int = 3, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of each text, repeats included, and how many each has: none without words, one if there are too few."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    h, n = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for lo, hi, some, counts, _, _ in shingle_runs(batch, 0, shingle, seed):
        h.append(some)
        n[lo:hi] += counts
    return np.concatenate(h), n


def shingle_runs(batch: pa.RecordBatch, column: int, shingle: int, seed: int = SEED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, bool]]:
    """(first row, end row, hashes, how many each row has here, part, last) of runs of rows; a long row comes in parts."""
    from xxhash import xxh64_digest as xx

    carry: list[bytes] = []
    total = 0
    for lo, hi, buf, offsets, part, last in _text.pieces(batch, column):
        hashes: list[bytes] = []
        counts = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            words = buf[a:b].tobytes().lower().split()
            total = total + len(words) if part else len(words)
            words = carry + words if part else words
            own = _hashes(words, shingle, seed)
            if last and 0 < total < shingle:
                own = [xx(b" ".join(words), seed)]
            hashes += own
            counts.append(len(own))
            carry = [] if last else words[max(0, len(words) - shingle + 1) :]
        yield lo, hi, np.frombuffer(b"".join(hashes), ">u8").astype("<u8"), np.array(counts, np.int64), part, last


def shingle_sets(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of runs of n hashes, each run sorted, and how many each has."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, owner))
    h = h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.bincount(owner[first], minlength=len(n)).astype(np.int64)


def bit_counts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run of n hashes, how many have each of the 64 bits."""
    out = np.zeros((len(n), 64), np.int64)
    live = n > 0
    if live.any():
        first = np.cumsum(n) - n
        # eight one-byte counters ride in each 64-bit word; runs of at most 255 rows can't overflow them
        lanes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        runs = -(-n[live] // 255)
        row = np.repeat(np.cumsum(runs) - runs, runs)
        begin = np.repeat(first[live], runs) + 255 * (np.arange(len(row)) - row)
        part = np.add.reduceat(lanes, begin, axis=0).view(np.uint8)
        out[live] = np.add.reduceat(part, np.cumsum(runs) - runs, axis=0, dtype=np.int64)
    return out


def majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if more than half of n hashes have it."""
    return np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of runs of n hashes; an empty run: 0."""
    return majority(bit_counts(h, n), n)


def fingerprints_of(texts: list[str | None], shingle: int = 3, seed: int = SEED) -> np.ndarray:
    return fingerprints(*shingle_hashes(texts, shingle, seed))


def sketches(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, planes) of runs of hashes: the keys of each run's bands, and two bits of each of its PLACES min-wise hashes.

    A run's four planes are the low bits of places 0-63 and 64-127, then the high bits.
    """
    least = np.full((PLACES, len(n)), np.iinfo(np.uint64).max, np.uint64)
    live = np.flatnonzero(n > 0)
    if len(live):
        first = (np.cumsum(n) - n)[live]
        for k, f in enumerate(_FACTORS):
            least[k, live] = np.minimum.reduceat(h * f, first)
    keys = np.zeros((BANDS, len(n)), np.uint64)
    for b in range(BANDS):
        for k in range(b * BAND_HASHES, (b + 1) * BAND_HASHES):
            keys[b] = _text.mix(keys[b] + least[k] + np.uint64(b))
    told = _text.mix(least)
    bits = [np.ascontiguousarray(np.packbits(((told >> np.uint64(k)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little").T).view(np.uint64) for k in (0, 1)]
    return keys, np.concatenate(bits, axis=1)


def equal_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places sketches agree."""
    x = a ^ b
    return PLACES - np.bitwise_count(x[..., 0] | x[..., 2]).astype(np.int64) - np.bitwise_count(x[..., 1] | x[..., 3])


class BkTree:
    """A BK-tree in arrays: of each node its fingerprint, and its children in one run ordered by distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        # all values descend from the root together; of those in one child place the first stays
        here, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(here):
            d = np.bitwise_count(values[here] ^ values[at]).astype(np.int64)
            slot = at * 65 + d
            _, lead, where = np.unique(slot, return_index=True, return_inverse=True)
            parent[here[lead]], edge[here[lead]] = at[lead], d[lead]
            rest = np.ones(len(here), bool)
            rest[lead] = False
            here, at = here[rest], here[lead][where][rest]
        order = np.lexsort((edge, parent))
        order = order[parent[order] >= 0]
        self.child = order
        self.slot = parent[order] * 65 + edge[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query's index, node) at distance radius or less."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            total = int(n.sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            node = self.child[np.repeat(lo, n) + step]
            q = np.repeat(q, n)


def spanning_links(values: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each value that has a link, (value, first value of its component here); roots are left out."""
    root = local_roots(values, radius, block)
    linked = root != np.arange(len(values))
    return values[linked], values[root[linked]]


def local_roots(values: np.ndarray, radius: int, block: int = 512, asked: np.ndarray | None = None) -> np.ndarray:
    """The first place of each value's component; asked limits the queries to some places, the tree then holds the others."""
    n = len(values)
    up = np.arange(n)
    held = np.arange(n) if asked is None else np.setdiff1d(np.arange(n), asked)
    asked = held if asked is None else asked
    if len(held):
        tree = BkTree(values[held])
        block = max(1, min(block, FRONTIER // len(held)))  # a frontier holds a few pairs for each query and node at most
        for lo in range(0, len(asked), block):
            some = asked[lo : lo + block]
            for q, node in tree.within(values[some], radius):
                _hang(up, some[q], held[node])
    return _roots(up, np.arange(n))


class RowTree:
    """A BK-tree over the distinct values of some rows, and the rows that each stands for."""

    def __init__(self, values: np.ndarray, rows: np.ndarray):
        self.values = values
        distinct, where = np.unique(values[rows], return_inverse=True)
        self.rows, self.n = rows[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(distinct))
        self.first, self.tree = np.cumsum(self.n) - self.n, BkTree(distinct)

    def within(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of asked, row of the tree) at distance radius or less."""
        if len(self.rows) and len(asked):
            for q, node in self.tree.within(self.values[asked], radius):
                n = self.n[node]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(asked[q], n), self.rows[np.repeat(self.first[node], n) + step]


def local_forest(values: np.ndarray, radius: int, planes: np.ndarray, equal: int, part: np.ndarray, holds: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within radius that have at least equal places in common, and that hold.

    Pairs come from searches of a BK-tree over the fingerprints. If part tells rows
    of two kinds apart, only pairs of different kinds are compared. With holds every
    pair that would join two trees is put to it, until one of them holds or none is
    left. Rows of the largest family search a tree without that family.
    """
    n = len(values)
    up = np.arange(n)
    out = []
    apart = n > 0 and bool((part != part[0]).any())

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for k in range(0, len(a), 4096):
            x, y = a[k : k + 4096], b[k : k + 4096]
            new = _roots(up, x) != _roots(up, y)  # what is joined already needs no further link
            x, y = x[new], y[new]
            near = equal_places(planes[x], planes[y]) >= equal
            x, y = x[near], y[near]
            if holds is None:
                out.extend(_hang(up, x, y))
                continue
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if (_roots(up, np.array([i])) != _roots(up, np.array([j])))[0] and holds(i, j):
                    out.extend(_hang(up, np.array([i]), np.array([j])))

    def search(rows: np.ndarray, tree: RowTree, reach: int) -> None:
        for a, b in tree.within(rows, reach):
            join(a, b) if apart else join(a[b < a], b[b < a])

    asked = np.flatnonzero(part == part.max()) if apart else np.arange(n)
    other = np.flatnonzero(part == part.min()) if apart else asked
    if n > 1000:  # most of a large family hangs on one of its first rows
        for k in range(LEADERS):
            for mine, theirs in ((other, asked), (asked, other)) if apart else ((asked, asked),):
                roots = _roots(up, np.arange(n))
                alone = mine[roots[mine] == mine][k : k + 1]
                if len(alone):
                    search(theirs[roots[theirs] != alone[0]], RowTree(values, alone), radius)
    every, few = RowTree(values, other), None
    # the nearest first, where a tree prunes well; what hangs together then leaves little for the wide search
    for reach in [r for r in (RADIUS, 3 * RADIUS) if n > 1000 and r < radius] + [radius]:
        block = max(1, FRONTIER // max(1, n))
        for lo in range(0, len(asked), block):
            some, inside = asked[lo : lo + block], np.zeros(n, bool)
            if n > 1000:
                roots = _roots(up, np.arange(n))
                if few is None:
                    family = np.bincount(roots).argmax()
                inside = roots == roots[family]
                rest = other[~inside[other]]
                if few is None or len(rest) < len(few.rows) // 2:
                    few = RowTree(values, rest)
                search(some[inside[some]], few, reach)
            search(some[~inside[some]], every, reach)
        few = None
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[x for x, _ in out]]), np.concatenate([none, *[y for _, y in out]])


def _hang(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hangs the larger root of each pair under the smaller until all pairs agree; the pairs that did it."""
    did = []
    while True:
        a_root, b_root = _roots(up, a), _roots(up, b)
        apart = a_root != b_root
        if not apart.any():
            return did
        a, b = a[apart], b[apart]
        hi, to = np.maximum(a_root[apart], b_root[apart]), np.minimum(a_root[apart], b_root[apart])
        np.minimum.at(up, hi, to)
        set_ = np.flatnonzero(up[hi] == to)
        which = set_[np.unique(hi[set_], return_index=True)[1]]
        did.append((a[which], b[which]))


def _roots(up: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = up[of]
    while True:
        to = up[at]
        if (to == at).all():
            up[of] = at
            return at
        at = to


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp) of every row, fp as signed 64-bit number; only key and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, n, part, last in shingle_runs(b, 1, shingle):
                counts = bit_counts(h, n)
                if part:  # a long text's counts are the sums of its parts'
                    counts, n = counts + held[0], n + held[1]
                held = counts, n
                if last:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(majority(counts, n).view(np.int64))], names=["doc_id", "fp"])

    return only(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (a, b) between fingerprints of column fp that connect all within radius of each other."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    value = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    shard = F.array(*[F.xxhash64(F.lit(k), value[i], value[j]) for k, (i, j) in enumerate(combinations(range(blocks), 2))])
    dealt = distinct.select(F.explode(shard).alias("shard"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, fp in _groups(batches):
            root = local_roots(fp.view(np.uint64), radius, asked=np.flatnonzero(part == part.max()) if (part != part[0]).any() else None)
            linked = root != np.arange(len(fp))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    return _in_cells(dealt, "fp", hot_rows).mapInArrow(run, "a long, b long")


def _in_cells(dealt: DataFrame, by: str, hot_rows: int) -> DataFrame:
    """Rows (shard, ...) as (shard, cell, part, ...), a cell's rows together.

    A shard of at most hot_rows is one cell. A larger one is cut into parts by a
    hash of column by, and each two parts, and each by itself, are a cell, so that
    no task holds more than two parts. Only shards beyond hot_rows are listed,
    from counts combined before they move.
    """
    size = dealt.groupBy("shard").count().where(F.col("count") > hot_rows).select("shard", F.ceil(F.col("count") / hot_rows).cast("int").alias("parts"))
    with Workspace() as w:
        size = w.kept(size)
        n = size.count()
        if n:
            size = w.hand_out(size)
    rest = [c for c in dealt.columns if c != "shard"]
    if not n:
        cells = dealt.select("shard", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("part"), *rest)
    else:
        told = dealt.join(F.broadcast(size) if n <= LISTED else size, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        told = told.withColumn("part", F.pmod(F.xxhash64(F.lit(7), by), F.col("parts")).cast("int"))
        other = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = other.select("shard", (F.least("part", "other").cast("long") * (1 << 31) + F.greatest("part", "other")).alias("cell"), "part", *rest)
    return cells.repartition("shard", "cell").sortWithinPartitions("shard", "cell")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    component_id is the smallest key that links lead to, a row's own included.
    Null and empty texts have fingerprint zero and link like any other; repeated
    rows each come back; a null key stays null and names no component unless all
    keys of it are null. An empty table gives none; further columns are not read,
    whatever their names. Long texts are read in parts.
    """
    with Workspace() as w:
        prints = w.kept(fingerprint(docs, key, text, shingle))
        distinct = w.kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
        parts = connected_components(fingerprint_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
        # all members of a component take the smallest key of any of its fingerprints
        rooted = parts.join(distinct, "fp")
        smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        named = w.kept(parts.join(smallest, "root").select("fp", "component_id"))
        label = w.kept(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id")))
        w.drop(distinct, named)
        return w.hand_out(prints).join(w.hand_out(label), "fp").select("doc_id", "fp", "component_id")


def similar_components(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text", shingle: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, component_id) of every row of docs whose key is not null, by similarity of shingle sets.

    Two sets are linked if their Jaccard similarity, taken over the whole sets,
    reaches the limit. Candidates are found by BK-trees of SimHash fingerprints (of
    distinct shingles), at a radius that such sets keep but for six standard errors.
    A shard's tree holds what agrees on a band of min-wise hashes, as no blocks of
    fingerprint bits survive that radius. Candidates must also agree in as many min-wise places as such sets do, less four standard
    errors. Each cell reports a spanning forest of its candidates; its links are verified, and a tree with a
    false one is searched again with the sets at hand. component_id is the
    smallest key that links lead to. Texts without a word are alike; repeated rows
    each come back; an empty table gives none; further columns are not read,
    whatever their names.
    """
    expected = similarity + (1 - similarity) / 4
    equal = int(np.floor(PLACES * expected - 4 * (PLACES * expected * (1 - expected)) ** 0.5))
    # cosine of sets from Jaccard, the angle's share of 64 bits, and six standard errors more; prints are of sets, too
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    radius = int(np.ceil(64 * share + 6 * (64 * share * (1 - share)) ** 0.5))
    planes = [f"p{k}" for k in range(4)]

    def told_of(b: pa.RecordBatch) -> Iterator[tuple]:
        long: list[np.ndarray] = []
        for lo, hi, h, n, part, last in shingle_runs(b, 1, shingle):
            if part or not last:
                long = [*long, np.unique(h)] if part else [np.unique(h)]
                if not last:
                    continue
                h = np.unique(np.concatenate(long))
                n, long = np.array([len(h)]), []
            else:
                h, n = shingle_sets(h, n)
            yield lo, hi, h, n, set_digests(h, n)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, n, item in told_of(b):
                keys, bits = sketches(h, n)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32)), pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(item), pa.array(fingerprints(h, n).view(np.int64)), bands, *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in bits.T]], names=["doc_id", "item", "fp", "bands", *planes])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, h, n, item in told_of(b):
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array([h[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], names=["item", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, cell), part, item, fp, *bits in _groups(batches):
            order = np.argsort(item)  # so that the trees of several shards have like links
            item, fp, bits = item[order], fp[order], np.stack([x[order] for x in bits], 1)
            a, b = local_forest(fp.view(np.uint64), radius, bits.view(np.uint64), equal, part[order])
            if len(a):
                up = np.arange(len(item))
                _hang(up, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), x)) for x in (shard, cell)] + [pa.array(x) for x in (item[a], item[b], item[_roots(up, a)])], names=["shard", "cell", "a", "b", "tree"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [similar_sets(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64), similarity) for k in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, item, fp, p0, p1, p2, p3, hashes in _groups(batches):
            sets, bits = [np.frombuffer(x, np.uint64) for x in hashes], np.stack([p0, p1, p2, p3], 1).view(np.uint64)
            a, b = local_forest(fp.view(np.uint64), radius, bits, equal, np.zeros(len(item), np.int32), lambda i, j, sets=sets: similar_sets(sets[i], sets[j], similarity))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(item[a]), pa.array(item[b])], names=["a", "b"])

    spark = docs.sparkSession
    rows = only(docs, doc_id=key, text=text).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Workspace() as w:
        told = w.kept(rows.mapInArrow(sketch, "doc_id long, item long, fp long, bands array<long>, " + ", ".join(f"{p} long" for p in planes)))
        # one row of each item, and of each row its item
        items = w.kept(told.groupBy("item").agg(F.min("doc_id").alias("first_doc"), *[F.first(c).alias(c) for c in ("fp", "bands", *planes)]))
        of_doc = w.kept(told.select("doc_id", "item"))
        w.drop(told)
        release_shuffles(spark)
        dealt = items.select(F.explode(F.array_distinct("bands")).alias("shard"), "item", "fp", *planes)
        found = w.kept(_in_cells(dealt, "item", hot_rows).mapInArrow(run, "shard long, cell long, a long, b long, tree long"))
        release_shuffles(spark)

        # the sets of what has a candidate, once each, from the first row that holds them
        pairs = w.kept(found.select("a", "b").distinct())
        wanted = w.kept(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "item"))
        of = items.join(wanted, "item", "left_semi").select(F.col("first_doc").alias("doc_id")).distinct()
        sets = rows.join(of, "doc_id", "left_semi").mapInArrow(whole, "item long, hashes binary").join(wanted, "item", "left_semi")
        sets = w.kept(sets.groupBy("item").agg(F.first("hashes").alias("hashes")))
        w.drop(wanted)
        release_shuffles(spark)
        told_a, told_b = (sets.select(F.col("item").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in "ab")
        checked = w.kept(pairs.join(told_a, "a").join(told_b, "b").select("a", "b", "a_hashes", "b_hashes").mapInArrow(verify, "a long, b long, good boolean"))
        release_shuffles(spark)
        links, tree = checked.where("good").select("a", "b"), ["shard", "cell", "tree"]
        if not checked.where("not good").isEmpty():
            false = found.join(checked.where("not good"), ["a", "b"], "left_semi").select(*tree).distinct()
            trees = found.join(false, tree, "left_semi").select(*tree, F.explode(F.array("a", "b")).alias("item")).distinct()
            trees = trees.select(F.xxhash64("shard", "tree").alias("shard"), "cell", "item")
            full = trees.join(items.select("item", "fp", *planes), "item").join(sets, "item").select("shard", "cell", F.lit(0).alias("part"), "item", "fp", *planes, "hashes")
            more = w.kept(full.repartition("shard", "cell").sortWithinPartitions("shard", "cell", "item").mapInArrow(again, "a long, b long"))
            links = links.union(more).distinct()
        roots = connected_components(links).withColumnRenamed("node", "item")
        w.drop(found, pairs, sets, checked)
        release_shuffles(spark)
        # all members of a component take the smallest key of any of its sets
        firsts = items.select("item", "first_doc")
        smallest = roots.join(firsts, "item").groupBy("root").agg(F.min("first_doc").alias("component_id"))
        label = firsts.join(roots.join(smallest, "root").select("item", "component_id"), "item", "left").select("item", F.coalesce("component_id", "first_doc").alias("component_id"))
        return w.hand_out(w.kept(of_doc.join(label, "item").select("doc_id", "component_id")))


def set_digests(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A signed 64-bit digest of each run of distinct hashes; an empty run has one of its own."""
    total = np.zeros(len(n), np.uint64)
    live = n > 0
    if live.any():
        total[live] = np.add.reduceat(_text.mix(h), (np.cumsum(n) - n)[live])
    return _text.mix(total + n.astype(np.uint64) * _FACTORS[0]).view(np.int64)


def similar_sets(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((shard, cell), further columns) of each run of rows with one shard and cell, for runs of two rows or more."""
    held: list[list] = []
    of: tuple[int, int] | None = None

    def joined() -> tuple:
        return (of, *(np.concatenate(c) for c in zip(*held, strict=True)))

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        shard, cell = cols[:2]
        cut = np.flatnonzero((shard[1:] != shard[:-1]) | (cell[1:] != cell[:-1])) + 1
        bounds = [0, *cut.tolist(), len(shard)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if lo == hi:
                continue
            here = (int(shard[lo]), int(cell[lo]))
            if of is not None and here != of:
                if sum(len(h[0]) for h in held) > 1:
                    yield joined()
                held = []
            of = here
            held.append([c[lo:hi] for c in cols[2:]])
    if sum(len(h[0]) for h in held) > 1:
        yield joined()

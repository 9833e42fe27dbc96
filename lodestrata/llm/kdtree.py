"""Exact top-k search by inner product over KD-trees, one per shard.

Each shard of candidates becomes a KD-tree: median splits along the widest
side, and for every node the tight bounding box of its vectors. The inner
product of a query with anything in a box is at most the sum over components of
the larger of q*low and q*high. A query visits nodes best bound first and stops
at the first bound below its k-th best score; that k-th score starts from what
the queries of its block already have among themselves, and is carried from leaf
to leaf and from shard to shard of a task. Leaves are multiplied as blocks.

Products are exact: where a sum could pass 2**53, whole numbers of any size are
multiplied instead of doubles. A score that no long can hold is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Workspace, numbered, place_of

LEAF = 256
#: Rows of a shard, bytes of a query block, and queries that give each other a first k-th score; none bounds the result.
SHARD_ROWS, QUERY_BYTES, POOL = 16_384, 32 << 20, 4096
EXACT = float(1 << 53)


class KdTree:
    """Nodes in arrays; children of node i are left[i] and left[i] + 1, leaves have left -1."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        lows, highs, left, begin, end = [], [], [], [], []

        def node(lo: int, hi: int) -> None:
            part = vectors[self.order[lo:hi]]
            lows.append(part.min(0))
            highs.append(part.max(0))
            left.append(-1)
            begin.append(lo)
            end.append(hi)

        node(0, len(vectors))
        k = 0
        while k < len(left):
            lo, hi = begin[k], end[k]
            spread = highs[k] - lows[k]
            if hi - lo > leaf and spread.max() > 0:
                axis, mid = int(spread.argmax()), (hi - lo) // 2
                own = self.order[lo:hi]
                self.order[lo:hi] = own[np.argpartition(vectors[own, axis], mid)]
                left[k] = len(left)
                node(lo, lo + mid)
                node(lo + mid, hi)
            k += 1
        self.low, self.high = np.array(lows), np.array(highs)
        self.left, self.begin, self.end = left, begin, end
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the most that an inner product with a vector in its box can be."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: KdTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray, uids: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores) of each query's best k in the tree that reach kth, ties to smaller ids.

    own names the row that each query may not meet, by uids (by default the ids).
    """
    rows, name = (ids if uids is None else uids)[tree.order], ids[tree.order]
    bound = tree.bounds(queries)
    for j, q in enumerate(queries):
        best_id, best_score, least = np.zeros(0, np.int64), np.zeros(0), kth[j]
        heap = [(-bound[j, 0], 0)]
        while heap and -heap[0][0] >= least:
            _, n = heapq.heappop(heap)
            child = tree.left[n]
            if child >= 0:
                for c in (child, child + 1):
                    if bound[j, c] >= least:
                        heapq.heappush(heap, (-bound[j, c], c))
                continue
            lo, hi = tree.begin[n], tree.end[n]
            score = tree.vectors[lo:hi] @ q
            hit = np.flatnonzero((score >= least) & (rows[lo:hi] != own[j]))
            if len(hit):
                best_id, best_score = _best(np.concatenate([best_id, name[lo:hi][hit]]), np.concatenate([best_score, score[hit]]), k)
                if len(best_id) == k:
                    least = max(least, best_score[-1])
        if len(best_id):
            yield j, best_id, best_score


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids, best first."""
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def _first_kth(m: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the k-th best product with the first POOL other rows: no more than its k-th best over all vectors."""
    out = np.full(len(m), -np.inf)
    pool, name = m[:POOL], uids[:POOL]
    for lo in range(0, len(m), 512):
        s = m[lo : lo + 512] @ pool.T
        s[uids[lo : lo + 512, None] == name[None, :]] = -np.inf
        if s.shape[1] > k:
            out[lo : lo + 512] = np.partition(s, -k, axis=1)[:, -k]
    return out


def _exact(ids: np.ndarray, uids: np.ndarray, m: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one query by whole numbers of any size."""
    q = [int(x) for x in query]
    told = sorted((-sum(a * int(b) for a, b in zip(q, v, strict=True)), i) for i, u, v in zip(ids.tolist(), uids.tolist(), m.tolist(), strict=True) if u != own)
    out = [(-s, i) for s, i in told[:k]]
    if any(abs(s) >= 1 << 63 for s, _ in out):
        raise OverflowError("an inner product is beyond what a long can hold")
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score) of the k highest integer inner products of each query row.

    column holds whole numbers as doubles. Candidates are all rows but the query's
    own; a row that repeats it counts like any other, and rows that share a key are
    queries each. Ties go to smaller keys. Vectors and keys that are null, and
    vectors that are empty or hold null, NaN or infinity, take no part; a query
    meets only vectors of its own length. An empty table gives an empty result;
    other columns are not read, whatever their names.

    Rows are dealt once, to a table in the shared folder. Queries travel in blocks
    of QUERY_BYTES at most, each of which is broadcast to one map over that table,
    whose tasks build the trees of their shards and give back k rows a query.
    """
    spark = vectors.sparkSession
    flagged = numbered(vectors.select("*", is_query.alias("asked")))
    names = vectors.columns
    every = flagged.select(F.col(f"c{place_of(names, key)}").cast("long").alias("id"), F.col(f"c{place_of(names, column)}").cast("array<double>").alias("v"), F.coalesce(F.col(f"c{len(names)}"), F.lit(False)).alias("asked"))
    every = every.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    every = every.withColumn("uid", F.monotonically_increasing_id())
    schema = f"query_uid long, query_id long, `{key}` long, score long"
    with Workspace() as w:
        base = w.kept(every.repartition(F.xxhash64("id", "v", "uid")))
        size = base.where("asked").agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
        blocks = -(-size // QUERY_BYTES)
        found = spark.createDataFrame([], "query_id long, rank int, id long, score long")
        for block in range(blocks):
            part = base.where(F.col("asked") & (F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block)).select("uid", "id", "v").toArrow()
            hits = base.select("uid", "id", "v").mapInArrow(_searcher(spark.sparkContext.broadcast(_by_length(part, k)), k, key), schema).withColumnRenamed(key, "id")
            order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "id")
            best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            found = found.unionByName(w.hand_out(w.kept(best.select("query_id", "rank", "id", "score"))))
    return found.toDF("query_id", "rank", key, "score")


def _by_length(block: pa.Table, k: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each vector length: query rows, ids, vectors and first k-th scores."""
    out: dict[int, list[tuple]] = {}
    for u, i, v in sorted(zip(block.column("uid").to_pylist(), block.column("id").to_pylist(), block.column("v").to_pylist(), strict=True), key=lambda r: r[:2]):
        out.setdefault(len(v), []).append((u, i, v))
    done = {}
    for d, rows in out.items():
        uids, ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        safe = float(np.abs(m).max()) ** 2 * d < EXACT
        done[d] = (uids, ids, m, _first_kth(m, uids, k) if safe else np.full(len(m), -np.inf))
    return done


def _searcher(shared, k: int, key: str):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        blocks = shared.value
        best: dict[int, list] = {d: [(np.zeros(0, np.int64), np.zeros(0))] * len(x[0]) for d, x in blocks.items()}
        kth = {d: x[3].copy() for d, x in blocks.items()}
        large: dict[tuple[int, int], list[tuple[int, int]]] = {}
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def shard(d: int) -> None:
            """Searches what is held of one length, and lets it go."""
            uids, ids, m = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
            query_uids, _, queries, _ = blocks[d]
            with np.errstate(over="ignore"):
                safe = float(np.abs(queries).max()) * float(np.abs(m).max()) * d < EXACT
            if not safe or any(q[0] == d for q in large):
                for j, q in enumerate(queries):
                    old = large.get((d, j)) or [(int(s), int(i)) for i, s in zip(*(x.tolist() for x in best[d][j]), strict=True)]
                    large[d, j] = sorted([*old, *_exact(ids, uids, m, q, int(query_uids[j]), k)], key=lambda x: (-x[0], x[1]))[:k]
                return
            for j, found, score in search(KdTree(m), ids, queries, query_uids, k, kth[d], uids):
                best[d][j] = _best(np.concatenate([best[d][j][0], found]), np.concatenate([best[d][j][1], score]), k)
                if len(best[d][j][0]) == k:
                    kth[d][j] = max(kth[d][j], best[d][j][1][-1])

        for b in batches:
            size = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                if d not in blocks:
                    continue
                part = b.filter(pa.array(size == d))
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for lo in range(0, len(flat), SHARD_ROWS):
                    held.setdefault(d, []).append((*(part.column(c).to_numpy(zero_copy_only=False)[lo : lo + SHARD_ROWS] for c in (0, 1)), flat[lo : lo + SHARD_ROWS]))
                    if sum(len(x[0]) for x in held[d]) >= SHARD_ROWS:
                        shard(d)
        for d in list(held):
            shard(d)
        out: list[list] = [[], [], [], []]
        for d, (uids, ids, _, _) in blocks.items():
            for j, (u, i) in enumerate(zip(uids.tolist(), ids.tolist(), strict=True)):
                rows = large.get((d, j)) or list(zip(map(int, best[d][j][1].tolist()), best[d][j][0].tolist(), strict=True))
                for s, c in rows:
                    for col, x in zip(out, (u, i, c, s), strict=True):
                        col.append(x)
        for at in range(0, len(out[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], pa.int64()) for c in out], names=["query_uid", "query_id", key, "score"])

    return run

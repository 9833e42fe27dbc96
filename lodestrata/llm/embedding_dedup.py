"""Near-duplicate vectors by p-stable hashing and exact cosines.

A vector of length 1 is projected on Gaussian directions, which are 2-stable: the
difference of two vectors' projections is distributed like their distance times a
Gaussian. Projections plus an offset are cut into cells of one width; DIRECTIONS
cells together are a bucket of a table, and two vectors meet if they share a
bucket of any table. The number of directions grows with the logarithm of the
number of vectors, and tables are as many as find a pair at the limit with
probability RECALL. What meets is compared by exact cosine.

Vectors that are equal are one class with a weight. Pairs are never written down:
a pair counts in the first table in which it meets, which both vectors' keys tell,
so a cell of a bucket reports a count for each of its vectors and a spanning forest
of its links. A bucket beyond CELL_ROWS is compared part by part, a cell for each
two parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Workspace, numbered, place_of
from ._text import mix
from .components import connected_components
from .simhash import _groups, _hang, _in_cells, _roots

LIMIT, RECALL, SEED = 0.9, 0.98, 2011
#: Vectors that a bucket may hold by chance, width of a cell, fewest directions of a table.
EXPECTED, WIDTH, FEWEST = 1024, 2.4, 4
#: Rows of a part of a bucket, and rows multiplied at once.
CELL_ROWS, ROWS = 8192, 1024
#: Vectors and directions are rounded to so many steps a unit: their products are whole numbers below 2**53, the same in any order of summing.
STEPS = float(1 << 18)


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """The chance that one projection of two vectors at this distance falls in one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape_for(n: int, limit: float = LIMIT, recall: float = RECALL) -> tuple[int, int]:
    """(directions of a table, tables) for n vectors.

    Unrelated vectors stand at right angles; a bucket then holds EXPECTED of them
    by chance. A pair at the limit is missed by all tables with a chance of 1 - recall
    at most; closer pairs are missed less.
    """
    apart, near = meeting_chance(math.sqrt(2)), meeting_chance(math.sqrt(2 - 2 * limit))
    directions = max(FEWEST, math.ceil(math.log(max(n, 1) / EXPECTED) / -math.log(apart)))
    return directions, math.ceil(math.log(1 - recall) / math.log(1 - near**directions))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1, whatever their size."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def bucket_keys(m: np.ndarray, directions: int, tables: int, upto: int | None = None) -> np.ndarray:
    """Of each row of length 1, the key of its bucket in each table, or in those before upto."""
    d = m.shape[1]
    upto = tables if upto is None else upto
    rng = np.random.Generator(np.random.PCG64([SEED, d]))
    onto = np.rint(rng.standard_normal((d, tables * directions)) * STEPS)
    shift = rng.uniform(0, WIDTH, tables * directions)
    some = slice(0, upto * directions)
    cells = np.floor((np.rint(m * STEPS) @ onto[:, some] / STEPS**2 + shift[some]) / WIDTH).astype(np.int64).view(np.uint64)
    keys = np.zeros((upto, len(m)), np.uint64)
    for t in range(upto):
        keys[t] = mix(np.full(len(m), t * 65_537 + d, np.uint64))
        for k in range(directions):
            keys[t] = mix(keys[t] + cells[:, t * directions + k])
    return keys


def links_of(m: np.ndarray, weight: np.ndarray, part: np.ndarray, earlier: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights of the other end summed for each row, forest a, forest b) of the pairs that reach limit and share no earlier key.

    If part tells rows of two kinds apart, only pairs of different kinds are compared.
    """
    n, u = len(m), unit(m)
    counts, up = np.zeros(n), np.arange(n)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    apart = bool((part != part[0]).any())
    asked, other = (np.flatnonzero(part == part.max()), np.flatnonzero(part == part.min())) if apart else (up.copy(), up.copy())
    step = max(1, min(ROWS, (1 << 22) // n))
    for lo in range(0, len(asked), step):
        some = asked[lo : lo + step]
        against = other if apart else other[: int(some[-1])]
        cos = u[some] @ u[against].T
        x, y = np.nonzero(np.abs(cos - limit) < 1e-9)
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, q = m[some[i]], m[against[j]]
            with np.errstate(all="ignore"):
                plain = np.dot(p, q) / (np.sqrt(np.dot(p, p)) * np.sqrt(np.dot(q, q)))
            cos[i, j] = plain if np.isfinite(plain) else cos[i, j]
        hit = cos >= limit
        if not apart:
            hit &= against[None, :] < some[:, None]
        x, y = np.nonzero(hit)
        x, y = some[x], against[y]
        for key in earlier:
            if not len(x):
                break
            new = key[x] != key[y]
            x, y = x[new], y[new]
        if len(x):
            counts += np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
            for p, q in _hang(up, x, y):
                a.append(p)
                b.append(q)
    return np.rint(counts).astype(np.int64), np.concatenate(a), np.concatenate(b)


def near_vectors(vectors: DataFrame, limit: float = LIMIT, recall: float = RECALL, key: str = "vec_id", column: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    n_links counts the other rows whose cosine with this one is found to reach
    limit; component_id is the smallest key that links lead to, a row's own
    included. Vectors that are null, empty, zero, or hold null, NaN or infinity link
    with nothing, nor do vectors of different lengths. Repeated rows and rows that
    share a key are vectors each, linked like others. A null key stays null and names
    no component unless all keys of it are null; it is not kept. An empty table gives
    none; other columns are not read, whatever their names.

    Each pair found is exact; a pair at the limit is found with probability recall or
    more, equal vectors always.
    """
    found = numbered(vectors)
    names = vectors.columns
    at = f"c{place_of(names, column)}"
    kind = "float" if vectors.schema[place_of(names, column)].dataType.simpleString() == "array<float>" else "double"
    rows = found.select(F.col(f"c{place_of(names, key)}").cast("long").alias("vec_id"), F.col(at).cast(f"array<{kind}>").alias("v"))
    fit = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    # equal vectors share two keys of 64 bits
    keyed = rows.where("fit").select("vec_id", F.xxhash64(F.lit(0), "v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"), "v")
    with Workspace() as w:
        classes = w.kept(keyed.groupBy("x", "y").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("first_id")).withColumn("item", F.monotonically_increasing_id()))
        directions, tables = shape_for(classes.count(), limit, recall)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, part in by_length(b, 2):
                    keys = bucket_keys(unit(flat_of(part.column(2), d)), directions, tables)
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[t].view(np.int64)), *part.columns, pa.array(np.full(len(part), t, np.int16))], names=["shard", "item", "n", "v", "place"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part, item, n, v, place in _groups(batches):
                order = np.argsort(item)
                m = np.stack(v[order]).astype(np.float64)
                counts, a, b = links_of(m, n[order], part[order], bucket_keys(unit(m), directions, tables, int(place[0])), limit)
                item, some = item[order], np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([item[some], item[a]])), pa.array(np.concatenate([np.zeros(len(some), np.int64), item[b]]), mask=np.arange(len(some) + len(a)) < len(some)), pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]))], names=["a", "b", "n"])

        dealt = classes.select("item", "n", "v").mapInArrow(deal, f"shard long, item long, n long, v array<{kind}>, place short")
        told = w.kept(_in_cells(dealt, "item", cell_rows).mapInArrow(run, "a long, b long, n long"))
        roots = connected_components(told.where("b is not null").select("a", "b")).withColumnRenamed("node", "item")
        slim = classes.select("item", "x", "y", "n", "first_id")
        smallest = roots.join(slim, "item").groupBy("root").agg(F.min("first_id").alias("component_id"))
        named = roots.join(smallest, "root").select("item", "component_id")
        linked = told.where("b is null").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("links"))
        label = slim.join(named, "item", "left").join(linked, "item", "left").select("x", "y", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
        label = w.hand_out(w.kept(label))
    good = keyed.select("vec_id", "x", "y").join(label, ["x", "y"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle() -> str:
    """DuckDB SQL for the rows over embeddings, by all pairs."""
    return f"""WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, CAST(embedding AS DOUBLE[]) AS e,
  coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fit FROM embeddings),
l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.fit AND b.fit AND a.id <> b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {LIMIT}),
r AS (SELECT id, id AS other FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT r.id, min(v.vec_id) AS component_id FROM r JOIN v ON v.id = r.other GROUP BY r.id), n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (id) LEFT JOIN n USING (id)"""


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, rows) of the rows of each vector length."""
    import pyarrow.compute as pc

    size = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        yield d, batch.filter(pa.array(size == d))


def flat_of(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)

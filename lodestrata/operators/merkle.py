"""A Merkle tree over a source tree's files: digests by ranges of hashes, folded level by level, and deltas from unequal nodes only.

A file belongs to the leaf that the first DEPTH hex digits of its path's hash name;
a node one level up stands for one digit less, so it has sixteen children at most,
whatever a project holds. A leaf's digest is that of the sums of its files' digests,
in four parts of 60 bits, and of their number: no row ever lists files, and sums
are combined before they move. Two trees are compared from the root down, children
of unequal nodes only, so the files of equal leaves are not compared at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import Workspace
from ..sources.versions import content_delta

DEPTH, FANOUT = 3, 16


def _bucket(path: Column, depth: int) -> Column:
    return F.substring(F.sha2(path, 256), 1, depth)


def tree(files: DataFrame, by: str = "project_id", path: str = "path", digest: str = "content_hash", depth: int = DEPTH) -> DataFrame:
    """(by, level, prefix, node_digest, n_files) of every node that has files, level 0 the root; paths are unique in a project.

    A null digest counts as an empty one. A file whose path is null has no place and
    is refused.
    """
    with Workspace() as w:
        place = F.when(F.col(path).isNull(), F.raise_error(F.lit("a file has no path"))).otherwise(_bucket(F.col(path), depth))
        own = F.sha2(F.concat(F.col(path), F.lit("\0"), F.coalesce(digest, F.lit(""))), 256)
        part = [F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(4)]
        rows = files.select(by, place.alias("prefix"), *part)
        sums = rows.groupBy(by, "prefix").agg(F.count("*").alias("n_files"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)])
        told = F.concat_ws(":", F.col("n_files").cast("string"), *[F.col(f"p{k}").cast("string") for k in range(4)])
        level = w.kept(sums.select(by, F.lit(depth).alias("level"), "prefix", F.sha2(told, 256).alias("node_digest"), "n_files"))
        out = level
        for k in range(depth - 1, -1, -1):
            digit = F.substring("prefix", k + 1, 1)
            children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(digit.alias("d"), "node_digest"))), lambda c: F.concat(c["d"], c["node_digest"])), "")
            level = level.groupBy(by, F.substring("prefix", 1, k).alias("prefix")).agg(children.alias("c"), F.sum("n_files").alias("n_files"))
            level = level.select(by, F.lit(k).alias("level"), "prefix", F.sha2("c", 256).alias("node_digest"), "n_files")
            out = out.unionByName(level)
        return w.hand_out(w.kept(out))


def roots(nodes: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, root_digest, n_files) of each project."""
    return nodes.where("level = 0").select(by, F.col("node_digest").alias("root_digest"), "n_files")


def unequal_leaves(old: DataFrame, new: DataFrame, by: str = "project_id", depth: int = DEPTH) -> DataFrame:
    """(by, prefix) of the leaves that differ, found from the roots down: a level is joined for children of unequal nodes only."""
    with Workspace() as w:
        apart = None
        for k in range(depth + 1):
            a, b = (t.where(F.col("level") == k).select(by, "prefix", F.col("node_digest").alias(c)) for t, c in ((old, "was"), (new, "now")))
            if apart is not None:
                up = apart.withColumnRenamed("prefix", "up")
                a, b = (t.withColumn("up", F.substring("prefix", 1, k - 1)).join(up, [by, "up"], "left_semi").drop("up") for t in (a, b))
            apart = w.kept(a.join(b, [by, "prefix"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select(by, "prefix"))
        return w.hand_out(apart)


def delta(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame, by: str = "project_id", path: str = "path", digest: str = "content_hash", depth: int = DEPTH) -> DataFrame:
    """(by, path, change): added, removed or changed, comparing only files whose leaves differ."""
    leaves = unequal_leaves(old_tree, new_tree, by, depth)
    told = []
    for files in (old, new):
        rows = files.select(by, path, digest, _bucket(F.col(path), depth).alias("prefix"))
        told.append(rows.join(leaves, [by, "prefix"], "left_semi").select(F.struct(by, path).alias("file"), digest))
    change = content_delta(told[0], told[1], "file", digest).where("change != 'same'")
    return change.select(f"file.{by}", f"file.{path}", "change")

"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Workspace


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Each round hangs every node under the smallest of its neighbours: first the
    larger neighbours, then the node itself and the smaller ones. It ends when
    the edges are stars, after a logarithmic number of rounds. Rounds are written
    to the shared checkpoint folder and deleted after the next; nothing but a count
    and a sum reaches the driver. Minima are combined before they are shuffled, and
    the joins that follow have a plain exchange on both sides, which adaptive
    execution splits where one node has very many neighbours.
    """
    with Workspace() as w:
        now = w.kept(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        last = None
        for _ in range(max_rounds):
            both = now.union(now.select("v", "u"))
            least = w.kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            # of each node, the smaller neighbours after the first star; all hang under the smallest
            large = w.kept(large.union(least.where("u != m")).distinct())
            lowest = w.kept(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            then = w.kept(small.union(lowest).distinct())
            w.drop(now, least, large, lowest)
            now = then
            state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if state == last:
                break
            last = state
        else:
            raise RuntimeError("components did not settle")
        roots = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")))
        return w.hand_out(w.kept(roots.groupBy("node").agg(F.min("root").alias("root"))))

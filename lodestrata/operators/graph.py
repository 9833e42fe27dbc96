"""A code property graph in two tables: point queries, bounded reachability, centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import Workspace

MIN_SCHEMA_VERSION = 5
MAX_DEPTH = 20
#: Edges that a task of a point query sorts at once, in the mean.
TASK_EDGES = 1 << 19


def require_schema(versions: DataFrame) -> int:
    """The graph's schema version; raises if it is older than the queries need."""
    v = versions.agg(F.max("version")).first()[0]
    if v is None or v < MIN_SCHEMA_VERSION:
        raise ValueError(f"graph schema {v}; {MIN_SCHEMA_VERSION} is needed")
    return v


def callers(edges: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, node_id, name) of what has an edge to each symbol."""
    return _neighbours(edges, nodes, symbols, "target", "source")


def callees(edges: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, node_id, name) of what each symbol has an edge to."""
    return _neighbours(edges, nodes, symbols, "source", "target")


def _neighbours(edges: DataFrame, nodes: DataFrame, symbols: DataFrame, at: str, other: str) -> DataFrame:
    """Other ends of the edges at each symbol, once each; tasks grow in number with the edges, so what one sorts doesn't."""
    n = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // TASK_EDGES))
    links = edges.select(F.col(at).alias("symbol"), F.col(other).alias("node_id")).repartition(n, "symbol")
    pairs = links.join(symbols, "symbol").select("symbol", "node_id").distinct().repartition(n, "node_id")
    return pairs.join(nodes.select(F.col("id").alias("node_id"), "name"), "node_id").select("symbol", "node_id", "name")


def explore(edges: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, role, node_id, name): each symbol itself and its neighbours on either side."""
    own = symbols.join(nodes, nodes["id"] == symbols["symbol"]).select("symbol", F.lit("self").alias("role"), F.col("id").alias("node_id"), "name")
    up = callers(edges, nodes, symbols).select("symbol", F.lit("caller").alias("role"), "node_id", "name")
    return own.unionByName(up).unionByName(callees(edges, nodes, symbols).select("symbol", F.lit("callee").alias("role"), "node_id", "name"))


def find_nodes(nodes: DataFrame, said: str, kind: str | None = None) -> DataFrame:
    """Nodes whose name holds `said`, case aside."""
    hit = nodes.where(F.contains(F.lower("name"), F.lit(said.lower())))
    return hit.where(F.col("kind") == kind) if kind else hit


def reach(edges: DataFrame, symbols: DataFrame, depth: int, w: Workspace) -> tuple[DataFrame, DataFrame]:
    """(group_no, node_id, bits, depth) and (group_no, bit, symbol): which of 64 symbols a node reaches first at this depth.

    Symbols that are neighbours in order share a word of 64 bits, so a node moves once
    for all symbols of a group that it newly reaches. A step's words and what the nodes
    have seen meet in one aggregation, which is written once; plans stay as short as one
    step, and the walk ends with an empty one. The tables stay until this program ends.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    listed = w.hand_out(w.kept(symbols.select("symbol").where("symbol is not null").distinct().sort("symbol").withColumn("n", F.monotonically_increasing_id())))
    members = listed.select(F.shiftright("n", 6).alias("group_no"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bit"), "symbol")
    seen = front = members.select("group_no", F.col("symbol").alias("node_id"), F.col("bit").alias("bits"))
    links = w.kept(edges.select("source", "target"))
    out, none = front.withColumn("depth", F.lit(0)), F.lit(0).cast("long")
    for d in range(1, depth + 1):
        step = front.withColumnRenamed("node_id", "target").join(links, "target").select("group_no", F.col("source").alias("node_id"), F.col("bits").alias("new"), none.alias("old"))
        met = step.unionByName(seen.select("group_no", "node_id", none.alias("new"), F.col("bits").alias("old"))).groupBy("group_no", "node_id").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        told = met.select("group_no", "node_id", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("fresh"), F.col("new").bitwiseOR(F.col("old")).alias("bits"))
        seen = w.hand_out(w.kept(told if d < depth else told.where("fresh != 0")))
        front = seen.where("fresh != 0").select("group_no", "node_id", F.col("fresh").alias("bits"))
        out = out.unionByName(front.withColumn("depth", F.lit(d)))
        if d == depth or front.isEmpty():
            break
    return out, members


def impact(edges: DataFrame, symbols: DataFrame, depth: int) -> DataFrame:
    """(symbol, node_id, depth): what reaches each symbol over at most `depth` edges, at its smallest depth.

    The walk moves a node once for 64 symbols (reach); pairs appear only at the
    end, where a word meets the symbols of its bits. A symbol that leads back
    to itself is not its own impact. Cycles end, and no path is walked twice.
    """
    with Workspace() as w:
        told, members = reach(edges, symbols, depth, w)
    pairs = told.where("depth > 0").join(members, "group_no").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return pairs.select("symbol", "node_id", F.col("depth").cast("long").alias("depth"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree) of each node with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def page_rank(edges: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(node_id, rank) after a fixed number of rounds; ranks sum to 1 less what nodes without edges out let go.

    The link table is cut to pairs with their share once and written, as every
    round reads it; a round is one join and one aggregation, combined before it
    is shuffled. Only the ranks stay; ids that are longs make it all lighter.
    """
    with Workspace() as w:
        pair = w.kept(edges.select("source", "target").distinct())
        out = pair.groupBy("source").agg(F.count("*").alias("n"))
        links = w.kept(pair.join(out, "source").select("source", "target", (1.0 / F.col("n")).alias("share")))
        nodes = w.kept(links.select("source").distinct().union(links.select("target").distinct()).distinct().toDF("node_id"))
        n = nodes.count()
        rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
        for _ in range(rounds):
            got = links.join(rank, links["source"] == rank["node_id"]).groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            rank = nodes.join(got, nodes["node_id"] == got["target"], "left").select("node_id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        return w.hand_out(w.kept(rank))


def canned(kind: Column, symbol: Column, answers: dict[str, str]) -> Column:
    """The stand-in graph's answer: the given one for a kind that answers has, else the symbol itself."""
    told = F.lit(None).cast("string")
    for k, answer in answers.items():
        told = F.when(kind == k, answer).otherwise(told)
    return F.coalesce(told, symbol)

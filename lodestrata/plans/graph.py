"""Queries over a graph that the order tables stand for: customers call orders, orders use parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, tools
from ._bind import table


def _edges(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = orders.select(_text("c", "o_custkey").alias("source"), _text("o", "o_orderkey").alias("target"), F.lit("calls").alias("kind"))
    b = items.select(_text("o", "l_orderkey").alias("source"), _text("p", "l_partkey").alias("target"), F.lit("imports").alias("kind"))
    c = items.select(_text("o", "l_orderkey").alias("source"), _text("s", "l_suppkey").alias("target"), F.lit("instantiates").alias("kind"))
    return a.unionByName(b).unionByName(c)


_TAGS = "cops"


def _text(k, c):
    return F.concat(F.lit(k + ":"), F.col(c).cast("string"))


def _long(k, c):
    """A key times four, and its table's place among the tags."""
    return (F.col(c) * 4 + _TAGS.index(k)).cast("long")


def _nodes(spark, sf_dir, ident=_text):
    parts = [("customer", "c", "c_custkey", "c_name"), ("orders", "o", "o_orderkey", "o_orderpriority"), ("part", "p", "p_partkey", "p_name"), ("supplier", "s", "s_suppkey", "s_name")]
    out = None
    for name, k, key, label in parts:
        rows = table(spark, sf_dir, name).select(ident(k, key).alias("id"), F.lit(name).alias("kind"), F.col(label).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _long_edges(spark, sf_dir):
    """The same edges between longs."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = orders.select(_long("c", "o_custkey").alias("source"), _long("o", "o_orderkey").alias("target"))
    parts = items.select(_long("o", "l_orderkey").alias("source"), F.explode(F.array(_long("p", "l_partkey"), _long("s", "l_suppkey"))).alias("target"))
    return a.unionByName(parts)


def _tagged(node):
    """A long id as the text that it stands for."""
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.pmod(F.col(node), F.lit(4)) + 1).cast("int"))
    return F.concat(tag, F.lit(":"), F.floor(F.col(node) / 4).cast("string"))


def _symbols(spark, sf_dir, kind, ident=_text):
    return _nodes(spark, sf_dir, ident).where(F.col("kind") == kind).select(F.col("id").alias("symbol"))


def _asked(ask, spark, sf_dir, kind):
    """What a point query tells of all symbols of a kind; ids are longs while they are joined and sorted, and text at the end."""
    told = ask(_long_edges(spark, sf_dir), _nodes(spark, sf_dir, _long), _symbols(spark, sf_dir, kind, _long))
    return told.withColumns({c: _tagged(c) for c in ("symbol", "node_id")})


def graph_callers(spark, sf_dir):
    return _asked(graph.callers, spark, sf_dir, "part")


def graph_callees(spark, sf_dir):
    return _asked(graph.callees, spark, sf_dir, "orders")


def graph_explore(spark, sf_dir):
    return _asked(graph.explore, spark, sf_dir, "supplier")


def graph_search(spark, sf_dir):
    return graph.find_nodes(_nodes(spark, sf_dir), "Ring", "part").select("id", "kind", "name")


def graph_impact(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(_long("s", "s_suppkey").alias("symbol"))
    told = graph.impact(_long_edges(spark, sf_dir), suppliers, 3).groupBy("symbol", "depth").agg(F.count("*").alias("n_nodes"))
    return told.withColumn("symbol", _tagged("symbol"))


def degree_centrality(spark, sf_dir):
    return graph.degrees(_long_edges(spark, sf_dir)).withColumn("node_id", _tagged("node_id"))


def tool_ask_graph(spark, sf_dir):
    """What an agent gets who asks for the callers of one supplier."""
    return tools.ask_graph(_edges(spark, sf_dir), _nodes(spark, sf_dir), "callers", "s:1")


def fake_graph(spark, sf_dir):
    """The stand-in's answers for each supplier, asked in three ways."""
    asked = _symbols(spark, sf_dir, "supplier").select("symbol", F.explode(F.array(F.lit("callers"), F.lit("callees"), F.lit("impact"))).alias("kind"))
    return asked.select("symbol", "kind", graph.canned(F.col("kind"), F.col("symbol"), {k: f"canned:{k}" for k in ("callers", "callees")}).alias("answer"))


def page_rank(spark, sf_dir):
    return graph.page_rank(_long_edges(spark, sf_dir), 3).select(_tagged("node_id").alias("node_id"), F.round("rank", 9).alias("rank"))


QUERIES = {f.__name__: f for f in (graph_callers, graph_callees, graph_explore, graph_search, graph_impact, degree_centrality, page_rank, fake_graph, tool_ask_graph)}

_G = """e AS (SELECT 'c:' || o_custkey AS source, 'o:' || o_orderkey AS target FROM orders UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem UNION ALL SELECT 'o:' || l_orderkey, 's:' || l_suppkey FROM lineitem),
n AS (SELECT 'c:' || c_custkey AS id, 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'o:' || o_orderkey, 'orders', o_orderpriority FROM orders UNION ALL SELECT 'p:' || p_partkey, 'part', p_name FROM part UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier)"""
_PAIRS = "pair AS (SELECT DISTINCT source, target FROM e), links AS (SELECT source, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS share FROM pair), nodes AS (SELECT source AS node_id FROM pair UNION SELECT target FROM pair), c AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT node_id, 1.0::DOUBLE / n AS rank FROM nodes, c)"
_ROUNDS = ", ".join(f"g{k} AS (SELECT target, sum(rank * share) AS got FROM links JOIN r{k - 1} ON node_id = source GROUP BY target), r{k} AS (SELECT node_id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM nodes LEFT JOIN g{k} ON target = node_id, c)" for k in (1, 2, 3))
ORACLES = {
    "tool_ask_graph": "SELECT DISTINCT 's:1' AS symbol, 'o:' || o_orderkey AS node_id, o_orderpriority AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey = 1",
    "fake_graph": "SELECT 's:' || s_suppkey AS symbol, kind, CASE WHEN kind = 'impact' THEN 's:' || s_suppkey ELSE 'canned:' || kind END AS answer FROM supplier, (VALUES ('callers'), ('callees'), ('impact')) k(kind)",
    "graph_callers": f"WITH {_G} SELECT DISTINCT target AS symbol, source AS node_id, m.name FROM e JOIN n s ON s.id = target JOIN n m ON m.id = source WHERE s.kind = 'part'",
    "graph_callees": f"WITH {_G} SELECT DISTINCT source AS symbol, target AS node_id, m.name FROM e JOIN n s ON s.id = source JOIN n m ON m.id = target WHERE s.kind = 'orders'",
    "graph_explore": f"WITH {_G}, s AS (SELECT * FROM n WHERE kind = 'supplier') SELECT id AS symbol, 'self' AS role, id AS node_id, name FROM s UNION SELECT s.id, 'caller', m.id, m.name FROM s JOIN e ON target = s.id JOIN n m ON m.id = source UNION SELECT s.id, 'callee', m.id, m.name FROM s JOIN e ON source = s.id JOIN n m ON m.id = target",
    "graph_search": f"WITH {_G} SELECT id, kind, name FROM n WHERE kind = 'part' AND contains(lower(name), 'ring')",
    "graph_impact": f"WITH RECURSIVE {_G}, walk AS (SELECT id AS symbol, id AS node_id, 0 AS depth FROM n WHERE kind = 'supplier' UNION SELECT symbol, source, depth + 1 FROM walk JOIN e ON target = node_id WHERE depth < 3) SELECT symbol, CAST(d AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS n_nodes FROM (SELECT symbol, node_id, min(depth) AS d FROM walk GROUP BY symbol, node_id) WHERE d > 0 GROUP BY symbol, d",
    "degree_centrality": f"WITH {_G}, x AS (SELECT source AS node_id, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) SELECT node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM x GROUP BY node_id",
    "page_rank": f"WITH {_G}, {_PAIRS}, {_ROUNDS} SELECT node_id, round(rank, 9) AS rank FROM r3",
}

"""The prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns, keyed by a digest of it, with an
edge to the digest of one turn less. Leaves and savings of whole subtrees come
from doubling rounds: every node knows the sum over its descendants fewer than
2**k levels down and the ancestor 2**k levels up; a round adds each node's sum to
that ancestor and replaces the pointer by the ancestor's own. A trie of depth D
takes log2(D) + 1 rounds, each over the nodes deeper than the last one's reach.

No task holds a whole conversation, a whole level or all children of a node.
Turns are sorted over the cluster into ranges, and a turn's place is its row in
the range after those of its conversation in earlier ranges. The digest of a
sequence is the exclusive or of digests of its turns, each salted by its place,
so that running digests come from blocks of turns. The conversations that end at
a node are sorted over the cluster, too, and written as blocks of text, which one
SHA-256 per node takes in order; only these blocks, not the rows, meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Workspace, only

#: Conversations of a family share the first one's opening, of this many turns less one at most.
FAMILY, OPENINGS = 100, 6
#: Turns of a block of running digests, conversations of a block of text, and blocks and bytes of text that are handed on at once.
BLOCK, END_BLOCK, BATCH_ROWS, BATCH_BYTES = 4096, 8192, 4096, 4 << 20
#: The key of the sequence without turns.
ROOT = "0-0-0"


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars, part) of every turn of a conversation, pos from 1 by turn (null first), then role, then text."""
    rows = only(turns, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("salt")
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("salt")]
    ranges = rows.where("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return ranges.select("conv_id", F.monotonically_increasing_id().alias("row"), said.alias("digest"), F.length("text").cast("long").alias("chars"))


def with_places(sorted_turns: DataFrame) -> DataFrame:
    """sorted_turns (a written table) with pos in place of row: a range's rows of a conversation come after those in earlier ranges."""
    part = F.shiftrightunsigned("row", 33)
    runs = sorted_turns.groupBy("conv_id", part.alias("part")).agg(F.min("row").alias("first_row"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "part", "first_row", F.coalesce(earlier, F.lit(0)).alias("before"))
    told = sorted_turns.withColumn("part", part).join(runs, ["conv_id", "part"])
    return told.select("conv_id", (F.col("before") + F.col("row") - F.col("first_row") + 1).alias("pos"), "digest", "chars")


def opening(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS).cast("long")


def rebuilt(turns: DataFrame, w: Workspace) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, chars) of all rebuilt turns, and (conv_id, n_turns) of all rebuilt conversations."""
    placed = w.kept(with_places(w.kept(placed_turns(turns))))
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    base = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base_id"), F.col("n_own").alias("n_base"))
    family = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base_id"), opening(F.col("conv_id")).alias("h"), "n_own")
    lengths = w.kept(family.join(base, "base_id", "left").select("conv_id", "base_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"), F.greatest(F.col("n_own") - F.col("h"), F.lit(0)).alias("left")))
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < OPENINGS)).withColumnRenamed("conv_id", "base_id")
    taken = lengths.where("taken > 0").select("conv_id", "base_id", "taken").join(heads, "base_id").where("pos <= taken").select("conv_id", "pos", "digest", "chars")
    # own turns move up where the first conversation is shorter than what is taken over
    up = lengths.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("up"))
    mine = placed.where(F.col("pos") > opening(F.col("conv_id"))).join(up, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "digest", "chars")
    return taken.unionByName(mine), lengths.select("conv_id", (F.col("taken") + F.col("left")).alias("n_turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with the digest (a, b) of the sequence up to each, and that of the sequence before it (pa, pb)."""
    one = turns.select("conv_id", "pos", "chars", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), F.xxhash64(F.lit(1), "pos", "digest").alias("x"), F.xxhash64(F.lit(2), "pos", "digest").alias("y"))
    per = one.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("conv_id", "block", F.bit_xor("x").over(before).alias("cx"), F.bit_xor("y").over(before).alias("cy")).where("block > 0")
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = one.withColumn("rx", F.bit_xor("x").over(upto)).withColumn("ry", F.bit_xor("y").over(upto)).join(per, ["conv_id", "block"], "left")
    a, b = (F.col(r).bitwiseXOR(F.coalesce(c, F.lit(0))) for r, c in (("rx", "cx"), ("ry", "cy")))
    return run.select("conv_id", "pos", "chars", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"))


def node_key(a: str, b: str, depth: Column) -> Column:
    """A node's key: its digest and its depth."""
    return F.concat(F.hex(a), F.lit("-"), F.hex(b), F.lit("-"), depth.cast("string"))


def trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of rebuilt conversations.

    turns (conv_id, turn, role, text); null roles and texts are empty ones, a null
    turn comes first, rows that share a turn go by role and text, repeated rows are
    turns each. Rows without a conv_id belong to no conversation. c - c % 100 is
    taken as SQL does, towards zero. An empty table has no root. Further columns are
    not read, whatever their names; of a text only its digest and length leave
    the sort, so long ones cost no more than that.

    Two sequences are taken for one node with a chance of 2**-128 for each pair of
    equal depth (no protection against texts made to collide).
    """
    with Workspace() as w:
        seqs, ends = rebuilt(turns, w)
        depth = F.col("pos")
        steps = prefixes(seqs).select("conv_id", depth.alias("depth"), "chars", node_key("a", "b", depth).alias("node"), node_key("pa", "pb", depth - 1).alias("parent"))
        steps = w.kept(steps)
        none = F.lit(0).cast("long")
        rows = steps.unionByName(ends.select("conv_id", none.alias("depth"), none.alias("chars"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent")))
        nodes = w.kept(rows.groupBy("node").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")))
        last = steps.join(ends.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"], "left_semi").select("node", "conv_id")
        last = last.unionByName(ends.where("n_turns = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
        sums = w.kept(end_digests(last))
        told = nodes.join(sums, "node", "left").select("*", (F.col("n_convs") == F.coalesce("n_ends", F.lit(0))).cast("long").alias("leaf"))
        told = w.kept(told.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("n_ends", "chars"))
        w.drop(nodes, sums)
        totals, parents = rolled_up(told, w)
        out = told.drop("leaf", "saved").join(totals, "node").join(parents, "node", "left")
        out = out.select("conv_id", "depth", F.col("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
        return w.hand_out(w.kept(out))


def rolled_up(nodes: DataFrame, w: Workspace) -> tuple[DataFrame, DataFrame]:
    """(node, n_leaves, saved_tokens, n_children) over subtrees, and (node, parent_conv_id), by doubling rounds.

    nodes: node, parent, depth, conv_id, leaf, saved. What a round adds is combined
    before it moves, so a node with very many children costs no more than others;
    the joins have a plain exchange on both sides, which adaptive execution
    splits where very many nodes point to one.
    """
    deepest, root_conv = nodes.agg(F.max("depth"), F.min("conv_id")).first()
    deepest = deepest or 0
    added = nodes.select("node", F.col("leaf").alias("leaves"), "saved", F.lit(0).cast("long").alias("children"))
    now = nodes.where("depth > 0").select("node", "depth", F.col("parent").alias("up"), F.col("leaf").alias("leaves"), "saved")
    reach = 1
    while reach <= deepest:
        got = w.kept(now.groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children")))
        added = added.unionByName(got.withColumn("children", F.col("children") if reach == 1 else F.lit(0).cast("long")))
        if 2 * reach <= deepest:
            far = now.where(F.col("depth") >= 2 * reach)
            sums = far.join(got.select("node", F.col("leaves").alias("more"), F.col("saved").alias("more_saved")), "node", "left")
            sums = sums.select("node", "depth", "up", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
            jumps = now.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            now = w.kept(sums.join(jumps, "up").select("node", "depth", F.col("upper").alias("up"), "leaves", "saved"))
        reach *= 2
    totals = added.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below_root = nodes.where("depth = 1").select("node", F.lit(root_conv).cast("long").alias("parent_conv_id"))
    parents = nodes.where("depth > 1").select("node", "parent").join(above, "parent").select("node", "parent_conv_id").unionByName(below_root)
    return totals, parents


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, n_ends, ends_sha256) of rows (node, conv_id): SHA-256 of the ids in decimal, ascending, joined by commas.

    Rows are sorted over the cluster and become blocks of text there; a node's
    blocks, a few thousandths of its rows, are hashed in order by one task.
    """
    order = [F.col("node"), F.col("conv_id")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, done, size = None, [], [], 0
        for b in batches:
            for key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (key != node or len(held) == END_BLOCK):
                    done.append((node, held[0], len(held), ",".join(map(str, held)).encode()))
                    size += len(done[-1][3])
                    held = []
                    if len(done) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(done, _BLOCKS)
                        done, size = [], 0
                node = key
                held.append(c)
        if held:
            done.append((node, held[0], len(held), ",".join(map(str, held)).encode()))
        yield _batch(done, _BLOCKS)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, h = None, 0, None
        for b in batches:
            done: list[tuple] = []
            for key, k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key != node:
                    if h is not None:
                        done.append((node, n, h.hexdigest()))
                    node, n, h = key, 0, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids)
                n += k
            yield _batch(done, _DIGESTS)
        if h is not None:
            yield _batch([(node, n, h.hexdigest())], _DIGESTS)

    told = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "node string, first long, n long, ids binary")
    return told.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, n_ends long, ends_sha256 string")


_BLOCKS = pa.schema([("node", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_DIGESTS = pa.schema([("node", pa.string()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def oracle() -> str:
    """DuckDB SQL for the rows over conversations, by sequences in full."""
    letters = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))"
    ones = "CAST(4294967295 AS BIGINT)"
    crc = f"xor(list_reduce(list_prepend({ones}, {letters}), lambda s, z: list_reduce(list_prepend(xor(s, z), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), {ones})"
    return f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT conv_id AS c, conv_id - conv_id % {FAMILY} AS base, {crc} % {OPENINGS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c, 0 AS own, pos, role, text FROM x JOIN t ON t.conv_id = base AND pos <= h UNION ALL SELECT c, 1, pos, role, text FROM x JOIN t ON t.conv_id = c AND pos > h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth, sha256(length(role) || ':' || role || text) AS said, length(text) AS chars FROM r),
p AS (SELECT c, depth, chars, string_agg(said, '') OVER (PARTITION BY c ORDER BY depth) AS node FROM o UNION ALL SELECT c, 0, 0, '' FROM x),
q AS (SELECT p.*, depth = max(depth) OVER (PARTITION BY c) AS last FROM p),
n AS (SELECT node, min(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, min(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM q GROUP BY node),
k AS (SELECT left(node, len(node) - 64) AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.node),
u AS (SELECT left(node, 64 * d) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (node) LEFT JOIN m a ON m.depth > 0 AND a.node = left(m.node, len(m.node) - 64)"""

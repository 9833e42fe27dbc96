"""Merkle trees, sketches, variants and observed metrics on small inputs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import merkle, rollups, variants
from lodestrata.sources import events, versions

FILES = "project_id string, path string, content_hash string"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_merkle_delta_equals_a_comparison_of_all_files(spark):
    r = random.Random(4)
    old = [(f"p{k % 3}", f"f{k}", str(r.random())) for k in range(400)] + [("gone", "a", "1"), ("p0", "null", None)]
    new = [(p, f, "x" if r.random() < 0.03 else h) for p, f, h in old if r.random() > 0.03 and p != "gone"] + [("fresh", "b", "2"), ("p1", "new", "3")]
    a, b = files(spark, old), files(spark, new)
    key = lambda d: d.select(F.concat_ws("/", "project_id", "path").alias("path"), "content_hash")
    want = {(x.path, x.change) for x in versions.content_delta(key(a), key(b)).where("change != 'same'").collect()}
    got = merkle.delta(a, b, merkle.tree(a), merkle.tree(b)).collect()
    assert {(f"{x.project_id}/{x.path}", x.change) for x in got} == want and len(got) == len(want) > 20
    assert merkle.delta(a, a, merkle.tree(a), merkle.tree(a)).count() == 0
    leaves = merkle.unequal_leaves(merkle.tree(a), merkle.tree(b))
    assert leaves.count() < merkle.tree(a).where(f"level = {merkle.DEPTH}").count() / 4  # most leaves are never compared


def test_merkle_nodes_are_small_and_roots_tell_states_apart(spark):
    rows = [("p", f"f{k}", "h") for k in range(3000)]
    t = merkle.tree(files(spark, rows), depth=2)
    below = t.where("level > 0").groupBy("level", F.expr("substring(prefix, 1, level - 1)").alias("up")).count()
    assert below.agg(F.max("count")).first()[0] <= merkle.FANOUT and t.where("level = 2").agg(F.sum("n_files")).first()[0] == 3000
    root = lambda x: merkle.roots(merkle.tree(files(spark, x))).first()
    assert root(rows) == root(rows[::-1]) and root(rows).n_files == 3000
    assert len({root(x).root_digest for x in (rows, rows[1:], [*rows[1:], ("p", "f0", "other")], [*rows[1:], ("p", "f0", None)], [*rows[1:], ("p", "f0b", "h")])}) == 5
    assert merkle.tree(files(spark, [])).count() == 0
    with pytest.raises(Exception, match="no path"):
        merkle.tree(files(spark, [("p", None, "h")])).count()


def test_sketches_of_days_merge_to_what_all_rows_give(spark):
    e = spark.range(40_000).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, id % 20) ts", "id % 9000 user_id", "cast(pmod(xxhash64(id), 100000) as double) value", "id % 4 = 0 AS good", "id % 9000 < 3000 AS opted")
    days = rollups.daily(e, F.col("good"), F.col("opted"))
    assert days.count() == 20
    m = rollups.merged(days, F.lit(1)).first()
    assert m.n_events == 40_000 and m.evidence_share == 0.25
    assert abs(m.n_users - 9000) < 270 and abs(m.opt_in_rate - 1 / 3) < 0.02
    spans = rollups.merged(days, F.lit(1))
    for at, q in (("p50", 0.5), ("p95", 0.95)):
        assert abs(rollups.rank_of(e, spans, F.lit(1), "value", at).first()["rank"] - q) < 0.01
    empty = rollups.merged(rollups.daily(e.where("false"), F.col("good"), F.col("opted")), F.lit(1))
    assert empty.count() == 0


def test_variants_of_odd_json(spark):
    rows = [(1, '{"k": 5, "deep": {"a": [1, "x"]}}'), (2, '{"k": "5"}'), (3, "not json"), (4, None), (5, '{"k": 1e3}'), (6, "[]")]
    v = variants.parsed(spark.createDataFrame(rows, "id long, props string"), "props")
    got = {r.id: (r.k, r.x) for r in v.select("id", variants.field("variant", "$.k", "int").alias("k"), variants.field("variant", "$.deep.a[1]", "string").alias("x")).collect()}
    assert got == {1: (5, "x"), 2: (5, None), 3: (None, None), 4: (None, None), 5: (1000, None), 6: (None, None)}
    told = variants.schema_by(v.where("id in (1, 3, 4)").withColumn("g", F.lit(1)), "g").first()
    assert (told.n, told.n_invalid) == (3, 2) and told.schema.startswith("OBJECT<deep: OBJECT<a: ARRAY<") and "k: BIGINT" in told.schema


def test_emit_runs_its_input_once_and_streams_report(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = spark.range(100).selectExpr("'x' name", "id").mapInArrow(count, "name string, id long")
    assert events.emit(rows, str(tmp_path / "sink"), enabled=True) == 100 == ran.value
    assert events.observed(spark.range(0), {"n": F.count(F.lit(1)), "m": F.max("id")}, lambda d: d.write.json(str(tmp_path / "none"))) == {"n": 0, "m": None}
    listener = events.StreamMetrics()
    spark.streams.addListener(listener)
    try:
        spark.range(30).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert [(n, m) for n, _, m in listener.rows if m["n"]] == [("seen", {"n": 30, "total": 435})]

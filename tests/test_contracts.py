"""Schemas, alphabets, validators and redaction."""

import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import hashing, redaction, validators
from lodestrata.operators import metrics
from lodestrata.plans.redaction import SAMPLES, harness
from lodestrata.sources import samples

FIELDS = {
    "chunk": 19, "anchor": 11, "evidence": 4, "provenance": 10, "manifest": 12, "registry_entry": 7, "store_stamp": 5, "policy": 7,
    "graph_nodes": 21, "graph_edges": 8, "graph_files": 8, "unresolved_refs": 9, "episode_card": 17, "event": 2, "obs_event": 2,
}


@pytest.mark.parametrize("name", sorted(FIELDS))
def test_schema_snapshot(name):
    schema = schemas.TABLES[name]()
    assert len(schema) == FIELDS[name] and len(set(schema.names)) == FIELDS[name]


def test_alphabets():
    assert schemas.ANCHOR_STATES == ("live", "stale", "moved", "unknown", "orphaned")
    assert schemas.GRAPH_KINDS == ("explore", "node", "callers", "callees", "search")
    assert {a for e in schemas.TRANSITIONS["anchor"] for a in e} == set(schemas.ANCHOR_STATES)


def test_the_stamp_carries_no_commit():
    assert not any("sha" in f or "commit" in f for f in schemas.store_stamp().names)


def test_closed_schema_refuses_other_fields(spark):
    good = spark.createDataFrame([], schemas.store_stamp())
    validators.check_closed(good, schemas.store_stamp())
    for bad in (good.drop("dimension"), good.withColumn("extra", F.lit(1)), good.withColumn("dimension", F.lit("64"))):
        with pytest.raises(ValueError):
            validators.check_closed(bad, schemas.store_stamp())


def test_parse_closed_splits_by_reason(spark):
    schema = schemas._schema("a string, n int", "note string")
    rows = [(1, '{"a": "x", "n": 1}'), (2, '{"a": "x", "n": 1, "z": 2}'), (3, '{"a": "x"}'), (4, '{"a": "x", "n": "one"}'), (5, "[1]"), (6, '{"a": "x", "n": 1, "note": null}'), (7, "not json")]
    got = {r.id: r.reason for r in validators.parse_closed(spark.createDataFrame(rows, "id int, raw string"), "raw", schema).collect()}
    assert got[1] is None and got[6] is None
    assert got[2] == "z:unknown" and got[3] == "n:missing" and got[4] == "n:type"
    assert got[5] is not None and got[7] is not None


def test_split_valid(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, " "), (3, "a\u202eb")], "id int, name string")
    good, bad = validators.split_valid(rows, {"name": validators.identity_problem(F.col("name"))})
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reason for r in bad.collect()} == {2: "name:empty", 3: "name:control_character"}


@pytest.mark.parametrize(("path", "ok"), [("a/b.md", True), ("a.md\n", False), ("a/../b", False), ("..", False), ("a/..b", True), ("/a", False), ("", False), ("a\u2044b", False), ("a%2e%2e", False), ("C:x", False)])
def test_path_bypasses(spark, path, ok):
    assert (spark.createDataFrame([(path,)], "p string").select(validators.path_problem(F.col("p"))).first()[0] is None) == ok


def test_hash_embedding_and_pair_score(spark):
    import hashlib

    row = spark.range(1).select(hashing.hash_embedding(F.lit("abc"), 40).alias("v"), hashing.pair_score(F.lit("q"), F.lit("d")).alias("s")).first()
    digest = hashlib.sha256(b"abc").digest()
    assert row.v == pytest.approx([digest[i % 32] / 255 for i in range(40)])
    assert row.s == pytest.approx(int(hashlib.sha256(b"q\0d").hexdigest()[:8], 16) / 0xFFFFFFFF)
    with pytest.raises(ValueError):
        hashing.hash_embedding(F.lit("x"), 0)


def test_sample_counts():
    rows = samples.secret_samples()
    assert rows == samples.secret_samples()
    catchable = [r for r in rows if r[1] and r[3] is None]
    assert len(catchable) == 125 and sum(1 for r in rows if r[1] and r[3]) == 8 and sum(1 for r in rows if not r[1]) == 26
    by = {c: sum(1 for r in catchable if r[2] == c) for c in schemas.SECRET_CLASSES}
    assert by == {"prefix_token": 51, "high_entropy_kv": 43, "json_sensitive_value": 26, "env_dump": 5}


def test_baseline_and_engine_recall(spark):
    for r in metrics.redaction_report(harness(SAMPLES.frame(spark), redaction.redact_baseline)).collect():
        assert (r.caught, r.catchable, r.residual_escaped, r.residual, r.false_positives, r.gate_pass) == (97, 125, 5, 8, 0, False)
    for r in metrics.redaction_report(harness(SAMPLES.frame(spark), redaction.redact_engine)).collect():
        assert r.recall >= 0.95 and r.fp_rate == 0 and r.gate_pass


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_engine_on_other_samples(spark, seed):
    rows = spark.createDataFrame(samples.secret_samples(seed), samples.SAMPLE_SCHEMA).withColumn("after", redaction.redact_engine(F.col("context")))
    missed = rows.where(F.col("is_secret") & F.col("residual").isNull() & redaction.leaked(F.col("plaintext"), F.col("after")))
    wrong = rows.where(~F.col("is_secret") & redaction.false_positive(F.col("plaintext"), F.col("context"), F.col("after")))
    assert missed.count() <= 3 and wrong.count() == 0


def test_engine_leaves_words_and_hashes(spark):
    said = ["a task-force meets", "ingestedFromSha=" + "ab12" * 10, "id 550e8400-e29b-41d4-a716-446655440000", 'token = "' + "0f" * 20 + '"']
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(redaction.redact_engine(F.col("t"))).collect()
    assert [r[0] for r in rows] == said


def test_entropy_and_quarantine(spark):
    row = spark.range(1).select(redaction.entropy(F.lit("aabb")), redaction.entropy(F.lit("")), redaction.quarantine(F.lit("blob: q7Zr0LpX2mVt9KcY4sWd8")), redaction.quarantine(F.lit("plain words only"))).first()
    assert row[0] == pytest.approx(1.0) and row[1] == 0 and row[2] and not row[3]


def test_fixture_sql_is_the_frame(spark):
    import duckdb

    rows = duckdb.connect().execute(f"select * from {SAMPLES.sql()} order by sample_id").fetchall()
    assert rows == [tuple(r) for r in SAMPLES.frame(spark).orderBy("sample_id").collect()]

"""The versioned store, generations, sources, migrations, and streams against their batch twins."""

import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import chunking, federation, graph, lint, providers, retrieval, scope, tools
from lodestrata.plans import migrations
from lodestrata.session import build_session
from lodestrata.sources import discovery, events, samples
from lodestrata.sources.versions import Generations, VersionedTable
from lodestrata.streaming import sync

ROW = "chunk_id string, source_path string, content_hash string, text string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROW)


def test_versions_upsert_read_optimize_and_collect(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "chunk_id")
    t.upsert(rows(spark, ("a", "f", "1", "x"), ("b", "f", "1", "y")))
    t.upsert(rows(spark, ("b", "f", "2", "z"), ("c", "g", "1", "w")), sha_tag="abc")
    assert {r.chunk_id: r.text for r in t.read().collect()} == {"a": "x", "b": "z", "c": "w"}
    assert t.read(vid=1).count() == 2 and t.index_stats() == {"num_unindexed_rows": 4, "num_indexed_rows": 0}
    t.replace_source("source_path", "f", rows(spark, ("a", "f", "3", "new")))
    assert {r.chunk_id: r.text for r in t.read().collect()} == {"a": "new", "c": "w"}
    assert t.read(with_tombstones=True).count() == 3
    t.optimize()
    assert t.index_stats() == {"num_unindexed_rows": 0, "num_indexed_rows": 2}
    with pytest.raises(ValueError):
        t.cleanup_old_versions(-1)
    assert t.cleanup_old_versions(1) == 2
    assert [v.sha_tag for v in t.versions()] == ["abc", None]
    assert {r.chunk_id: r.text for r in t.read(sha_tag="abc").collect()} == {"a": "x", "b": "z", "c": "w"}
    t.restore("abc")
    assert t.read().count() == 3
    assert t.cleanup_old_versions(0) == 2 and t.read().count() == 3


def test_a_version_is_written_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "chunk_id")
    t.upsert(rows(spark, ("a", "f", "1", "x")))
    other = VersionedTable(spark, str(tmp_path / "t"), "chunk_id")
    other._next = lambda: 1  # as a second writer counts who began before the first one committed
    with pytest.raises(Exception, match="exist"):
        other.upsert(rows(spark, ("a", "f", "1", "y")))
    assert t.read().first().text == "x"


def test_a_crash_at_any_place_leaves_the_last_version_and_the_next_write_goes_on(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), "chunk_id")
    t.upsert(rows(spark, ("a", "f", "1", "x")))
    whole = t.store.put

    def dies(name, text):
        if cut is not None:
            whole(name, text[:cut])
        raise OSError("lost")

    for cut in (None, 0, 7):  # before the manifest, while it is written, after a part of it
        monkeypatch.setattr(t.store, "put", dies)
        with pytest.raises(OSError):
            t.upsert(rows(spark, ("a", "f", "1", "lost")))
        monkeypatch.setattr(t.store, "put", whole)
        assert t.read().first().text == "x" and len(t.versions()) == 1
    t.upsert(rows(spark, ("a", "f", "1", "y")))
    assert t.read().first().text == "y" and t.current().vid > 1


def test_numbers_are_not_given_out_again_after_a_cleanup(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "chunk_id")
    for k in range(3):
        t.upsert(rows(spark, (f"k{k}", "f", "1", "x")))
    assert t.cleanup_old_versions(0) == 3 and t.current() is None
    assert t.upsert(rows(spark, ("a", "f", "1", "x"))).vid == 4 and t.cleanup_old_versions(1) == 0
    assert t.upsert(rows(spark, ("b", "f", "1", "x"))).vid == 5


def test_a_batch_with_a_key_twice_is_refused(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "chunk_id", partition_by=("source_path",))
    t.upsert(rows(spark, ("a", "f", "1", "x"), ("b", "g", "1", "x")))
    with pytest.raises(ValueError, match="more than one row"):
        t.upsert(rows(spark, ("c", "f", "1", "x"), ("c", "g", "1", "y")))
    assert {r.chunk_id for r in t.read().collect()} == {"a", "b"} and len(t.versions()) == 1
    assert sorted(p.name for p in (tmp_path / "t" / t.current().folders[0]).iterdir() if p.is_dir()) == ["source_path=f", "source_path=g"]
    t.upsert(rows(spark, ("a", "g", "2", "z")))
    assert {(r.chunk_id, r.source_path) for r in t.read().collect()} == {("a", "g"), ("b", "g")}


def test_a_crash_before_the_pointer_leaves_the_old_generation(spark, tmp_path, monkeypatch):
    g = Generations(spark, str(tmp_path / "g"))
    g.build(rows(spark, ("a", "f", "1", "x")), lambda d: True)
    whole = g.store.put

    def dies(name, text):
        if cut is not None:
            whole(name, text[:cut])
        raise OSError("lost")

    for cut in (None, 0, 5):
        monkeypatch.setattr(g.store, "put", dies)
        with pytest.raises(OSError):
            g.build(rows(spark, ("b", "f", "1", "y")), lambda d: True)
        monkeypatch.setattr(g.store, "put", whole)
        assert g.active() == 1 and g.read().first().chunk_id == "a"
    n = g.build(rows(spark, ("b", "f", "1", "y")), lambda d: True)
    assert g.active() == n > 1 and g.read().first().chunk_id == "b"


def test_weights_and_stamps_that_are_not_one_are_refused(spark):
    from lodestrata.operators import grounding

    items = spark.createDataFrame([(1, 0.5, 1.0, 1.0)], "item_id long, authority double, recency double, agreement double")
    weights = [(f"other{k}", 1.0) for k in range(40)] + [("authority", 5.0)]
    assert grounding.drift_rank(items, spark.createDataFrame(weights, "feature string, weight double"), "item_id").first().score == 0.03125
    with pytest.raises(ValueError, match="authority"):
        grounding.drift_rank(items, spark.createDataFrame([*weights, ("authority", 1.0)], "feature string, weight double"), "item_id")
    stamp = "embedding_model string, dimension int, schema_version int"
    own = spark.createDataFrame([("p", "m", 4, 1)], "project_id string, " + stamp)
    gate = lambda *rows: [r.reason for r in federation.stamp_gate(own, spark.createDataFrame(list(rows), stamp)).collect()]
    assert gate(("m", 4, 1), ("m", 4, 1)) == [None] and gate() == ["schema_version_mismatch"]
    with pytest.raises(ValueError, match="more than one"):
        gate(("m", 4, 1), ("m", 4, 2))


def test_holding_of_short_repeated_and_empty_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 100)  # several blocks
    docs = spark.createDataFrame([(1, "alphabet alpha beta"), (2, "beta"), (3, None), (4, ""), (4, "漢字 beta")], "doc_id long, text string")
    asked = [(10, "alpha beta"), (11, "a"), (12, ""), (13, None), (14, "beta"), (15, "beta"), (16, "字 b")]
    got = retrieval.holding(docs, spark.createDataFrame(asked, "query_id long, query string"))
    want = [(i, d) for i, q in asked for d, t in [(1, "alphabet alpha beta"), (2, "beta"), (4, ""), (4, "漢字 beta")] if q is not None and q in t]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_a_deleted_file_is_orphaned(spark):
    from lodestrata.operators import grounding

    anchors = spark.createDataFrame([("a", "gone.py", 1, 2, "h"), ("b", "locked.py", 1, 2, "h")], "anchor_id string, target_path string, line_start int, line_end int, stored_hash string")
    spans = spark.createDataFrame([], "path string, line_start int, line_end int, span_hash string")
    files = spark.createDataFrame([("locked.py", False)], "path string, readable boolean")
    assert {r.anchor_id: r.state for r in grounding.revalidate(anchors, spans, files).collect()} == {"a": "orphaned", "b": "unknown"}


def test_generations_swap_only_if_valid(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "g"))
    assert g.build(rows(spark, ("a", "f", "1", "x")), lambda d: d.count() == 1) == 1
    with pytest.raises(ValueError):
        g.build(rows(spark, ("b", "f", "1", "y")), lambda d: False)
    assert g.active() == 1 and g.read().first().chunk_id == "a"
    assert g.build(rows(spark, ("b", "f", "1", "y")), lambda d: True) == 2 and g.read().first().chunk_id == "b"
    with pytest.raises(OSError):
        g.build(rows(spark, ("c", "f", "1", "z")), lambda d: True, room_bytes=1 << 62)


def test_discover_and_classify(spark, tmp_path):
    for p in ("README.md", "docs/a.md", "docs/private/b.md", "src/x.py", "vendor/README.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("# hello")
    found = discovery.discover(spark, str(tmp_path), ["docs/private/"])
    got = {r.path.split("/")[-2] + "/" + r.path.split("/")[-1]: r.ownership for r in discovery.classify(found).collect()}
    assert set(got) == {f"{tmp_path.name}/README.md", "docs/a.md", "vendor/README.md"}


def test_ignore_rules_with_negation_and_nested_files(spark):
    lines = [("", 1, "*.log"), ("", 2, "/build"), ("", 3, "docs/**/draft?.md"), ("", 4, "# no rule"), ("", 5, "!keep.log"), ("", 6, "tmp/"), ("", 7, "a+b[1].md "), ("sub", 1, "!x.log"), ("sub/deep", 1, "*.log"), ("sub", 2, "/only.md")]
    rules = discovery.ignore_patterns(spark.createDataFrame(lines, "dir string, line_no int, line string"))
    gone = ["x.log", "a/x.log", "build", "build/x.md", "docs/draft1.md", "docs/a/b/draft2.md", "tmp/x", "a/tmp/x", "a+b[1].md", "sub/deep/x.log", "sub/only.md", "sub/y.log"]
    stay = ["keep.log", "a/keep.log", "a/build", "docs/draft12.md", "other/docs/draft1.md", "tmp", "xlog", "aab1.md", "sub/x.log", "sub/a/x.log", "sub/a/only.md", "only.md"]
    files = spark.createDataFrame([(p,) for p in gone + stay], "path string")
    assert sorted(r.path for r in discovery.without_ignored_by(files, rules).collect()) == sorted(stay)
    assert discovery.without_ignored_by(files, rules.limit(0)).count() == len(gone + stay)


def test_lookup_looks_at_the_keys_only(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "chunk_id")
    t.upsert(rows(spark, *[(f"k{k}", "f", "1", "x") for k in range(50)]))
    t.upsert(rows(spark, ("k1", "f", "2", "y"), ("new", "g", "1", "z")))
    t.replace_source("source_path", "g", rows(spark))
    got = t.lookup(spark.createDataFrame([("k1",), ("k2",), ("new",), ("none",), ("k1",)], "chunk_id string"))
    assert {(r.chunk_id, r.text) for r in got.collect()} == {("k1", "y"), ("k2", "x")} and got.count() == 2


def test_tools_refuse_without_a_job(spark):
    files = spark.createDataFrame([("p", "a.md", "token ghp_" + "a" * 36)], "project_id string, path string, text string")
    ran = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = ran()
    for path, project in (("../a", "p"), ("", "p"), ("a.md", " "), ("a.md", None)):
        with pytest.raises(ValueError):
            tools.get_file(files, path, project)
    assert ran() == before
    assert tools.get_file(files, "a.md", "other").count() == 0 and "ghp_" not in tools.get_file(files, "a.md", "p").first().text


def test_trust_metrics_with_nothing_to_count(spark):
    from lodestrata.operators import grounding

    checked = spark.createDataFrame([], "answer_id long, path string, state string, status string")
    gold, claims = spark.createDataFrame([], "answer_id long, path string"), spark.createDataFrame([], "answer_id long, pos long, supported boolean, flagged boolean")
    assert tuple(grounding.trust_metrics(checked, gold, claims).first()) == (1.0, 1.0, 1.0, 0, 0, 0.0)


def test_code_graph_source(spark, tmp_path):
    path = str(tmp_path / "g.db")
    con = sqlite3.connect(path)
    con.executescript("create table schema_versions(version int); insert into schema_versions values (4), (5); create table edges(id integer primary key, source text, target text, kind text);")
    con.executemany("insert into edges values (?, ?, ?, 'calls')", [(k, f"n{k}", f"n{k + 1}") for k in range(1, 101)])
    con.commit()
    spark.dataSource.register(discovery.CodeGraphSource)
    read = lambda: spark.read.format("codegraph").option("path", path).option("table", "edges").load()
    assert read().count() == 100 and read().agg(F.sum("id")).first()[0] == 5050
    con.execute("delete from schema_versions where version = 5")
    con.commit()
    with pytest.raises(Exception, match="graph schema 4"):
        read().count()
    with pytest.raises(ValueError):
        graph.require_schema(spark.createDataFrame([(4,)], "version int"))


def test_impact_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "source string, target string")
    got = {(r.node_id, r.depth) for r in graph.impact(edges, spark.createDataFrame([("a",)], "symbol string"), 10).collect()}
    assert got == {("c", 1), ("d", 1), ("b", 2)}
    with pytest.raises(ValueError):
        graph.impact(edges, edges.selectExpr("source symbol"), 0)


def test_migrations():
    steps = {1: lambda d: d + ["a"], 2: lambda d: d + ["b"]}
    assert migrations.path_of(1, 3, steps) == [1, 2] and migrations.path_of(3, 3, {}) == []
    with pytest.raises(migrations.DowngradeRefused):
        migrations.path_of(4, 3, steps)
    with pytest.raises(migrations.MissingMigration):
        migrations.path_of(1, 4, steps)


def test_migrate_a_table(spark):
    df = migrations.migrate(spark.range(2), 1, 3, {1: lambda d: d.withColumn("x", F.lit(1)), 2: lambda d: d.withColumnRenamed("x", "y")})
    assert df.columns == ["id", "y"]


def test_poll_drains_once(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    args = (str(feed), "event_id string, seq long", str(tmp_path / "cp"), str(tmp_path / "sink"))
    (feed / "1.json").write_text('{"event_id": "a", "seq": 1}\n')
    assert [r.event_id for r in events.poll(spark, *args).collect()] == ["a"]
    assert events.poll(spark, *args).count() == 0
    (feed / "2.json").write_text('{"event_id": "b", "seq": 2}\n{"event_id": "c", "seq": 3}\n')
    assert sorted(r.event_id for r in events.poll(spark, *args).collect()) == ["b", "c"]


def test_observability_is_off_by_default(spark, tmp_path):
    rows = spark.createDataFrame([("indexed", [("k", "v")])], "name string, attributes array<struct<k:string,v:string>>")
    assert events.emit(rows, str(tmp_path / "obs")) == 0 and not (tmp_path / "obs").exists()
    assert events.emit(rows, str(tmp_path / "obs"), enabled=True) == 1


def stream_of(spark, tmp_path, df):
    path = str(tmp_path / f"in{time.time_ns()}")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_debounce_is_the_same_on_a_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    last = spark.createDataFrame([(-1, "2030-01-01 00:00:00")], "path long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {tuple(r) for r in sync.debounce(e, "6 hours").collect()}
    got = {tuple(r) for r in drain(sync.debounce(stream_of(spark, tmp_path, e.unionByName(last)), "6 hours"), "debounced").collect() if r.path != -1}
    assert got == want


def test_dedup_and_windows_on_a_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert drain(sync.dedup(stream_of(spark, tmp_path, e.unionByName(e))), "once").count() == e.count()
    want = {tuple(r) for r in sync.windowed_counts(e, "1 day").collect()}
    assert {tuple(r) for r in drain(sync.windowed_counts(stream_of(spark, tmp_path, e), "1 day"), "daily", "complete").collect()} == want
    assert sync.windowed_counts(e, "2 days", "1 day").agg(F.sum("n")).first()[0] == 2 * e.count()


def test_machine_refuses_undefined_steps(spark, tmp_path):
    changes = spark.createDataFrame([(1, 1, "building"), (1, 2, "active"), (1, 3, "reembedding"), (2, 1, "active"), (2, 2, "retired")], "entity_id long, seq long, state string")
    got = {(r.entity_id, r.seq): r.accepted for r in drain(sync.apply_machine(stream_of(spark, tmp_path, changes), "generation"), "machine").collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): True, (2, 2): True}


def test_sync_is_idempotent(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "chunk_id")
    df = spark.createDataFrame([("a", "f", "1", "x", 1), ("a", "f", "2", "y", 2), ("b", "f", "1", "z", 1)], ROW + ", seq long")
    for k in range(2):
        sync.sync_table(stream_of(spark, tmp_path, df), t, str(tmp_path / f"cp{k}")).awaitTermination()
    assert len(t.versions()) == 1 and {r.chunk_id: r.text for r in t.read().collect()} == {"a": "y", "b": "z"}


def test_corpus_is_a_function_of_its_seed(spark):
    a, b = samples.corpus(spark, 3, 10, 128, 512), samples.corpus(spark, 3, 10, 128, 512).repartition(7)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert a.where("length(text) not between 128 and 512").count() == 0 and a.first().chunk_id == "repo_000:chunk_00000"
    assert a.select("text").distinct().count() == 30


def test_python_scopes_and_tripwire(spark):
    src = "class A:\n    def f(self):\n        open('x')\n\ndef g():\n    pass\n"
    files = spark.createDataFrame([("a.py", src), ("bad.py", "def (\n" * 90), ("core/fs.py", src)], "path string, source string")
    got = {(r.path, r.name, r.start_line, r.end_line) for r in chunking.python_scopes(files).collect()}
    assert {("a.py", "A", 1, 3), ("a.py", "A.f", 2, 3), ("a.py", "g", 5, 6), ("bad.py", None, 1, 40)} <= got
    assert {(r.path, r.line, r.call) for r in lint.mutation_tripwire(files, ["core/fs.py"]).collect()} == {("a.py", 3, "open"), ("bad.py", 0, "unparsed")}


@pytest.mark.parametrize(("span", "want"), [("10", (10, 10)), ("10-20", (10, 20)), ("10:5-12:8", (10, 12)), ("x", None), ("10-", None), ("", None)])
def test_spans(spark, span, want):
    got = spark.createDataFrame([(span,)], "s string").select(chunking.parse_span(F.col("s"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_phrase_search_of_repeated_words(spark):
    docs = spark.createDataFrame([(1, "a a b a b"), (2, "a b"), (3, "b a")], "doc_id int, text string")
    assert {r.doc_id: r.hits for r in retrieval.phrase_search(docs, "a b").collect()} == {1: 2, 2: 1}
    assert {r.doc_id: r.hits for r in retrieval.phrase_search(docs, "a a b").collect()} == {1: 1}


def test_names_are_never_picked_from_several(spark):
    refs = spark.createDataFrame([(1, "x", None), (2, "b.x", None)], "ref_id long, reference_name string, candidates string")
    nodes = spark.createDataFrame([("n1", "a.x", True), ("n2", "b.x", True)], "node_id string, qualified_name string, is_exported boolean")
    assert {r.ref_id: (r.status, r.resolved) for r in federation.resolve_names(refs, nodes).collect()} == {1: ("AMBIGUOUS", None), 2: ("RESOLVED", "b.x")}


def test_dense_gives_the_same_rows_for_any_block_of_queries(spark, monkeypatch):
    rows = [(k, [float((k * 7 + j * j) % 11 - 5) for j in range(4)]) for k in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.selectExpr("vec_id query_id", "embedding query_vector")
    best = lambda: sorted(retrieval.ranked(retrieval.dense(v, asked, 5), "vec_id", 5).collect(), key=str)
    want = best()
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 7 * 32)
    assert best() == want and {r.query_id for r in want} == set(range(60)) | {61, 62}

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else None

    for q, u in rows[:60:9]:
        told = sorted(((-c, k) for k, w in rows if w and len(w) == 4 and (c := cosine(u, w)) is not None))[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in want if r.query_id == q), key=lambda r: r["rank"])] == [(k, pytest.approx(-c)) for c, k in told]


def test_ranks_of_a_whole_table(spark):
    from lodestrata.durable import whole_rank

    rows = [(k * 37 % 101 // 3, k) for k in range(101)]
    got = whole_rank(spark.createDataFrame(rows, "a int, b int").repartition(5), [F.desc("a"), F.col("b")], "n").collect()
    assert {(r.a, r.b): r.n for r in got} == {x: n + 1 for n, x in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))}


def test_session_is_in_utc():
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"


def test_tools_check_their_requests(spark):
    chunks = spark.createDataFrame([("c1", "p1", "alpha beta"), ("c2", "p2", 'beta password: "' + "x" * 30 + '"')], "chunk_id string, project_id string, text string")
    policies = spark.createDataFrame([("p1", True), ("p2", True)], "project_id string, federation_visible boolean")
    assert [r.chunk_id for r in tools.search(chunks, policies, " alpha ", 5, "portfolio").collect()] == ["c1"]
    assert "x" * 30 not in tools.search(chunks, policies, "password", 5, "portfolio").first().text
    for bad in ({"query": " "}, {"query": "a", "top_k": 0}, {"query": "a", "top_k": 101}, {"query": "a", "within": "galaxy"}, {"query": "a", "within": "project"}):
        with pytest.raises(ValueError):
            tools.search(chunks, policies, **bad)
    files = spark.createDataFrame([("a/b.md", "text")], "path string, text string")
    assert tools.get_file(files, "a/b.md").count() == 1
    for bad in ("../b", "/a", ""):
        with pytest.raises(ValueError):
            tools.get_file(files, bad)
    edges = spark.createDataFrame([("x", "y")], "source string, target string")
    nodes = spark.createDataFrame([("x", "f", "fx"), ("y", "f", "fy")], "id string, kind string, name string")
    assert tools.ask_graph(edges, nodes, "callers", "y").first().node_id == "x" and tools.ask_graph(edges, nodes, "search", "FY").count() == 1
    assert tools.ask_graph(edges, nodes, "explore", "x").count() == 2 and tools.ask_graph(edges, nodes, "node", "x").count() == 1
    with pytest.raises(ValueError):
        tools.ask_graph(edges, nodes, "impact", "y")


def test_providers_are_checked(spark):
    class Short(providers.HashProvider):
        def embed(self, texts):
            return [[0.0] for _ in texts]

    class Nan:
        def score(self, query, docs):
            return [float("nan") for _ in docs]

    class Length:
        def score(self, query, docs):
            return [float(len(d)) for d in docs]

    docs = spark.createDataFrame([("a", "x y")], "chunk_id string, text string")
    with pytest.raises(Exception, match="another length"):
        providers.embed(docs, Short(4)).collect()
    pairs = spark.createDataFrame([(1, 0, "q", "dd"), (1, 1, "q", "ddd"), (2, 0, "r", "d")], "query_id int, pos int, query string, doc string")
    assert {tuple(r) for r in providers.rerank_with(pairs, Length()).collect()} == {(1, 0, 2.0), (1, 1, 3.0), (2, 0, 1.0)}
    with pytest.raises(Exception, match="not finite"):
        providers.rerank_with(pairs, Nan()).collect()


def test_registers_and_live_citations(spark):
    rows = spark.createDataFrame([(1, "plain", "live"), (2, "deep", None)], "id int, register string, state string")
    assert [r.id for r in scope.in_register(rows, "deep").collect()] == [2]
    assert {r.id: r.served_as_cited for r in scope.live_only_cited(rows, F.col("state")).collect()} == {1: True, 2: False}
    with pytest.raises(ValueError):
        scope.in_register(rows, "other")


def test_transcripts_team_events_and_streamed_answers(spark, tmp_path):
    from lodestrata.operators import tools

    lines = tmp_path / "log.jsonl"
    lines.write_text('{"session_id": "a", "seq": 1, "kind": "edit", "path": "x.py", "old_text": "ab", "new_text": "abc"}\nnot json\n{"session_id": "a", "seq": 2, "kind": "say", "text": "hi"}\n{"session_id": "a", "seq": 3, "kind": "edit", "path": "x.py", "new_text": "d"}\n')
    told = events.transcripts(spark, str(lines))
    assert told.count() == 3
    assert [tuple(r) for r in events.transcript_deltas(told).collect()] == [("a", "x.py", 2, 4, 2, 1, 3)]
    team = [("2026-01-01T00:00:00Z", "TaskCompleted", "s1", "lee", "t1", "a task"), ("2026-01-01T00:00:05Z", "TeammateIdle", "s1", "lee", "t1", None), ("2026-01-01T00:00:06Z", "TeammateIdle", "s2", "kim", None, None)]
    events.append_team_events(spark.createDataFrame(team, events.TEAM_EVENT), str(tmp_path / "team"))
    events.append_team_events(spark.createDataFrame([("2026-01-01T00:00:09Z", "TaskCompleted", "s2")], "ts string, event string, session string"), str(tmp_path / "team"))
    log = events.team_events(spark, str(tmp_path / "team"))
    assert log.count() == 4 and [tuple(r) for r in lint.idle_without_completion(log).collect()] == [("2026-01-01T00:00:05Z", "s1", "t1")]
    got = tools.stream_items(spark.range(50).repartition(7), "id")
    assert next(got).id == 0 and [r.id for r in got] == list(range(1, 50))

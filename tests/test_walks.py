"""Span relocation, nearest commits and reachability against plain Python, with the odd and the busy cases they define."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.catalogue import QUERIES
from lodestrata.operators import graph, relocation, sessions


def plain_state(old, new, unreadable, path, s, e):
    text = [x if x.strip() else "" for x in (old.get(path) or "").split("\n")] if old.get(path) is not None else []
    if s < 1 or e < s or e > len(text):
        return "unknown", None, None
    span, m = text[s - 1 : e], e - s + 1
    now = {p: [x if x.strip() else "" for x in t.split("\n")] for p, t in new.items() if t is not None and p not in unreadable}
    spots = lambda run: [(p, k + 1) for p in sorted(now) for k in range(len(now[p]) - len(run) + 1) if now[p][k : k + len(run)] == run]
    whole = spots(span)
    if (path, s) in whole:
        return "live", path, s
    if whole:
        return ("moved", *min([x for x in whole if x[0] == path] or whole))
    if path in unreadable:
        return "unknown", None, None
    half = -(-m // 2)
    runs = [span[k : k + half] for k in range(m - half + 1)]
    part = [line for r in runs if any(r) for p, line in spots(r) if p == path]
    return ("stale", path, min(part)) if part else ("orphaned", None, None)


def test_relocation_equals_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(relocation, "WANTED_BYTES", 4000)  # several blocks of fingerprints
    monkeypatch.setattr(relocation, "LINES", 40)
    r = random.Random(8)
    line = lambda: r.choice(["", " ", "}", "return x", "é漢", *[f"line {k}" for k in range(40)]])
    old = {f"f{k}": "\n".join(line() for _ in range(r.randint(1, 40))) for k in range(25)} | {"empty": "", "null": None}
    new = {}
    for p, t in old.items():
        rows = (t or "").split("\n")
        if r.random() < 0.5:
            k = r.randint(0, len(rows))
            rows[k:k] = [line() for _ in range(r.randint(0, 3))]
        if r.random() < 0.5:
            rows = [x for x in rows if r.random() > 0.1]
        new[p] = "\n".join(rows)
    del new["f3"], new["f4"]
    new["later"] = old["f3"]
    unreadable = {"f5", "f6"}
    anchors = [(f"{p}:{s}:{n}", p, s, s + n - 1) for p in [*old, "absent"] for s in (0, 1, 2, 5, 9) for n in (1, 2, 3, 4, 7, 12)] + [("bad", "f1", 4, 2)]
    stored = relocation.fingerprinted(spark.createDataFrame(anchors, "anchor_id string, path string, line_start int, line_end int"), spark.createDataFrame(list(old.items()), "path string, text string"))
    files = spark.createDataFrame([(p, t, p not in unreadable) for p, t in new.items()], "path string, text string, readable boolean")
    got = {x.anchor_id: (x.state, x.new_path, x.new_line) for x in relocation.relocate(stored, files).collect()}
    want = {i: plain_state(old, new, unreadable, p, s, e) for i, p, s, e in anchors}
    assert got == want and {s for s, _, _ in want.values()} == {"live", "moved", "stale", "orphaned", "unknown"}


def test_relocation_without_files_or_anchors(spark):
    files = spark.createDataFrame([("a", "x\ny")], "path string, text string")
    stored = relocation.fingerprinted(spark.createDataFrame([("k", "a", 1, 2)], "anchor_id string, path string, line_start int, line_end int"), files)
    assert [r.state for r in relocation.relocate(stored, files.limit(0)).collect()] == ["orphaned"]
    assert relocation.relocate(stored.limit(0), files).count() == 0


def test_run_hashes_tell_runs_apart():
    lines = np.random.Generator(np.random.PCG64(1)).integers(0, 3, 500).astype(np.uint64)
    for size, told in relocation.run_hashes(lines, [1, 2, 3, 4, 5, 8, 13, 100, 499, 500, 501]):
        runs = [tuple(lines[k : k + size].tolist()) for k in range(len(lines) - size + 1)]
        assert len(told) == len(runs) and len(set(zip(told.tolist(), runs, strict=True))) == len(set(runs)) == len(set(told.tolist()))


def nearest(edits, commits, width):
    out = []
    for i, p, t in edits:
        best = min(((abs(t - u), u, c) for c, q, u in commits if q == p and abs(t - u) <= width), default=None)
        out.append((i, best[2] if best else None, round(1 - best[0] / width, 6) if best else None))
    return Counter(out)


def test_nearest_commit_equals_all_pairs(spark):
    r = random.Random(5)
    second = 1_000_000
    edits = [(k, r.choice("abc"), r.randint(-40, 400) * second) for k in range(150)]
    commits = [(k, r.choice("abd"), r.randint(-40, 400) * second) for k in range(60)]
    commits += [(900 + k, "a", c[2]) for k, c in enumerate(commits[:20])]  # several at one time
    e, c = spark.createDataFrame(edits, "edit_id long, path string, ts_us long"), spark.createDataFrame(commits, "commit_id long, path string, ts_us long")
    for width in (1, 7, 60, 5000):
        assert Counter(map(tuple, sessions.nearest_commit(e, c, width).collect())) == nearest(edits, commits, width * second)
    assert all(x.commit_id is None for x in sessions.nearest_commit(e, c.limit(0)).collect())


def test_a_busy_path_makes_no_pairs(spark):
    """10^5 edits and as many commits to one path within a horizon: all pairs would be 10^10."""
    e = spark.range(100_000).selectExpr("id edit_id", "'p' path", "id * 20000 ts_us")
    c = spark.range(100_000).selectExpr("id commit_id", "'p' path", "id * 20000 + 7000 ts_us")
    got = sessions.nearest_commit(e, c)
    assert got.where("commit_id = edit_id").count() == 100_000


@pytest.mark.parametrize("n_symbols", [1, 63, 130])
def test_impact_equals_a_plain_walk(spark, n_symbols):
    r = random.Random(n_symbols)
    pairs = [(f"n{r.randint(0, 250)}", f"n{r.randint(0, 250)}") for _ in range(420)]
    back = defaultdict(set)
    for a, b in pairs:
        back[b].add(a)
    symbols = [f"n{k}" for k in range(n_symbols)] + ["n0", None]
    want = set()
    for s in {x for x in symbols if x}:
        seen, front = {s}, {s}
        for d in range(1, 7):
            front = {a for b in front for a in back[b]} - seen
            seen |= front
            want |= {(s, a, d) for a in front}
    edges = spark.createDataFrame(pairs, "source string, target string")
    got = graph.impact(edges, spark.createDataFrame([(s,) for s in symbols], "symbol string"), 6).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_a_step_of_a_walk_meets_what_was_seen_in_one_aggregation(spark, monkeypatch):
    """Each round writes one table and shuffles its words once; symbols that are neighbours share a word."""
    plans = []
    kept = graph.Workspace.kept

    def seen(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(self, df)

    monkeypatch.setattr(graph.Workspace, "kept", seen)
    edges = spark.range(640).selectExpr("1000 + id % 64 source", "id target").unionByName(spark.range(64).selectExpr("2000L source", "1000 + id target"))
    with graph.Workspace() as w:
        told, _ = graph.reach(edges, spark.range(640).selectExpr("(id * 7) % 640 symbol").repartition(5), 2, w)
        words = told.groupBy("depth").count().collect()
    rounds = [p for p in plans if "bit_or" in p]
    assert len(rounds) == 2 and all(p.count("Aggregate [") == 1 and p.count("Join ") == 1 for p in rounds)
    n = {r["depth"]: r["count"] for r in words}
    assert n[0] == 640 and n[2] <= 18  # ten full words, and one more where a range of symbols ends


@pytest.mark.parametrize("name", ["callers", "callees", "explore"])
def test_point_queries_join_long_ids(spark, monkeypatch, name):
    kinds = []
    ask = getattr(graph, name)

    def seen(edges, nodes, symbols):
        kinds.extend([*(edges.schema[c].dataType.simpleString() for c in ("source", "target")), nodes.schema["id"].dataType.simpleString(), symbols.schema["symbol"].dataType.simpleString()])
        return ask(edges, nodes, symbols)

    monkeypatch.setattr(graph, name, seen)
    told = QUERIES[f"graph_{name}"](spark, "/root/testdata/sf0.001")
    assert set(kinds) == {"bigint"} and {dict(told.dtypes)[c] for c in ("symbol", "node_id")} == {"string"}


def test_tasks_of_a_point_query_grow_with_the_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 50, raising=False)
    edges = spark.range(1000).selectExpr("id % 100 source", "1000 + id % 37 target").unionByName(spark.sql("SELECT 3L source, 1003L target"))
    nodes = spark.range(2000).selectExpr("id", "'n' || id name")
    symbols = spark.range(60).selectExpr("id symbol")
    want = {(s, t, f"n{t}") for s, t in ({(k % 100, 1000 + k % 37) for k in range(1000)} | {(3, 1003)}) if s < 60}
    down, up = graph.callees(edges, nodes, symbols), graph.callers(edges, nodes, symbols.selectExpr("symbol + 1000 symbol"))
    got = down.collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert {(x.node_id, x.symbol) for x in up.collect()} == {(s, t) for s, t in ((k % 100, 1000 + k % 37) for k in range(1000))} | {(3, 1003)}
    assert down.rdd.getNumPartitions() == 21

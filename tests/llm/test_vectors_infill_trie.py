"""Embedding near-duplicates, fill-in-middle and the prefix trie against brute force, SQL, and odd inputs."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("lodestrata.llm")

from pyspark.sql import functions as F  # noqa: E402

from lodestrata.llm import embedding_dedup, infill, prefix_trie  # noqa: E402
from lodestrata.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000


def same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    got, cursor = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[k] for k in order) for r in cursor.fetchall())


# --- 11 ------------------------------------------------------------------------------------------------------------


def brute_links(rows, limit=0.9):
    """Of each row: links, component's smallest key; all pairs."""
    n = len(rows)
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    near, up = defaultdict(set), list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if fit[i] and fit[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= limit:
                    near[i].add(j)
                    near[j].add(i)
                    up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [(k, len(near[i]), least[root(i)], k is not None and k == least[root(i)]) for i, (k, _) in enumerate(rows)]


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def near_family(r, n, d=16, spread=0.05):
    rows = []
    for k in range(n):
        base = r.standard_normal(d)
        rows += [base + spread * r.standard_normal(d) for _ in range(1 + k % 5)]
    return [[float(np.float32(x)) for x in v] for v in rows]


def test_embedding_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op11_embedding_dedup"](spark, SF).collect())) == Counter(brute_links(rows))
    same_as_sql(spark, "op11_embedding_dedup")


def test_near_vectors_equal_brute_force(spark):
    r = np.random.Generator(np.random.PCG64(3))
    rows = list(enumerate(near_family(r, 60)))
    rows += [(1000 + k, rows[k][1]) for k in (0, 0, 5)]
    want = Counter(brute_links(rows))
    assert sum(n for _, n, _, _ in want.elements()) > 200
    assert Counter(map(tuple, embedding_dedup.near_vectors(vectors_of(spark, rows)).collect())) == want
    # buckets that are compared part by part give the same
    assert Counter(map(tuple, embedding_dedup.near_vectors(vectors_of(spark, rows), cell_rows=5).collect())) == want


def test_near_vectors_of_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v), (1, v), (2, [2.0, 4.0, 6.0]), (None, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, 2.0]), (10, [1e300, 2e300, 3e300]), (11, [1e-310, 2e-310, 3e-310]), (None, [5.0, -1.0, 0.0])]
    df = vectors_of(spark, rows, "double").withColumn("kept", F.lit("mine")).withColumn("item", F.lit(1)).withColumn("VEC_ID2", F.lit(1))
    got = embedding_dedup.near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_links(rows))
    assert embedding_dedup.near_vectors(vectors_of(spark, [])).count() == 0
    assert {tuple(r) for r in embedding_dedup.near_vectors(vectors_of(spark, [(None, v), (None, v)])).collect()} == {(None, 1, None, False)}


def test_recall_at_the_limit():
    """Pairs at a cosine of exactly 0.9, the hardest: found as often as promised, for the shapes of small and large tables."""
    r = np.random.Generator(np.random.PCG64(5))
    a, b = r.standard_normal((2, 4000, 64))
    a = embedding_dedup.unit(a)
    b = embedding_dedup.unit(b - (a * b).sum(1, keepdims=True) * a)
    c = 0.9 * a + np.sqrt(1 - 0.81) * b
    for n in (1, 50_000, 10_000_000):
        shape = embedding_dedup.shape_for(n)
        met = (embedding_dedup.bucket_keys(a, *shape) == embedding_dedup.bucket_keys(embedding_dedup.unit(c), *shape)).any(0)
        assert met.mean() > embedding_dedup.RECALL - 0.015
    shape = embedding_dedup.shape_for(50_000)
    assert (embedding_dedup.bucket_keys(a, *shape, 3) == embedding_dedup.bucket_keys(a, *shape)[:3]).all()


# --- 12 ------------------------------------------------------------------------------------------------------------


def plain_infill(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    n = len(units)
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_query_equals_its_sql(spark):
    same_as_sql(spark, "op12_infill")


def test_infill_of_odd_rows(spark):
    r = random.Random(4)
    letters = "aZ bé漢😀\n<>P.0ſ"
    rows = [(1, None), (2, ""), (None, "no key at all"), (4, "a"), (4, "a"), (5, LONG), (6, "x<S>y"), (7, "<P"), (8, "S>a<"), (9, "x" * 9000), (10, "é" * 9000)]
    rows += [(k, "".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for k in range(100, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Form", F.lit("mine")).withColumn("place", F.lit(7)).withColumn("c0", F.lit(8))
    got = infill.infill(df)
    assert got.columns == ["doc_id", "text", "place", "c0", "n", "form", "prefix_chars", "middle_chars", "output"]
    have = got.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in have) == Counter((k, *plain_infill(k, t)) for k, t in rows)
    assert all(x.back == (x.text or "") for x in have)
    assert infill.infill(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="result"):
        infill.infill(df.withColumnRenamed("doc_id", "n"), key="n")


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_chunks_of_any_size_find_the_same_cuts(chunk, monkeypatch):
    monkeypatch.setattr(infill, "STRIP", 11)
    texts = ["", "abc", "a b", "", "漢x漢xx漢", "  ", "abcdefghijklmnopqrstuvwxyz.Z", "é"]
    data = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    chunked = infill.chunk_counts(buf, offsets, chunk)
    total = np.concatenate([[0], np.cumsum(chunked[1])])
    assert (total[chunked[2][1:]] - total[chunked[2][:-1]]).tolist() == [len(u) for u in units]
    for rank in range(8):
        ranks = np.array([[min(rank, len(u))] for u in units])
        want = [o + len("".join(u[: min(rank, len(u))]).encode()) for o, u in zip(offsets.tolist(), units, strict=False)]
        assert infill.cut_places(buf, offsets, ranks, chunked)[:, 0].tolist() == want


# --- 13 ------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children, leaves, saved = Counter(s[:-1] for s in members if s), Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1]) if s else 0)
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == s)))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_query_equals_its_sql_and_brute_force(spark):
    same_as_sql(spark, "op13_prefix_trie")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op13_prefix_trie"](spark, SF).collect())) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, 1, "assistant", "b"), (-5, 2, "user", "x"), (-105, 2, "user", "x"), (100, 0, "user", "only"), (105, 3, "user", ""), (105, 4, None, "é漢😀"), (0, 0, "user", "hi"), (12, 0, "u:ser", "a"), (13, 0, "u", ":sera")]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("mine")).withColumn("Node", F.lit(1))
    assert Counter(map(tuple, prefix_trie.trie(df).collect())) == plain_trie(rows)
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


def test_trie_of_shared_beginnings_and_a_deep_conversation(spark, monkeypatch):
    """Many conversations alike, one with more turns than a block of running digests, and more ends at a node than a block of text."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "END_BLOCK", 10)
    r = random.Random(2)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", r.choice("ab") if c % 3 else "same") for c in range(300) for t in range(1 + c % 7)]
    rows += [(1000, t, "user", f"t{t % 3}") for t in range(150)] + [(1001, t, "user", f"t{t % 3}") for t in range(90)]
    assert Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(3)).collect())) == plain_trie(rows)

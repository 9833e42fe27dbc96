"""Queries that SQL can't express, against plain Python."""

import ast
import hashlib
import re

from pyspark.sql import functions as F

from lodestrata.catalogue import QUERIES
from lodestrata.functions import redaction
from lodestrata.operators import chunking, lint, retrieval
from lodestrata.plans.redaction import PLANTED, SAMPLES

SF = "/root/testdata/sf0.01"


def plain_engine(text):
    for pattern, to in redaction.engine_rules():
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", to), text, flags=re.ASCII)
    return text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_engine_over_documents_equals_plain_python(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["redact_documents"](spark, SF).collect()
    want = {d: plain_engine(t) for d, t in texts.items()}
    assert {r.doc_id: (r.redacted_hash, r.n_marks) for r in rows} == {d: (sha(t), t.count(redaction.MARK)) for d, t in want.items()}


def test_engine_over_texts_with_secrets_equals_plain_python(spark):
    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(len(SAMPLES.rows)).collect()]
    texts = [f"{t[: 40 * k]}\n{row[5]}\n{t[40 * k :]}" for k, (t, row) in enumerate(zip(docs, SAMPLES.rows, strict=True))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", redaction.redact_engine(F.col("t")).alias("after")).collect()
    assert {r.k: r.after for r in rows} == {k: plain_engine(t) for k, t in enumerate(texts)}
    assert sum(r.after != texts[r.k] for r in rows) > 100


def test_engine_metrics_equal_plain_python(spark):
    caught = catchable = residual = escaped = wrong = others = 0
    for _, secret, _, kind, plain, context in PLANTED.frame(spark, SF).collect():
        after, before = plain_engine(context).lower(), context.lower()
        leaked = len(plain.strip()) >= 8 and plain.strip().lower() in after
        if secret and kind is None:
            catchable, caught = catchable + 1, caught + (not leaked)
        elif secret:
            residual, escaped = residual + 1, escaped + leaked
        else:
            others, wrong = others + 1, wrong + (plain.strip().lower() in before and plain.strip().lower() not in after)
    for r in QUERIES["redact_engine_metrics"](spark, SF).collect():
        assert (r.catchable, r.caught, r.residual, r.residual_escaped, r.non_secrets, r.false_positives) == (catchable, caught, residual, escaped, others, wrong)


def test_episode_cards_equal_plain_python(spark):
    sessions = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        if r.role != "thinking":
            sessions.setdefault(r.conv_id, []).append((r.turn, r.role, plain_engine(r.text or "")))
    want = set()
    for c, turns in sessions.items():
        asks = sorted((t, s) for t, role, s in turns if role == "user")
        words = sorted((t, s) for t, role, s in turns if role == "assistant")
        want.add((c, len(turns), len(asks), sha(asks[0][1]) if asks else None, sha(words[-1][1]) if words else None))
    assert {tuple(r) for r in QUERIES["episode_cards"](spark, SF).collect()} == want


def test_scopes_and_mutations_equal_a_walk_of_the_tree(spark):
    source = "import os\n\nclass A:\n    def f(self):\n        self.x.write('a')\n\ndef g():\n    os.remove('b')\n    return 1\n"
    files = spark.createDataFrame([("a.py", source), ("ok.py", source), ("bad.py", "def (")], "path string, source string")
    got = {tuple(r) for r in lint.mutation_tripwire(files, ["ok.py"]).collect()}
    calls = {("a.py", n.lineno, n.func.attr) for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in lint.MUTATORS}
    assert {x for x in got if x[0] == "a.py"} == calls and not any(x[0] == "ok.py" for x in got)
    scopes = chunking.python_scopes(files.where("path = 'a.py'")).collect()
    names = {n.name for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.ClassDef))}
    assert all(any(n in str(r.asDict()) for r in scopes) for n in names)


def test_postings_are_dealt_by_document_only(spark):
    docs = spark.createDataFrame([(k, f"a b{k % 3} c{k}") for k in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b1"), (2, "c7 b2 a")], "query_id long, query string")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = retrieval.bm25(docs, queries)
        assert "SortMergeJoin" not in scored._jdf.queryExecution().executedPlan().toString()
        assert scored.count() == 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)

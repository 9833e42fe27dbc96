"""Queries of redaction: over documents, and the measured harness over synthetic samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import spread
from ..functions import redaction as R
from ..operators import metrics
from ..schemas import SINKS
from ..sources.samples import SAMPLE_SCHEMA, secret_samples
from ._bind import Fixture, quoted, re2, table

SAMPLES = Fixture(SAMPLE_SCHEMA, secret_samples())
#: The samples by themselves, and one planted in each document, after its own text.
PLANTED = Fixture(SAMPLE_SCHEMA, secret_samples(), f"SELECT CAST({len(SAMPLES.rows)} + doc_id % 2000000000 AS INT) AS sample_id, is_secret, secret_class, residual, plaintext, coalesce(text, '') || chr(10) || context AS context FROM {{documents}} JOIN {{rows}} ON sample_id = {SAMPLES.rows[0][0]} + doc_id % {len(SAMPLES.rows)}")


def _over_documents(spark, sf_dir, redact):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", redact(F.coalesce("text", F.lit(""))).alias("t"))
    return docs.select("doc_id", F.sha2("t", 256).alias("redacted_hash"), F.regexp_count("t", F.lit(R.MARK_IN_JAVA)).cast("long").alias("n_marks"))


def redact_stub(spark, sf_dir):
    return _over_documents(spark, sf_dir, R.redact_baseline)


def fake_redact(spark, sf_dir):
    return _over_documents(spark, sf_dir, R.redact_stand_in)


def redact_documents(spark, sf_dir):
    """The required engine over documents, with what its entropy check would still quarantine."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", R.redact_engine(F.coalesce("text", F.lit(""))).alias("t"))
    return docs.select("doc_id", F.sha2("t", 256).alias("redacted_hash"), F.regexp_count("t", F.lit(R.MARK_IN_JAVA)).cast("long").alias("n_marks"), R.quarantine(F.col("t")).alias("quarantined"))


def harness(samples, redact):
    """What becomes of each sample (SAMPLE_SCHEMA) at each sink."""
    rows = spread(samples).withColumn("after", redact(F.col("context"))).withColumn("sink", F.explode(F.array(*map(F.lit, SINKS))))
    return rows.select("sink", "sample_id", "is_secret", "secret_class", "residual", (F.col("is_secret") & R.leaked(F.col("plaintext"), F.col("after"))).alias("leaked"), (~F.col("is_secret") & R.false_positive(F.col("plaintext"), F.col("context"), F.col("after"))).alias("false_positive"))


def redact_metrics(spark, sf_dir):
    return metrics.redaction_report(harness(PLANTED.frame(spark, sf_dir), R.redact_baseline))


def redact_class_recall(spark, sf_dir):
    return metrics.class_recall(harness(PLANTED.frame(spark, sf_dir), R.redact_baseline))


def redact_engine_metrics(spark, sf_dir):
    return metrics.redaction_report(harness(PLANTED.frame(spark, sf_dir), R.redact_engine))


def leak_oracle(spark, sf_dir):
    rows = harness(PLANTED.frame(spark, sf_dir), R.redact_baseline)
    return rows.select("sink", "sample_id", "leaked", "false_positive", R.gate_failure(F.col("leaked"), F.col("residual")).alias("gate_failure"))


def residual_sha_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.regexp_count("text", F.lit('token = "[0-9a-f]{40}"')).cast("long")
    return docs.withColumn("n_residual", n).where("n_residual > 0").select("doc_id", "n_residual")


QUERIES = {f.__name__: f for f in (redact_stub, fake_redact, redact_documents, redact_metrics, redact_class_recall, redact_engine_metrics, leak_oracle, residual_sha_report)}


def _sql_baseline(text: str) -> str:
    for pattern, to in R.baseline_rules():
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(re2(to))}, 'g')"
    return text


def _sql_over_documents(redacted: str) -> str:
    return f"SELECT doc_id, sha256(t) AS redacted_hash, CAST((length(t) - length(replace(t, '[REDACTED]', ''))) // 10 AS BIGINT) AS n_marks FROM (SELECT doc_id, {redacted} AS t FROM documents)"


_PLAIN = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))".format
_RESULTS = f"""r AS (SELECT *, {_sql_baseline('context')} AS after FROM {PLANTED.sql()}),
o AS (SELECT sink, sample_id, is_secret, secret_class, residual, is_secret AND length({_PLAIN('plaintext')}) >= 8 AND contains({_PLAIN('after')}, {_PLAIN('plaintext')}) AS leaked,
  NOT is_secret AND contains({_PLAIN('context')}, {_PLAIN('plaintext')}) AND NOT contains({_PLAIN('after')}, {_PLAIN('plaintext')}) AS false_positive FROM r, (VALUES ('persist'), ('mcp_egress'), ('cloud_egress')) s(sink))"""
ORACLES = {
    "redact_stub": _sql_over_documents(_sql_baseline("coalesce(text, '')")),
    "fake_redact": _sql_over_documents("regexp_replace(coalesce(text, ''), '(?:github_pat_|ghp_|sk-|xoxb-)[A-Za-z0-9_-]+', '[REDACTED]', 'g')"),
    "redact_metrics": f"""WITH {_RESULTS}, a AS (SELECT sink, CAST(count(*) FILTER (is_secret AND residual IS NULL) AS BIGINT) AS catchable, CAST(count(*) FILTER (is_secret AND residual IS NULL AND NOT leaked) AS BIGINT) AS caught,
 CAST(count(*) FILTER (is_secret AND residual IS NOT NULL) AS BIGINT) AS residual, CAST(count(*) FILTER (is_secret AND residual IS NOT NULL AND leaked) AS BIGINT) AS residual_escaped, CAST(count(*) FILTER (NOT is_secret) AS BIGINT) AS non_secrets, CAST(count(*) FILTER (NOT is_secret AND false_positive) AS BIGINT) AS false_positives FROM o GROUP BY sink),
 b AS (SELECT *, CASE WHEN catchable = 0 THEN 1.0 ELSE round(caught / catchable::DOUBLE, 6) END AS recall, CASE WHEN non_secrets = 0 THEN 0.0 ELSE round(false_positives / non_secrets::DOUBLE, 6) END AS fp_rate FROM a)
SELECT *, recall >= 0.95 AND fp_rate <= 0.05 AS gate_pass FROM b""",
    "redact_class_recall": f"WITH {_RESULTS} SELECT sink, secret_class, CAST(count(*) FILTER (NOT leaked) AS BIGINT) AS caught, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (NOT leaked) / count(*)::DOUBLE, 6) AS recall FROM o WHERE is_secret AND residual IS NULL GROUP BY ROLLUP (sink, secret_class)",
    "leak_oracle": f"WITH {_RESULTS} SELECT sink, sample_id, leaked, false_positive, leaked AND residual IS NULL AS gate_failure FROM o",
    "residual_sha_report": """SELECT doc_id, n_residual FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"')) AS BIGINT) AS n_residual FROM documents) WHERE n_residual > 0""",
}

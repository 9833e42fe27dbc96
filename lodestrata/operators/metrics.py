"""Measurements: redaction recall, maintenance budgets, coverage, success rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The gates.
RECALL_FLOOR, FP_CEILING = 0.95, 0.05
LATENCY_MS, RAM_BYTES, DISK_BYTES = 5000, 2 << 30, 5 << 30


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole to six places; `empty` where there is nothing to count."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(part / whole, 6))


def redaction_report(results: DataFrame) -> DataFrame:
    """Per sink, from rows (sink, is_secret, residual, leaked, false_positive).

    Samples with a residual class count apart: they may escape.
    """
    secret, residual = F.col("is_secret"), F.col("residual").isNotNull()
    out = results.groupBy("sink").agg(
        F.count_if(secret & ~residual).alias("catchable"),
        F.count_if(secret & ~residual & ~F.col("leaked")).alias("caught"),
        F.count_if(secret & residual).alias("residual"),
        F.count_if(secret & residual & F.col("leaked")).alias("residual_escaped"),
        F.count_if(~secret).alias("non_secrets"),
        F.count_if(~secret & F.col("false_positive")).alias("false_positives"),
    )
    out = out.withColumn("recall", ratio(F.col("caught"), F.col("catchable"), 1.0)).withColumn("fp_rate", ratio(F.col("false_positives"), F.col("non_secrets"), 0.0))
    return out.withColumn("gate_pass", (F.col("recall") >= RECALL_FLOOR) & (F.col("fp_rate") <= FP_CEILING))


def class_recall(results: DataFrame) -> DataFrame:
    """(sink, secret_class, caught, total, recall), with subtotals by sink and in all (nulls)."""
    rows = results.where("is_secret and residual is null")
    out = rows.rollup("sink", "secret_class").agg(F.count_if(~F.col("leaked")).alias("caught"), F.count("*").alias("total"))
    return out.withColumn("recall", ratio(F.col("caught"), F.col("total"), 1.0))


def maintenance_gate(reports: DataFrame) -> DataFrame:
    """reports (run_id, latency_ms, ram_bytes, disk_bytes, unindexed) with gate_pass."""
    return reports.withColumn("gate_pass", (F.col("latency_ms") <= LATENCY_MS) & (F.col("ram_bytes") <= RAM_BYTES) & (F.col("disk_bytes") <= DISK_BYTES) & (F.col("unindexed") == 0))


def first_seen(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with their first position."""
    return rows.groupBy(key).agg(F.min(pos).alias("first_pos"))


def lag_percentiles(rows: DataFrame, by: str, seconds: str) -> DataFrame:
    """(by, p50, p95) exact to the row."""
    return rows.groupBy(by).agg(F.expr(f"round(percentile({seconds}, 0.5), 6)").alias("p50"), F.expr(f"round(percentile({seconds}, 0.95), 6)").alias("p95"))


def counts_by_kind(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, counts): a map from kind to how often it occurs, keys in order; counted before kinds are gathered, so a map holds a kind once."""
    n = rows.where(F.col(kind).isNotNull()).groupBy(by, kind).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))

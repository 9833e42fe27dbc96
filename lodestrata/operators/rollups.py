"""Daily rollups of usage: exact counts beside sketches that merge, so that any range of days comes from stored rows alone.

A day's row holds a KLL sketch of values (quantiles), an HLL sketch of users
(distinct counts) and theta sketches of those who did something (distinct counts of
unions, intersections and differences). A range merges its days' rows; events are
not read again, and a row's size doesn't grow with the day's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches: KLL k (rank error under 0.5 %), HLL and theta log2 of entries (errors about 1 %).
KLL_K, LOG_ENTRIES = 400, 14


def daily(events: DataFrame, evidence: Column, opted_in: Column, ts: str = "ts", user: str = "user_id", value: str = "value") -> DataFrame:
    """(day, n_events, n_evidence, values, users, opted) of events: counts, and sketches of values, users and users who opted in."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n_events"),
        F.count_if(evidence).alias("n_evidence"),
        F.kll_sketch_agg_double(F.col(value), F.lit(KLL_K)).alias("values"),
        F.hll_sketch_agg(F.col(user), F.lit(LOG_ENTRIES)).alias("users"),
        F.theta_sketch_agg(F.col(user), F.lit(LOG_ENTRIES)).alias("active"),
        F.theta_sketch_agg(F.when(opted_in, F.col(user)), F.lit(LOG_ENTRIES)).alias("opted"),
    )


def merged(days: DataFrame, by: Column) -> DataFrame:
    """(span, n_events, evidence_share, p50, p95, n_users, opt_in_rate) of daily rows, merged by the span that `by` names for each day."""
    m = days.groupBy(by.alias("span")).agg(
        F.sum("n_events").alias("n_events"),
        F.sum("n_evidence").alias("n_evidence"),
        F.kll_merge_agg_double("values", F.lit(KLL_K)).alias("values"),
        F.hll_union_agg("users").alias("users"),
        F.theta_union_agg("active", F.lit(LOG_ENTRIES)).alias("active"),
        F.theta_union_agg("opted", F.lit(LOG_ENTRIES)).alias("opted"),
    )
    quantile = lambda q: F.kll_sketch_get_quantile_double("values", F.lit(q))
    rate = F.try_divide(F.theta_sketch_estimate(F.theta_intersection("active", "opted")), F.theta_sketch_estimate("active"))
    return m.select("span", "n_events", F.round(F.col("n_evidence") / F.col("n_events"), 6).alias("evidence_share"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), F.hll_sketch_estimate("users").alias("n_users"), rate.alias("opt_in_rate"))


def rank_of(rows: DataFrame, spans: DataFrame, by: Column, value: str, at: str) -> DataFrame:
    """(span, rank): the share of a span's values that are at most spans' value `at`; what a quantile's rank is in truth."""
    told = rows.where(F.col(value).isNotNull()).select(by.alias("span"), value).join(F.broadcast(spans.select("span", at)), "span")
    return told.groupBy("span").agg((F.count_if(F.col(value) <= F.col(at)) / F.count("*")).alias("rank"))

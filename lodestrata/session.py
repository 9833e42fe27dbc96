"""The session that the engine expects: UTC, adaptive execution, skew joins split."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lodestrata", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that results (time zone) and scale (AQE) rely on."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()

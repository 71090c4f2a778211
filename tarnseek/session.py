"""A Spark session with the settings this engine is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tarnseek", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive plans with skew splitting, UTC, and any settings given on top.

    Partition counts are left to the adaptive planner: it starts from
    ``spark.sql.shuffle.partitions`` and merges small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

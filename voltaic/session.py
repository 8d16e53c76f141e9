"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "voltaic", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; settings override, dots written as two underscores."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Spark sessions with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "motifloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf: further settings, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

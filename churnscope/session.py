"""Sessions as the engine wants them: UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "churnscope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

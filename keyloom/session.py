"""A Spark session with the settings that the engine is run with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, name: str = "keyloom", **more: str) -> SparkSession:
    """Adaptive plans, skew joins and UTC; ``more`` settings with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        **{k.replace("_", "."): v for k, v in more.items()},
    }
    return builder.config(map=settings).getOrCreate()

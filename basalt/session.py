"""A Spark session with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides any of it."""
    builder = SparkSession.builder.appName("basalt")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Files of lineage that was cut go with the DataFrames that read them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

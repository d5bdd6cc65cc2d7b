"""A session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed join keys and coalesces small partitions; times are UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str, **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}).getOrCreate()

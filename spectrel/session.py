"""A session with the settings that the engine expects. A cluster's own settings win where they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("spectrel")
    if master:
        builder = builder.master(master)
    settings = SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | more
    return builder.config(map=settings).getOrCreate()

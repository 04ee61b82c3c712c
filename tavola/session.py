"""A session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tavola", **settings: str) -> SparkSession:
    """The running session, or a new one; master and sizes come from the caller or from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def in_small_batches(rows: DataFrame, size: str = "4m") -> DataFrame:
    """``rows``, whose session now sends rows to Python in batches of ``size``, unless it has set a bound of its own; by default they may be 64 MB."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "64m", "64MB"):
        conf.set(name, size)
    return rows

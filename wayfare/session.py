"""A session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Instants are UTC; Lima's clock is an expression.
    "spark.sql.session.timeZone": "UTC",
    # Partitions are merged, split and skewed joins are dealt anew at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Timestamps with statistics, by which scans skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def build_session(name: str = "wayfare", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A cluster names ``spark.checkpoint.dir`` itself: a folder that driver and executors share. About 100 shuffle partitions a GB of input keep tasks small."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()

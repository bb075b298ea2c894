"""SparkSession settings this library is written against."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # A bad cast must fail, and dates must not move with the host's zone.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # AQE merges the small shuffles of the marts and splits skewed partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
}


def session(app_name: str = "requestmarts", **extra: str) -> SparkSession:
    """Session with the library's settings; the master comes from spark-submit.

    Executor sizes and ``spark.sql.shuffle.partitions`` depend on the cluster
    and are left to the submitter.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str
) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("requestmarts-local")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

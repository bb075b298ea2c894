"""Cutting lineage at results that many later plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_directory(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named (tests), checkpoints go below the warehouse folder, which
    every executor reads and writes as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and keep in reliable storage: survives lost executors, and plans
    over it stay short."""
    ensure_directory(df.sparkSession)
    return df.checkpoint(eager=True)

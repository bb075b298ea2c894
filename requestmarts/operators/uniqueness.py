"""Finding the values that repeat in a column whose values should all differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestmarts.operators.lookups import MAX_BROADCAST_BYTES, measured_bytes
from requestmarts.sources.checkpoints import checkpointed


def repeated_hashes(df: DataFrame, column: str) -> DataFrame:
    """64-bit hashes that more than one row's value has. NULLs are ignored."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.xxhash64(column).alias("_hash"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_hash")
    )


def repeated_values(
    df: DataFrame, column: str, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame | None:
    """The values that more than one row has, stored; None if all differ. NULLs are ignored.

    The first pass moves one hash of eight bytes for each value of a task, whatever the
    length of the values, and is the only one where no hash repeats. Else only values
    with a repeated hash are moved and counted: the real repeats and the few different
    values that share a hash. The repeated hashes are measured before they are sent to
    the tasks; where they are too many, all values are counted.
    """
    hashes = repeated_hashes(df, column)
    size = measured_bytes(hashes)
    if not size:
        return None
    values = df.select(F.col(column).alias("_value")).where("_value is not null")
    if size <= max_broadcast_bytes:
        values = values.join(F.broadcast(checkpointed(hashes)), F.xxhash64("_value") == F.col("_hash"), "left_semi")
    counted = values.groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    found = checkpointed(counted.where("_n > 1").select(F.col("_value").alias(column)))
    return None if found.isEmpty() else found

"""Joins of the request table to a dimension table of checked size."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestmarts.sources.checkpoints import checkpointed

# Most a broadcast side may take, measured, before the join is shuffled instead.
MAX_BROADCAST_BYTES = 64 << 20

# Requests of one key that may meet in a task. Keys with more are split by rows.
HEAVY_ROWS = 1_000_000

_ROW_OVERHEAD = 48


def _value_bytes(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    return F.lit(16)


def measured_bytes(dim: DataFrame) -> int:
    """Size of a flat dimension table from its actual values (one aggregate row)."""
    row_bytes = F.lit(_ROW_OVERHEAD).cast("bigint")
    for field in dim.schema.fields:
        row_bytes = row_bytes + _value_bytes(field)
    return dim.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("n")).first()["n"]


def heavy_keys(facts: DataFrame, keys: list[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(keys, _parts) of the keys with more than ``heavy_rows`` rows, counted map-side. There is
    at most one for that many rows."""
    counted = facts.where(~_any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / heavy_rows).cast("int").alias("_parts")
    return counted.where(F.col("_n") > heavy_rows).select(*keys, parts)


def _any_null(keys: list[str]) -> Column:
    return reduce(or_, (F.col(k).isNull() for k in keys))


def split_join(
    facts: DataFrame, dim: DataFrame, keys: list[str], how: str, spread_by: str, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Shuffled equi-join in which a heavy key is split into parts of its rows.

    Facts of a heavy key go to one of its parts, chosen by hashing ``spread_by``, and its
    dimension rows to each of them. All other dimension rows are moved once. Facts with a
    NULL key match nothing and are dealt out evenly.
    """
    heavy = checkpointed(heavy_keys(facts, keys, heavy_rows))
    if measured_bytes(heavy) <= MAX_BROADCAST_BYTES:
        heavy = F.broadcast(heavy)
    dealt = F.xxhash64(spread_by)
    part = F.when(_any_null(keys), dealt).otherwise(F.pmod(dealt, F.coalesce("_parts", F.lit(1)))).alias("_part")
    parted = facts.join(heavy, keys, "left").select(*facts.columns, part)
    parts = F.sequence(F.lit(0).cast("bigint"), (F.coalesce("_parts", F.lit(1)) - 1).cast("bigint"))
    copied = dim.join(heavy, keys, "left").select(*dim.columns, F.explode(parts).alias("_part"))
    return parted.join(copied, [*keys, "_part"], how).drop("_part")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str,
    *,
    small: bool,
    spread_by: str = "id_chamado",
) -> DataFrame:
    """Map-side join if ``dim`` was found small, shuffled join with heavy keys split if not."""
    if small:
        return facts.join(F.broadcast(dim), keys, how)
    return split_join(facts, dim, keys, how, spread_by)

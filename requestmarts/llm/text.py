"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words of the contamination and license rules: ASCII letters and digits and everything beyond ASCII.
ASCII_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
LOWER_AND_SPLIT = bytes.maketrans(
    ASCII_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b" " * len(ASCII_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz",
)
#: Only A-Z change case in the contracts of the corpus operators.
LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANKS = "[\\x20\\x09-\\x0D]+"
NOT_BLANK = "[^\\x20\\x09-\\x0D]+"


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text, split at every ASCII character that is no letter or digit."""
    return text.translate(LOWER_AND_SPLIT).split() if text else []


def with_struct(docs: DataFrame, id_column: str, result: Column, schema: T.StructType) -> DataFrame:
    """The id and the fields of a struct that is computed once for each row."""
    computed = docs.select(F.col(id_column), result.alias("_result"))
    return computed.select(id_column, *[F.col(f"_result.{f.name}").alias(f.name) for f in schema.fields])


def as_row(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that further columns clash with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def global_rank(df: DataFrame, keys: list[str], order_hash: str, ties: list[str], out: str) -> DataFrame:
    """Rank from 0 within each key by a hex hash and the tie columns, without one task for a key.

    The first three hex digits of the hash cut every key into 4,096 ranges. Range
    sizes are counted first (a small table), so a row needs only its rank within
    its own range and the number of rows in the ranges before it.
    """
    cut = df.withColumn("_range", F.substring(order_hash, 1, 3))
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    return _offset_rank(cut, sizes, keys, order_hash, ties, F.lit(1), out, "_n")


def global_prefix(
    df: DataFrame, keys: list[str], order_hash: str, ties: list[str], amount: str, out: str
) -> DataFrame:
    """Sum of ``amount`` over the rows before each one, in the order of ``global_rank``."""
    cut = df.withColumn("_range", F.substring(order_hash, 1, 3))
    sizes = cut.groupBy(*keys, "_range").agg(F.sum(amount).alias("_n"))
    return _offset_rank(cut, sizes, keys, order_hash, ties, F.col(amount), out, "_n")


def _offset_rank(
    cut: DataFrame, sizes: DataFrame, keys: list[str], order_hash: str, ties: list[str], amount: Column, out: str, n: str
) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_range").alias("_key_range"),
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_rows_before"),
    )
    own = (
        Window.partitionBy(*keys, "_range")
        .orderBy(order_hash, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = cut.withColumn("_rows_inside", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = inside.join(offsets, [*same, F.col("_range") == F.col("_key_range")])
    return joined.withColumn(out, F.col("_rows_before") + F.col("_rows_inside")).drop(
        "_rows_before", "_rows_inside", "_range", "_key_range", *[f"_key_{k}" for k in keys]
    )

"""Scans of the landed tables and of the marts."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from requestmarts.operators.filters import in_months
from requestmarts.schema import OPENED_MONTH, STORED_DETAIL_SCHEMA, TYPE_MAP_SCHEMA
from requestmarts.sources import pointers

DETAIL = "chamados"
# Where a refreshed build finds each month of its fact.
MONTHS_TABLE = "chamados_months"
MONTHS_SCHEMA = f"{OPENED_MONTH} date, folder string"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_neighbourhoods(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_type_map(spark: SparkSession, path: str) -> DataFrame:
    """Seed CSV with a header; every column is text."""
    return spark.read.schema(TYPE_MAP_SCHEMA).csv(path, header=True, escape='"', multiLine=True)


def build_name(database: str | None = None) -> str:
    return f"{database}.mart_build" if database else "mart_build"


def current_build(spark: SparkSession, database: str | None = None, folder: str | None = None) -> str | None:
    """Folder of the published build: by the pointer files in the folder of the builds, which any
    session can read, else by the one row of the pointer view."""
    if folder is not None:
        return pointers.current(spark, folder)
    name = build_name(database)
    return spark.table(name).first()["folder"] if spark.catalog.tableExists(name) else None


def _stored(spark: SparkSession, path: str) -> bool:
    """A finished write is there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def read_mart(spark: SparkSession, card: str, build: str | None = None, database: str | None = None) -> DataFrame:
    """A table of the given build, or of the published one. A missing table raises."""
    build = build or current_build(spark, database)
    if build is None:
        raise LookupError(f"no build is published in {build_name(database)}")
    if not _stored(spark, f"{build}/{card}"):
        raise LookupError(f"build {build} has no table {card}")
    # A detail fact without requests has no month directory, and so no file to tell its columns.
    if card == DETAIL:
        return _detail(spark, build)
    return spark.read.parquet(f"{build}/{card}")


def months_kept(spark: SparkSession, build: str) -> dict[str, set[dt.date | None]] | None:
    """Build folder -> opening months of the fact that are read from there; None if all are in this build."""
    if not _stored(spark, f"{build}/{MONTHS_TABLE}"):
        return None
    kept: dict[str, set[dt.date | None]] = {}
    for row in spark.read.schema(MONTHS_SCHEMA).parquet(f"{build}/{MONTHS_TABLE}").collect():  # one row a month
        kept.setdefault(row["folder"], set()).add(row[OPENED_MONTH])
    return kept


def _detail(spark: SparkSession, build: str) -> DataFrame:
    """The fact of a build; a refreshed one has its unchanged months in the builds that wrote them."""
    files = lambda folder: spark.read.schema(STORED_DETAIL_SCHEMA).parquet(f"{folder}/{DETAIL}")
    kept = months_kept(spark, build)
    if kept is None:
        return files(build)
    parts = [files(folder).where(in_months(months)) for folder, months in sorted(kept.items())]
    return reduce(DataFrame.unionByName, parts) if parts else files(build)


def read_mart_or_empty(
    spark: SparkSession, card: str, schema: T.StructType, build: str | None = None, database: str | None = None
) -> DataFrame:
    """The table, or an empty frame of its shape if the build has none."""
    build = build or current_build(spark, database)
    if build is not None and _stored(spark, f"{build}/{card}"):
        return read_mart(spark, card, build)
    return spark.createDataFrame([], schema)

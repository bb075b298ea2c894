"""Landing jobs: project, filter and save the source tables as Parquet."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from requestmarts.schema import (
    ADMIN_REGION_COLUMNS,
    DEFAULT_SINCE,
    NEIGHBOURHOOD_SCHEMA,
    PLANNING_AREA_COLUMNS,
    REQUEST_SCHEMA,
    SUBPREFECTURE_COLUMNS,
)

# Partition directory of landed requests; a date cut then skips whole months.
MONTH_COLUMN = "mes_particao"

# The order in which tables are landed.
LANDING_ORDER = (
    "regiao_administrativa",
    "area_planejamento",
    "subprefeitura",
    "bairro",
    "chamado",
)

REPORT_SCHEMA = "table string, rows bigint, skipped boolean"


def extract_requests(source: DataFrame, start: dt.date | str = DEFAULT_SINCE) -> DataFrame:
    """The 16 request columns of the source, its target date renamed to the deadline."""
    renamed = {"prazo_atendimento": "data_alvo_finalizacao"}
    return source.where(F.col("data_particao") >= F.lit(str(start)).cast("date")).select(
        *(F.col(renamed.get(c, c)).alias(c) for c in REQUEST_SCHEMA.fieldNames())
    )


def extract_neighbourhoods(source: DataFrame) -> DataFrame:
    return source.select(*NEIGHBOURHOOD_SCHEMA.fieldNames())


def extract_admin_regions(source: DataFrame) -> DataFrame:
    return source.select(*ADMIN_REGION_COLUMNS)


def extract_planning_areas(source: DataFrame) -> DataFrame:
    return source.select(*PLANNING_AREA_COLUMNS)


def extract_subprefectures(source: DataFrame) -> DataFrame:
    return source.select(*SUBPREFECTURE_COLUMNS)


def _save(df: DataFrame, out: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write and return the row count, observed in the write itself."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    writer = writer.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(out)
    return seen.get["rows"]


def land_requests(source: DataFrame, out: str, start: dt.date | str = DEFAULT_SINCE) -> int:
    """Rebalanced by month: AQE cuts a heavy month into several tasks and merges
    light ones, so files are of even size and each holds one month."""
    monthly = extract_requests(source, start).withColumn(
        MONTH_COLUMN, F.trunc("data_particao", "month")
    )
    return _save(monthly.hint("rebalance", MONTH_COLUMN), out, (MONTH_COLUMN,))


def land_neighbourhoods(source: DataFrame, out: str) -> int:
    return _save(extract_neighbourhoods(source), out)


def land_admin_regions(source: DataFrame, out: str) -> int:
    return _save(extract_admin_regions(source), out)


def land_planning_areas(source: DataFrame, out: str) -> int:
    return _save(extract_planning_areas(source), out)


def land_subprefectures(source: DataFrame, out: str) -> int:
    return _save(extract_subprefectures(source), out)


def is_landed(spark: SparkSession, path: str) -> bool:
    """A finished write is there; leftovers of a failed one do not count."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(marker)


def land_all(
    sources: dict[str, DataFrame], out_dir: str, start: dt.date | str = DEFAULT_SINCE
) -> DataFrame:
    """Land every table in order and report (table, rows, skipped).

    Tables already landed are skipped and have no row count. The first failure
    is raised and leaves the tables before it landed.
    """
    missing = [t for t in LANDING_ORDER if t not in sources]
    if missing:
        raise ValueError(f"no source for {', '.join(missing)}")
    spark = sources["chamado"].sparkSession
    jobs = {
        "regiao_administrativa": land_admin_regions,
        "area_planejamento": land_planning_areas,
        "subprefeitura": land_subprefectures,
        "bairro": land_neighbourhoods,
        "chamado": lambda source, out: land_requests(source, out, start),
    }
    report = []
    for table in LANDING_ORDER:
        out = f"{out_dir.rstrip('/')}/{table}.parquet"
        if is_landed(spark, out):
            report.append((table, None, True))
        else:
            report.append((table, jobs[table](sources[table], out), False))
    return spark.createDataFrame(report, REPORT_SCHEMA)

"""Small hand-made frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from requestmarts.schema import DETAIL_SCHEMA, REQUEST_SCHEMA

TYPE_MAP = [("Vacina", "SMS"), ("Creche", "SME"), ("Abrigo", "SMAS"), ("Poda", "Outros")]


def _frame(spark: SparkSession, schema, rows: list[dict], defaults: dict) -> DataFrame:
    """Rows given by column name; timestamps and dates as text."""
    text = ", ".join(f"{f.name} string" for f in schema.fields)
    data = [
        tuple(None if v is None else str(v) for v in ({**defaults, "id_chamado": str(i), **row}.get(f.name) for f in schema.fields))
        for i, row in enumerate(rows, 1)
    ]
    raw = spark.createDataFrame(data, text)
    return raw.select(*(raw[f.name].cast(f.dataType).alias(f.name) for f in schema.fields))


def requests(spark: SparkSession, rows: list[dict]) -> DataFrame:
    defaults = {"data_inicio": "2024-03-10 08:00:00", "tipo": "Vacina", "data_particao": "2024-03-10"}
    return _frame(spark, REQUEST_SCHEMA, rows, defaults)


def detail(spark: SparkSession, rows: list[dict]) -> DataFrame:
    defaults = {
        "data_inicio": "2024-03-10 08:00:00",
        "tipo": "Vacina",
        "secretaria": "SMS",
        "data_particao": "2024-03-10",
        "resolvido_no_prazo": "false",
    }
    return _frame(spark, DETAIL_SCHEMA, rows, defaults)


def type_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPE_MAP, "tipo string, secretaria string")


def areas(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(id, sub-prefecture, WKT) as staged neighbourhoods."""
    full = [(i, f"nome {i}", sub, f"RA {i}", "AP 1", wkt) for i, sub, wkt in rows]
    return spark.createDataFrame(
        full,
        "id_bairro string, nome string, subprefeitura string, regiao_administrativa string, "
        "area_planejamento string, geometry_wkt string",
    )


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)

"""Staging casts and the enriched request table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestmarts.functions import semantics as S
from requestmarts.operators.lookups import MAX_BROADCAST_BYTES, lookup_join, measured_bytes
from requestmarts.operators.territory import TerritoryLookup, resolve_territory
from requestmarts.schema import (
    DEFAULT_SINCE,
    DEPARTMENTS,
    DETAIL_COLUMNS,
    NEIGHBOURHOOD_SCHEMA,
    REQUEST_SCHEMA,
)
from requestmarts.sources.landing import MONTH_COLUMN


def since(df: DataFrame, start: dt.date | str = DEFAULT_SINCE) -> DataFrame:
    """Rows of partitions on or after ``start``; NULL partition dates drop."""
    day = S.date_literal(start)
    kept = df.where(F.col("data_particao") >= day)
    if MONTH_COLUMN in df.columns:
        kept = kept.where(F.col(MONTH_COLUMN) >= F.trunc(day, "month"))
    return kept


def stage_requests(raw: DataFrame, start: dt.date | str = DEFAULT_SINCE) -> DataFrame:
    """Typed requests. Casts fail on bad input; fractional counts round half to even."""
    types = dict(raw.dtypes)
    columns = []
    for field in REQUEST_SCHEMA.fields:
        c = F.col(field.name)
        if field.name == "reclamacoes" and types[field.name] in ("double", "float"):
            c = F.rint(c)
        columns.append(c.cast(field.dataType).alias(field.name))
    day_is_typed = types["data_particao"] == "date"
    if day_is_typed:
        return since(raw, start).select(*columns)
    return since(raw.select(*columns), start)


def stage_neighbourhoods(raw: DataFrame) -> DataFrame:
    renamed = {
        "nome_regiao_administrativa": "regiao_administrativa",
        "nome_regiao_planejamento": "area_planejamento",
    }
    return raw.select(
        *(
            F.col(f.name).cast(f.dataType).alias(renamed.get(f.name, f.name))
            for f in NEIGHBOURHOOD_SCHEMA.fields
        )
    )


def with_department(
    requests: DataFrame, type_map: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Add the responsible department by request type, with a default."""
    pairs = type_map.where(F.col("tipo").isNotNull()).select("tipo", F.col("secretaria").alias("_department"))
    small = measured_bytes(pairs) <= max_broadcast_bytes
    joined = lookup_join(requests, pairs, ["tipo"], "left", small=small)
    return joined.select(*requests.columns, S.department(F.col("_department")).alias("secretaria"))


def in_scope(df: DataFrame) -> DataFrame:
    return df.where(F.col("secretaria").isin(*DEPARTMENTS))


def with_deadline_metrics(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        S.days_to_resolution().alias("dias_resolucao"),
        S.resolved_on_time().alias("resolvido_no_prazo"),
    )


def scoped_requests(
    staged: DataFrame, type_map: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Requests of the departments in scope, with department and deadline metrics."""
    return with_deadline_metrics(in_scope(with_department(staged, type_map, max_broadcast_bytes)))


def enrich(
    staged: DataFrame,
    type_map: DataFrame,
    lookup: TerritoryLookup,
    *,
    unique_ids: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """One row per request in scope: department, deadline metrics and territory.

    The scope filter runs before any territory work.
    """
    scoped = scoped_requests(staged, type_map, max_broadcast_bytes)
    return resolve_territory(scoped, lookup, unique_ids=unique_ids, max_broadcast_bytes=max_broadcast_bytes)


def mart_requests(enriched: DataFrame) -> DataFrame:
    """The detail fact behind lists, exports and filtered dashboards."""
    return enriched.select(*DETAIL_COLUMNS)

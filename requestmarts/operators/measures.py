"""Additive measures: what every mart sums, per request or pre-aggregated.

A measured frame has the dimension columns, the counters below and the newest
partition date. One built from requests has a row per request; the roll-up has a
row per combination of dimensions. Marts read either.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestmarts.functions import semantics as S
from requestmarts.schema import TERRITORY_COLUMNS

TERRITORY_DIMENSIONS = ("secretaria", *TERRITORY_COLUMNS, "nome_unidade_organizacional")
VOLUME_DIMENSIONS = ("secretaria", "tipo", "categoria", "periodo")
DIMENSIONS = tuple(dict.fromkeys((*TERRITORY_DIMENSIONS, *VOLUME_DIMENSIONS)))
# A dimension no filter asks for, so it is never one of the territory cube.
_VOLUME_ONLY = "categoria"


def _counted(condition: str) -> str:
    return f"if({condition}, 1L, 0L)"


_WITH_DEADLINE = "data_fim is not null and prazo_atendimento is not null"

# Counter -> SQL over one request; ``age`` is its age in days while it is open.
_COUNTERS = {
    "n": "1L",
    "n_closed": _counted("data_fim is not null"),
    "n_open": _counted("data_fim is null"),
    "n_with_deadline": _counted(_WITH_DEADLINE),
    "n_on_time": _counted("resolvido_no_prazo"),
    "n_late": _counted(f"{_WITH_DEADLINE} and not resolvido_no_prazo"),
    "n_no_deadline": _counted("data_fim is not null and prazo_atendimento is null"),
    "days_sum": "coalesce(dias_resolucao, 0L)",
    "days_n": _counted("dias_resolucao is not null"),
    "age_sum": "coalesce({age}, 0L)",
    "age_n": _counted("data_fim is null and data_inicio is not null"),
    "complaints_n": _counted("reclamacoes is not null"),
    "complaints_repeated": _counted("reclamacoes >= 2"),
}
COUNTERS = tuple(_COUNTERS)

# Columns an older detail table may lack; its cards then come out empty.
_OPTIONAL = {
    **dict.fromkeys((*TERRITORY_COLUMNS, "categoria", "nome_unidade_organizacional"), "string"),
    "reclamacoes": "int",
}


def measured(detail: DataFrame, as_of: dt.date | str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One measured row per request. ``as_of`` dates the backlog; None is today.
    ``extra`` are further columns to keep."""
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in detail.columns}
    if missing:
        detail = detail.withColumns(missing)
    period = S.month_of(F.col("data_inicio")).alias("periodo")
    as_of_day = "current_date()" if as_of is None else f"date'{as_of}'"
    age = f"if(data_fim is null, cast(datediff({as_of_day}, data_inicio) as bigint), null)"
    return detail.select(
        *(period if d == "periodo" else F.col(d) for d in (*DIMENSIONS, *extra)),
        *(F.expr(sql.format(age=age)).alias(c) for c, sql in _COUNTERS.items()),
        F.col("data_particao").alias("newest_partition"),
    )


def total(counter: str) -> Column:
    """Sum of a counter; zero, not NULL, over no rows."""
    return F.expr(f"coalesce(sum({counter}), 0L)")


def on_time_rate() -> Column:
    return S.pct("sum(n_on_time)", "sum(n_with_deadline)", 2)


def rollup(m: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """All measures by territory and unit, and by type, category and month.

    Grouping sets give both cubes in one scan, and their sizes add up instead of
    multiplying. ``cube`` tells the rows apart. Requests collapse map-side, so
    only distinct combinations are shuffled. Both have ``extra`` dimensions as well.
    """
    sets = [[F.col(c) for c in dict.fromkeys((*own, *extra))] for own in (TERRITORY_DIMENSIONS, VOLUME_DIMENSIONS)]
    territory_only = F.grouping(_VOLUME_ONLY) == 1
    return m.groupingSets(sets, *(F.col(c) for c in dict.fromkeys((*DIMENSIONS, *extra)))).agg(
        F.when(territory_only, "territory").otherwise("volume").alias("cube"),
        *(F.sum(c).alias(c) for c in COUNTERS),
        F.max("newest_partition").alias("newest_partition"),
    )


def territory_cube(rolled: DataFrame) -> DataFrame:
    return rolled.where(F.col("cube") == "territory")


def volume_cube(rolled: DataFrame) -> DataFrame:
    return rolled.where(F.col("cube") == "volume")

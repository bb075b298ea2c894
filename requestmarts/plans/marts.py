"""One function per mart, over a measured frame (see ``operators.measures``).

The same function gives the unfiltered mart, its filtered recomputation and the
dashboard card. Every ranking ends in its group key, so cuts are repeatable.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from requestmarts.functions import semantics as S
from requestmarts.operators.measures import on_time_rate, total
from requestmarts.schema import TERRITORY_COLUMNS

# --- fixed values: how many rows each ranking keeps --------------------------
TOP_TYPES = 10
WORST_TERRITORIES = 10
WORST_PER_DEPARTMENT = 5
UNITS_PER_TERRITORY = 3
TOP_COMPLAINTS = 12
TOP_TERRITORIES = 12
# -----------------------------------------------------------------------------

_SHORT_NAME = {"regiao_administrativa": "regiao"}


def _territory(column: str) -> str:
    if column not in TERRITORY_COLUMNS:
        raise ValueError(f"not a territory column: {column}")
    return column


def _short(column: str) -> str:
    return _SHORT_NAME.get(_territory(column), column)


def kpis(m: DataFrame, built_at: dt.datetime | str | None = None) -> DataFrame:
    return kpis_filtered(m).withColumn("atualizado_em", S.build_time(built_at))


def kpis_filtered(m: DataFrame) -> DataFrame:
    """The same without a build time: a recomputation has none."""
    return m.agg(
        total("n").alias("total_chamados"),
        total("n_closed").alias("total_resolvidos"),
        total("n_open").alias("chamados_abertos"),
        on_time_rate().alias("taxa_resolucao_prazo"),
        S.mean("sum(days_sum)", "sum(days_n)", 2).alias("tempo_medio_resolucao_dias"),
    )


def kpi_response(kpi: DataFrame) -> DataFrame:
    """As answered to a reader: a missing rate shows as zero."""
    return kpi.withColumn("taxa_resolucao_prazo", F.coalesce("taxa_resolucao_prazo", F.lit(0.0)))


def backlog(m: DataFrame) -> DataFrame:
    return m.agg(
        total("n_open").alias("chamados_abertos"),
        S.mean("sum(age_sum)", "sum(age_n)", 1).alias("idade_media_aberto_dias"),
    )


def sla_breakdown(m: DataFrame) -> DataFrame:
    return m.agg(
        total("n_on_time").alias("no_prazo"),
        total("n_late").alias("fora_prazo"),
        total("n_no_deadline").alias("fechado_sem_prazo"),
        total("n_open").alias("em_aberto"),
    )


def monthly_volume(m: DataFrame) -> DataFrame:
    return (
        m.where(F.col("periodo").isNotNull())
        .groupBy("periodo")
        .agg(total("n").alias("total_chamados"), total("n_closed").alias("total_encerrados"))
        .orderBy("periodo")
    )


def by_department(m: DataFrame) -> DataFrame:
    return (
        m.where(F.col("secretaria").isNotNull())
        .groupBy("secretaria")
        .agg(total("n").alias("total_chamados"), on_time_rate().alias("taxa_resolucao_prazo"))
        .orderBy(F.desc("total_chamados"), "secretaria")
    )


def top_types(m: DataFrame) -> DataFrame:
    return (
        m.where(F.col("tipo").isNotNull())
        .groupBy("tipo", "secretaria")
        .agg(total("n").alias("total_chamados"))
        .orderBy(F.desc("total_chamados"), "tipo", "secretaria")
        .limit(TOP_TYPES)
    )


def by_category(m: DataFrame) -> DataFrame:
    return (
        m.where(F.col("categoria").isNotNull())
        .groupBy("categoria")
        .agg(total("n").alias("total_chamados"))
        .orderBy(F.desc("total_chamados"), "categoria")
    )


def _by_territory(m: DataFrame, column: str) -> DataFrame:
    return (
        m.where(F.col(_territory(column)).isNotNull())
        .groupBy(F.col(column).alias("territorio"))
        .agg(total("n").alias("total_chamados"), on_time_rate().alias("taxa_resolucao_prazo"))
    )


def worst_territories(m: DataFrame, column: str) -> DataFrame:
    """Lowest on-time rates first; territories without a rate are left out."""
    return (
        _by_territory(m, column)
        .where(F.col("taxa_resolucao_prazo").isNotNull())
        .orderBy("taxa_resolucao_prazo", F.desc("total_chamados"), "territorio")
        .limit(WORST_TERRITORIES)
    )


def top_territories(m: DataFrame, column: str) -> DataFrame:
    return (
        _by_territory(m, column)
        .orderBy(F.desc("total_chamados"), "territorio")
        .limit(TOP_TERRITORIES)
    )


def late_by_department(m: DataFrame, column: str) -> DataFrame:
    """The territories with the lowest on-time rate in each department."""
    name = _short(column)
    worst_first = (F.asc("taxa_resolucao_prazo"), F.desc("chamados_atrasados"), F.asc(name))
    place = F.row_number().over(Window.partitionBy("secretaria").orderBy(*worst_first))
    return (
        m.where(F.col(column).isNotNull() & F.col("secretaria").isNotNull())
        .groupBy(F.col(column).alias(name), "secretaria")
        .agg(total("n_late").alias("chamados_atrasados"), on_time_rate().alias("taxa_resolucao_prazo"))
        .where(F.col("taxa_resolucao_prazo").isNotNull())
        .withColumn("_place", place)
        .where(F.col("_place") <= WORST_PER_DEPARTMENT)
        .drop("_place")
        .orderBy("secretaria", *worst_first)
    )


def late_by_unit(m: DataFrame, column: str) -> DataFrame:
    """The executing units with most late requests per department and territory,
    with their share of the territory's late requests."""
    name = _short(column)
    group = Window.partitionBy("secretaria", name)
    most_first = (F.desc("chamados_atrasados"), F.asc("orgao"))
    return (
        m.where(
            F.col(column).isNotNull()
            & F.col("nome_unidade_organizacional").isNotNull()
            & (F.col("n_late") > 0)
        )
        .groupBy("secretaria", F.col(column).alias(name), F.col("nome_unidade_organizacional").alias("orgao"))
        .agg(total("n_late").alias("chamados_atrasados"))
        .withColumns(
            {
                "_all": F.sum("chamados_atrasados").over(group),
                "_place": F.row_number().over(group.orderBy(*most_first)),
            }
        )
        .withColumn("pct_do_atraso", S.pct("chamados_atrasados", "_all", 1))
        .where(F.col("_place") <= UNITS_PER_TERRITORY)
        .drop("_all", "_place")
        .orderBy("secretaria", name, *most_first)
    )


def volume_by_department(m: DataFrame, column: str) -> DataFrame:
    """Territory x department volumes in long form."""
    name = _short(column)
    return (
        m.where(F.col(column).isNotNull() & F.col("secretaria").isNotNull())
        .groupBy(F.col(column).alias(name), "secretaria")
        .agg(total("n").alias("total_chamados"))
        .orderBy(name, F.desc("total_chamados"), "secretaria")
    )


def complaints(m: DataFrame, column: str) -> DataFrame:
    """Requests with two or more complaints. Unknown counts are left out first, so a
    territory with none known is absent and one with only 0 or 1 shows zero."""
    return (
        m.where(F.col(_territory(column)).isNotNull() & (F.col("complaints_n") > 0))
        .groupBy(F.col(column).alias("territorio"))
        .agg(total("complaints_repeated").alias("com_reclamacoes_repetidas"))
        .orderBy(F.desc("com_reclamacoes_repetidas"), "territorio")
        .limit(TOP_COMPLAINTS)
    )


def freshness(m: DataFrame, built_at: dt.datetime | str | None = None) -> DataFrame:
    return m.agg(F.max("newest_partition").alias("ultima_particao")).select(
        S.build_time(built_at).alias("atualizado_em"), "ultima_particao"
    )

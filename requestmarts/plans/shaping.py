"""Chart-ready shapes of the cards."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestmarts.schema import DEPARTMENTS

# --- fixed values -------------------------------------------------------------
PIVOT_TOP = 20
WORST_POINTS = 10
TOP_CATEGORIES = 10
SLA_LABELS = {
    "no_prazo": "No prazo",
    "fora_prazo": "Fora do prazo",
    "fechado_sem_prazo": "Fechado sem prazo",
    "em_aberto": "Em aberto",
}
# ------------------------------------------------------------------------------


def department_pivot(volumes: DataFrame, territory: str) -> DataFrame:
    """One row per territory with a column per department, largest sums first."""
    pivoted = (
        volumes.groupBy(F.col(territory).alias("territorio"))
        .pivot("secretaria", list(DEPARTMENTS))
        .agg(F.sum("total_chamados"))
    )
    volume = reduce(add, (F.coalesce(F.col(d), F.lit(0)) for d in DEPARTMENTS))
    return pivoted.orderBy(volume.desc(), "territorio").limit(PIVOT_TOP)


def worst_points(worst: DataFrame) -> DataFrame:
    return (
        worst.where(F.col("taxa_resolucao_prazo").isNotNull())
        .orderBy("taxa_resolucao_prazo", F.desc("total_chamados"), "territorio")
        .limit(WORST_POINTS)
    )


def late_with_units(late: DataFrame, units: DataFrame, territory: str) -> DataFrame:
    """Late territories, each with the array of its units, most late first.

    A territory has at most three units, so the arrays stay short.
    """
    place = F.struct(
        (-F.col("chamados_atrasados")).alias("_place"),
        F.col("orgao"),
        F.col("pct_do_atraso"),
    )
    nested = units.groupBy("secretaria", territory).agg(
        F.transform(
            F.sort_array(F.collect_list(place)),
            lambda u: F.struct(u["orgao"].alias("orgao"), u["pct_do_atraso"].alias("pct_do_atraso")),
        ).alias("top_orgaos")
    )
    return late.join(nested, ["secretaria", territory], "left").select(
        F.col(territory).alias("territorio"),
        "secretaria",
        F.coalesce("chamados_atrasados", F.lit(0)).alias("chamados_atrasados"),
        F.coalesce("taxa_resolucao_prazo", F.lit(0.0)).alias("taxa_resolucao_prazo"),
        "top_orgaos",
    )


def unit_rows(nested: DataFrame) -> DataFrame:
    """The nested units as rows; a territory without units keeps one row."""
    return nested.select(
        "territorio",
        "secretaria",
        "chamados_atrasados",
        "taxa_resolucao_prazo",
        F.posexplode_outer("top_orgaos").alias("pos", "unit"),
    ).select(
        "territorio",
        "secretaria",
        "chamados_atrasados",
        "taxa_resolucao_prazo",
        (F.col("pos") + 1).cast("bigint").alias("posicao"),
        "unit.orgao",
        "unit.pct_do_atraso",
    )


def top_categories(categories: DataFrame) -> DataFrame:
    return categories.orderBy(F.desc("total_chamados"), "categoria").limit(TOP_CATEGORIES)


def sla_parts(breakdown: DataFrame) -> DataFrame:
    """One row per non-empty part of the deadline composition."""
    parts = breakdown.select(*(F.col(c).alias(label) for c, label in SLA_LABELS.items()))
    return parts.unpivot([], list(SLA_LABELS.values()), "parte", "total").where(F.col("total") > 0)

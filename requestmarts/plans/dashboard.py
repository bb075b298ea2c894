"""The whole dashboard for one filter: marts if there is none, else recomputed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from requestmarts.operators.filters import RequestFilter
from requestmarts.operators.measures import measured, rollup, territory_cube, volume_cube
from requestmarts.plans import cubes, marts, search_index
from requestmarts.schema import CARD_SCHEMAS, DEPARTMENTS
from requestmarts.sources.checkpoints import checkpointed
from requestmarts.sources.readers import DETAIL, current_build, read_mart, read_mart_or_empty

REGION, SUBPREFECTURE = "regiao_administrativa", "subprefeitura"

# Card -> function of the volume cube, or of the territory cube.
VOLUME_CARDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kpis": marts.kpis,
    "backlog": marts.backlog,
    "sla_breakdown": marts.sla_breakdown,
    "monthly_volume": marts.monthly_volume,
    "by_department": marts.by_department,
    "top_types": marts.top_types,
    "by_category": marts.by_category,
}
TERRITORY_CARDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "worst_regions": partial(marts.worst_territories, column=REGION),
    "worst_subprefectures": partial(marts.worst_territories, column=SUBPREFECTURE),
    "late_region_by_department": partial(marts.late_by_department, column=REGION),
    "late_subprefecture_by_department": partial(marts.late_by_department, column=SUBPREFECTURE),
    "late_region_by_unit": partial(marts.late_by_unit, column=REGION),
    "late_subprefecture_by_unit": partial(marts.late_by_unit, column=SUBPREFECTURE),
    "region_by_department": partial(marts.volume_by_department, column=REGION),
    "subprefecture_by_department": partial(marts.volume_by_department, column=SUBPREFECTURE),
    "complaints_by_region": partial(marts.complaints, column=REGION),
    "complaints_by_subprefecture": partial(marts.complaints, column=SUBPREFECTURE),
}

LATE_CARDS = ("late_region_by_department", "late_subprefecture_by_department")
# Cards whose answer is restricted to the departments in scope.
DEPARTMENT_CARDS = (
    "by_department",
    *LATE_CARDS,
    "late_region_by_unit",
    "late_subprefecture_by_unit",
    "region_by_department",
    "subprefecture_by_department",
)

# Cards every build has; a missing table of any other shows as an empty card.
REQUIRED_CARDS = ("kpis", "backlog", "sla_breakdown", "monthly_volume", "by_department", "top_types")


Cards = dict[str, DataFrame]

# A roll-up of at most so many rows is read by one task: the cards then shuffle nothing.
ONE_TASK_ROWS = 100_000


def in_one_task(rolled: DataFrame) -> DataFrame:
    """A stored roll-up, read by one task if it was counted to be small."""
    return rolled.coalesce(1) if rolled.count() <= ONE_TASK_ROWS else rolled


def cards_from_rollup(rolled: DataFrame) -> Cards:
    """Every card from one roll-up, without a build time.

    The roll-up is written once to checkpoint storage, so the plans of the cards begin
    there and nothing stays in executor storage.
    """
    rolled = in_one_task(checkpointed(rolled))
    volume, territory = volume_cube(rolled), territory_cube(rolled)
    cards = {card: build(volume) for card, build in VOLUME_CARDS.items() if card != "kpis"}
    cards |= {card: build(territory) for card, build in TERRITORY_CARDS.items()}
    return {"kpis": marts.kpi_response(marts.kpis_filtered(volume)), **cards}


def as_served(card: str, df: DataFrame) -> DataFrame:
    """A stored card as an answer shows it: departments in scope only, no late count is NULL."""
    if card in DEPARTMENT_CARDS:
        df = df.where(F.col("secretaria").isin(*DEPARTMENTS))
    if card in LATE_CARDS:
        df = df.withColumn("chamados_atrasados", F.coalesce("chamados_atrasados", F.lit(0).cast("bigint")))
    return marts.kpi_response(df) if card == "kpis" else df


def cards_from_marts(spark: SparkSession, database: str | None = None, build: str | None = None) -> Cards:
    """Every card of a build, the published one if none is named. The pointer is read once, so all are of one build."""
    build = build or current_build(spark, database)
    cards: Cards = {}
    for card, schema in CARD_SCHEMAS.items():
        required = card in REQUIRED_CARDS
        stored = read_mart(spark, card, build) if required else read_mart_or_empty(spark, card, schema, build)
        cards[card] = as_served(card, stored)
    return cards


def dashboard(
    detail: DataFrame,
    filt: RequestFilter,
    *,
    as_of: dt.date | str | None = None,
    database: str | None = None,
) -> Cards:
    """All cards by name. A filtered dashboard scans the given detail fact once."""
    if not filt.active:
        return cards_from_marts(detail.sparkSession, database)
    return cards_from_rollup(rollup(measured(filt.apply(detail), as_of)))


def served_dashboard(
    spark: SparkSession,
    filt: RequestFilter,
    *,
    as_of: dt.date | str | None = None,
    build: str | None = None,
    database: str | None = None,
) -> Cards:
    """All cards of a build: its marts, else the smallest of its cubes that holds the filter's
    columns, else (text that a request id may hold) the months of its detail fact that can match."""
    build = build or current_build(spark, database)
    if not filt.active:
        return cards_from_marts(spark, build=build)
    detail = read_mart(spark, DETAIL, build)
    answer = cubes.match(spark, build, filt) or search_index.cube_answer(spark, build, filt)
    if answer is None:
        return cards_from_rollup(rollup(measured(search_index.served_rows(spark, build, filt), as_of)))
    return cards_from_rollup(cubes.rolled_up(spark, build, answer, detail, as_of))


def collected(cards: dict[str, DataFrame], at_once: int = 4) -> dict[str, list[Row]]:
    """The rows of every card. Cards are independent small jobs, so several run at
    once; their rows are rankings and group totals, never requests."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(cards, pool.map(lambda df: df.collect(), cards.values())))


def long_form(cards: dict[str, DataFrame]) -> DataFrame:
    """All cards as (card, key1, key2, key3, metric, value), one row per number."""
    parts = []
    for card, df in cards.items():
        fields = [(f.name, f.dataType.typeName()) for f in df.schema.fields]
        keys = [f"cast({name} as string)" for name, kind in fields if kind in ("string", "date")]
        keys += ["cast(null as string)"] * (3 - len(keys))
        values = ", ".join(
            f"struct('{name}' as metric, cast({name} as double) as value)" for name, kind in fields if kind in ("long", "double")
        )
        named = (f"{key} as key{i}" for i, key in enumerate(keys, 1))
        parts.append(df.selectExpr(f"'{card}' as card", *named, f"inline(array({values}))"))
    return reduce(DataFrame.union, parts)

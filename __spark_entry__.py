
from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_queries
from requestmarts.operators import quality
from requestmarts.operators.enrich import (
    enrich,
    mart_requests,
    scoped_requests,
    stage_neighbourhoods,
    stage_requests,
    with_department,
)
from requestmarts.operators.filters import RequestFilter
from requestmarts.operators.measures import measured, rollup, territory_cube
from requestmarts.operators.territory import (
    TerritoryLookup,
    geo_by_id,
    geo_by_point,
    geo_pairs,
    geo_pending,
    resolve_territory,
    territory_lookup,
    unify_geo,
)
from requestmarts.plans import listing, marts, search_index, shaping
from requestmarts.plans.dashboard import (
    REGION,
    SUBPREFECTURE,
    TERRITORY_CARDS,
    VOLUME_CARDS,
    cards_from_marts,
    cards_from_rollup,
    dashboard,
    in_one_task,
    long_form,
    served_dashboard,
)
from requestmarts.plans.pipeline import build_marts, refresh_marts
from requestmarts.schema import OPENED_MONTH, REQUEST_SCHEMA
from requestmarts.sources import landing, standin
from requestmarts.sources.checkpoints import checkpointed
from requestmarts.sources.landing import (
    extract_admin_regions,
    extract_neighbourhoods,
    extract_planning_areas,
    extract_requests,
    extract_subprefectures,
)
from requestmarts.sources.readers import DETAIL, read_mart, read_neighbourhoods, read_requests, read_type_map

try:  # The training-data operators can be left out of an installation.
    from requestmarts.llm import queries as corpus_queries
except ImportError as missing:
    # Left out are the operators or the pipeline over them; anything else is a fault to be seen.
    if missing.name not in ("requestmarts.llm", "corpus_pipeline"):
        raise
    corpus_queries = None

COMMON = RequestFilter(q=" h_G ", data_inicio_from="1997-06-01", data_inicio_to="2001-06-30")
NARROW = RequestFilter(tipo="HOUSEHOLD-1", subtipo="1-URGENT", status="Fechado com solução")
LISTED = RequestFilter(secretaria="SMS", situacao="Encerrado")
DAYS = RequestFilter(tipo="HOUSEHOLD-1", data_inicio_from="1997-06-10", data_inicio_to="2000-02-20")
MONTHS = RequestFilter(data_inicio_from="1997-02-01", data_inicio_to="2000-02-29")
SOLVED = RequestFilter(q=" _SOLUÇÃO", data_inicio_from="1997-06-10", data_inicio_to="2000-02-20")
NUMBERED = RequestFilter(q="123", situacao="Encerrado")
FAR_PAGE = 10**9


@dataclass(frozen=True)
class Tables:
    """Lazy frames over one data folder. Only the small polygon grid is stored."""

    sf_dir: str
    raw: DataFrame
    staged: DataFrame
    type_map: DataFrame
    lookup: TerritoryLookup
    scoped: DataFrame
    enriched: DataFrame
    detail: DataFrame
    m: DataFrame
    m_filtered: DataFrame
    areas: DataFrame
    admin_regions: DataFrame
    planning_areas: DataFrame
    subprefectures: DataFrame


@lru_cache(maxsize=4)
def _tables(spark: SparkSession, application: str, sf_dir: str) -> Tables:
    raw = standin.requests(spark, sf_dir)
    areas = standin.neighbourhoods(spark, sf_dir)
    staged = stage_requests(raw, standin.SINCE)
    type_map = standin.type_map(spark)
    lookup = territory_lookup(stage_neighbourhoods(areas))
    enriched = enrich(staged, type_map, lookup)
    detail = mart_requests(enriched)
    return Tables(
        sf_dir=sf_dir,
        raw=raw,
        staged=staged,
        type_map=type_map,
        lookup=lookup,
        scoped=scoped_requests(staged, type_map),
        enriched=enriched,
        detail=detail,
        m=measured(detail, standin.AS_OF),
        m_filtered=measured(COMMON.apply(detail), standin.AS_OF),
        areas=areas,
        admin_regions=standin.admin_regions(spark, sf_dir),
        planning_areas=standin.planning_areas(spark, sf_dir),
        subprefectures=standin.subprefectures(spark, sf_dir),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return _tables(spark, spark.sparkContext.applicationId, sf_dir)


def _landing_requests(t: Tables) -> DataFrame:
    source = t.raw.withColumnRenamed("prazo_atendimento", "data_alvo_finalizacao")
    return extract_requests(source, standin.SINCE)


def _geo_by_point(t: Tables) -> DataFrame:
    return geo_by_point(geo_pending(t.scoped, t.lookup), t.lookup)


def _late_with_units(t: Tables, column: str, name: str) -> DataFrame:
    # Both cards read one small cube, so the requests are scanned once.
    cube = territory_cube(in_one_task(checkpointed(rollup(t.m))))
    late, units = marts.late_by_department(cube, column), marts.late_by_unit(cube, column)
    return shaping.unit_rows(shaping.late_with_units(late, units, name))


def _twice(t: Tables) -> DataFrame:
    """Requests in scope, pending ones a second time at another point and without a neighbourhood."""
    again = t.scoped.where("status = 'Pendente'").withColumns(
        {"longitude": F.expr("longitude + 1"), "id_bairro": F.lit(None).cast("string")}
    )
    return t.scoped.unionByName(again)


def _repeated_ids(t: Tables) -> DataFrame:
    return resolve_territory(_twice(t), t.lookup, unique_ids=False)


def _built(t: Tables) -> str:
    """A new build, checked and published; its folder."""
    out = f"{t.raw.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/marts"
    return build_marts(
        t.raw, t.type_map, t.areas, out, start=standin.SINCE, as_of=standin.AS_OF, built_at=standin.BUILT_AT
    )


@lru_cache(maxsize=4)
def _build_of(spark: SparkSession, application: str, sf_dir: str) -> str:
    return _built(_tables(spark, application, sf_dir))


def _build(t: Tables) -> str:
    """The build that stored queries read: made once for a session and folder."""
    spark = t.raw.sparkSession
    return _build_of(spark, spark.sparkContext.applicationId, t.sf_dir)


@lru_cache(maxsize=4)
def _refreshed_of(spark: SparkSession, application: str, sf_dir: str) -> str:
    t = _tables(spark, application, sf_dir)
    out = _new_folder(t, "refreshed")
    late, corrected = "cast(id_chamado as long) % 11 = 0", "cast(id_chamado as long) % 13 = 0"
    # As it was: late requests missing, the later corrected ones opened earlier and of another type.
    was = {"data_inicio": "data_inicio - interval 40 days", "tipo": "'HOUSEHOLD-1'", "situacao": "'Encerrado'"}
    before = t.raw.where(f"not ({late})").withColumns(
        {c: F.expr(f"case when {corrected} then {old} else {c} end") for c, old in was.items()}
    )
    stamps = {"start": standin.SINCE, "as_of": standin.AS_OF, "built_at": standin.BUILT_AT}
    build_marts(before, t.type_map, t.areas, out, **stamps | {"as_of": "2001-12-01"})
    return refresh_marts(t.raw.where(f"{late} or {corrected}"), t.type_map, t.areas, out, **stamps)


def _refreshed(t: Tables) -> str:
    """A build refreshed with late and corrected requests: made once for a session and folder."""
    spark = t.raw.sparkSession
    return _refreshed_of(spark, spark.sparkContext.applicationId, t.sf_dir)


def _without_build_time(cards: dict[str, DataFrame]) -> DataFrame:
    return long_form({**cards, "kpis": cards["kpis"].drop("atualizado_em")})


def _new_folder(t: Tables, name: str) -> str:
    return f"{t.raw.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _sources(t: Tables) -> dict[str, DataFrame]:
    """The five tables as a warehouse names their columns."""
    return {
        "chamado": t.raw.withColumnRenamed("prazo_atendimento", "data_alvo_finalizacao"),
        "bairro": t.areas,
        "regiao_administrativa": t.admin_regions,
        "area_planejamento": t.planning_areas,
        "subprefeitura": t.subprefectures,
    }


def _landing_plan(t: Tables) -> DataFrame:
    """Reports of landing all tables, and of landing them again."""
    out, spark = _new_folder(t, "landed"), t.raw.sparkSession
    reports = [(run, *r) for run in (1, 2) for r in landing.land_all(_sources(t), out, standin.SINCE).collect()]
    return spark.createDataFrame(reports, "run int, table string, rows long, skipped boolean")


@lru_cache(maxsize=4)
def _landed_in(spark: SparkSession, application: str, sf_dir: str) -> str:
    t = _tables(spark, application, sf_dir)
    out = _new_folder(t, "landed")
    landing.land_all(_sources(t), out, standin.SINCE)
    return out


def _landed(t: Tables) -> str:
    """Folder of the landed tables: made once for a session and folder."""
    spark = t.raw.sparkSession
    return _landed_in(spark, spark.sparkContext.applicationId, t.sf_dir)


def _with_csv_department(t: Tables) -> DataFrame:
    """Departments by a type map that was written as CSV and read as the seed is."""
    out = _new_folder(t, "type_map")
    seed = t.type_map.selectExpr("tipo", "secretaria", "'alta, \"média\"' as confianca", "cast(null as string) as notas")
    seed.write.csv(out, header=True, escape='"')
    return with_department(t.staged, read_type_map(t.raw.sparkSession, out))


def _exported_csv(t: Tables) -> DataFrame:
    """The written export, read back as text."""
    out = _new_folder(t, "export")
    listing.export_requests(t.detail, LISTED, out)
    return t.raw.sparkSession.read.csv(out, header=True, escape='"')


def _from_marts(t: Tables) -> DataFrame:
    """The dashboard as served: built, checked, published and read back."""
    _built(t)
    return _without_build_time(dashboard(t.detail, RequestFilter()))


def _served(t: Tables, filt: RequestFilter) -> DataFrame:
    return long_form(served_dashboard(t.raw.sparkSession, filt, as_of=standin.AS_OF, build=_build(t)))


def _served_page(t: Tables, filt: RequestFilter, *page: int | str) -> DataFrame:
    return listing.served_page(t.raw.sparkSession, filt, *page, build=_build(t), direct_rows=500)


def _contract(t: Tables) -> DataFrame:
    """The declared checks over the tables of a build."""
    stored = partial(read_mart, t.raw.sparkSession, build=_build(t))
    detail = stored(DETAIL)
    checked = ("by_department", "kpis", "monthly_volume", "top_types")
    return quality.run_contract(
        {"stg_chamado": t.staged, "int_chamados_enriched": detail, "mart_chamados": detail}
        | {f"mart_{table}": stored(table) for table in checked}
    )


_FILTERED_NAME = {"sla_breakdown": "sla", "monthly_volume": "monthly"}


def _queries() -> dict[str, Callable[[Tables], DataFrame]]:
    out: dict[str, Callable[[Tables], DataFrame]] = {}
    for name, card in {**VOLUME_CARDS, **TERRITORY_CARDS}.items():
        if name == "kpis":
            out["kpis"] = lambda t: marts.kpis(t.m, standin.BUILT_AT)
            out["kpis_filtered"] = lambda t: marts.kpis_filtered(t.m_filtered)
            continue
        out[name] = lambda t, card=card: card(t.m)
        out[f"{_FILTERED_NAME.get(name, name)}_filtered"] = lambda t, card=card: card(t.m_filtered)
    out |= {
        "landing_requests": _landing_requests,
        "landing_neighbourhoods": lambda t: extract_neighbourhoods(t.areas),
        "landing_admin_regions": lambda t: extract_admin_regions(t.admin_regions),
        "landing_planning_areas": lambda t: extract_planning_areas(t.planning_areas),
        "landing_subprefectures": lambda t: extract_subprefectures(t.subprefectures),
        "landing_plan": _landing_plan,
        "landed_requests": lambda t: stage_requests(
            read_requests(t.raw.sparkSession, f"{_landed(t)}/chamado.parquet"), standin.SINCE
        ),
        "landed_neighbourhoods": lambda t: read_neighbourhoods(t.raw.sparkSession, f"{_landed(t)}/bairro.parquet"),
        "type_map_csv": _with_csv_department,
        "staged_requests": lambda t: t.staged,
        "with_department": lambda t: with_department(t.staged, t.type_map),
        "geo_by_id": lambda t: geo_by_id(t.scoped, t.lookup),
        "geo_pending": lambda t: geo_pending(t.scoped, t.lookup),
        "geo_pairs": lambda t: geo_pairs(geo_pending(t.scoped, t.lookup), t.lookup),
        "geo_by_point": _geo_by_point,
        "geo_unified": lambda t: unify_geo(geo_by_id(t.scoped, t.lookup), _geo_by_point(t)),
        "enriched": lambda t: t.enriched,
        "enriched_by_request": lambda t: resolve_territory(t.scoped, t.lookup, unique_ids=False),
        "enriched_repeated_ids": _repeated_ids,
        "detail_fact": lambda t: t.detail,
        "freshness": lambda t: marts.freshness(t.m, standin.BUILT_AT),
        "top_territories_by_volume": lambda t: marts.top_territories(t.m_filtered, "area_planejamento"),
        "kpi_response": lambda t: marts.kpi_response(
            marts.kpis_filtered(measured(RequestFilter(q="__nenhum__").apply(t.detail)))
        ),
        "kpi_response_filtered": lambda t: marts.kpi_response(marts.kpis_filtered(t.m_filtered)),
        "dashboard": lambda t: long_form(cards_from_rollup(rollup(t.m))),
        "dashboard_department": lambda t: _served(t, RequestFilter(secretaria="SMS")),
        "dashboard_cube_days": lambda t: _served(t, DAYS),
        "dashboard_served_search": lambda t: _served(t, COMMON),
        "dashboard_search_cube": lambda t: _served(t, SOLVED),
        "dashboard_from_marts": _from_marts,
        "dashboard_refreshed": lambda t: _without_build_time(cards_from_marts(t.raw.sparkSession, build=_refreshed(t))),
        "detail_refreshed": lambda t: read_mart(t.raw.sparkSession, DETAIL, _refreshed(t)).drop(OPENED_MONTH),
        "list_page_refreshed": lambda t: listing.served_page(
            t.raw.sparkSession, RequestFilter(), 31, 100, build=_refreshed(t), direct_rows=500
        ),
        "dashboard_filtered": lambda t: long_form(dashboard(t.detail, COMMON, as_of=standin.AS_OF)),
        "search_text": lambda t: RequestFilter(q=" SOLUÇÃO ").apply(t.detail),
        "search_stored": lambda t: search_index.served_rows(t.raw.sparkSession, _build(t), SOLVED).drop(OPENED_MONTH),
        "search_stored_ids": lambda t: search_index.served_rows(t.raw.sparkSession, _build(t), NUMBERED).drop(OPENED_MONTH),
        "list_page": lambda t: listing.list_page(t.detail, RequestFilter()),
        "list_page_sorted": lambda t: listing.list_page(t.detail, LISTED, 3, 50, "data_fim", "asc"),
        "list_page_middle": lambda t: _served_page(t, RequestFilter(), 31, 100),
        "list_page_months": lambda t: _served_page(t, MONTHS, 9, 100, "status", "asc"),
        "list_page_narrowed": lambda t: listing.list_page(t.detail, LISTED, 12, 50, "tipo", direct_rows=500),
        "list_filtered": lambda t: listing.export_rows(t.detail, NARROW),
        "list_page_beyond": lambda t: listing.list_page(t.detail, LISTED, FAR_PAGE, 100, "status"),
        "page_info": lambda t: listing.page_info(t.detail, LISTED, FAR_PAGE),
        "export": lambda t: listing.export_rows(t.detail, LISTED),
        "export_csv": _exported_csv,
        "distinct_values": lambda t: listing.distinct_values(t.detail, "tipo", LISTED),
        "filter_options": lambda t: listing.filter_options(t.detail, LISTED),
        "filter_options_stored": lambda t: listing.served_options(t.raw.sparkSession, DAYS, build=_build(t)),
        "filter_options_search": lambda t: listing.served_options(t.raw.sparkSession, NUMBERED, build=_build(t)),
        "distinct_values_stored": lambda t: listing.served_values(t.raw.sparkSession, "subtipo", SOLVED, build=_build(t)),
        "region_pivot": lambda t: shaping.department_pivot(marts.volume_by_department(t.m, REGION), "regiao"),
        "subprefecture_pivot": lambda t: shaping.department_pivot(
            marts.volume_by_department(t.m, SUBPREFECTURE), SUBPREFECTURE
        ),
        "worst_prazo_points": lambda t: shaping.worst_points(marts.worst_territories(t.m, REGION)),
        "worst_prazo_points_subprefecture": lambda t: shaping.worst_points(
            marts.worst_territories(t.m, SUBPREFECTURE)
        ),
        "late_regions_with_units": lambda t: _late_with_units(t, REGION, "regiao"),
        "late_subprefectures_with_units": lambda t: _late_with_units(t, SUBPREFECTURE, SUBPREFECTURE),
        "top_categories": lambda t: shaping.top_categories(marts.by_category(t.m)),
        # There are three categories; the types as categories are more than the list holds.
        "top_categories_cut": lambda t: shaping.top_categories(
            marts.by_category(t.m.withColumn("categoria", F.col("tipo")))
        ),
        "sla_parts": lambda t: shaping.sla_parts(marts.sla_breakdown(t.m)),
        "dq_unique": lambda t: quality.check_unique(t.staged, ["id_bairro", "tipo"]),
        "dq_unique_ids": lambda t: quality.check_unique(_twice(t), ["id_chamado"]),
        "dq_not_null": lambda t: quality.check_not_null(t.staged, REQUEST_SCHEMA.fieldNames()),
        "dq_accepted": lambda t: quality.check_accepted(
            with_department(t.staged, t.type_map), "secretaria", quality.DEPARTMENTS
        ),
        "dq_contract": _contract,
    }
    return out


def _run(build: Callable[[Tables], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(tables(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """Late requests by executing unit: enrichment, point fallback, ranking and share."""
    return queries()["late_region_by_unit"](spark, "/root/testdata/sf0.001")


def request_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries over service requests."""
    return {name: partial(_run, build) for name, build in _queries().items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """(spark, folder of the test tables) -> frame, for every operator."""
    return request_queries() | (corpus_queries.queries() if corpus_queries else {})


def oracle_sql() -> dict[str, str]:
    """The same queries as DuckDB SQL over the test tables."""
    return oracle_queries.oracle_sql() | (corpus_queries.oracle_sql() if corpus_queries else {})

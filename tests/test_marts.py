from __future__ import annotations

import pytest

import __spark_entry__ as entry
from requestmarts.operators.filters import RequestFilter
from requestmarts.operators.measures import measured, rollup, territory_cube, volume_cube
from requestmarts.plans import marts, shaping
from requestmarts.plans.dashboard import TERRITORY_CARDS, VOLUME_CARDS, cards_from_rollup
from requestmarts.schema import CARD_SCHEMAS
from requestmarts.sources import standin
from tests import helpers as H

REGION = "regiao_administrativa"
CLOSED = {"data_fim": "2024-03-12 00:00:00", "dias_resolucao": 2}
ON_TIME = {**CLOSED, "prazo_atendimento": "2024-03-13 00:00:00", "resolvido_no_prazo": "true"}
LATE = {**CLOSED, "prazo_atendimento": "2024-03-11 00:00:00"}


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return entry.tables(spark, sf_dir)


@pytest.fixture(scope="module")
def m(tables):
    return tables.m.cache()


@pytest.fixture(scope="module")
def rolled(m):
    return rollup(m).cache()


def test_known_totals(m):
    got = marts.kpis_filtered(m).first().asDict()
    assert got == {
        "total_chamados": 7306,
        "total_resolvidos": 4877,
        "chamados_abertos": 2429,
        "taxa_resolucao_prazo": 44.29,
        "tempo_medio_resolucao_dias": 15.08,
    }


def test_sla_parts_sum_to_the_total(m):
    assert sum(marts.sla_breakdown(m).first()) == 7306


@pytest.mark.parametrize("card", [*VOLUME_CARDS, *TERRITORY_CARDS])
def test_rollup_gives_the_same_card(card, m, rolled):
    build = {**VOLUME_CARDS, **TERRITORY_CARDS}[card]
    cube = volume_cube(rolled) if card in VOLUME_CARDS else territory_cube(rolled)
    direct, pre_aggregated = build(m), build(cube)
    if card == "kpis":
        direct, pre_aggregated = direct.drop("atualizado_em"), pre_aggregated.drop("atualizado_em")
    assert [tuple(r) for r in direct.collect()] == [tuple(r) for r in pre_aggregated.collect()]
    assert direct.count() > 0


@pytest.mark.parametrize("card", [*VOLUME_CARDS, *TERRITORY_CARDS])
def test_card_has_its_contract_schema(card, m):
    built = {**VOLUME_CARDS, **TERRITORY_CARDS}[card](m)
    want = [(f.name, f.dataType) for f in CARD_SCHEMAS[card].fields]
    assert [(f.name, f.dataType) for f in built.schema.fields] == want


def test_empty_filter_equals_the_mart(tables, m):
    same = measured(RequestFilter().apply(tables.detail), standin.AS_OF)
    assert H.rows_of(marts.late_by_unit(same, REGION)) == H.rows_of(marts.late_by_unit(m, REGION))
    assert H.rows_of(marts.kpis_filtered(same)) == H.rows_of(marts.kpis_filtered(m))


def test_impossible_search_gives_zeros_and_empty_lists(tables):
    nothing = RequestFilter(q="__id_inexistente_xyz__").apply(tables.detail)
    cards = cards_from_rollup(rollup(measured(nothing, standin.AS_OF)))
    assert cards["kpis"].first().asDict() == {
        "total_chamados": 0,
        "total_resolvidos": 0,
        "chamados_abertos": 0,
        "taxa_resolucao_prazo": 0.0,
        "tempo_medio_resolucao_dias": None,
    }
    assert tuple(cards["sla_breakdown"].first()) == (0, 0, 0, 0)
    assert tuple(cards["backlog"].first()) == (0, None)
    for card in ("monthly_volume", "by_department", "worst_regions", "late_region_by_unit"):
        assert cards[card].count() == 0


def test_department_filter_shows_only_that_department(tables):
    rows = marts.by_department(measured(RequestFilter(secretaria="SMS").apply(tables.detail))).collect()
    assert [r["secretaria"] for r in rows] == ["SMS"]
    assert rows[0]["total_chamados"] > 0


def test_rate_leaves_out_closed_without_deadline(spark):
    m = measured(H.detail(spark, [ON_TIME, LATE, LATE, CLOSED, {}]), "2024-03-20")
    kpi = marts.kpis_filtered(m).first()
    assert (kpi["total_chamados"], kpi["taxa_resolucao_prazo"]) == (5, 33.33)
    assert tuple(marts.sla_breakdown(m).first()) == (1, 2, 1, 1)
    assert tuple(marts.backlog(m).first()) == (1, 10.0)


def test_no_deadline_at_all_is_a_null_rate_shown_as_zero(spark):
    kpi = marts.kpis_filtered(measured(H.detail(spark, [CLOSED, {}])))
    assert kpi.first()["taxa_resolucao_prazo"] is None
    assert marts.kpi_response(kpi).first()["taxa_resolucao_prazo"] == 0.0


def test_open_without_start_is_in_the_backlog_but_has_no_age(spark):
    m = measured(H.detail(spark, [{"data_inicio": None}, {}]), "2024-03-11")
    assert tuple(marts.backlog(m).first()) == (2, 1.0)
    assert marts.monthly_volume(m).count() == 1


def test_complaints_drop_unknown_counts_first(spark):
    rows = [
        {REGION: "só nulos"},
        {REGION: "zero", "reclamacoes": 0},
        {REGION: "zero", "reclamacoes": 1},
        {REGION: "dois", "reclamacoes": 2},
        {REGION: "dois", "reclamacoes": 5},
        {REGION: "dois"},
        {"reclamacoes": 9},
    ]
    m = measured(H.detail(spark, rows))
    for frame in (m, territory_cube(rollup(m))):
        assert [tuple(r) for r in marts.complaints(frame, REGION).collect()] == [("dois", 2), ("zero", 0)]


def test_three_units_per_territory_ties_by_name(spark):
    rows = [
        {**LATE, REGION: "R", "nome_unidade_organizacional": unit}
        for unit in ("d", "c", "b", "a", "a", None)
    ] + [{**ON_TIME, REGION: "R", "nome_unidade_organizacional": "z"}] * 5
    got = marts.late_by_unit(measured(H.detail(spark, rows)), REGION).collect()
    assert [(r["orgao"], r["chamados_atrasados"], r["pct_do_atraso"]) for r in got] == [
        ("a", 2, 40.0), ("b", 1, 20.0), ("c", 1, 20.0),
    ]


def test_worst_territories_need_a_rate(spark):
    rows = [{**LATE, REGION: "b"}, {**LATE, REGION: "a"}, {**ON_TIME, REGION: "c"}, {**CLOSED, REGION: "d"}, LATE]
    m = measured(H.detail(spark, rows))
    got = [(r["territorio"], r["taxa_resolucao_prazo"]) for r in marts.worst_territories(m, REGION).collect()]
    assert got == [("a", 0.0), ("b", 0.0), ("c", 100.0)]
    assert [r["territorio"] for r in marts.top_territories(m, REGION).collect()] == ["a", "b", "c", "d"]


def test_unknown_territory_column_is_refused(m):
    with pytest.raises(ValueError):
        marts.worst_territories(m, "nome")


def test_detail_without_newer_columns_has_empty_cards(spark):
    old = H.detail(spark, [LATE]).drop("reclamacoes", "subprefeitura", "categoria")
    cards = cards_from_rollup(rollup(measured(old)))
    for card in ("by_category", "worst_subprefectures", "complaints_by_region", "subprefecture_by_department"):
        assert cards[card].count() == 0
    assert cards["kpis"].first()["total_chamados"] == 1


def test_pivot_keeps_missing_departments_null(spark):
    volumes = spark.createDataFrame(
        [("A", "SMS", 5), ("B", "SME", 3), ("B", "SMAS", 4)], "regiao string, secretaria string, total_chamados bigint"
    )
    got = [tuple(r) for r in shaping.department_pivot(volumes, "regiao").collect()]
    assert got == [("B", None, 3, 4), ("A", 5, None, None)]


def test_late_territory_without_units_has_no_array(spark):
    late = spark.createDataFrame(
        [("R", "SMS", 4, 10.0), ("Q", "SMS", None, None)],
        "regiao string, secretaria string, chamados_atrasados bigint, taxa_resolucao_prazo double",
    )
    units = spark.createDataFrame(
        [("SMS", "R", "b", 1, 25.0), ("SMS", "R", "a", 1, 25.0), ("SMS", "R", "c", 2, 50.0)],
        "secretaria string, regiao string, orgao string, chamados_atrasados bigint, pct_do_atraso double",
    )
    nested = {r["territorio"]: r for r in shaping.late_with_units(late, units, "regiao").collect()}
    assert [u["orgao"] for u in nested["R"]["top_orgaos"]] == ["c", "a", "b"]
    assert nested["Q"]["top_orgaos"] is None
    assert (nested["Q"]["chamados_atrasados"], nested["Q"]["taxa_resolucao_prazo"]) == (0, 0.0)


def test_empty_parts_of_the_composition_are_dropped(spark):
    breakdown = spark.createDataFrame([(3, 0, 0, 2)], "no_prazo bigint, fora_prazo bigint, fechado_sem_prazo bigint, em_aberto bigint")
    assert H.rows_of(shaping.sla_parts(breakdown)) == [("Em aberto", 2), ("No prazo", 3)]

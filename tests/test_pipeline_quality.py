from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from requestmarts.operators import quality
from requestmarts.operators.enrich import stage_requests
from requestmarts.operators.filters import RequestFilter
from requestmarts.plans.dashboard import REQUIRED_CARDS, as_served, collected, dashboard
from requestmarts.plans import listing
from requestmarts.plans.pipeline import ContractError, _clustered, build_marts
from requestmarts.schema import CARD_SCHEMAS, DETAIL_SCHEMA, OPENED_MONTH
from requestmarts.sources import landing, pointers, readers, standin
from tests import helpers as H


@pytest.fixture(scope="module")
def sources(spark, sf_dir):
    """The five warehouse tables under their source column names."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    return {
        "chamado": standin.requests(spark, sf_dir)
        .withColumnRenamed("prazo_atendimento", "data_alvo_finalizacao")
        .withColumn("coluna_extra", F.lit(1)),
        "bairro": standin.neighbourhoods(spark, sf_dir).withColumn("area", F.lit(1.0)),
        "regiao_administrativa": nation.select(
            F.col("n_nationkey").alias("id_regiao_administrativa"),
            F.col("n_name").alias("nome"),
            F.col("n_regionkey").alias("id_area_planejamento_sms"),
            "n_regionkey",
        ),
        "area_planejamento": region.select(
            F.col("r_regionkey").cast("string").alias("id_area_planejamento"),
            F.col("r_regionkey").alias("id_area_planejamento_numerico"),
            F.lit("POLYGON EMPTY").alias("geometry_wkt"),
        ),
        "subprefeitura": region.select(
            F.col("r_name").alias("subprefeitura"),
            F.lit(1.0).alias("area"),
            F.lit(2.0).alias("perimetro"),
            F.lit("POLYGON EMPTY").alias("geometry_wkt"),
        ),
    }


def test_land_all_then_build_then_serve(spark, sources, tmp_path):
    raw = str(tmp_path / "raw")
    report = {r["table"]: (r["rows"], r["skipped"]) for r in landing.land_all(sources, raw, standin.SINCE).collect()}
    assert report == {
        "regiao_administrativa": (25, False),
        "area_planejamento": (5, False),
        "subprefeitura": (5, False),
        "bairro": (25, False),
        "chamado": (10479, False),
    }
    again = landing.land_all(sources, raw, standin.SINCE).collect()
    assert all(r["skipped"] and r["rows"] is None for r in again)

    landed = readers.read_requests(spark, f"{raw}/chamado.parquet")
    assert set(landed.columns) == {*landing.REQUEST_SCHEMA.fieldNames(), landing.MONTH_COLUMN}
    assert landed.count() == 10479
    cut = stage_requests(landed, "2000-01-01")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes_particao" in plan
    assert cut.count() == stage_requests(landed.drop(landing.MONTH_COLUMN), "2000-01-01").count()

    seed = tmp_path / "seed.csv"
    rows = "\n".join(f'{t},{d},alta,"nota, com vírgula"' for t, d in standin.TYPE_TO_DEPARTMENT)
    seed.write_text(f"tipo,secretaria,confianca,notas\n{rows}\n", encoding="utf-8")
    seeds = readers.read_type_map(spark, str(seed))
    assert seeds.count() == 16 and seeds.first()["notas"] == "nota, com vírgula"

    build = build_marts(
        landed,
        seeds,
        readers.read_neighbourhoods(spark, f"{raw}/bairro.parquet"),
        str(tmp_path / "marts"),
        start=standin.SINCE,
        as_of=standin.AS_OF,
        built_at=standin.BUILT_AT,
    )
    detail = readers.read_mart(spark, "chamados")
    own = [f for f in detail.schema.fields if f.name != OPENED_MONTH]
    assert [(f.name, f.dataType) for f in own] == [(f.name, f.dataType) for f in DETAIL_SCHEMA.fields]
    assert detail.count() == 7306
    unfiltered = dashboard(detail, RequestFilter())
    assert set(unfiltered) == set(CARD_SCHEMAS)
    for card, df in unfiltered.items():
        assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in CARD_SCHEMAS[card].fields]
    kpi = unfiltered["kpis"].first()
    assert (kpi["total_chamados"], kpi["taxa_resolucao_prazo"]) == (7306, 44.29)
    assert str(kpi["atualizado_em"]) == standin.BUILT_AT
    assert readers.read_mart(spark, "freshness").count() == 1

    # A blank search is active, so it recomputes, and must give the marts' numbers.
    recomputed = dashboard(detail, RequestFilter(q=" "), as_of=standin.AS_OF)
    unfiltered["kpis"] = unfiltered["kpis"].drop("atualizado_em")
    assert collected(recomputed) == collected(unfiltered)

    checks = quality.run_contract(
        {
            "stg_chamado": stage_requests(landed, standin.SINCE),
            "int_chamados_enriched": detail,
            **{f"mart_{t}": readers.read_mart(spark, t) for t in ("chamados", "by_department", "kpis", "monthly_volume", "top_types")},
        }
    ).collect()
    assert len(checks) == 15 and all(r["failures"] == 0 for r in checks)

    # A second build replaces what the names show and leaves the first in place.
    second = build_marts(
        landed.limit(0), seeds, readers.read_neighbourhoods(spark, f"{raw}/bairro.parquet"),
        str(tmp_path / "marts"), start=standin.SINCE, as_of=standin.AS_OF,
    )
    assert second != build
    assert readers.read_mart(spark, "kpis").first()["total_chamados"] == 0
    assert spark.read.parquet(f"{build}/kpis").first()["total_chamados"] == 7306


def test_landing_stops_at_the_first_failure(spark, sources, tmp_path):
    broken = {**sources, "subprefeitura": sources["subprefeitura"].withColumn("area", F.raise_error(F.lit("boom")))}
    with pytest.raises(Exception, match="boom"):
        landing.land_all(broken, str(tmp_path))
    assert landing.is_landed(spark, f"{tmp_path}/area_planejamento.parquet")
    assert not landing.is_landed(spark, f"{tmp_path}/subprefeitura.parquet")
    assert not landing.is_landed(spark, f"{tmp_path}/bairro.parquet")


def test_missing_source_is_named(sources, tmp_path):
    with pytest.raises(ValueError, match="bairro"):
        landing.land_all({k: v for k, v in sources.items() if k != "bairro"}, str(tmp_path))


def test_a_build_that_breaks_the_contract_is_not_published(spark, sources, tmp_path):
    def build(requests, database=None, **options):
        return build_marts(
            requests, standin.type_map(spark), sources["bairro"], str(tmp_path / "marts"), start=standin.SINCE, as_of=standin.AS_OF, **options
        )

    raw = sources["chamado"].withColumnRenamed("data_alvo_finalizacao", "prazo_atendimento")
    good = build(raw)
    assert readers.current_build(spark) == good == readers.current_build(spark, folder=str(tmp_path / "marts"))
    twice = raw.unionByName(raw.where("status = 'Pendente'"))
    with pytest.raises(ValueError, match="repeat"):
        build(twice)
    with pytest.raises(ContractError, match="id_chamado unique"):
        build(twice, unique_ids=False)
    with pytest.raises(ContractError, match="id_chamado not_null"):
        build(raw.withColumn("id_chamado", F.expr("nullif(id_chamado, '1')")), unique_ids=False)
    assert readers.current_build(spark) == good
    spark.sql("drop view mart_build")
    # A session without the view finds the build by its folder.
    assert readers.current_build(spark) is None
    assert readers.current_build(spark.newSession(), folder=str(tmp_path / "marts")) == good


def test_pointers_are_versions_of_which_the_last_whole_one_counts(spark, tmp_path):
    out = str(tmp_path / "builds")
    assert pointers.current(spark, out) is None
    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(lambda i: pointers.publish(spark, out, f"{out}/build={i}"), range(8)))
    assert len(set(names)) == 8
    assert pointers.current(spark, out) == f"{out}/build={names.index(max(names))}"
    (tmp_path / "builds" / pointers.FOLDER / f"{9:010d}-torn").write_text('{"build": "/half/writ')
    assert pointers.current(spark, out) == f"{out}/build={names.index(max(names))}"
    assert pointers.publish(spark, out, "next") > max(names) and pointers.current(spark, out) == "next"


def test_served_cards_hold_departments_in_scope_and_no_null_counts(spark):
    late = CARD_SCHEMAS["late_region_by_department"]
    stored = spark.createDataFrame([("A", "SMS", None, None), ("B", "Outros", 3, 1.0), ("C", None, 3, 1.0)], late)
    served = as_served("late_region_by_department", stored)
    assert served.schema.fieldNames() == late.fieldNames()
    assert H.rows_of(served) == [("A", "SMS", 0, None)]
    types = spark.createDataFrame([("t", "Outros", 1)], CARD_SCHEMAS["top_types"])
    assert as_served("top_types", types).count() == 1


def test_stored_detail_is_pruned_by_month_and_keeps_rows_without_a_date(spark, tmp_path):
    days = ["2024-01-31 23:59:59", "2024-02-01 00:00:00", "2024-03-05 10:00:00", None]
    rows = H.detail(spark, [{"data_inicio": d} for d in days])
    _clustered(rows).write.partitionBy(OPENED_MONTH).parquet(str(tmp_path / "detail"))
    stored = spark.read.parquet(str(tmp_path / "detail"))
    assert stored.count() == 4
    filt = RequestFilter(data_inicio_from="2024-02-01", data_inicio_to="2024-03-05")
    for df in (filt.apply(stored), listing.export_rows(stored, filt)):
        assert f"PartitionFilters: [isnotnull({OPENED_MONTH}" in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 2
    assert H.rows_of(filt.apply(stored).select("id_chamado")) == H.rows_of(filt.apply(rows).select("id_chamado"))


def test_missing_mart_is_empty_only_where_allowed(spark, tmp_path):
    empty = readers.read_mart_or_empty(spark, "nunca_feita", CARD_SCHEMAS["by_category"], str(tmp_path))
    assert empty.count() == 0 and empty.schema == CARD_SCHEMAS["by_category"]
    with pytest.raises(LookupError, match="nunca_feita"):
        readers.read_mart(spark, "nunca_feita", str(tmp_path))
    with pytest.raises(LookupError, match="no build"):
        readers.read_mart(spark, "kpis", database="sem_marts")
    assert "by_category" not in REQUIRED_CARDS


def test_checks_find_what_offends(spark):
    df = H.detail(
        spark,
        [{"id_chamado": "a"}, {"id_chamado": "a"}, {"id_chamado": None}, {"id_chamado": None}, {"secretaria": "X"}, {"secretaria": None}],
    )
    assert H.rows_of(quality.check_unique(df, ["id_chamado"])) == [("a", 2)]
    assert H.rows_of(quality.check_not_null(df, ["id_chamado", "secretaria"])) == [("id_chamado", 2), ("secretaria", 1)]
    assert H.rows_of(quality.check_accepted(df, "secretaria", ["SMS"])) == [("X", 1)]


def test_contract_counts_failures(spark):
    bad = H.detail(
        spark,
        [{"id_chamado": "a"}, {"id_chamado": "a"}, {"id_chamado": None}, {"secretaria": "X"}, {"secretaria": "X"}, {"data_particao": None}],
    )
    good = {
        "mart_by_department": "secretaria string",
        "mart_kpis": "total_chamados bigint",
        "mart_monthly_volume": "periodo date, total_chamados bigint",
        "mart_top_types": "tipo string",
    }
    tables = {t: bad for t in ("stg_chamado", "int_chamados_enriched", "mart_chamados")}
    tables |= {t: spark.createDataFrame([], s) for t, s in good.items()}
    failed = {(r["table"], r["column"], r["check"]): r["failures"] for r in quality.run_contract(tables).collect()}
    assert len(failed) == 15
    assert failed["stg_chamado", "id_chamado", "unique"] == 1
    assert failed["stg_chamado", "id_chamado", "not_null"] == 1
    assert failed["stg_chamado", "data_particao", "not_null"] == 1
    assert failed["int_chamados_enriched", "secretaria", "accepted_values"] == 1
    assert failed["int_chamados_enriched", "secretaria", "not_null"] == 0
    assert failed["mart_by_department", "secretaria", "accepted_values"] == 0

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from requestmarts.functions import semantics as S
from requestmarts.operators.enrich import (
    in_scope,
    scoped_requests,
    since,
    stage_neighbourhoods,
    stage_requests,
    with_deadline_metrics,
    with_department,
)
from requestmarts.operators.measures import measured
from tests import helpers as H


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_scales_the_double(spark):
    values = [1.005, 2.675, 0.125, -0.125, 2.5, 1e15 + 0.3, 33.333333]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.selectExpr(S.round_half_away("v", 2)).collect()]
    want = [math.copysign(math.floor(abs(v) * 100 + 0.5), v) / 100 for v in values]
    assert got == want
    assert got[0] == 1.0


def test_percentage_is_null_on_zero_and_a_double(spark):
    assert one(spark, S.pct("1", "0", 2)) is None
    assert one(spark, S.pct("1", "3", 2)) == 33.33
    assert one(spark, S.pct("2", "3", 1)) == 66.7


def test_days_count_calendar_days_and_may_be_negative(spark):
    df = H.requests(
        spark,
        [
            {"data_inicio": "2024-03-10 23:59:00", "data_fim": "2024-03-11 00:01:00"},
            {"data_inicio": "2024-03-10 00:01:00", "data_fim": "2024-03-10 23:59:00"},
            {"data_inicio": "2024-03-10 00:00:00", "data_fim": "2024-03-08 12:00:00"},
            {"data_fim": None},
            {"data_inicio": None, "data_fim": "2024-03-08 12:00:00"},
        ],
    )
    out = with_deadline_metrics(df).orderBy("id_chamado")
    assert [r["dias_resolucao"] for r in out.collect()] == [1, 0, -2, None, None]
    assert dict(out.dtypes)["dias_resolucao"] == "bigint"


def test_on_time_is_never_null(spark):
    df = H.requests(
        spark,
        [
            {"data_fim": "2024-03-12 10:00:00", "prazo_atendimento": "2024-03-12 10:00:00"},
            {"data_fim": "2024-03-12 10:00:01", "prazo_atendimento": "2024-03-12 10:00:00"},
            {"data_fim": "2024-03-12 10:00:00"},
            {"prazo_atendimento": "2024-03-12 10:00:00"},
        ],
    )
    out = with_deadline_metrics(df)
    late = measured(out.withColumn("secretaria", F.lit("SMS"))).select("n_late")
    on_time = [r["resolvido_no_prazo"] for r in out.orderBy("id_chamado").collect()]
    assert on_time == [True, False, False, False]
    assert sorted(r["n_late"] for r in late.collect()) == [0, 0, 0, 1]


def test_unmapped_types_are_out_of_scope(spark):
    df = H.requests(spark, [{"tipo": t} for t in ("Vacina", "Creche", "Poda", "?", None)])
    out = with_department(df, H.type_map(spark))
    got = {r["tipo"]: r["secretaria"] for r in out.collect()}
    assert got == {"Vacina": "SMS", "Creche": "SME", "Poda": "Outros", "?": "Outros", None: "Outros"}
    assert in_scope(out).count() == 2


def test_repeated_type_fans_out(spark):
    twice = H.type_map(spark).union(spark.createDataFrame([("Vacina", "SME")], "tipo string, secretaria string"))
    df = H.requests(spark, [{"tipo": "Vacina"}])
    assert {r["secretaria"] for r in with_department(df, twice).collect()} == {"SMS", "SME"}


def test_shuffled_type_lookup_gives_the_same(spark):
    df = H.requests(spark, [{"tipo": t} for t in ("Vacina",) * 30 + ("Creche", "Poda", "?", None)])
    small, large = (
        scoped_requests(df, H.type_map(spark), max_broadcast_bytes=limit) for limit in (1 << 20, 0)
    )
    assert H.rows_of(small) == H.rows_of(large)


def test_partition_cut_drops_null_dates(spark):
    df = H.requests(spark, [{"data_particao": d} for d in ("2022-12-31", "2023-01-01", None)])
    assert [r["data_particao"].isoformat() for r in since(df).collect()] == ["2023-01-01"]


def test_staging_casts_text_and_fails_on_bad_values(spark):
    raw = H.requests(spark, [{"reclamacoes": 3, "longitude": "-43.2"}])
    text = raw.select(*(F.col(c).cast("string").alias(c) for c in raw.columns))
    staged = stage_requests(text)
    assert staged.schema == raw.schema
    assert H.rows_of(staged) == H.rows_of(raw)
    bad = text.withColumn("longitude", F.lit("abc"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        stage_requests(bad).collect()


def test_fractional_complaints_round_half_to_even(spark):
    raw = H.requests(spark, [{}, {}, {}])
    halves = F.element_at(F.array(F.lit(2.5), F.lit(3.7), F.lit(0.4)), F.col("id_chamado").cast("int"))
    staged = stage_requests(raw.withColumn("reclamacoes", halves)).orderBy("id_chamado")
    assert [r["reclamacoes"] for r in staged.collect()] == [2, 4, 0]


def test_neighbourhood_renames(spark):
    raw = spark.createDataFrame(
        [(1, "Centro", "Sub", "RA", "AP", None)],
        "id_bairro int, nome string, subprefeitura string, nome_regiao_administrativa string, "
        "nome_regiao_planejamento string, geometry_wkt string",
    )
    staged = stage_neighbourhoods(raw)
    assert staged.columns == [
        "id_bairro", "nome", "subprefeitura", "regiao_administrativa", "area_planejamento", "geometry_wkt",
    ]
    assert staged.first()["id_bairro"] == "1"
    assert staged.first()["area_planejamento"] == "AP"


def test_month_is_a_date(spark):
    df = H.requests(spark, [{"data_inicio": "2024-03-31 23:59:59"}]).select(S.month_of(F.col("data_inicio")).alias("m"))
    assert df.dtypes == [("m", "date")]
    assert df.first()["m"].isoformat() == "2024-03-01"

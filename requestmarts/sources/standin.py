"""Stand-in request tables derived from an orders star schema.

There is no public request data to ship. Orders become requests, customers give
their type and neighbourhood, nations become unit squares on a 5 x 5 grid. All
values are fixed arithmetic on the keys, so another engine can derive the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SINCE = "1997-01-01"
AS_OF = "2002-01-01"
BUILT_AT = "2002-01-01 06:00:00"

# Department of each request type.
TYPE_TO_DEPARTMENT = (
    ("HOUSEHOLD-0", "SMS"), ("HOUSEHOLD-1", "SMS"), ("HOUSEHOLD-2", "SMS"), ("HOUSEHOLD-3", "SMS"),
    ("BUILDING-0", "SME"), ("BUILDING-1", "SME"), ("BUILDING-2", "SME"), ("BUILDING-3", "SME"),
    ("FURNITURE-0", "SMAS"), ("FURNITURE-1", "SMAS"), ("FURNITURE-2", "SMAS"), ("FURNITURE-3", "SMAS"),
    ("MACHINERY-0", "SMS"), ("MACHINERY-1", "SMS"), ("MACHINERY-2", "Outros"), ("MACHINERY-3", "Outros"),
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the landed column names."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(
        "cast(o_orderkey as string) as id_chamado",
        "o_orderdate as data_inicio",
        "case when o_orderstatus <> 'O' then o_orderdate + make_dt_interval(cast(o_orderkey * 7 % 31 as int)) end as data_fim",
        "case when o_orderkey % 11 <> 0 then o_orderdate + make_dt_interval(cast(5 + o_orderkey % 17 as int)) end as prazo_atendimento",
        "case when o_orderkey % 97 <> 0 then concat(c_mktsegment, '-', c_custkey % 4) end as tipo",
        "o_orderpriority as subtipo",
        "case o_orderstatus when 'F' then 'Fechado com solução' when 'P' then 'Pendente' else 'Aberto' end as status",
        "case o_orderstatus when 'O' then 'Não encerrado' else 'Encerrado' end as situacao",
        "case o_custkey % 10 when 0 then null when 1 then '999' else cast(c_nationkey as string) end as id_bairro",
        "case o_orderkey % 4 when 0 then 'Serviço' when 1 then 'Informação' when 2 then 'Reclamação' end as categoria",
        "case o_orderstatus when 'O' then 'Andamento' else 'Atendido' end as tipo_situacao",
        "case when o_orderkey % 13 <> 0 then concat('UO-', o_orderkey % 7) end as nome_unidade_organizacional",
        "cast(case when o_custkey % 5 <> 4 then o_custkey % 5 end as int) as reclamacoes",
        "case when o_orderkey % 19 <> 0 then cast(o_orderkey % 53 as double) / 10 end as longitude",
        "cast(o_orderkey % 59 as double) / 10 as latitude",
        "cast(o_orderdate as date) as data_particao",
    )


def neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw neighbourhoods: number 7 is two squares wide, number 24 has no polygon."""
    squares = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(
        "n_nationkey as k",
        "n_name as nome",
        "n_nationkey % 5 as x",
        "n_nationkey div 5 as y",
        "n_nationkey % 5 + if(n_nationkey = 7, 2, 1) as x2",
        "n_nationkey div 5 + 1 as y2",
    )
    ring = "concat_ws(', ', concat(x, ' ', y), concat(x2, ' ', y), concat(x2, ' ', y2), concat(x, ' ', y2), concat(x, ' ', y))"
    return squares.selectExpr(
        "cast(k as string) as id_bairro",
        "nome",
        "concat('SUB-', k % 13) as subprefeitura",
        "concat('RA-', k) as nome_regiao_administrativa",
        "concat('AP-', k % 3) as nome_regiao_planejamento",
        f"case when k <> 24 then concat('POLYGON ((', {ring}, '))') end as geometry_wkt",
    )


def admin_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Administrative regions with a column that landing leaves out: one for each nation."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(
        "cast(n_nationkey as string) as id_regiao_administrativa",
        "n_name as nome",
        "cast(n_regionkey as string) as id_area_planejamento_sms",
        "n_regionkey as outra",
    )


def planning_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr(
        "cast(r_regionkey as string) as id_area_planejamento",
        "r_regionkey as id_area_planejamento_numerico",
        "'POLYGON EMPTY' as geometry_wkt",
        "r_name as outra",
    )


def subprefectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr(
        "r_name as subprefeitura",
        "cast(r_regionkey as double) / 2 as area",
        "cast(r_regionkey as double) * 2 as perimetro",
        "'POLYGON EMPTY' as geometry_wkt",
        "r_name as outra",
    )


def type_map(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{tipo}', '{secretaria}')" for tipo, secretaria in TYPE_TO_DEPARTMENT)
    return spark.sql(f"select * from values {rows} as m(tipo, secretaria)")

"""Column contracts. Names are the data's own; they must stay as they are."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
DEPARTMENTS = ("SMS", "SME", "SMAS")
OTHER_DEPARTMENT = "Outros"
DEFAULT_SINCE = "2023-01-01"
# ----------------------------------------------------------------------------

_TYPES = {
    "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def columns(text: str) -> T.StructType:
    """``"name type, ..."`` as a schema, without needing a running session."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


REQUEST_SCHEMA = columns(
    "id_chamado string, data_inicio timestamp_ntz, data_fim timestamp_ntz, "
    "prazo_atendimento timestamp_ntz, tipo string, subtipo string, status string, "
    "situacao string, id_bairro string, categoria string, tipo_situacao string, "
    "nome_unidade_organizacional string, reclamacoes int, longitude double, "
    "latitude double, data_particao date"
)

NEIGHBOURHOOD_SCHEMA = columns(
    "id_bairro string, nome string, subprefeitura string, "
    "nome_regiao_administrativa string, nome_regiao_planejamento string, "
    "geometry_wkt string"
)

TYPE_MAP_SCHEMA = columns(
    "tipo string, secretaria string, confianca string, notas string"
)

ADMIN_REGION_COLUMNS = ("id_regiao_administrativa", "nome", "id_area_planejamento_sms")
PLANNING_AREA_COLUMNS = (
    "id_area_planejamento",
    "id_area_planejamento_numerico",
    "geometry_wkt",
)
SUBPREFECTURE_COLUMNS = ("subprefeitura", "area", "perimetro", "geometry_wkt")

TERRITORY_COLUMNS = ("subprefeitura", "regiao_administrativa", "area_planejamento")

DETAIL_SCHEMA = columns(
    "id_chamado string, data_inicio timestamp_ntz, data_fim timestamp_ntz, "
    "prazo_atendimento timestamp_ntz, tipo string, subtipo string, status string, "
    "situacao string, longitude double, latitude double, data_particao date, "
    "secretaria string, dias_resolucao bigint, resolvido_no_prazo boolean, "
    "subprefeitura string, regiao_administrativa string, area_planejamento string, "
    "categoria string, tipo_situacao string, reclamacoes int, "
    "nome_unidade_organizacional string"
)
DETAIL_COLUMNS = tuple(DETAIL_SCHEMA.fieldNames())
# Partition directory of the stored detail fact; a range of opening dates then skips months.
OPENED_MONTH = "mes_inicio"
STORED_DETAIL_SCHEMA = T.StructType([*DETAIL_SCHEMA.fields, T.StructField(OPENED_MONTH, T.DateType())])

# --- fixed values: columns of lists, filters and sorting ----------------------
LIST_COLUMNS = (
    "id_chamado",
    "data_inicio",
    "data_fim",
    "prazo_atendimento",
    "tipo",
    "subtipo",
    "status",
    "situacao",
    "longitude",
    "latitude",
    "data_particao",
    "secretaria",
    "dias_resolucao",
    "resolvido_no_prazo",
)

FILTER_COLUMNS = ("tipo", "subtipo", "secretaria", "status", "situacao")
SEARCH_COLUMNS = ("id_chamado", *FILTER_COLUMNS)
SORTABLE_COLUMNS = (
    "id_chamado",
    "data_inicio",
    "data_fim",
    "tipo",
    "subtipo",
    "secretaria",
    "status",
    "situacao",
    "resolvido_no_prazo",
)
DEFAULT_SORT = "data_inicio"
# ------------------------------------------------------------------------------

_RATED = "total_chamados bigint, taxa_resolucao_prazo double"


# One entry per dashboard card, keyed by the card's name.
CARD_SCHEMAS: dict[str, T.StructType] = {
    "kpis": columns(
        "total_chamados bigint, total_resolvidos bigint, chamados_abertos bigint, "
        "taxa_resolucao_prazo double, tempo_medio_resolucao_dias double, "
        "atualizado_em timestamp_ntz"
    ),
    "backlog": columns("chamados_abertos bigint, idade_media_aberto_dias double"),
    "sla_breakdown": columns(
        "no_prazo bigint, fora_prazo bigint, fechado_sem_prazo bigint, em_aberto bigint"
    ),
    "monthly_volume": columns("periodo date, total_chamados bigint, total_encerrados bigint"),
    "by_department": columns(f"secretaria string, {_RATED}"),
    "top_types": columns("tipo string, secretaria string, total_chamados bigint"),
    "by_category": columns("categoria string, total_chamados bigint"),
    "worst_regions": columns(f"territorio string, {_RATED}"),
    "worst_subprefectures": columns(f"territorio string, {_RATED}"),
    "late_region_by_department": columns(
        "regiao string, secretaria string, chamados_atrasados bigint, "
        "taxa_resolucao_prazo double"
    ),
    "late_subprefecture_by_department": columns(
        "subprefeitura string, secretaria string, chamados_atrasados bigint, "
        "taxa_resolucao_prazo double"
    ),
    "late_region_by_unit": columns(
        "secretaria string, regiao string, orgao string, chamados_atrasados bigint, "
        "pct_do_atraso double"
    ),
    "late_subprefecture_by_unit": columns(
        "secretaria string, subprefeitura string, orgao string, "
        "chamados_atrasados bigint, pct_do_atraso double"
    ),
    "region_by_department": columns("regiao string, secretaria string, total_chamados bigint"),
    "subprefecture_by_department": columns(
        "subprefeitura string, secretaria string, total_chamados bigint"
    ),
    "complaints_by_region": columns("territorio string, com_reclamacoes_repetidas bigint"),
    "complaints_by_subprefecture": columns(
        "territorio string, com_reclamacoes_repetidas bigint"
    ),
}

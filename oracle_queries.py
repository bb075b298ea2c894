"""DuckDB SQL for every registered query, written independently of the Spark code.

Each text starts with the same CTEs: the stand-in tables, the staged and
enriched requests (``detail``), and ``m``, the detail with a few flags.
"""

from __future__ import annotations

SINCE, AS_OF, BUILT_AT = "1997-01-01", "2002-01-01", "2002-01-01 06:00:00"

LIST_COLUMNS = (
    "id_chamado, data_inicio, data_fim, prazo_atendimento, tipo, subtipo, status, situacao, "
    "longitude, latitude, data_particao, secretaria, dias_resolucao, resolvido_no_prazo"
)
STAGED_COLUMNS = (
    "id_chamado", "data_inicio", "data_fim", "prazo_atendimento", "tipo", "subtipo", "status",
    "situacao", "id_bairro", "categoria", "tipo_situacao", "nome_unidade_organizacional",
    "reclamacoes", "longitude", "latitude", "data_particao",
)

_MAP = ", ".join(
    f"('{segment}-{i}', '{departments[i]}')"
    for segment, departments in {
        "HOUSEHOLD": ("SMS",) * 4,
        "BUILDING": ("SME",) * 4,
        "FURNITURE": ("SMAS",) * 4,
        "MACHINERY": ("SMS", "SMS", "Outros", "Outros"),
    }.items()
    for i in range(4)
)

BASE = f"""
chamado as (
  select cast(o_orderkey as varchar) as id_chamado, o_orderdate as data_inicio,
    case when o_orderstatus = 'O' then null
         else o_orderdate + to_days(cast(o_orderkey * 7 % 31 as int)) end as data_fim,
    case when o_orderkey % 11 = 0 then null
         else o_orderdate + to_days(cast(5 + o_orderkey % 17 as int)) end as prazo_atendimento,
    case when o_orderkey % 97 = 0 then null
         else concat(c_mktsegment, '-', cast(c_custkey % 4 as varchar)) end as tipo,
    o_orderpriority as subtipo,
    case o_orderstatus when 'F' then 'Fechado com solução' when 'P' then 'Pendente' else 'Aberto' end as status,
    case o_orderstatus when 'O' then 'Não encerrado' else 'Encerrado' end as situacao,
    case o_custkey % 10 when 0 then null when 1 then '999' else cast(c_nationkey as varchar) end as id_bairro,
    case o_orderkey % 4 when 0 then 'Serviço' when 1 then 'Informação' when 2 then 'Reclamação' end as categoria,
    case when o_orderstatus = 'O' then 'Andamento' else 'Atendido' end as tipo_situacao,
    case when o_orderkey % 13 = 0 then null else concat('UO-', cast(o_orderkey % 7 as varchar)) end
      as nome_unidade_organizacional,
    cast(case when o_custkey % 5 = 4 then null else o_custkey % 5 end as int) as reclamacoes,
    case when o_orderkey % 19 = 0 then null else cast(o_orderkey % 53 as double) / 10 end as longitude,
    cast(o_orderkey % 59 as double) / 10 as latitude,
    cast(o_orderdate as date) as data_particao
  from orders join customer on o_custkey = c_custkey),
bairro as (
  select cast(k as varchar) as id_bairro, concat('SUB-', cast(k % 13 as varchar)) as subprefeitura,
    concat('RA-', cast(k as varchar)) as regiao_administrativa,
    concat('AP-', cast(k % 3 as varchar)) as area_planejamento,
    case when k = 24 then null else concat('POLYGON ((', x, ' ', y, ', ', x2, ' ', y, ', ', x2, ' ', y2,
      ', ', x, ' ', y2, ', ', x, ' ', y, '))') end as geometry_wkt
  from (select n_nationkey as k, n_nationkey % 5 as x, n_nationkey // 5 as y,
          n_nationkey % 5 + case when n_nationkey = 7 then 2 else 1 end as x2, n_nationkey // 5 + 1 as y2
        from nation)),
mapa(tipo, secretaria) as (values {_MAP}),
stg as (select * from chamado where data_particao >= date '{SINCE}'),
scoped as (
  select stg.*, coalesce(mapa.secretaria, 'Outros') as secretaria,
    date_diff('day', cast(data_inicio as date), cast(data_fim as date)) as dias_resolucao,
    coalesce(data_fim <= prazo_atendimento, false) as resolvido_no_prazo
  from stg left join mapa using (tipo)
  where coalesce(mapa.secretaria, 'Outros') in ('SMS', 'SME', 'SMAS')),
com_poligono as (select * from bairro where geometry_wkt is not null),
geo_id as (
  select id_chamado, subprefeitura, regiao_administrativa, area_planejamento
  from scoped join com_poligono using (id_bairro)),
pending as (
  select * from scoped
  where id_chamado not in (select id_chamado from geo_id) and longitude is not null and latitude is not null),
aneis as (select id_bairro, unnest(regexp_extract_all(geometry_wkt, '\\(([^()]+)\\)', 1)) as anel from com_poligono),
vertices as (
  select id_bairro, list_transform(string_split(anel, ','),
    lambda s: [cast(v as double) for v in string_split(trim(s), ' ')]) as pts from aneis),
arestas as (
  select id_bairro, pts[i][1] as x1, pts[i][2] as y1, pts[i + 1][1] as x2, pts[i + 1][2] as y2
  from vertices, unnest(range(1, len(pts))) t(i)),
pares as (
  select id_chamado, arestas.id_bairro from pending, arestas
  group by id_chamado, arestas.id_bairro
  having count(*) filter (where (y1 > latitude) <> (y2 > latitude)
      and longitude < (x2 - x1) * (latitude - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1
    and count(*) filter (where (x2 - x1) * (latitude - y1) = (y2 - y1) * (longitude - x1)
      and longitude between least(x1, x2) and greatest(x1, x2)
      and latitude between least(y1, y2) and greatest(y1, y2)) = 0),
geo_pairs as (
  select id_chamado, id_bairro, subprefeitura, regiao_administrativa, area_planejamento
  from pares join bairro using (id_bairro)),
geo_point as (
  select id_chamado, subprefeitura, regiao_administrativa, area_planejamento from geo_pairs
  qualify row_number() over (partition by id_chamado order by subprefeitura nulls last, id_bairro) = 1),
geo_all as (select * from geo_id union all select * from geo_point),
detail as (
  select scoped.*, subprefeitura, regiao_administrativa, area_planejamento
  from scoped left join geo_all using (id_chamado)),
"""

_FLAGS = """
m as (
  select *, data_fim is not null and prazo_atendimento is not null as com_prazo,
    data_fim is not null and prazo_atendimento is not null and not resolvido_no_prazo as atrasado,
    cast(date_trunc('month', data_inicio) as date) as mes
  from detail where {where})
"""

# The filters of the registered filtered queries, as SQL.
COMMON_WHERE = (
    "cast(data_inicio as date) between date '1997-06-01' and date '2001-06-30' and ("
    + " or ".join(
        f"{c} ilike '%h_G%'" for c in ("id_chamado", "tipo", "subtipo", "secretaria", "status", "situacao")
    )
    + ")"
)
LIST_WHERE = "secretaria = 'SMS' and situacao = 'Encerrado'"
DAYS_WHERE = "tipo = 'HOUSEHOLD-1' and cast(data_inicio as date) between date '1997-06-10' and date '2000-02-20'"


def _searched(pattern: str) -> str:
    return f"concat_ws('|', id_chamado, tipo, subtipo, secretaria, status, situacao) ilike '%{pattern}%'"


SOLVED_WHERE = f"{_searched('_solução')} and cast(data_inicio as date) between date '1997-06-10' and date '2000-02-20'"
NUMBERED_WHERE = f"{_searched('123')} and situacao = 'Encerrado'"

RATE = (
    "round(cast(100.0 * count(*) filter (where resolvido_no_prazo)"
    " / nullif(count(*) filter (where com_prazo), 0) as double), 2)"
)


def _over(body: str, where: str = "true") -> str:
    return f"with {BASE}{_FLAGS.format(where=where)}{body}"


def kpis(stamp: bool) -> str:
    return f"""
select count(*) as total_chamados, count(data_fim) as total_resolvidos,
  count(*) - count(data_fim) as chamados_abertos, {RATE} as taxa_resolucao_prazo,
  round(avg(dias_resolucao), 2) as tempo_medio_resolucao_dias
  {f", timestamp '{BUILT_AT}' as atualizado_em" if stamp else ""}
from m"""


BACKLOG = f"""
select count(*) - count(data_fim) as chamados_abertos,
  round(avg(case when data_fim is null then date_diff('day', cast(data_inicio as date), date '{AS_OF}') end), 1)
    as idade_media_aberto_dias
from m"""

SLA = """
select count(*) filter (where com_prazo and resolvido_no_prazo) as no_prazo,
  count(*) filter (where atrasado) as fora_prazo,
  count(*) filter (where data_fim is not null and prazo_atendimento is null) as fechado_sem_prazo,
  count(*) filter (where data_fim is null) as em_aberto
from m"""

MONTHLY = """
select mes as periodo, count(*) as total_chamados, count(data_fim) as total_encerrados
from m where mes is not null group by mes"""

BY_DEPARTMENT = f"""
select secretaria, count(*) as total_chamados, {RATE} as taxa_resolucao_prazo from m group by secretaria"""

TOP_TYPES = """
select tipo, secretaria, count(*) as total_chamados from m where tipo is not null
group by all order by total_chamados desc, tipo, secretaria limit 10"""

BY_CATEGORY = """
select categoria, count(*) as total_chamados from m where categoria is not null group by categoria"""


def worst(column: str) -> str:
    return f"""
select {column} as territorio, count(*) as total_chamados, {RATE} as taxa_resolucao_prazo
from m where {column} is not null group by {column}
having count(*) filter (where com_prazo) > 0
order by taxa_resolucao_prazo, total_chamados desc, territorio limit 10"""


def top_territories(column: str) -> str:
    return f"""
select {column} as territorio, count(*) as total_chamados, {RATE} as taxa_resolucao_prazo
from m where {column} is not null group by {column}
order by total_chamados desc, territorio limit 12"""


def late_by_department(column: str, name: str) -> str:
    return f"""
select * from (
  select {column} as {name}, secretaria, count(*) filter (where atrasado) as chamados_atrasados,
    {RATE} as taxa_resolucao_prazo
  from m where {column} is not null group by all having count(*) filter (where com_prazo) > 0)
qualify row_number() over (
  partition by secretaria order by taxa_resolucao_prazo, chamados_atrasados desc, {name}) <= 5"""


def late_by_unit(column: str, name: str) -> str:
    return f"""
select secretaria, {name}, orgao, chamados_atrasados,
  round(cast(100.0 * chamados_atrasados / todos as double), 1) as pct_do_atraso
from (
  select secretaria, {column} as {name}, nome_unidade_organizacional as orgao, count(*) as chamados_atrasados,
    (select count(*) from m as t where t.atrasado and t.nome_unidade_organizacional is not null
       and t.secretaria = m.secretaria and t.{column} = m.{column}) as todos
  from m where atrasado and {column} is not null and nome_unidade_organizacional is not null
  group by all)
qualify row_number() over (partition by secretaria, {name} order by chamados_atrasados desc, orgao) <= 3"""


def volume(column: str, name: str) -> str:
    return f"""
select {column} as {name}, secretaria, count(*) as total_chamados
from m where {column} is not null group by all"""


def complaints(column: str) -> str:
    return f"""
select {column} as territorio, count(*) filter (where reclamacoes >= 2) as com_reclamacoes_repetidas
from m where {column} is not null and reclamacoes is not null group by {column}
order by com_reclamacoes_repetidas desc, territorio limit 12"""


def pivot(column: str) -> str:
    counts = ", ".join(
        f"nullif(count(*) filter (where secretaria = '{d}'), 0) as {d.upper()}" for d in ("SMS", "SME", "SMAS")
    )
    return f"""
select {column} as territorio, {counts} from m where {column} is not null
group by {column} order by count(*) desc, territorio limit 20"""


def with_units(column: str, name: str) -> str:
    return f"""
select l.{name} as territorio, l.secretaria, l.chamados_atrasados, l.taxa_resolucao_prazo,
  case when u.orgao is not null then row_number() over (
    partition by l.secretaria, l.{name} order by u.chamados_atrasados desc, u.orgao) end as posicao,
  u.orgao, u.pct_do_atraso
from ({late_by_department(column, name)}) l
left join ({late_by_unit(column, name)}) u on l.secretaria = u.secretaria and l.{name} = u.{name}"""


def page(number: int, size: int, order: str) -> str:
    first = f"(least({number}, greatest(1, cast(ceil((select count(*) from m) / {size}) as bigint))) - 1) * {size}"
    return f"""
select {LIST_COLUMNS} from (select *, row_number() over (order by {order}) as place from m)
where place > {first} and place <= {first} + {size}"""


def page_info(number: int, size: int) -> str:
    return f"""
select total, least({number}, pages) as page, cast({size} as bigint) as page_size, pages
from (select count(*) as total, greatest(1, cast(ceil(count(*) / {size}) as bigint)) as pages from m)"""


_ISO = {"data_inicio", "data_fim", "prazo_atendimento"}
EXPORT = "select " + ", ".join(
    f"strftime({c}, '%Y-%m-%dT%H:%M:%S') as {c}"
    if c in _ISO
    else f"case {c} when true then 'True' when false then 'False' end as {c}"
    if c == "resolvido_no_prazo"
    else f"cast({c} as varchar) as {c}"
    for c in LIST_COLUMNS.split(", ")
) + " from m"

FILTER_OPTIONS = " union all ".join(
    f"select distinct '{c}' as \"column\", {c} as value from m where {c} is not null"
    for c in ("tipo", "subtipo", "secretaria", "status", "situacao")
)


def repeated_ids() -> str:
    """Pending requests a second time, one degree east and without a neighbourhood id."""
    source = "  where coalesce(mapa.secretaria, 'Outros') in ('SMS', 'SME', 'SMAS')),\n"
    once, rest = BASE.split(source)
    head = once.replace("scoped as (", "once as (")
    twice = """scoped as (
  select * from once union all by name
  select * replace (longitude + 1 as longitude, cast(null as varchar) as id_bairro) from once where status = 'Pendente'),
"""
    # A request id is pending only if none of its rows has a neighbourhood; each row brings its own point.
    rest = rest.replace("select id_chamado, arestas.id_bairro from pending, arestas\n  group by id_chamado, arestas.id_bairro",
                        "select id_chamado, arestas.id_bairro from pending, arestas\n  group by id_chamado, longitude, latitude, arestas.id_bairro")
    return f"with {head}{source}{twice}{rest}{_FLAGS.format(where='true')} select * from detail"


def _long(card: str, sql: str, keys: tuple[str, ...], metrics: tuple[str, ...]) -> str:
    padded = [*(f"cast({k} as varchar)" for k in keys), *["cast(null as varchar)"] * (3 - len(keys))]
    named = ", ".join(f"{k} as key{i}" for i, k in enumerate(padded, 1))
    return " union all ".join(
        f"select '{card}' as card, {named}, '{metric}' as metric, cast({metric} as double) as value from ({sql})"
        for metric in metrics
    )


def dashboard() -> str:
    region, sub = "regiao_administrativa", "subprefeitura"
    rated = ("total_chamados", "taxa_resolucao_prazo")
    late = ("chamados_atrasados", "taxa_resolucao_prazo")
    share = ("chamados_atrasados", "pct_do_atraso")
    kpi = f"select * replace (coalesce(taxa_resolucao_prazo, 0) as taxa_resolucao_prazo) from ({kpis(False)})"
    cards = [
        ("kpis", kpi, (), ("total_chamados", "total_resolvidos", "chamados_abertos", "taxa_resolucao_prazo", "tempo_medio_resolucao_dias")),
        ("backlog", BACKLOG, (), ("chamados_abertos", "idade_media_aberto_dias")),
        ("sla_breakdown", SLA, (), ("no_prazo", "fora_prazo", "fechado_sem_prazo", "em_aberto")),
        ("monthly_volume", MONTHLY, ("periodo",), ("total_chamados", "total_encerrados")),
        ("by_department", BY_DEPARTMENT, ("secretaria",), rated),
        ("top_types", TOP_TYPES, ("tipo", "secretaria"), ("total_chamados",)),
        ("by_category", BY_CATEGORY, ("categoria",), ("total_chamados",)),
        ("worst_regions", worst(region), ("territorio",), rated),
        ("worst_subprefectures", worst(sub), ("territorio",), rated),
        ("late_region_by_department", late_by_department(region, "regiao"), ("regiao", "secretaria"), late),
        ("late_subprefecture_by_department", late_by_department(sub, sub), (sub, "secretaria"), late),
        ("late_region_by_unit", late_by_unit(region, "regiao"), ("secretaria", "regiao", "orgao"), share),
        ("late_subprefecture_by_unit", late_by_unit(sub, sub), ("secretaria", sub, "orgao"), share),
        ("region_by_department", volume(region, "regiao"), ("regiao", "secretaria"), ("total_chamados",)),
        ("subprefecture_by_department", volume(sub, sub), (sub, "secretaria"), ("total_chamados",)),
        ("complaints_by_region", complaints(region), ("territorio",), ("com_reclamacoes_repetidas",)),
        ("complaints_by_subprefecture", complaints(sub), ("territorio",), ("com_reclamacoes_repetidas",)),
    ]
    return " union all ".join(_long(*card) for card in cards)


def contract() -> str:
    relations = {
        "stg_chamado": "stg",
        "int_chamados_enriched": "detail",
        "mart_chamados": "detail",
        "mart_by_department": f"({BY_DEPARTMENT})",
        "mart_kpis": f"({kpis(False)})",
        "mart_monthly_volume": f"({MONTHLY})",
        "mart_top_types": f"({TOP_TYPES})",
    }
    checks = [
        *((t, "id_chamado", c) for t in ("stg_chamado", "int_chamados_enriched", "mart_chamados") for c in ("unique", "not_null")),
        ("stg_chamado", "data_particao", "not_null"),
        *((t, "secretaria", c) for t in ("int_chamados_enriched", "mart_by_department") for c in ("not_null", "accepted_values")),
        ("mart_kpis", "total_chamados", "not_null"),
        ("mart_monthly_volume", "periodo", "not_null"),
        ("mart_monthly_volume", "total_chamados", "not_null"),
        ("mart_top_types", "tipo", "not_null"),
    ]
    out = []
    for table, column, check in checks:
        relation = relations[table]
        failures = {
            "unique": f"(select count(*) from (select {column} from {relation} where {column} is not null group by {column} having count(*) > 1))",
            "not_null": f"(select count(*) from {relation} where {column} is null)",
            "accepted_values": f"(select count(distinct {column}) from {relation} where {column} not in ('SMS', 'SME', 'SMAS'))",
        }[check]
        out.append(f"select '{table}' as \"table\", '{column}' as \"column\", '{check}' as \"check\", {failures} as failures")
    return " union all ".join(out)


def _cards() -> dict[str, str]:
    region, sub = "regiao_administrativa", "subprefeitura"
    return {
        "backlog": BACKLOG,
        "sla": SLA,
        "monthly": MONTHLY,
        "by_department": BY_DEPARTMENT,
        "top_types": TOP_TYPES,
        "by_category": BY_CATEGORY,
        "worst_regions": worst(region),
        "worst_subprefectures": worst(sub),
        "late_region_by_department": late_by_department(region, "regiao"),
        "late_subprefecture_by_department": late_by_department(sub, sub),
        "late_region_by_unit": late_by_unit(region, "regiao"),
        "late_subprefecture_by_unit": late_by_unit(sub, sub),
        "region_by_department": volume(region, "regiao"),
        "subprefecture_by_department": volume(sub, sub),
        "complaints_by_region": complaints(region),
        "complaints_by_subprefecture": complaints(sub),
    }


def oracle_sql() -> dict[str, str]:
    region, sub = "regiao_administrativa", "subprefeitura"
    unfiltered_name = {"sla": "sla_breakdown", "monthly": "monthly_volume"}
    geo = "id_chamado, subprefeitura, regiao_administrativa, area_planejamento"
    fact = f"{LIST_COLUMNS}, {sub}, {region}, area_planejamento, categoria, tipo_situacao, reclamacoes, nome_unidade_organizacional"
    out = {"kpis": _over(kpis(True)), "kpis_filtered": _over(kpis(False), COMMON_WHERE)}
    for name, sql in _cards().items():
        out[unfiltered_name.get(name, name)] = _over(sql)
        out[f"{name}_filtered"] = _over(sql, COMMON_WHERE)
    out |= {
        "landing_requests": f"with {BASE} {_FLAGS.format(where='true')} select {', '.join(STAGED_COLUMNS)} from stg",
        "landing_neighbourhoods": f"with {BASE} {_FLAGS.format(where='true')} select id_bairro, n_name as nome, subprefeitura, "
        "regiao_administrativa as nome_regiao_administrativa, area_planejamento as nome_regiao_planejamento, geometry_wkt "
        "from bairro join nation on cast(n_nationkey as varchar) = id_bairro",
        "landing_admin_regions": "select cast(n_nationkey as varchar) as id_regiao_administrativa, n_name as nome, "
        "cast(n_regionkey as varchar) as id_area_planejamento_sms from nation",
        "landing_planning_areas": "select cast(r_regionkey as varchar) as id_area_planejamento, "
        "r_regionkey as id_area_planejamento_numerico, 'POLYGON EMPTY' as geometry_wkt from region",
        "landing_subprefectures": "select r_name as subprefeitura, cast(r_regionkey as double) / 2 as area, "
        "cast(r_regionkey as double) * 2 as perimetro, 'POLYGON EMPTY' as geometry_wkt from region",
        "landing_plan": _over(
            "select run, t as \"table\", case when run = 1 then n end as rows, run = 2 as skipped from ("
            "select 'chamado' as t, count(*) as n from stg union all select 'bairro', count(*) from nation "
            "union all select 'regiao_administrativa', count(*) from nation union all select 'area_planejamento', count(*) from region "
            "union all select 'subprefeitura', count(*) from region), (values (1), (2)) as runs(run)"
        ),
        "landed_requests": _over(f"select {', '.join(STAGED_COLUMNS)} from stg"),
        "landed_neighbourhoods": f"with {BASE} {_FLAGS.format(where='true')} select id_bairro, n_name as nome, subprefeitura, "
        "regiao_administrativa as nome_regiao_administrativa, area_planejamento as nome_regiao_planejamento, geometry_wkt "
        "from bairro join nation on cast(n_nationkey as varchar) = id_bairro",
        "type_map_csv": _over(
            f"select {', '.join('stg.' + c for c in STAGED_COLUMNS)}, coalesce(secretaria, 'Outros') as secretaria "
            "from stg left join mapa on stg.tipo = mapa.tipo"
        ),
        "export_csv": _over(EXPORT, LIST_WHERE),
        "kpi_response_filtered": _over(
            f"select * replace (coalesce(taxa_resolucao_prazo, 0.0) as taxa_resolucao_prazo) from ({kpis(False)})", COMMON_WHERE
        ),
        "staged_requests": _over(f"select {', '.join(STAGED_COLUMNS)} from stg"),
        "with_department": _over(
            f"select {', '.join('stg.' + c for c in STAGED_COLUMNS)}, coalesce(secretaria, 'Outros') as secretaria "
            "from stg left join mapa on stg.tipo = mapa.tipo"
        ),
        "geo_by_id": _over(f"select {geo} from geo_id"),
        "geo_pending": _over("select * from pending"),
        "geo_pairs": _over("select * from geo_pairs"),
        "geo_by_point": _over(f"select {geo} from geo_point"),
        "geo_unified": _over(f"select {geo} from geo_all"),
        "enriched": _over("select * from detail"),
        "enriched_by_request": _over("select * from detail"),
        "enriched_repeated_ids": repeated_ids(),
        "detail_fact": _over(f"select {fact} from detail"),
        "freshness": _over(
            f"select timestamp '{BUILT_AT}' as atualizado_em, max(data_particao) as ultima_particao from m"
        ),
        "top_territories_by_volume": _over(top_territories("area_planejamento"), COMMON_WHERE),
        "kpi_response": _over(
            f"select * replace (coalesce(taxa_resolucao_prazo, 0) as taxa_resolucao_prazo) from ({kpis(False)})",
            "tipo ilike '%__nenhum__%'",
        ),
        "dashboard": _over(dashboard()),
        "dashboard_department": _over(dashboard(), "secretaria = 'SMS'"),
        "dashboard_cube_days": _over(
            dashboard(),
            "tipo = 'HOUSEHOLD-1' and cast(data_inicio as date) between date '1997-06-10' and date '2000-02-20'",
        ),
        "dashboard_served_search": _over(dashboard(), COMMON_WHERE),
        "dashboard_search_cube": _over(dashboard(), SOLVED_WHERE),
        "dashboard_from_marts": _over(dashboard()),
        "dashboard_refreshed": _over(dashboard()),
        "detail_refreshed": _over(f"select {fact} from detail"),
        "list_page_refreshed": _over(page(31, 100, "data_inicio desc nulls last, id_chamado desc")),
        "dashboard_filtered": _over(dashboard(), COMMON_WHERE),
        "search_text": _over(f"select {fact} from m", "concat_ws('|', id_chamado, tipo, subtipo, secretaria, status, situacao) ilike '%solução%'"),
        "search_stored": _over(f"select {fact} from m", SOLVED_WHERE),
        "search_stored_ids": _over(f"select {fact} from m", NUMBERED_WHERE),
        "list_page": _over(page(1, 20, "data_inicio desc nulls last, id_chamado desc")),
        "list_page_sorted": _over(page(3, 50, "data_fim asc nulls last, id_chamado asc"), LIST_WHERE),
        "list_page_middle": _over(page(31, 100, "data_inicio desc nulls last, id_chamado desc")),
        "list_page_months": _over(
            page(9, 100, "status asc nulls last, id_chamado asc"),
            "cast(data_inicio as date) between date '1997-02-01' and date '2000-02-29'",
        ),
        "list_page_narrowed": _over(page(12, 50, "tipo desc nulls last, id_chamado desc"), LIST_WHERE),
        "list_filtered": _over(EXPORT, "tipo = 'HOUSEHOLD-1' and subtipo = '1-URGENT' and status = 'Fechado com solução'"),
        "list_page_beyond": _over(page(10**9, 100, "status desc nulls last, id_chamado desc"), LIST_WHERE),
        "page_info": _over(page_info(10**9, 20), LIST_WHERE),
        "export": _over(EXPORT, LIST_WHERE),
        "distinct_values": _over("select distinct tipo as value from m where tipo is not null", LIST_WHERE),
        "filter_options": _over(FILTER_OPTIONS, LIST_WHERE),
        "filter_options_stored": _over(FILTER_OPTIONS, DAYS_WHERE),
        "filter_options_search": _over(FILTER_OPTIONS, NUMBERED_WHERE),
        "distinct_values_stored": _over("select distinct subtipo as value from m where subtipo is not null", SOLVED_WHERE),
        "region_pivot": _over(pivot(region)),
        "subprefecture_pivot": _over(pivot(sub)),
        "worst_prazo_points": _over(worst(region)),
        "worst_prazo_points_subprefecture": _over(worst(sub)),
        "late_regions_with_units": _over(with_units(region, "regiao")),
        "late_subprefectures_with_units": _over(with_units(sub, sub)),
        "top_categories": _over(f"{BY_CATEGORY} order by total_chamados desc, categoria limit 10"),
        "top_categories_cut": _over(
            "select tipo as categoria, count(*) as total_chamados from m where tipo is not null group by tipo "
            "order by total_chamados desc, categoria limit 10"
        ),
        "sla_parts": _over(
            f"select parte, total from (unpivot ({SLA}) on no_prazo as 'No prazo', fora_prazo as 'Fora do prazo', "
            "fechado_sem_prazo as 'Fechado sem prazo', em_aberto as 'Em aberto' into name parte value total) where total > 0"
        ),
        "dq_unique": _over(
            "select id_bairro, tipo, count(*) as n from stg where id_bairro is not null and tipo is not null "
            "group by all having count(*) > 1"
        ),
        "dq_unique_ids": _over("select id_chamado, cast(2 as bigint) as n from scoped where status = 'Pendente'"),
        "dq_not_null": _over(
            " union all ".join(
                f"select '{c}' as \"column\", count(*) - count({c}) as failures from stg" for c in STAGED_COLUMNS
            )
        ),
        "dq_accepted": _over(
            "select value, count(*) as n from (select coalesce(secretaria, 'Outros') as value "
            "from stg left join mapa on stg.tipo = mapa.tipo) where value not in ('SMS', 'SME', 'SMAS') group by value"
        ),
        "dq_contract": _over(contract()),
    }
    return out

"""The batch build: landed tables to the detail fact, the roll-up and the marts."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requestmarts.operators.enrich import (
    enrich,
    mart_requests,
    stage_neighbourhoods,
    stage_requests,
)
from requestmarts.operators.filters import in_months, not_in_months
from requestmarts.operators.lookups import MAX_BROADCAST_BYTES, lookup_join, measured_bytes
from requestmarts.operators.measures import territory_cube, volume_cube
from requestmarts.operators.quality import run_contract
from requestmarts.operators.territory import territory_lookup
from requestmarts.plans import cubes, marts, rank_index, search_index
from requestmarts.plans.dashboard import TERRITORY_CARDS, VOLUME_CARDS, in_one_task
from requestmarts.schema import DEFAULT_SINCE, OPENED_MONTH, SORTABLE_COLUMNS
from requestmarts.sources import pointers
from requestmarts.sources.checkpoints import checkpointed
from requestmarts.sources.readers import DETAIL, MONTHS_SCHEMA, MONTHS_TABLE, build_name, months_kept, read_mart

FRESHNESS = "freshness"
_WRITERS = 4


class ContractError(ValueError):
    """A build broke a declared check and was not published."""


def _publish(spark: SparkSession, out: str, build: str, database: str | None) -> None:
    """Move the pointer that readers follow; they see one build or the other. The view names
    the same build for readers that go by database."""
    pointers.publish(spark, out, build)
    quoted = ".".join(f"`{part}`" for part in build_name(database).split("."))
    folder = build.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create or replace view {quoted} as select '{folder}' as folder")


def _clustered(detail: DataFrame) -> DataFrame:
    """The detail fact by opening month: each file holds one month, a heavy month has several."""
    monthly = detail.withColumn(OPENED_MONTH, F.trunc("data_inicio", "month"))
    return monthly.hint("rebalance", OPENED_MONTH)


Save = Callable[..., DataFrame]


def _saver(spark: SparkSession, build: str) -> Save:
    def save(df: DataFrame, table: str, by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{build}/{table}"
        df.write.mode("errorifexists").partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def _stamps(spark: SparkSession, as_of: dt.date | str | None, built_at: dt.datetime | str | None) -> tuple:
    now = spark.sql("select localtimestamp() as l, current_date() as d").first()
    return as_of or now["d"], built_at or now["l"]


def _new_build(out: str) -> str:
    return f"{out.rstrip('/')}/build={uuid.uuid4().hex}"


def _save_rank_index(save: Save, detail: DataFrame) -> DataFrame:
    splits, counts = rank_index.rank_index(detail)
    save(splits.coalesce(1), rank_index.RANK_SPLITS)
    return save(counts.coalesce(1), rank_index.RANK_COUNTS)


def build_marts(
    requests: DataFrame,
    type_map: DataFrame,
    areas: DataFrame,
    out: str,
    *,
    start: dt.date | str = DEFAULT_SINCE,
    as_of: dt.date | str | None = None,
    built_at: dt.datetime | str | None = None,
    database: str | None = None,
    unique_ids: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> str:
    """Build everything from raw tables and publish it; returns the build's folder.

    The detail fact is enriched map-side and written by opening month. The widest cube
    is one scan of it; the roll-up and the other cubes are summed from that, and every
    mart from the roll-up. The rank index is two more scans, and the dictionary and the
    pieces of ids for searches one each. Each build has its own
    folder under ``out``. The declared checks run on the written tables; the
    pointer moves to the build only if all of them pass.
    """
    spark = requests.sparkSession
    as_of, built_at = _stamps(spark, as_of, built_at)
    build = _new_build(out)
    save = _saver(spark, build)
    staged = stage_requests(requests, start)
    lookup = territory_lookup(stage_neighbourhoods(areas), max_broadcast_bytes)
    enriched = enrich(
        staged,
        type_map,
        lookup,
        unique_ids=unique_ids,
        max_broadcast_bytes=max_broadcast_bytes,
    )
    detail = save(_clustered(mart_requests(enriched)), DETAIL, (OPENED_MONTH,))
    widest = save(cubes.largest(detail, as_of), cubes.WIDEST)
    indexes = {
        search_index.DICTIONARY: partial(save, search_index.dictionary(detail), search_index.DICTIONARY),
        search_index.ID_PIECES: partial(save, search_index.id_pieces(detail), search_index.ID_PIECES),
        rank_index.RANK_COUNTS: partial(_save_rank_index, save, detail),
    }
    _finish(spark, save, build, staged, detail, widest, indexes, as_of, built_at)
    _publish(spark, out, build, database)
    return build


def refresh_marts(
    changed: DataFrame,
    type_map: DataFrame,
    areas: DataFrame,
    out: str,
    *,
    base: str | None = None,
    start: dt.date | str = DEFAULT_SINCE,
    as_of: dt.date | str | None = None,
    built_at: dt.datetime | str | None = None,
    database: str | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> str:
    """A new build from the last one, or from ``base``, and the raw requests that are new or corrected.

    Only opening months that gain or lose a request are written; the others stay where they
    are, and the new build names the folders to read them from (so old builds that it names
    must be kept). Everything else is additive by month: cubes, dictionary, pieces of ids and
    rank counts keep their unchanged months and are summed with the changed ones, and the
    roll-up and marts are summed from the widest cube. A corrected request leaves the month it
    was in, or the fact if it is out of scope now. Ids of ``changed`` must not repeat. The rank
    index keeps its ranges; a full build cuts them anew. Other types or areas need a full build.
    """
    spark = changed.sparkSession
    base = base or pointers.current(spark, out)
    if base is None:
        raise LookupError(f"no build is published in {out}")
    as_of, built_at = _stamps(spark, as_of, built_at)
    build = _new_build(out)
    save = _saver(spark, build)

    staged = checkpointed(stage_requests(changed, start))
    lookup = territory_lookup(stage_neighbourhoods(areas), max_broadcast_bytes)
    fresh = mart_requests(enrich(staged, type_map, lookup, max_broadcast_bytes=max_broadcast_bytes))
    fresh = checkpointed(fresh.withColumn(OPENED_MONTH, F.trunc("data_inicio", "month")))
    # Every changed id leaves the fact, also one that is not staged any more.
    ids = changed.where("id_chamado is not null").select("id_chamado").distinct()
    small = measured_bytes(ids) <= max_broadcast_bytes
    before = read_mart(spark, DETAIL, base)
    old = lookup_join(before.select("id_chamado", OPENED_MONTH), ids, ["id_chamado"], "left_semi", small=small)
    months = {r[0] for r in old.select(OPENED_MONTH).union(fresh.select(OPENED_MONTH)).distinct().collect()}  # one row a month

    others = lookup_join(before.where(in_months(months)), ids, ["id_chamado"], "left_anti", small=small)
    rows = others.select(fresh.columns).unionByName(fresh)
    rewritten = save(rows.hint("rebalance", OPENED_MONTH), DETAIL, (OPENED_MONTH,))

    widest = save(cubes.kept(spark, base, months, as_of).unionByName(cubes.largest(rewritten, as_of)), cubes.WIDEST)

    def by_month(table: str, own: DataFrame) -> DataFrame:
        unchanged = read_mart(spark, table, base).where(not_in_months(months))
        return save(unchanged.unionByName(own).coalesce(1) if table == rank_index.RANK_COUNTS else unchanged.unionByName(own), table)

    splits = [rank_index.stored_splits(spark, base, c) for c in SORTABLE_COLUMNS]
    save(read_mart(spark, rank_index.RANK_SPLITS, base).coalesce(1), rank_index.RANK_SPLITS)
    made = {
        search_index.DICTIONARY: search_index.dictionary(rewritten),
        search_index.ID_PIECES: search_index.id_pieces(rewritten),
        rank_index.RANK_COUNTS: rank_index.counted(rewritten, splits),
    }
    indexes = {table: partial(by_month, table, own) for table, own in made.items()}

    here = {r[0] for r in rewritten.select(OPENED_MONTH).distinct().collect()}
    kept = months_kept(spark, base)
    if kept is None:
        kept = {base: {r[0] for r in read_mart(spark, search_index.DICTIONARY, base).select(OPENED_MONTH).distinct().collect()}}
    places = [(m, folder) for folder, own in kept.items() for m in own - months] + [(m, build) for m in here]
    save(spark.createDataFrame(places, MONTHS_SCHEMA).coalesce(1), MONTHS_TABLE)
    _finish(spark, save, build, staged, read_mart(spark, DETAIL, build), widest, indexes, as_of, built_at)
    _publish(spark, out, build, database)
    return build


def _finish(
    spark: SparkSession,
    save: Save,
    build: str,
    staged: DataFrame,
    detail: DataFrame,
    widest: DataFrame,
    indexes: dict[str, Callable[[], DataFrame]],
    as_of: dt.date | str,
    built_at: dt.datetime | str,
) -> None:
    """Roll-up, marts and smaller cubes from the widest cube, the indexes, and the declared checks."""
    rolled = save(cubes.summed(widest, ()), cubes.ROLLUP)
    # The marts are sums over the roll-up; a small one is read by one task each, without a shuffle.
    shared = in_one_task(rolled)
    volume, territory = volume_cube(shared), territory_cube(shared)

    tables = {card: make(volume) for card, make in VOLUME_CARDS.items() if card != "kpis"}
    tables |= {card: make(territory) for card, make in TERRITORY_CARDS.items()}
    tables["kpis"] = marts.kpis(volume, built_at)
    tables[FRESHNESS] = marts.freshness(volume, built_at)
    jobs = {table: partial(save, df.coalesce(1), table) for table, df in tables.items()}
    jobs |= {name: partial(save, cubes.summed(widest, extra), name) for name, extra in cubes.CUBES.items() if name != cubes.WIDEST}
    jobs |= indexes
    with ThreadPoolExecutor(_WRITERS) as pool:
        # The longest first.
        running = {name: pool.submit(jobs[name]) for name in reversed(jobs)}
        stored = {name: running[name].result() for name in jobs}
        sized = {cubes.ROLLUP: ((), rolled), cubes.WIDEST: (cubes.CUBES[cubes.WIDEST], widest)}
        sized |= {name: (extra, stored[name]) for name, extra in cubes.CUBES.items() if name != cubes.WIDEST}
        rows = list(pool.map(lambda c: c[1].count(), sized.values()))
    kept = [(name, ",".join(extra), n, str(as_of)) for (name, (extra, _)), n in zip(sized.items(), rows, strict=True)]
    save(spark.createDataFrame(kept, cubes.CUBES_SCHEMA).coalesce(1), cubes.CUBES_TABLE)
    stored = {table: stored[table] for table in tables}
    checked = {f"mart_{table}": df for table, df in stored.items()} | {
        "stg_chamado": staged,
        "int_chamados_enriched": detail,
        "mart_chamados": detail,
    }
    broken = run_contract(checked).where("failures > 0").collect()
    if broken:
        found = ", ".join(f"{r.table}.{r.column} {r.check}: {r.failures}" for r in broken)
        raise ContractError(f"{build} is not published: {found}")

"""Which territory a request belongs to: by neighbourhood id, else by point.

The point test is an equi-join on grid cells. Each polygon is laid on a grid
whose cell is 1/16 of its extent rounded up to a power of four, so a polygon
covers at most 17 x 17 cells whatever its size, and polygons of different sizes
use different grid levels. A cell keeps only the edges a ray to the right can
meet; a cell no edge touches is wholly inside or dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from requestmarts.functions.geometry import bounds, edge_overlaps, strictly_inside, wkt_edges
from requestmarts.operators.lookups import MAX_BROADCAST_BYTES, lookup_join, measured_bytes
from requestmarts.operators.uniqueness import repeated_values
from requestmarts.schema import TERRITORY_COLUMNS
from requestmarts.sources.checkpoints import checkpointed

_CELLS_PER_EXTENT = 16

# Size of a cell entry in memory: fixed part, edges and texts.
_ENTRY_BYTES = " + ".join(
    ["160", "48 * size(edges)"]
    + [f"coalesce(octet_length({c}), 0)" for c in ("id_bairro", *TERRITORY_COLUMNS)]
)


def _cell_size(level: int | str) -> str:
    return f"(pow(4D, {level}) / {_CELLS_PER_EXTENT}D)"


def _cell_of(coordinate: str, size: str) -> str:
    # Powers of two: the division is exact, so a point never lands one cell off.
    return f"case when not isnan({coordinate}) then floor({coordinate} / {size}) end"


def _once(value: str) -> str:
    """Evaluate a costly expression once. A plain projection would be merged into
    every later filter and evaluated again in each; a generator is not."""
    return f"explode(array({value}))"


def polygon_cells(areas: DataFrame) -> DataFrame:
    """One row per (polygon, grid cell it covers), with the edges needed there."""
    extent = "greatest(box.x_max - box.x_min, box.y_max - box.y_min)"
    level = f"cast(ceil(log(4, {extent})) as int)"
    grid = f"named_struct('level', {level}, 'size', {_cell_size(level)})"
    shapes = (
        areas.where("geometry_wkt is not null")
        .select("id_bairro", *TERRITORY_COLUMNS, F.expr(_once(wkt_edges("geometry_wkt"))).alias("edges"))
        .where("size(edges) > 0")
        .selectExpr("*", f"{_once(bounds('edges'))} as box")
        .where(f"{extent} > 0")
        .selectExpr("*", f"{_once(grid)} as grid")
        .selectExpr("*", "grid.level as level", "grid.size as size")
    )
    x_lo, x_hi = "(cx * size)", "((cx + 1) * size)"
    y_lo, y_hi = "(cy * size)", "((cy + 1) * size)"
    in_band = f"greatest(e.y1, e.y2) >= {y_lo} and least(e.y1, e.y2) <= {y_hi}"
    touched = f"exists(band, e -> {edge_overlaps(x_lo, x_hi, y_lo, y_hi)})"
    centre_inside = strictly_inside("band", "((cx + 0.5D) * size)", "((cy + 0.5D) * size)")
    needed = f"filter(band, e -> greatest(e.x1, e.x2) >= {x_lo})"
    return (
        shapes.selectExpr("*", "explode(sequence(floor(box.y_min / size), floor(box.y_max / size))) as cy")
        .selectExpr("*", f"{_once(f'filter(edges, e -> {in_band})')} as band")
        .selectExpr("*", "explode(sequence(floor(box.x_min / size), floor(box.x_max / size))) as cx")
        .selectExpr("*", f"{_once(touched)} as touched")
        .where(f"touched or {centre_inside}")
        .selectExpr(
            "level",
            "cx",
            "cy",
            "id_bairro",
            *TERRITORY_COLUMNS,
            "not touched as whole",
            f"case when touched then {needed} else slice(band, 1, 0) end as edges",
        )
    )


# First wins when polygons overlap: smallest sub-prefecture, then id; NULLs last.
_PREFERENCE = ("subprefeitura", "id_bairro", "regiao_administrativa", "area_planejamento")


def _candidates(cells: DataFrame) -> DataFrame:
    """One row per cell with its polygons in order of preference."""
    place = ", ".join(f"{c} is null as no_{c}, {c}" for c in _PREFERENCE)
    entry = f"struct(struct({place}) as place, whole, edges)"
    return cells.groupBy("level", "cx", "cy").agg(
        F.expr(f"sort_array(collect_list({entry}))").alias("polygons")
    )


@dataclass(frozen=True)
class TerritoryLookup:
    """Neighbourhoods prepared for both ways of finding a request's territory.

    ``candidates`` is there only if everything fits in a broadcast.
    """

    by_id: DataFrame
    cells: DataFrame
    levels: tuple[int, ...]
    candidates: DataFrame | None

    @property
    def small(self) -> bool:
        return self.candidates is not None


def territory_lookup(
    areas: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> TerritoryLookup:
    """Prepare staged neighbourhoods.

    The grid is written once to checkpoint storage, so each lookup owns its own and no
    other can drop it: one aggregate over it tells the levels in use and whether
    everything fits in a broadcast, then the lookups read it.
    """
    by_id = areas.where("geometry_wkt is not null and id_bairro is not null").select(
        "id_bairro", *TERRITORY_COLUMNS
    )
    cells = checkpointed(polygon_cells(areas))
    found = cells.agg(
        F.sort_array(F.collect_set("level")).alias("levels"),
        F.expr(f"coalesce(sum({_ENTRY_BYTES}), 0L)").alias("n"),
    ).first()
    small = found["n"] + measured_bytes(by_id) <= max_broadcast_bytes
    candidates = checkpointed(_candidates(cells)) if small else None
    return TerritoryLookup(by_id, cells, tuple(found["levels"]), candidates)


def geo_by_id(requests: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """Territory of the requests whose neighbourhood id has a polygon."""
    joined = lookup_join(
        requests.select("id_chamado", "id_bairro"),
        lookup.by_id,
        ["id_bairro"],
        "inner",
        small=lookup.small,
    )
    return joined.select("id_chamado", *TERRITORY_COLUMNS)


def _located(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())


def geo_pending(requests: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """Requests with coordinates that the neighbourhood id does not resolve.

    Decided per row by its own id, so nothing is shuffled. Where ``id_chamado``
    may repeat use ``geo_pending_by_request``.
    """
    return lookup_join(
        _located(requests),
        lookup.by_id.select("id_bairro"),
        ["id_bairro"],
        "left_anti",
        small=lookup.small,
    ).select(requests.columns)


def geo_pending_by_request(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """The same, leaving out every request id that any of its rows resolved."""
    return _located(requests).join(resolved.select("id_chamado"), "id_chamado", "left_anti")


def geo_pairs(points: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """Every (request, polygon) pair with the point strictly inside the polygon."""
    levels = ", ".join(map(str, lookup.levels))
    keyed = (
        points.selectExpr(
            "id_chamado", "longitude", "latitude", f"explode(cast(array({levels}) as array<int>)) as level"
        )
        .selectExpr("*", f"{_cell_size('level')} as size")
        .selectExpr("*", f"{_cell_of('longitude', 'size')} as cx", f"{_cell_of('latitude', 'size')} as cy")
    )
    return (
        lookup_join(keyed, lookup.cells, ["level", "cx", "cy"], "inner", small=lookup.small)
        .where(f"whole or {strictly_inside('edges', 'longitude', 'latitude')}")
        .select("id_chamado", "id_bairro", *TERRITORY_COLUMNS)
    )


def one_per_request(pairs: DataFrame) -> DataFrame:
    """The preferred polygon of each request id."""
    best = Window.partitionBy("id_chamado").orderBy(
        *(F.col(c).asc_nulls_last() for c in _PREFERENCE)
    )
    return (
        pairs.withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") == 1)
        .select("id_chamado", *TERRITORY_COLUMNS)
    )


def geo_by_point(pending: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """One territory per pending request that lies in some polygon."""
    return one_per_request(geo_pairs(pending, lookup))


def unify_geo(by_id: DataFrame, by_point: DataFrame) -> DataFrame:
    return by_id.unionByName(by_point)


def attach_territory(requests: DataFrame, geo: DataFrame) -> DataFrame:
    """Requests with their territory, NULL where there is none."""
    return requests.join(geo, "id_chamado", "left").select(*requests.columns, *TERRITORY_COLUMNS)


def resolve_by_request(requests: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """Territory through ``id_chamado`` alone: what rows of a repeated id mean.

    They share the territories any of them resolved. Shuffles the requests by id
    several times, so ``resolve_territory`` gives it only the repeated ones.
    """
    by_id = geo_by_id(requests, lookup)
    by_point = geo_by_point(geo_pending_by_request(requests, by_id), lookup)
    return attach_territory(requests, unify_geo(by_id, by_point))


def _flagged_by_id(requests: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """Requests with ``_id_*`` territory columns; ``_by_id`` is true where they apply."""
    by_id = lookup.by_id.selectExpr(
        "id_bairro", *(f"{c} as _id_{c}" for c in TERRITORY_COLUMNS), "true as _by_id"
    )
    return lookup_join(requests, by_id, ["id_bairro"], "left", small=lookup.small)


def resolve_by_shuffle(requests: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """Territory where the neighbourhoods are too many to broadcast: salted joins,
    and only the points' answers are joined back by the unique request id."""
    flagged = _flagged_by_id(requests, lookup)
    # Rows without an id have no territory; left in, all of them would meet in one task.
    points = geo_by_point(_located(flagged.where("_by_id is null and id_chamado is not null")), lookup).selectExpr(
        "id_chamado", *(f"{c} as _point_{c}" for c in TERRITORY_COLUMNS)
    )
    return flagged.join(points, "id_chamado", "left").selectExpr(
        *requests.columns,
        *(f"case when _by_id then _id_{c} else _point_{c} end as {c}" for c in TERRITORY_COLUMNS),
    )


def resolve_by_row(requests: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """Territory without moving a request row: all lookups are map-side joins.

    A cell row carries its candidate polygons already in order of preference, so
    the first one holding the point is the answer and no per-request ranking is
    needed. Needs a broadcastable lookup and unique request ids.
    """
    out = _flagged_by_id(requests, lookup)
    firsts = []
    for i, level in enumerate(lookup.levels):
        name, size = f"_polygons_{i}", _cell_size(level)
        keys = [f"{name}_cx", f"{name}_cy"]
        polygons = lookup.candidates.where(F.col("level") == level).selectExpr(
            f"cx as {keys[0]}", f"cy as {keys[1]}", f"polygons as {name}"
        )
        out = out.selectExpr(
            "*",
            f"case when _by_id is null then {_cell_of('longitude', size)} end as {keys[0]}",
            f"case when _by_id is null then {_cell_of('latitude', size)} end as {keys[1]}",
        ).join(F.broadcast(polygons), keys, "left")
        inside = strictly_inside("p.edges", "longitude", "latitude")
        firsts.append(f"get(filter({name}, p -> p.whole or {inside}), 0).place")
    if not firsts:
        return out.selectExpr(*requests.columns, *(f"_id_{c} as {c}" for c in TERRITORY_COLUMNS))
    return out.selectExpr("*", f"array_min(array({', '.join(firsts)})) as _point").selectExpr(
        *requests.columns,
        *(f"case when _by_id then _id_{c} else _point.{c} end as {c}" for c in TERRITORY_COLUMNS),
    )


def _resolve_unique(requests: DataFrame, lookup: TerritoryLookup) -> DataFrame:
    """Requests without repeated ids. A NULL id is joined to no territory."""
    resolved = (resolve_by_row if lookup.small else resolve_by_shuffle)(requests, lookup)
    return resolved.selectExpr(
        *requests.columns, *(f"case when id_chamado is not null then {c} end as {c}" for c in TERRITORY_COLUMNS)
    )


def resolve_territory(
    requests: DataFrame,
    lookup: TerritoryLookup,
    *,
    unique_ids: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add the three territory columns.

    Territories belong to request ids: rows sharing an id share them, and rows
    without an id have none. ``unique_ids`` requires that no id repeats; they are
    looked for first (``repeated_values``) and a repeated one raises. With False, repeated ids are resolved
    by id and all others row by row, which gives the same rows as if all were.
    """
    repeated = repeated_values(requests, "id_chamado", max_broadcast_bytes)
    if repeated is None:
        return _resolve_unique(requests, lookup)
    if unique_ids:
        raise ValueError(f"request ids repeat, {repeated.first()[0]!r} for one; resolve with unique_ids=False")
    small = measured_bytes(repeated) <= max_broadcast_bytes
    shared = lookup_join(requests, repeated, ["id_chamado"], "left_semi", small=small)
    others = lookup_join(requests, repeated, ["id_chamado"], "left_anti", small=small)
    return _resolve_unique(others.select(requests.columns), lookup).unionByName(
        resolve_by_request(shared.select(requests.columns), lookup)
    )

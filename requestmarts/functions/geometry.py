"""Point-in-polygon in Spark SQL expressions: WKT edges and an even-odd test.

The functions return SQL text, which reads better than nested lambdas here and
is parsed in one call. Arguments are SQL expressions too.
"""

from __future__ import annotations

EDGES_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


_NUMBERS = "[-+.,0-9eE ]*"
_RINGS = f"[(] *(?:[(]{_NUMBERS}[)][ ,]*)+[)]"
_PREFIX = "(?i)"
_AREA = f"{_PREFIX}(?:MULTIPOLYGON *[(] *(?:{_RINGS}[ ,]*)+[)]|POLYGON *{_RINGS})"
# One shape: its name, then EMPTY or brackets around numbers and, in collections, further shapes.
_NAMES = "(?:MULTI)?(?:POINT|LINESTRING|POLYGON)|GEOMETRYCOLLECTION|LINEARRING"
_SHAPE = f"{_PREFIX}^(?:{_NAMES}) *(?:EMPTY|[(](?:{_NAMES}|EMPTY|[-+.,0-9eE() ])*[)])$"


def wkt_edges(wkt: str) -> str:
    """Edges of every ring of the polygons in a WKT text, holes included.

    Points, lines and empty shapes have no interior and give no edge. Collections
    give the edges of their polygons, and a leading SRID is passed over. Text that
    is none of these shapes is an error, never a shape without edges.
    """
    points = (
        "transform(split(ring, ','), pair -> transform(split(trim(pair), '[ ]+'), v -> cast(v as double)))"
    )
    ring_edges = (
        "zip_with(slice(points, 1, size(points) - 1), slice(points, 2, size(points) - 1), "
        "(a, b) -> named_struct('x1', get(a, 0), 'y1', get(a, 1), 'x2', get(b, 0), 'y2', get(b, 1)))"
    )
    one_line = f"trim(regexp_replace(translate({wkt}, '\n\r\t', '   '), '(?i)^ *SRID *= *[0-9]+ *;', ''))"
    # Rings of polygons stand in their brackets; those of points and lines in a collection do not count.
    areas = f"array_join(regexp_extract_all({one_line}, '{_AREA}', 0), ' ')"
    rings = f"regexp_extract_all({areas}, '[(]([^()]+)[)]', 1)"
    vertices = f"transform({rings}, ring -> {points})"
    edges = f"flatten(transform({vertices}, points -> {ring_edges}))"
    known = f"{one_line} rlike '{_SHAPE}'"
    return f"case when {known} then {edges} else raise_error(concat('not a WKT shape: ', left({wkt}, 80))) end"


def bounds(edges: str) -> str:
    """Bounding box; every ring is closed, so the start points are all vertices."""
    xs, ys = f"transform({edges}, e -> e.x1)", f"transform({edges}, e -> e.y1)"
    return (
        f"named_struct('x_min', array_min({xs}), 'x_max', array_max({xs}), "
        f"'y_min', array_min({ys}), 'y_max', array_max({ys}))"
    )


def edge_overlaps(x_lo: str, x_hi: str, y_lo: str, y_hi: str) -> str:
    """The bounding box of edge ``e`` meets the closed rectangle."""
    return (
        f"(greatest(e.x1, e.x2) >= {x_lo} and least(e.x1, e.x2) <= {x_hi} "
        f"and greatest(e.y1, e.y2) >= {y_lo} and least(e.y1, e.y2) <= {y_hi})"
    )


# Relative error of the orientation in doubles, below which its sign is certain: (3 + 16 u) u with u = 2^-53.
_CERTAIN = "3.3306690738754716e-16D"
# 2^27 + 1 splits a double into two halves whose products are exact.
_SPLITTER = "134217729D"


def exact_orientation(e: str, x: str, y: str) -> str:
    """A double with the exact sign of the orientation of a point against edge ``e``.

    The orientation is a sum of six products. Each is written as two doubles without error,
    and the twelve are added to an expansion: doubles that do not overlap, in ascending
    size, so the last one that is not zero has the sign of the sum.
    """
    pairs = (
        (f"{e}.x1", f"{e}.y2"), (f"{e}.x2", f"-{e}.y1"), (f"{e}.x2", y),
        (f"-({x})", f"{e}.y2"), (x, f"{e}.y1"), (f"-{e}.x1", y),
    )
    factors = ", ".join(f"named_struct('a', {a}, 'b', {b})" for a, b in pairs)
    halves = (
        f"transform(array({factors}), t -> named_struct('a', t.a, 'b', t.b, 'p', t.a * t.b, "
        f"'a1', {_SPLITTER} * t.a - ({_SPLITTER} * t.a - t.a), 'b1', {_SPLITTER} * t.b - ({_SPLITTER} * t.b - t.b)))"
    )
    error = "(t.a - t.a1) * (t.b - t.b1) - (((t.p - t.a1 * t.b1) - (t.a - t.a1) * t.b1) - t.a1 * (t.b - t.b1))"
    terms = f"flatten(transform({halves}, t -> array({error}, t.p)))"
    # Sum and its rounding error, from the largest component so far and the next one.
    lost = "(s.q - ((s.q + v) - ((s.q + v) - s.q))) + (v - ((s.q + v) - s.q))"
    nothing = "cast(array() as array<double>)"
    grown = (
        f"aggregate(sum, named_struct('q', term, 'h', {nothing}), "
        f"(s, v) -> named_struct('q', s.q + v, 'h', concat(s.h, array({lost}))), s -> concat(s.h, array(s.q)))"
    )
    expansion = f"aggregate({terms}, {nothing}, (sum, term) -> {grown})"
    return f"aggregate({expansion}, 0D, (sign, v) -> if(v <> 0D, v, sign))"


def orientation(e: str, x: str, y: str) -> str:
    """On which side of edge ``e`` a point lies: the sign is exact, zero is on the edge's line.

    Doubles decide wherever their rounding cannot change the sign; the few doubtful points
    are decided without rounding.
    """
    sides = (
        f"named_struct('l', ({e}.x2 - {e}.x1) * ({y} - {e}.y1), 'r', ({e}.y2 - {e}.y1) * ({x} - {e}.x1))"
    )
    certain = f"abs(d.l - d.r) >= {_CERTAIN} * (abs(d.l) + abs(d.r))"
    return (
        f"get(transform(array({sides}), d -> case when {certain} then d.l - d.r "
        f"else {exact_orientation(e, x, y)} end), 0)"
    )


def strictly_inside(edges: str, x: str, y: str) -> str:
    """Even-odd test with a ray to the right; on the boundary means outside.

    Edges the ray's line does not meet are passed over. The sign of the orientation tells
    left from right without dividing by the slope. A point on an edge makes the crossing
    count negative whatever else its ray meets.
    """
    level = f"least(e.y1, e.y2) <= {y} and greatest(e.y1, e.y2) >= {y}"
    met = (
        f"case when o = 0D and {edge_overlaps(x, x, y, y)} then -1000000000000L "
        f"when (e.y1 > {y}) <> (e.y2 > {y}) and (o > 0D) = (e.y2 > e.y1) then 1L else 0L end"
    )
    crossings = (
        f"aggregate({edges}, 0L, (n, e) -> n + case when {level} "
        f"then get(transform(array({orientation('e', x, y)}), o -> {met}), 0) else 0L end)"
    )
    return f"(greatest({crossings}, 0L) % 2 = 1)"

"""Planar geometry as SQL functions, which Catalyst inlines: values from well-known text or coordinates, measures, and the predicates that relate two of them.

A geometry is (dim, rings): dim 0 a point, 1 a line, 2 a polygon, whose first
ring is its outside and whose others are holes.  Coordinates are doubles and
comparisons are exact: there is no tolerance, and no unit but the coordinates'.
A null argument gives null.
"""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import SparkSession

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
GEO = f"STRUCT<dim: INT, rings: ARRAY<ARRAY<{POINT}>>>"
SEG = "STRUCT<ax: DOUBLE, ay: DOUBLE, bx: DOUBLE, by: DOUBLE>"
SEGS = f"ARRAY<{SEG}>"

# Pieces of SQL text. A lambda's variable cannot be the argument of a SQL function, so what works on single segments is written out.

_fresh = count()


def _var(stem: str) -> str:
    return f"{stem}_{next(_fresh)}"


def _let(value: str, kind: str, body) -> str:
    """body(name) with a value worked out once under that name."""
    v, old = _var("v"), _var("o")
    return f"aggregate(array({value}), CAST(NULL AS {kind}), ({old}, {v}) -> {body(v)})"


def _each(how: str, items: str, body) -> str:
    v = _var("e")
    return f"{how}({items}, {v} -> {body(v)})"


def _seg(ax: str, ay: str, bx: str, by: str) -> str:
    return f"named_struct('ax', {ax}, 'ay', {ay}, 'bx', {bx}, 'by', {by})"


def _segments(g: str) -> str:
    r, i = _var("r"), _var("i")
    one = _seg(f"{r}[0].x", f"{r}[0].y", f"{r}[0].x", f"{r}[0].y")
    more = _seg(f"{r}[{i}].x", f"{r}[{i}].y", f"{r}[{i} + 1].x", f"{r}[{i} + 1].y")
    return f"flatten(transform({g}.rings, {r} -> if(size({r}) < 2, array({one}), transform(sequence(0, size({r}) - 2), {i} -> {more}))))"


def _turn(s: str, x: str, y: str) -> str:
    """Over 0 left of a segment's line, under 0 right of it, 0 on it."""
    return f"(({s}.bx - {s}.ax) * ({y} - {s}.ay) - ({s}.by - {s}.ay) * ({x} - {s}.ax))"


def _on(s: str, x: str, y: str) -> str:
    return f"({_turn(s, x, y)} = 0 AND {x} BETWEEN least({s}.ax, {s}.bx) AND greatest({s}.ax, {s}.bx) AND {y} BETWEEN least({s}.ay, {s}.by) AND greatest({s}.ay, {s}.by))"


def _apart(s: str, t: str) -> str:
    """The ends of t lie on either side of s's line."""
    return f"{_turn(s, f'{t}.ax', f'{t}.ay')} * {_turn(s, f'{t}.bx', f'{t}.by')} < 0"


def _meet(s: str, t: str) -> str:
    ends = " OR ".join([_on(s, f"{t}.ax", f"{t}.ay"), _on(s, f"{t}.bx", f"{t}.by"), _on(t, f"{s}.ax", f"{s}.ay"), _on(t, f"{s}.bx", f"{s}.by")])
    return f"({_apart(s, t)} AND {_apart(t, s)} OR {ends})"


def _along(s: str, x: str, y: str) -> str:
    """How far along a segment a point's foot lies: 0 at its beginning, 1 at its end."""
    return f"try_divide(({x} - {s}.ax) * ({s}.bx - {s}.ax) + ({y} - {s}.ay) * ({s}.by - {s}.ay), power({s}.bx - {s}.ax, 2) + power({s}.by - {s}.ay, 2))"


def _cuts(s: str, t: str) -> str:
    """Where t meets s between the ends of s."""
    a = _turn(t, f"{s}.ax", f"{s}.ay")
    cross = f"if({_apart(s, t)}, try_divide({a}, {a} - {_turn(t, f'{s}.bx', f'{s}.by')}), NULL)"
    ends = [f"if({_on(s, f'{t}.{e}x', f'{t}.{e}y')}, {_along(s, f'{t}.{e}x', f'{t}.{e}y')}, NULL)" for e in "ab"]
    return _each("filter", f"array({cross}, {', '.join(ends)})", lambda u: f"{u} > 0 AND {u} < 1")


def _position(x: str, y: str, g: str, segs: str) -> str:
    """1 inside, 0 on the boundary, -1 outside. An open line's ends are its boundary, a point is its own inside."""
    point = f"named_struct('x', {x}, 'y', {y})"
    ends = f"{g}.rings[0][0] <> element_at({g}.rings[0], -1) AND ({g}.rings[0][0] = {point} OR element_at({g}.rings[0], -1) = {point})"
    at = lambda s: _on(s, x, y)
    crossed = _each("filter", segs, lambda s: f"({s}.ay > {y}) <> ({s}.by > {y}) AND {x} < ({s}.bx - {s}.ax) * ({y} - {s}.ay) / ({s}.by - {s}.ay) + {s}.ax")
    return (
        f"CASE WHEN {g}.dim = 0 THEN if({g}.rings[0][0].x = {x} AND {g}.rings[0][0].y = {y}, 1, -1) "
        f"WHEN {g}.dim = 1 THEN CASE WHEN NOT {_each('exists', segs, at)} THEN -1 WHEN {ends} THEN 0 ELSE 1 END "
        f"WHEN {_each('exists', segs, at)} THEN 0 WHEN size({crossed}) % 2 = 1 THEN 1 ELSE -1 END"
    )


def _inner(g: str, segs: str, body) -> str:
    """body(x, y) of a point inside a polygon: halfway between the first two crossings of a line between its two lowest heights."""
    p = _var("p")
    heights = f"array_sort(array_distinct(transform(flatten({g}.rings), {p} -> {p}.y)))"

    def at(y: str) -> str:
        crossed = _each("filter", segs, lambda s: f"({s}.ay > {y}) <> ({s}.by > {y})")
        xs = "array_sort(" + _each("transform", crossed, lambda s: f"({s}.bx - {s}.ax) * ({y} - {s}.ay) / ({s}.by - {s}.ay) + {s}.ax") + ")"
        return _let(xs, "INT", lambda v: body(f"(({v}[0] + get({v}, 1)) / 2)", y))

    return _let(heights, "INT", lambda ys: _let(f"({ys}[0] + get({ys}, 1)) / 2", "INT", at))


def _places(g: str, gs: str, h: str, hs: str) -> str:
    """Positions in h of the ends of g's segments, of the places where h cuts them, and of the middles between those (mid)."""

    def segment(s: str) -> str:
        cuts = f"flatten({_each('transform', hs, lambda t: _cuts(s, t))})"

        def found(us: str) -> str:
            at = lambda u: _position(f"if({u} = 1, {s}.bx, {s}.ax + {u} * ({s}.bx - {s}.ax))", f"if({u} = 1, {s}.by, {s}.ay + {u} * ({s}.by - {s}.ay))", h, hs)
            ends = _each("transform", us, lambda u: f"named_struct('mid', false, 'at', {at(u)})")
            pairs = _each("transform", f"if({g}.dim = 0, CAST(array() AS ARRAY<INT>), sequence(0, size({us}) - 2))", lambda i: f"({us}[{i}] + {us}[{i} + 1]) / 2")
            return f"concat({ends}, {_each('transform', pairs, lambda u: f'''named_struct('mid', true, 'at', {at(u)})''')})"

        return "flatten(" + _each("transform", f"array(array_sort(array_distinct(concat(array(0D, 1D), {cuts}))))", found) + ")"

    return f"flatten({_each('transform', gs, segment)})"


class _Pair:
    """Text of the relations of two geometries g and h whose segments are gs and hs."""

    def __init__(self, g: str, h: str, gs: str, hs: str):
        self.g, self.h, self.gs, self.hs = g, h, gs, hs

    def turned(self) -> "_Pair":
        return _Pair(self.h, self.g, self.hs, self.gs)

    def intersects(self) -> str:
        first = lambda a, b, bs: f"{_position(f'{a}.rings[0][0].x', f'{a}.rings[0][0].y', b, bs)} >= 0"
        return f"({_each('exists', self.gs, lambda s: _each('exists', self.hs, lambda t: _meet(s, t)))} OR {first(self.g, self.h, self.hs)} OR {first(self.h, self.g, self.gs)})"

    def places(self) -> str:
        return _places(self.g, self.gs, self.h, self.hs)

    def enters(self) -> str:
        """A piece of g's segments lies inside h."""
        return _each("exists", self.places(), lambda p: f"{p}.mid AND {p}.at = 1")

    def inner(self, least: int) -> str:
        """A point inside the polygon g has at least that position in h."""
        return f"({_inner(self.g, self.gs, lambda x, y: _position(x, y, self.h, self.hs))} >= {least})"

    def covers(self) -> str:
        back = self.turned()
        return f"({self.g}.dim >= {self.h}.dim AND {_each('forall', back.places(), lambda p: f'{p}.at >= 0')} AND ({self.h}.dim < 2 OR NOT {self.enters()} AND {back.inner(0)}))"

    def shared(self) -> str:
        """The insides have a point in common."""
        back = self.turned()
        first = lambda a, b, bs: f"{_position(f'{a}.rings[0][0].x', f'{a}.rings[0][0].y', b, bs)} = 1"
        lies = lambda pair: _each("exists", pair.places(), lambda p: f"{p}.at = 1")
        return (
            f"CASE WHEN {self.g}.dim = 0 THEN {first(self.g, self.h, self.hs)} WHEN {self.h}.dim = 0 THEN {first(self.h, self.g, self.gs)} "
            f"WHEN {self.g}.dim = 2 AND {self.h}.dim = 2 THEN {self.enters()} OR {back.enters()} OR {self.inner(1)} OR {back.inner(1)} "
            f"WHEN {self.g}.dim = 2 THEN {back.enters()} WHEN {self.h}.dim = 2 THEN {self.enters()} ELSE {lies(self)} AND {lies(back)} END"
        )

    def distance(self) -> str:
        def reach(s: str, x: str, y: str) -> str:
            u = f"greatest(0D, least(1D, coalesce({_along(s, x, y)}, 0D)))"
            return f"sqrt(power({x} - {s}.ax - {u} * ({s}.bx - {s}.ax), 2) + power({y} - {s}.ay - {u} * ({s}.by - {s}.ay), 2))"

        pair = lambda s, t: f"least({reach(s, f'{t}.ax', f'{t}.ay')}, {reach(s, f'{t}.bx', f'{t}.by')}, {reach(t, f'{s}.ax', f'{s}.ay')}, {reach(t, f'{s}.bx', f'{s}.by')})"
        every = _each("transform", self.gs, lambda s: _each("transform", self.hs, lambda t: pair(s, t)))
        return f"if({self.intersects()}, 0D, array_min(flatten({every})))"


def _of_pair(kind: str, body) -> str:
    """The body of a function of geometries g and h, whose segments are cut once."""
    # a lambda over the two arrays of segments: named once, used in all that follows
    v, old = _var("v"), _var("o")
    inner = body(_Pair("g", "h", f"{v}.gs", f"{v}.hs"))
    return f"if(g IS NULL OR h IS NULL, NULL, aggregate(array(named_struct('gs', {_segments('g')}, 'hs', {_segments('h')})), CAST(NULL AS {kind}), ({old}, {v}) -> CAST({inner} AS {kind})))"


def functions() -> list[tuple[str, str, str, str]]:
    """(name, parameters, result, body) of every function."""
    parse = (
        r"if(w IS NULL, NULL, named_struct('dim', CASE upper(regexp_extract(w, '([A-Za-z]+)\\s*\\(', 1)) WHEN 'POINT' THEN 0 WHEN 'LINESTRING' THEN 1 WHEN 'POLYGON' THEN 2 "
        r"ELSE CAST(raise_error(concat('no point, line or polygon: ', substr(w, 1, 40))) AS INT) END, "
        r"'rings', transform(regexp_extract_all(w, '\\(([^()]+)\\)', 1), r -> transform(split(trim(r), '\\s*,\\s*'), p -> named_struct('x', CAST(split(trim(p), '\\s+')[0] AS DOUBLE), 'y', CAST(split(trim(p), '\\s+')[1] AS DOUBLE))))))"
    )
    corner = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    low_x, high_x, low_y, high_y = "least(a, c)", "greatest(a, c)", "least(b, d)", "greatest(b, d)"
    ring = ", ".join([corner(low_x, low_y), corner(high_x, low_y), corner(high_x, high_y), corner(low_x, high_y), corner(low_x, low_y)])
    area = lambda r: f"abs(aggregate(sequence(0, size({r}) - 2), 0D, (n, i) -> n + {r}[i].x * {r}[i + 1].y - {r}[i + 1].x * {r}[i].y)) / 2"
    bound = lambda how, k: f"array_{how}(transform(flatten(g.rings), p -> p.{k}))"
    text = (
        "concat(CASE g.dim WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' ELSE 'POLYGON(' END, "
        "array_join(transform(g.rings, r -> concat('(', array_join(transform(r, p -> concat(CAST(p.x AS STRING), ' ', CAST(p.y AS STRING))), ', '), ')')), ', '), if(g.dim = 2, ')', ''))"
    )
    two = f"g {GEO}, h {GEO}"
    return [
        ("geo_parse", "w STRING", GEO, parse),
        ("geo_point", "x DOUBLE, y DOUBLE", GEO, "if(x IS NULL OR y IS NULL, NULL, named_struct('dim', 0, 'rings', array(array(named_struct('x', x, 'y', y)))))"),
        ("geo_box", "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE", GEO, f"if(a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL, NULL, named_struct('dim', 2, 'rings', array(array({ring}))))"),
        ("geo_path", "dim INT, o ARRAY<DOUBLE>", GEO, "if(o IS NULL OR exists(o, v -> v IS NULL), NULL, named_struct('dim', dim, 'rings', array(transform(sequence(0, CAST(size(o) / 2 AS INT) - 1), i -> named_struct('x', o[2 * i], 'y', o[2 * i + 1])))))"),
        ("geo_intersects", two, "BOOLEAN", _of_pair("BOOLEAN", lambda p: p.intersects())),
        ("geo_covers", two, "BOOLEAN", _of_pair("BOOLEAN", lambda p: p.covers())),
        ("geo_contains", two, "BOOLEAN", _of_pair("BOOLEAN", lambda p: f"{p.covers()} AND {p.shared()}")),
        ("geo_touches", two, "BOOLEAN", _of_pair("BOOLEAN", lambda p: f"{p.intersects()} AND NOT {p.shared()}")),
        ("geo_overlaps", two, "BOOLEAN", _of_pair("BOOLEAN", lambda p: f"g.dim = h.dim AND {p.shared()} AND NOT {p.covers()} AND NOT {p.turned().covers()}")),
        ("geo_equals", two, "BOOLEAN", _of_pair("BOOLEAN", lambda p: f"{p.covers()} AND {p.turned().covers()}")),
        ("geo_distance", two, "DOUBLE", _of_pair("DOUBLE", lambda p: p.distance())),
        ("geo_area", f"g {GEO}", "DOUBLE", f"CASE WHEN g IS NULL THEN NULL WHEN g.dim < 2 THEN 0D ELSE 2 * {area('g.rings[0]')} - aggregate(g.rings, 0D, (m, r) -> m + {area('r')}) END"),
        ("geo_length", f"g {GEO}", "DOUBLE", f"if(g IS NULL, NULL, aggregate({_segments('g')}, 0D, (n, s) -> n + sqrt(power(s.bx - s.ax, 2) + power(s.by - s.ay, 2))))"),
        ("geo_bounds", f"g {GEO}", SEG, f"if(g IS NULL, NULL, {_seg(bound('min', 'x'), bound('min', 'y'), bound('max', 'x'), bound('max', 'y'))})"),
        ("geo_text", f"g {GEO}", "STRING", f"if(g IS NULL, NULL, {text})"),
    ]


def register(spark: SparkSession, sql: str) -> None:
    """Makes the functions that a SQL text calls known to the session, unless they are."""
    wanted = set(re.findall(r"\bgeo_\w+", sql))
    for name, parameters, result, body in functions() if wanted else ():
        if name in wanted and not spark.catalog.functionExists(name):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

"""Polygons as rings: ``array<struct<x,y>>`` without a closing point, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ring(*pairs) -> Column:
    """Ring of literal coordinates."""
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in pairs])


def turned(r: Column) -> Column:
    """The ring with its first point last: zipped with the ring it gives the edges."""
    return F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def edges(r: Column) -> Column:
    """``array<struct<a,b>>`` of consecutive vertices, the last back to the first."""
    return F.zip_with(r, turned(r), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(r: Column) -> Column:
    """Shoelace area, positive for counter-clockwise rings."""
    return F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def area(r: Column, holes: Column | None = None) -> Column:
    whole = F.abs(signed_area(r))
    if holes is None:
        return whole
    return whole - F.aggregate(F.coalesce(holes, F.array()), F.lit(0.0), lambda s, h: s + F.abs(signed_area(h)))


def _length(e: Column) -> Column:
    return F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])


def perimeter(r: Column, holes: Column | None = None) -> Column:
    one = lambda q: F.aggregate(edges(q), F.lit(0.0), lambda s, e: s + _length(e))
    return one(r) if holes is None else one(r) + F.aggregate(F.coalesce(holes, F.array()), F.lit(0.0), lambda s, h: s + one(h))


def counter_clockwise(r: Column) -> Column:
    return F.when(signed_area(r) >= 0, r).otherwise(F.reverse(r))


def contains(r: Column, x: Column, y: Column) -> Column:
    """Even-odd test by counting edges that a ray to the right crosses."""
    crossing = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges(r), crossing)) % 2 == 1


def bounds(r: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def segment_distance(e: Column, x: Column, y: Column) -> Column:
    """Distance of a point from an edge."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-30))))
    return F.hypot(e["a"]["x"] + t * dx - x, e["a"]["y"] + t * dy - y)


def distance(r: Column, x: Column, y: Column) -> Column:
    """Distance of a point from the area: 0 inside."""
    return F.when(contains(r, x, y), 0.0).otherwise(F.array_min(F.transform(edges(r), lambda e: segment_distance(e, x, y))))


def dedupe(r: Column, tol: float = 1e-6) -> Column:
    """Without vertices that repeat their predecessor (around the ring)."""
    pairs = F.zip_with(r, F.concat(F.slice(r, -1, 1), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.transform(F.filter(pairs, lambda e: F.hypot(e["p"]["x"] - e["q"]["x"], e["p"]["y"] - e["q"]["y"]) > tol), lambda e: e["p"])


def drop_collinear(r: Column, tol: float = 1e-9) -> Column:
    """Without vertices in the middle of a straight run; rings of fewer than three corners stay."""
    before = F.concat(F.slice(r, -1, 1), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))))
    trio = F.zip_with(F.zip_with(before, r, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), turned(r), lambda ab, c: F.struct(ab["a"].alias("a"), ab["b"].alias("b"), c.alias("c")))
    turn = lambda e: (e["b"]["x"] - e["a"]["x"]) * (e["c"]["y"] - e["b"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (e["c"]["x"] - e["b"]["x"])
    kept = F.transform(F.filter(trio, lambda e: F.abs(turn(e)) > tol), lambda e: e["b"])
    return F.when(F.size(kept) >= 3, kept).otherwise(r)


def is_rectilinear(r: Column, tol: float = 1e-6) -> Column:
    """Whether every edge runs along an axis."""
    return F.forall(edges(r), lambda e: (F.abs(e["b"]["x"] - e["a"]["x"]) < tol) | (F.abs(e["b"]["y"] - e["a"]["y"]) < tol))


def crossings(r: Column, y: Column) -> Column:
    """Sorted x of the places where the outline crosses a horizontal line."""
    cut = F.filter(edges(r), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    return F.array_sort(F.transform(cut, lambda e: e["a"]["x"] + (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])))


def chords(r: Column, y: Column) -> Column:
    """``array<struct<x0,x1>>``: the stretches of a horizontal line inside the area."""
    xs = crossings(r, y)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1), lambda k: F.struct(F.get(xs, 2 * k).alias("x0"), F.get(xs, 2 * k + 1).alias("x1")))


def chord_through(r: Column, x: Column, y: Column) -> Column:
    """Length of the chord that a point lies on; the width of the bounds outside the area."""
    here = F.when(F.size(crossings(r, y)) >= 2, F.filter(chords(r, y), lambda c: (c["x0"] - 1e-9 <= x) & (x <= c["x1"] + 1e-9)))
    box = bounds(r)
    return F.coalesce(F.get(F.transform(here, lambda c: c["x1"] - c["x0"]), F.lit(0)), box["x1"] - box["x0"])


def centroid(r: Column) -> Column:
    a = signed_area(r)
    moment = lambda k: F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + (e["a"][k] + e["b"][k]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / (6 * a)
    return point(moment("x"), moment("y"))


def label_point(r: Column, c: Column | None = None, box: Column | None = None) -> Column:
    """A point inside: the centroid, or the middle of the longest chord half way up. ``c`` and ``box`` are
    the ring's centroid and bounds where a row has them, for as expressions they run once an edge."""
    c, box = centroid(r) if c is None else c, bounds(r) if box is None else box
    y = (box["y0"] + box["y1"]) / 2 + (box["y1"] - box["y0"]) * 1e-7
    spans = F.transform(chords(r, y), lambda k: F.struct((k["x1"] - k["x0"]).alias("w"), ((k["x0"] + k["x1"]) / 2).alias("x")))
    return F.when(contains(r, c["x"], c["y"]), c).otherwise(point(F.array_max(spans)["x"], y))


def scaled(r: Column, factor: Column) -> Column:
    return F.transform(r, lambda p: point(p["x"] * factor, p["y"] * factor))


def impossible(r: Column) -> Column:
    """Whether no shape can have this area and outline: nothing, or longer than a circle by 12, or shorter."""
    a, p = area(r), perimeter(r)
    circle = 2 * F.sqrt(F.lit(3.141592653589793) * a)
    return (a <= 0) | (p <= 0) | (p < circle - 1e-6) | (p > 12 * circle)


def quarter_arc(hx: Column, hy: Column, tx: Column, ty: Column, jx: Column, jy: Column, n: int = 14) -> Column:
    """Points of a door leaf's way about its hinge from its tip to the far jamb, the short way."""
    import math

    radius = F.hypot(tx - hx, ty - hy)
    a0, a1 = F.atan2(ty - hy, tx - hx), F.atan2(jy - hy, jx - hx)
    da = F.pmod(a1 - a0 + math.pi, F.lit(2 * math.pi)) - math.pi
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: point(hx + radius * F.cos(a0 + da * k / n), hy + radius * F.sin(a0 + da * k / n)))


def vertices_from(r: Column, start: Column) -> Column:
    """The ring rotated to begin at a 0-based index."""
    return F.concat(F.slice(r, start + 1, F.size(r)), F.when(start > 0, F.slice(r, 1, F.greatest(start, F.lit(1)))).otherwise(F.slice(r, 1, 0)))

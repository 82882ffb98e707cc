"""Whole sheets: the plan with dimension chains, axes, door swings, tags and room labels, and
beside it schedules, notes, stamp, north arrow and title block. A sheet is the same table of
primitives as a bare drawing, so every drawing format writes it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings, text
from ..functions.walls import WallColumns
from ..functions.words import WORDS
from ..operators.graph import checkpointed
from ..plans import quality, schedules
from . import sinks

W = WallColumns()
S = ["scene_id"]
LINE, GAP = 0.32, 1.2  # metres of a table's line, and between the plan and what stands beside it
FIELDS = ("scene_id", "o", "k", "kind", "points", "text", "layer", "size")


def _prim(df: DataFrame, order: int, k: Column, layer: str, kind: str, points: Column, words: Column | None = None, size: float | Column = 0.15) -> DataFrame:
    words = F.lit(None).cast("string") if words is None else words
    size = size if isinstance(size, Column) else F.lit(float(size))
    return df.select("scene_id", F.lit(order).alias("o"), k.cast("long").alias("k"), F.lit(kind).alias("kind"), points.alias("points"), words.alias("text"), F.lit(layer).alias("layer"), size.alias("size"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*FIELDS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FIELDS))
    return out


def _made(*parts: DataFrame) -> DataFrame:
    """One checkpointed table of several: a plan of dozens of branches would be optimised anew after
    every stage of each."""
    return checkpointed(_union(list(parts)))


def word(key: Column | str, lang: str) -> Column:
    return text.label(WORDS, F.lit(lang), key if isinstance(key, Column) else F.lit(key))


def dimension_lines(walls: DataFrame, openings: DataFrame, rooms: DataFrame, units: str = "m") -> list[DataFrame]:
    """Chains along walls: a line, a slanted tick a station, a length a stretch."""
    c = schedules.chains(walls, openings, rooms).withColumnRenamed("wall", "id").join(walls, [*S, "id"])
    off = F.col("side") * F.col("offset")
    line = _prim(c, 6, F.col("id"), "dims", "polyline", F.array(W.at(F.element_at("stations", 1), off), W.at(F.element_at("stations", -1), off)))
    t = F.col("t")
    tick = c.select("*", off.alias("off"), F.posexplode("stations").alias("i", "t"))
    ticks = _prim(tick, 6, F.col("id") * 1000 + F.col("i"), "dims", "polyline", F.array(W.at(t - 0.06, F.col("off") - 0.06), W.at(t + 0.06, F.col("off") + 0.06)))
    pairs = F.zip_with(F.slice("stations", 1, F.size("stations") - 1), F.slice("stations", 2, F.size("stations")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    span = c.select("*", (F.col("side") * (F.col("offset") + 0.14)).alias("off"), F.posexplode(pairs).alias("i", "p")).filter("p.b - p.a >= 0.05")
    said = _prim(span, 6, F.col("id") * 1000 + F.col("i"), "dims", "text", F.array(W.at((F.col("p.a") + F.col("p.b")) / 2, F.col("off"))), text.length_text(F.col("p.b") - F.col("p.a"), units), 0.13)
    return [line, ticks, said]


def axis_lines(walls: DataFrame, extents: DataFrame) -> list[DataFrame]:
    """Reference axes through the plan with their names in circles."""
    a = schedules.reference_axes(walls).join(extents, S)
    up, p = F.col("orientation") == "x", F.col("position")
    ends = F.when(up, F.array(rings.point(p, F.col("y0") - GAP), rings.point(p, F.col("y1") + 0.3))).otherwise(F.array(rings.point(F.col("x0") - GAP, p), rings.point(F.col("x1") + 0.3, p)))
    a = a.withColumns({"ends": ends, "n": F.row_number().over(Window.partitionBy("scene_id").orderBy("orientation", "name"))})
    centre = F.get("ends", F.lit(0))
    circle = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: rings.point(centre["x"] + 0.22 * F.cos(k * (math.pi / 8)), centre["y"] + 0.22 * F.sin(k * (math.pi / 8))))
    n = F.col("n")
    return [_prim(a, 7, n, "axis", "polyline", F.col("ends")), _prim(a, 8, n, "axis", "polygon", circle), _prim(a, 9, n, "axis", "text", F.array(centre), F.col("name"), 0.18)]


def door_swings(openings: DataFrame, walls: DataFrame, rooms: DataFrame) -> list[DataFrame]:
    """Leaf and way of each door, to the side of its room."""
    doors = openings.filter("kind = 'door'").select("scene_id", "id", "wall_id", "t0", "t1").join(schedules.swing_sides(openings, walls, rooms), [*S, "id"])
    on = doors.withColumnRenamed("id", "opening").withColumnRenamed("wall_id", "id").join(walls, [*S, "id"])
    hinge, jamb, tip = W.at(F.col("t0")), W.at(F.col("t1")), W.at(F.col("t0"), F.col("side") * (F.col("t1") - F.col("t0")))
    on = on.withColumns({"hinge": hinge, "jamb": jamb, "tip": tip})
    arc = rings.quarter_arc(*(F.col(f"{p}.{c}") for p in ("hinge", "tip", "jamb") for c in "xy"))
    k = F.col("opening")
    return [_prim(on, 5, k, "swing", "polyline", F.array("hinge", "tip")), _prim(on, 5, k + 100_000, "swing", "polyline", arc)]


def labels(rooms: DataFrame, walls: DataFrame, openings: DataFrame, units: str = "m") -> list[DataFrame]:
    """Room labels line by line, wall tags beside their walls."""
    r = schedules.room_labels(rooms, units=units).select("scene_id", "id", "x", "y", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    y = F.col("y") + (F.col("n") / 2.0 - F.col("i") - 0.5) * 0.24
    tags = schedules.wall_tags(walls, openings, rooms)
    return [_prim(r, 10, F.col("id") * 100 + F.col("i"), "label", "text", F.array(rings.point(F.col("x"), y)), F.col("line.text"), F.col("line.size") / 80.0), _prim(tags, 10, F.col("wall_id") + 1_000_000, "label", "text", F.array("p"), F.concat(F.lit("M"), (F.col("wall_id") + 1).cast("string")), 0.13)]


def table_rows(rows: DataFrame, columns: list[tuple[Column, float]], extents: DataFrame, order: int, skip: Column) -> list[DataFrame]:
    """Rows ``(scene_id, line)`` of a table right of the plan, ``skip`` lines down: a text a cell."""
    on = rows.join(extents, S)
    y = F.col("y1") - LINE * (F.col("line") + skip)
    return [_prim(on, order, F.col("line") * 100 + i, "table", "text", F.array(rings.point(F.col("x1") + GAP + left, y)), F.coalesce(value, F.lit("")), 0.16) for i, (value, left) in enumerate(columns)]


def sheet(walls: DataFrame, openings: DataFrame, rooms: DataFrame, info: DataFrame | None = None, found: DataFrame | None = None, stamps: DataFrame | None = None, units: str = "m", lang: str = "en") -> DataFrame:
    """Primitives of whole sheets. ``info(scene_id, project, sheet, north_deg, scale)`` fills the title
    block (any may be null), ``found`` are the plan's findings, ``stamps`` its stamp if it has one."""
    walls, openings, rooms = checkpointed(walls), checkpointed(openings), checkpointed(rooms)
    box = checkpointed(schedules.bounds(walls, rooms))
    bare = sinks.drawing(walls, openings, rooms, labelled=False).select("scene_id", F.lit(0).alias("o"), F.col("seq").cast("long").alias("k"), "kind", "points", "text", "layer", F.lit(0.15).alias("size"))
    parts = [_made(bare), _made(*door_swings(openings, walls, rooms)), _made(*dimension_lines(walls, openings, rooms, units)), _made(*axis_lines(walls, box)), *map(_made, labels(rooms, walls, openings, units))]

    heads = lambda df, keys: df.select("scene_id").distinct().select("scene_id", F.lit(0).alias("line"), *[word(k, lang).alias(f"c{i}") for i, k in enumerate(keys)])
    line = F.row_number().over(Window.partitionBy("scene_id").orderBy("position"))
    areas = checkpointed(schedules.area_schedule(rooms, walls, units))
    name = F.when(F.col("position") >= 1_000_000, word(F.col("name"), lang)).otherwise(F.col("name"))
    a = areas.select("scene_id", line.alias("line"), name.alias("c0"), F.col("area").alias("c1"), F.col("perimeter").alias("c2")).unionByName(heads(areas, ("room", "area", "perimeter")))
    parts += table_rows(a, [(F.col(f"c{i}"), x) for i, x in enumerate((0.9, 2.8, 4.6))], box, 20, F.lit(1))
    parts = [*parts[:-3], _made(*parts[-3:])]
    many = a.groupBy("scene_id").agg(F.count("*").alias("above"))
    doors = schedules.opening_schedule(openings, units)
    o = doors.select("scene_id", line.alias("line"), F.col("tag").alias("c0"), word(F.col("kind"), lang).alias("c1"), F.col("width").alias("c2"), F.col("height").alias("c3"), F.col("sill").alias("c4"), F.col("wall").alias("c5")).unionByName(heads(doors, ("tag", "kind", "width", "height", "sill", "wall")))
    o = o.join(many, S, "left").fillna(0, ["above"])
    parts += table_rows(o, [(F.col(f"c{i}"), x) for i, x in enumerate((0.3, 1.4, 2.6, 3.8, 5.0, 6.0))], box, 21, F.col("above") + 2)
    parts = [*parts[:-6], _made(*parts[-6:])]
    below = o.groupBy("scene_id").agg((F.count("*") + F.max("above")).alias("above"))
    if found is not None:
        noted = schedules.wrapped(quality.notes(checkpointed(found), walls, lang), 420.0).join(below, S, "left").fillna(0, ["above"])
        parts += table_rows(noted, [(F.concat(F.repeat(F.lit(" "), F.floor(F.col("indent") / 3).cast("int")), F.col("text")), 3.2)], box, 22, F.col("above") + 3)
    if stamps is not None:
        top = stamps.join(box, S)
        parts.append(_prim(top, 30, F.lit(0), "stamp", "text", F.array(rings.point((F.col("x0") + F.col("x1")) / 2, F.col("y1") + 0.9)), word(F.col("stamp"), lang), 0.28))
    if info is not None:
        at = info.join(box, S)
        rows = F.array(*[F.concat(word(k, lang), F.lit(": "), v) for k, v in (("project", F.coalesce("project", F.lit("-"))), ("sheet", F.coalesce("sheet", F.lit("A-01"))), ("scale", F.coalesce(F.format_string("1:%d", F.col("scale").cast("int")), F.lit("-"))), ("units", F.lit(units)))])
        titles = at.select("scene_id", "x0", "y0", F.posexplode(rows).alias("i", "t"))
        parts.append(_prim(titles, 31, F.col("i"), "title", "text", F.array(rings.point(F.col("x0") + 1.5, F.col("y0") - 2.0 - LINE * F.col("i"))), F.col("t"), 0.18))
        north = at.filter("north_deg is not null").withColumns({"a": F.radians("north_deg"), "cx": F.col("x1") + 0.4, "cy": F.col("y0") - 2.2})
        turn = lambda x, y: rings.point(F.col("cx") + x * F.cos("a") + y * F.sin("a"), F.col("cy") - x * F.sin("a") + y * F.cos("a"))
        parts += [_prim(north, 32, F.lit(0), "title", "polygon", F.array(turn(-0.15, 0.0), turn(0.15, 0.0), turn(0.0, 0.6))), _prim(north, 33, F.lit(0), "title", "text", F.array(turn(0.0, 0.8)), word("north", lang), 0.2)]
    ranked = [p.select("scene_id", F.struct("o", "k", "kind", "text").alias("rank"), "kind", "points", "text", "layer", "size") for p in parts]
    every = ranked[0]
    for p in ranked[1:]:
        every = every.unionByName(p)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("scene_id").orderBy("rank"))).drop("rank")

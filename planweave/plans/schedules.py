"""Derived tables of a plan: areas, openings, dimension chains, axes, labels, solids, edits.

Joins of a plan's tables ask for a merge: Spark guesses their sizes from the files that were read, without
what an explode or an array adds, and would send whole tables through the driver as broadcasts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings, text
from ..functions.walls import WallColumns
from ..operators import ordered, polygons, select

W = WallColumns()
S = ["scene_id"]
PRINT_SCALES = (20, 25, 50, 75, 100, 125, 150, 200, 250, 500)
# Paper sizes in millimetres, portrait (fixed values).
PAPER = {"A4": (210.0, 297.0), "A3": (297.0, 420.0), "A2": (420.0, 594.0), "A1": (594.0, 841.0), "Letter": (215.9, 279.4), "Legal": (215.9, 355.6), "Tabloid": (279.4, 431.8)}


def with_length(walls: DataFrame) -> DataFrame:
    return walls.withColumn("length", W.length)


def area_summary(rooms: DataFrame, walls: DataFrame) -> DataFrame:
    """Useful, wall and gross area (common parts once, at any angle) and wall length of each scene."""
    floor = polygons.edges(polygons.outlines(rooms, S), S, "ring", 0, F.col("hole"))
    body = polygons.edges(walls.select(*S, W.body.alias("ring")), S, "ring", 1)
    found = polygons.areas(polygons.trapezoids(floor.unionByName(body), S, 1.0), S, ["left", "right", "union"])
    length = walls.groupBy(*S).agg(F.sum(W.length).alias("wall_length_m"))
    every = rooms.select(*S).unionByName(walls.select(*S)).distinct()
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return every.join(found.hint("merge"), S, "left").join(length.hint("merge"), S, "left").select(*S, zero("left", "useful_m2"), zero("right", "walls_m2"), zero("union", "gross_m2"), zero("wall_length_m", "wall_length_m"))


def area_schedule(rooms: DataFrame, walls: DataFrame, units: str = "m") -> DataFrame:
    """Rooms in order and three totals: scene_id, position, name, area, perimeter, floor_seen."""
    seen = F.when(F.col("floor_seen").isNotNull(), F.concat(F.bround(100 * F.col("floor_seen")).cast("int").cast("string"), F.lit(" %")))
    rows = rooms.select("scene_id", F.col("id").alias("position"), F.concat("name", F.when(F.col("closed"), "").otherwise(" *")).alias("name"), text.area_text(rings.area(F.col("polygon"), F.col("holes")), units).alias("area"), text.length_text(rings.perimeter(F.col("polygon"), F.col("holes")), units).alias("perimeter"), seen.alias("floor_seen"))
    sums = area_summary(rooms, walls)
    none = F.lit(None).cast("string")
    totals = F.array(
        F.struct(F.lit(1_000_000).alias("position"), F.lit("useful").alias("name"), text.area_text(F.col("useful_m2"), units).alias("area"), none.alias("perimeter")),
        F.struct(F.lit(1_000_001).alias("position"), F.lit("walls").alias("name"), text.area_text(F.col("walls_m2"), units).alias("area"), text.length_text(F.col("wall_length_m"), units).alias("perimeter")),
        F.struct(F.lit(1_000_002).alias("position"), F.lit("gross").alias("name"), text.area_text(F.col("gross_m2"), units).alias("area"), none.alias("perimeter")),
    )
    return rows.unionByName(sums.select("scene_id", F.explode(totals).alias("t")).select("scene_id", "t.*", none.alias("floor_seen")))


def opening_schedule(openings: DataFrame, units: str = "m") -> DataFrame:
    """Openings by kind and tag (as texts): tag, kind, width, height, sill of windows, wall."""
    order = F.row_number().over(Window.partitionBy("scene_id").orderBy("kind", "tag"))
    return openings.select(
        "scene_id", order.alias("position"), F.coalesce(F.nullif("tag", F.lit("")), F.lit("-")).alias("tag"), "kind", text.length_text(F.col("t1") - F.col("t0"), units).alias("width"), text.length_text(F.col("z1") - F.col("z0"), units).alias("height"),
        F.when(F.col("kind") == "window", text.length_text(F.col("z0"), units)).otherwise("-").alias("sill"), F.concat(F.lit("M"), (F.col("wall_id") + 1).cast("string")).alias("wall"),
    )


def sides(walls: DataFrame, rooms: DataFrame, probe: float = 0.3) -> DataFrame:
    """Walls with the area of the room on either side of their middle (0 for none)."""
    at = lambda sign: W.at(W.length / 2, (F.col("thickness") / 2 + probe) * sign)
    asked = walls.select("scene_id", F.col("id").alias("wall"), at(1.0).alias("p"), at(-1.0).alias("q"))
    inside = select.once(rooms.select("scene_id", F.col("id").alias("room"), "polygon", "holes"), area=rings.area(F.col("polygon"), F.col("holes"))).drop("holes")
    met = asked.join(inside.hint("merge"), S)
    first = lambda p: F.min(F.when(rings.contains(F.col("polygon"), F.col(f"{p}.x"), F.col(f"{p}.y")), F.struct("room", "area")))["area"]
    hit = met.groupBy("scene_id", F.col("wall").alias("id")).agg(first("p").alias("plus"), first("q").alias("minus"))
    out = walls.withColumn("length", W.length).join(hit.hint("merge"), ["scene_id", "id"], "left")
    return out.fillna(0.0, ["plus", "minus"])


def swing_sides(openings: DataFrame, walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """+1 or -1: the side of the wall to which each opening's room lies."""
    on = openings.select("scene_id", F.col("id").alias("opening"), F.col("wall_id").alias("id"), "t0", "t1").join(walls.hint("merge"), ["scene_id", "id"])
    probe = on.select("scene_id", "opening", W.at((F.col("t0") + F.col("t1")) / 2, F.col("thickness") / 2 + 0.3).alias("p"))
    met = probe.join(rooms.select("scene_id", "polygon").hint("merge"), S, "left")
    hit = F.bool_or(F.coalesce(rings.contains(F.col("polygon"), F.col("p.x"), F.col("p.y")), F.lit(False)))
    return met.groupBy("scene_id", F.col("opening").alias("id")).agg(F.when(hit, 1.0).otherwise(-1.0).alias("side"))


def stations(walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Walls with the sorted stations of their ends and openings."""
    held = openings.groupBy("scene_id", F.col("wall_id").alias("id")).agg(F.collect_list(F.struct("t0", "t1")).alias("cuts"))
    joined = walls.join(held.hint("merge"), ["scene_id", "id"], "left")
    none = F.array().cast("array<struct<t0:double,t1:double>>")
    return joined.withColumn("stations", ordered.stations(W.length, F.coalesce("cuts", none))).withColumn("n_openings", F.size(F.coalesce("cuts", none))).drop("cuts")


def chains(walls: DataFrame, openings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Dimension chains: along outer walls of a metre or more on the side without a room, and along
    partitions with openings inside the larger room: wall, side, stations, offset, inside."""
    both = stations(sides(walls, rooms), openings)
    outer = ((F.col("plus") > 0) != (F.col("minus") > 0)) & (F.col("length") >= 1.0)
    inner = (F.col("plus") > 0) & (F.col("minus") > 0) & (F.col("length") >= 0.8) & (F.col("n_openings") > 0)
    side = F.when(inner, F.when(F.col("plus") >= F.col("minus"), 1.0).otherwise(-1.0)).otherwise(F.when(F.col("plus") == 0, 1.0).otherwise(-1.0))
    return both.filter(outer | inner).select("scene_id", F.col("id").alias("wall"), side.alias("side"), "stations", (F.col("thickness") / 2 + F.when(inner, 0.35).otherwise(0.5)).alias("offset"), inner.alias("inside"))


def reference_axes(walls: DataFrame, merge: float = 0.35) -> DataFrame:
    """Letters for upright walls from the left, numbers for level ones from the top: scene_id,
    orientation, name, position."""
    up, level = F.abs(W.dx) < 0.05, F.abs(W.dy) < 0.05
    held = walls.groupBy("scene_id").agg(F.collect_list(F.when(up, (F.col("ax") + F.col("bx")) / 2)).alias("xs"), F.collect_list(F.when(level & ~up, (F.col("ay") + F.col("by")) / 2)).alias("ys"))
    fold = held.select("scene_id", ordered.running_clusters(F.col("xs"), merge).alias("xs"), F.reverse(ordered.running_clusters(F.col("ys"), merge)).alias("ys"))
    letters = fold.select("scene_id", F.lit("x").alias("orientation"), F.posexplode("xs").alias("k", "position")).filter("k < 26").select("scene_id", "orientation", F.char(F.col("k") + 65).alias("name"), "position")
    numbers = fold.select("scene_id", F.lit("y").alias("orientation"), F.posexplode("ys").alias("k", "position")).select("scene_id", "orientation", (F.col("k") + 1).cast("string").alias("name"), "position")
    return letters.unionByName(numbers)


def axis_chains(walls: DataFrame) -> DataFrame:
    """Positions of the axes of each direction that has two or more."""
    held = reference_axes(walls).groupBy("scene_id", "orientation").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    return held.filter(F.size("positions") >= 2)


def wall_pieces(walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Solid boxes (t0, t1, z0, z1) of each wall around its openings: between them, below sills
    and above lintels. Overlapping openings are cut at the furthest end before them."""
    w = Window.partitionBy("scene_id", "wall_id").orderBy("t0", "t1")
    on = openings.join(walls.select("scene_id", F.col("id").alias("wall_id"), W.length.alias("length"), "height").hint("merge"), ["scene_id", "wall_id"]).withColumns({"a": F.greatest(F.lit(0.0), F.col("t0")), "b": F.least(F.col("length"), F.col("t1"))})
    on = on.withColumn("cursor", F.greatest(F.lit(0.0), F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))).filter("b > cursor")
    piece = lambda a, b, lo, hi, when: F.when(when, F.struct(a.alias("t0"), b.alias("t1"), lo.alias("z0"), hi.alias("z1")))
    zero, h = F.lit(0.0), F.col("height")
    parts = F.array(piece(F.col("cursor"), F.col("a"), zero, h, F.col("a") > F.col("cursor") + 1e-6), piece(F.col("a"), F.col("b"), zero, F.least("z0", h), F.col("z0") > 0.01), piece(F.col("a"), F.col("b"), F.greatest("z1", zero), h, F.col("z1") < h - 0.01))
    around = on.select("scene_id", "wall_id", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("scene_id", "wall_id", "p.*")
    last = openings.groupBy("scene_id", "wall_id").agg(F.max("t1").alias("last"))
    tail = walls.select("scene_id", F.col("id").alias("wall_id"), W.length.alias("length"), "height").join(last.hint("merge"), ["scene_id", "wall_id"], "left").withColumn("t0", F.greatest(F.lit(0.0), F.coalesce("last", F.lit(0.0)))).filter("length > t0 + 1e-6")
    return around.unionByName(tail.select("scene_id", "wall_id", "t0", F.col("length").alias("t1"), F.lit(0.0).alias("z0"), F.col("height").alias("z1")))


def _corner(t: Column, off: Column, z: Column) -> Column:
    """``W.at`` with a height, of a row that holds the wall's direction (dx, dy)."""
    x, y = F.col("ax") + F.col("dx") * t - F.col("dy") * off, F.col("ay") + F.col("dy") * t + F.col("dx") * off
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def model_faces(walls: DataFrame, openings: DataFrame, rooms: DataFrame, ceiling: float | None = None, slab: float = 0.05) -> DataFrame:
    """Faces of the solid model: scene_id, kind (wall, door, window, floor, ceiling), face (points)."""
    solid = wall_pieces(walls, openings).select("scene_id", "wall_id", F.lit("wall").alias("kind"), "t0", "t1", "z0", "z1", F.lit(None).cast("double").alias("th"))
    leaf = openings.filter("kind in ('door', 'window')").select("scene_id", "wall_id", "kind", "t0", "t1", F.when(F.col("kind") == "door", 0.0).otherwise(F.col("z0")).alias("z0"), "z1", F.when(F.col("kind") == "door", 0.04).otherwise(0.02).alias("th"))
    on = solid.unionByName(leaf).filter("t1 - t0 > 1e-4 and z1 - z0 > 1e-4").withColumnRenamed("wall_id", "id").join(walls.hint("merge"), ["scene_id", "id"])
    on = select.once(on, h=F.coalesce("th", "thickness") / 2, dx=W.dx, dy=W.dy)
    c = lambda t, s, z: _corner(F.col(f"t{t}"), F.col("h") * s, F.col(f"z{z}"))
    quads = F.array(*[F.array(*[c(*p) for p in q]) for q in (
        ((0, -1, 1), (1, -1, 1), (1, 1, 1), (0, 1, 1)), ((0, -1, 0), (1, -1, 0), (1, -1, 1), (0, -1, 1)), ((0, 1, 0), (1, 1, 0), (1, 1, 1), (0, 1, 1)), ((0, -1, 0), (0, 1, 0), (0, 1, 1), (0, -1, 1)), ((1, -1, 0), (1, 1, 0), (1, 1, 1), (1, -1, 1)))])
    faces = on.select("scene_id", "kind", F.explode(quads).alias("face"))
    lift = lambda r, z: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(float(z)).alias("z")))
    floors = rooms.select("scene_id", F.lit("floor").alias("kind"), lift(F.col("polygon"), 0.0).alias("face"))
    rim = rooms.select("scene_id", F.lit("floor").alias("kind"), F.explode(rings.edges(F.col("polygon"))).alias("e"))
    corner = lambda p, z: F.struct(F.col(f"e.{p}.x").alias("x"), F.col(f"e.{p}.y").alias("y"), F.lit(float(z)).alias("z"))
    rim = rim.select("scene_id", "kind", F.array(corner("a", -slab), corner("b", -slab), corner("b", 0), corner("a", 0)).alias("face"))
    out = faces.unionByName(floors).unionByName(rim)
    if ceiling is not None:
        out = out.unionByName(rooms.select("scene_id", F.lit("ceiling").alias("kind"), lift(F.col("polygon"), ceiling).alias("face")))
    return out


def painted(faces: DataFrame, azimuth: float = -35.0, elevation: float = 32.0) -> DataFrame:
    """Faces in painter's order, the far ones first: scene_id, rank, kind, outline on screen."""
    from ..functions.vec import isometric

    flat = F.transform("face", lambda p: isometric(p["x"], p["y"], p["z"], azimuth, elevation))
    depth = lambda c: F.aggregate(c, F.lit(0.0), lambda s, p: s + p["depth"]) / F.size(c)
    seen = select.once(faces, screen=flat)
    seen = select.once(seen, depth=depth(F.col("screen")))
    w = Window.partitionBy("scene_id").orderBy(F.desc("depth"), "kind")
    return seen.select("scene_id", F.row_number().over(w).alias("rank"), "kind", F.transform("screen", lambda p: F.struct(p["sx"].alias("x"), p["sy"].alias("y"))).alias("outline"), "depth")


def scene_stats(faces: DataFrame) -> DataFrame:
    return faces.groupBy("scene_id").agg(F.count_distinct("kind").alias("geometries"), F.sum(F.size("face")).alias("vertices"), F.count("*").alias("faces"))


def open_edges(rooms: DataFrame, walls: DataFrame, tol: float = 0.15, least: float = 0.2) -> DataFrame:
    """Stretches of open rooms' outlines on no wall: the sides that were not scanned. The wall boxes
    that touch an edge cut it; what is left comes from an interval difference."""
    edge = rooms.filter("not closed").select("scene_id", F.col("id").alias("room"), F.posexplode(rings.edges(F.col("polygon"))).alias("k", "e"))
    edge = edge.select("scene_id", "room", "k", F.col("e.a.x").alias("ex"), F.col("e.a.y").alias("ey"), F.col("e.b.x").alias("fx"), F.col("e.b.y").alias("fy")).withColumn("length", F.hypot(F.col("fx") - F.col("ex"), F.col("fy") - F.col("ey"))).filter("length >= 0.05")
    box = rings.bounds(W.body)
    near = walls.select("scene_id", box.alias("b"))
    dx, dy = (F.col("fx") - F.col("ex")) / F.col("length"), (F.col("fy") - F.col("ey")) / F.col("length")

    def slab(p, d, lo, hi):
        a, b = (lo - p) / F.when(F.abs(d) > 1e-12, d), (hi - p) / F.when(F.abs(d) > 1e-12, d)
        on = p.between(lo, hi)
        return F.coalesce(F.least(a, b), F.when(on, F.lit(-1e9)).otherwise(1e9)), F.coalesce(F.greatest(a, b), F.when(on, F.lit(1e9)).otherwise(-1e9))

    j = edge.join(near.hint("merge"), S)
    x0, x1 = slab(F.col("ex"), dx, F.col("b.x0") - tol, F.col("b.x1") + tol)
    y0, y1 = slab(F.col("ey"), dy, F.col("b.y0") - tol, F.col("b.y1") + tol)
    cut = j.select("scene_id", "room", "k", F.greatest(F.lit(0.0), x0, y0).alias("t0"), F.least("length", x1, y1).alias("t1")).filter("t1 > t0")
    whole = edge.select("scene_id", "room", "k", F.lit(0.0).alias("t0"), F.col("length").alias("t1"))
    left = ordered.interval_difference(whole, cut, ["scene_id", "room", "k"], least)
    return left.join(edge.hint("merge"), ["scene_id", "room", "k"]).select("scene_id", "room", rings.point(F.col("ex") + dx * F.col("t0"), F.col("ey") + dy * F.col("t0")).alias("a"), rings.point(F.col("ex") + dx * F.col("t1"), F.col("ey") + dy * F.col("t1")).alias("b"))


def room_labels(rooms: DataFrame, scale: float = 80.0, units: str = "m", smallest: float = 6.0) -> DataFrame:
    """Lines of each room's label with sizes that fit its chord, and where it stands."""
    poly = F.col("polygon")
    on = select.once(rooms, c=rings.centroid(poly), box=rings.bounds(poly))
    on = select.once(on, p=rings.label_point(poly, F.col("c"), F.col("box")))
    on = select.once(on, avail=F.greatest(F.lit(0.3), rings.chord_through(poly, F.col("p.x"), F.col("p.y")) - 0.16) * scale)
    said = F.filter(F.array(F.when(~F.col("closed"), F.lit("incomplete")), F.when(F.col("floor_seen") < 0.60, F.concat(F.lit("floor seen "), F.bround(100 * F.col("floor_seen")).cast("int").cast("string"), F.lit(" %")))), lambda x: x.isNotNull())
    note = F.concat(F.lit("("), F.array_join(said, " · "), F.lit(")"))
    line = lambda t, s, b: F.struct(t.alias("text"), F.lit(float(s)).alias("size"), F.lit(b).alias("bold"))
    fits = lambda t, s, b: text.text_width(t, s, b) <= F.col("avail")
    dims = F.concat(text.length_text(F.col("box.x1") - F.col("box.x0"), units), F.lit(" × "), text.length_text(F.col("box.y1") - F.col("box.y0"), units))
    area = text.area_text(rings.area(poly, F.col("holes")), units)
    on = select.once(on, area=area, dims=dims, note=note, one=F.concat_ws(" ", "name", note))
    area, dims, note, one = (F.col(c) for c in ("area", "dims", "note", "one"))
    on = select.once(on, head=F.when(F.size(said) == 0, F.array(line(F.col("name"), 13, True))).when(fits(one, 13.0, True), F.array(line(one, 13, True))).otherwise(F.array(line(F.col("name"), 13, True), line(note, 11, False))))
    both = F.concat(area, F.lit(" · "), dims)
    body = F.when(fits(both, 11.0, False), F.array(line(both, 11, False))).otherwise(F.array(line(area, 11, False), line(dims, 11, False)))
    wide = lambda x: F.when(x["bold"], text.text_width(x["text"], x["size"], True)).otherwise(text.text_width(x["text"], x["size"], False))
    on = select.once(on, lines=F.concat("head", body))
    on = select.once(on, wide=F.transform("lines", wide))
    size = lambda x, w: F.when(w > F.col("avail"), F.greatest(F.lit(smallest), x["size"] * F.col("avail") / w)).otherwise(x["size"])
    fitted = F.zip_with("lines", "wide", lambda x, w: F.struct(x["text"].alias("text"), size(x, w).alias("size"), x["bold"].alias("bold")))
    return on.select("scene_id", "id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), fitted.alias("lines"))


def wall_tags(walls: DataFrame, openings: DataFrame, rooms: DataFrame, avoid: DataFrame | None = None, radius: float = 0.12) -> DataFrame:
    """Where each wall's tag stands: beside the middle of its longest solid stretch, on the larger
    room's side, off the boxes ``avoid(scene_id, x0, y0, x1, y1)`` if any place is."""
    on = stations(sides(walls, rooms), openings)
    side = F.when(F.col("plus") >= F.col("minus"), 1.0).otherwise(-1.0)
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size("stations") - 2, F.lit(0))), lambda k: F.struct(F.get("stations", k).alias("a"), F.get("stations", k + 1).alias("b")))
    span = on.select("scene_id", F.col("id").alias("wall_id"), "ax", "ay", "bx", "by", "thickness", "length", side.alias("side"), F.explode(spans).alias("s"))
    cut = openings.select("scene_id", "wall_id", F.round("t0", 6).alias("ca"), F.round("t1", 6).alias("cb")).distinct()
    solid = span.withColumns({"ca": F.round("s.a", 6), "cb": F.round("s.b", 6)}).join(cut.hint("merge"), ["scene_id", "wall_id", "ca", "cb"], "left_anti").filter(F.col("s.b") - F.col("s.a") >= 0.25)
    place = solid.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), (F.col("s.a") + (F.col("s.b") - F.col("s.a")) * f).alias("t")) for i, f in enumerate((0.5, 0.25, 0.75))]))).withColumn("flip", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    at = W.at(F.col("c.t"), F.col("side") * F.col("flip") * (F.col("thickness") / 2 + 0.28))
    place = place.withColumn("p", at).select("scene_id", "wall_id", "p", (F.col("side") * F.col("flip")).alias("side"), F.struct(-F.col("flip"), F.when(F.col("c.o") == 0, 0).otherwise(1), -(F.col("s.b") - F.col("s.a")), F.col("c.o"), F.col("c.t")).alias("order"))
    if avoid is None:
        hit = place.withColumn("bad", F.lit(0))
    else:
        on_box = place.join(avoid.hint("merge"), S).filter((F.col("p.x") >= F.col("x0") - radius) & (F.col("p.x") <= F.col("x1") + radius) & (F.col("p.y") >= F.col("y0") - radius) & (F.col("p.y") <= F.col("y1") + radius)).select("scene_id", "wall_id", "order").distinct().withColumn("bad", F.lit(1))
        hit = place.join(on_box.hint("merge"), ["scene_id", "wall_id", "order"], "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    best = hit.groupBy("scene_id", "wall_id").agg(F.min_by(F.struct("p", "side"), F.struct("bad", "order")).alias("b"))
    beside = on.select("scene_id", F.col("id").alias("wall_id"), W.at(F.when(F.col("length") < 1.0, -0.18).otherwise(F.col("length") + 0.18), side * (F.col("thickness") / 2 + 0.28)).alias("q"), side.alias("s0"))
    return beside.join(best.hint("merge"), ["scene_id", "wall_id"], "left").select("scene_id", "wall_id", F.coalesce("b.p", "q").alias("p"), F.coalesce("b.side", "s0").alias("side"))


def elevation_rows(walls: DataFrame, scale: float = 50.0, widest: float = 1000.0, least: float = 0.6, gap: float = 60.0) -> DataFrame:
    """Walls seen face on, packed into rows of a sheet in order: scene_id, id, row, x. A fold over
    a scene's walls inside its row."""
    held = walls.withColumn("w", W.length * scale).filter(F.col("w") >= least * scale).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("ws"))
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("x"), F.array().cast("array<struct<id:int,row:int,x:double>>").alias("out"))

    def step(s, v):
        new = (s["x"] > 0) & (s["x"] + v["w"] > widest)
        row, x = F.when(new, s["row"] + 1).otherwise(s["row"]), F.when(new, 0.0).otherwise(s["x"])
        return F.struct(row.alias("row"), (x + v["w"] + gap).alias("x"), F.concat(s["out"], F.array(F.struct(v["id"].alias("id"), row.alias("row"), x.alias("x")))).alias("out"))

    return held.select("scene_id", F.explode(F.aggregate("ws", start, step, lambda s: s["out"])).alias("r")).select("scene_id", "r.*")


def bounds(walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """Extent of wall bodies and rooms of each scene."""
    b = walls.select("scene_id", rings.bounds(W.body).alias("b")).unionByName(rooms.select("scene_id", rings.bounds(F.col("polygon")).alias("b")))
    return b.groupBy("scene_id").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


def print_scale(extents: DataFrame, paper: str = "A4", landscape: bool = True, margin_mm: float = 12.0) -> DataFrame:
    """First standard scale at which each plan with room for its chains fits the paper."""
    w, h = sorted(PAPER[paper], reverse=landscape)
    side = lambda a, b: (F.col(b) - F.col(a) + 2.7) * 1000 / F.col("scale")
    return select.first_fitting(extents, list(PRINT_SCALES), (side("x0", "x1") <= w - 2 * margin_mm) & (side("y0", "y1") <= h - 2 * margin_mm))


def scaled(walls: DataFrame, openings: DataFrame, rooms: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans with every length multiplied by their scene's ``factor``."""
    by = lambda df, cols: df.join(factors.select("scene_id", "factor").hint("merge"), S).withColumns({c: F.col(c) * F.col("factor") for c in cols}).drop("factor")
    r = rooms.join(factors.select("scene_id", "factor").hint("merge"), S).withColumns({"polygon": rings.scaled(F.col("polygon"), F.col("factor")), "holes": F.transform("holes", lambda h: rings.scaled(h, F.col("factor")))}).drop("factor")
    return by(walls, ["ax", "ay", "bx", "by", "thickness", "height"]), by(openings, ["t0", "t1", "z0", "z1"]), r


def door_factors(openings: DataFrame, true_width: float = 0.90) -> DataFrame:
    """Factor that brings each scene's median door to a known width, 1 without a door."""
    width = F.when(F.col("kind") == "door", F.col("t1") - F.col("t0"))
    return openings.groupBy("scene_id").agg(F.coalesce(F.lit(true_width) / F.median(width), F.lit(1.0)).alias("factor"))


def renamed(rooms: DataFrame, names: DataFrame) -> DataFrame:
    """Rooms named anew by ``names(scene_id, id, old, new)``: by id or by old name, empty keeps."""
    by_id = names.filter("id is not null").select("scene_id", "id", F.col("new").alias("n1"))
    by_old = names.filter("id is null").select("scene_id", F.col("old").alias("name"), F.col("new").alias("n2"))
    out = rooms.join(by_id.hint("merge"), ["scene_id", "id"], "left").join(by_old.hint("merge"), ["scene_id", "name"], "left")
    return out.withColumn("name", F.coalesce(F.nullif("n1", F.lit("")), F.nullif("n2", F.lit("")), "name")).select(*rooms.columns)


def edited(walls: DataFrame, openings: DataFrame, rooms: DataFrame, names: DataFrame | None = None, scale: float | None = None, door_width: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A user's edits in order: room names, then one factor for every length, given or such that the
    median door gets a known width (a given factor wins)."""
    if names is not None:
        rooms = renamed(rooms, names)
    if scale is not None:
        if not scale > 0:
            raise ValueError("a scale must be positive")
        factors = walls.select("scene_id").distinct().withColumn("factor", F.lit(float(scale)))
    elif door_width is not None:
        factors = door_factors(openings, door_width)
        factors = walls.select("scene_id").distinct().join(factors.hint("merge"), S, "left").fillna(1.0, ["factor"])
    else:
        return walls, openings, rooms
    return scaled(walls, openings, rooms, factors)


def summary(scenes: DataFrame, walls: DataFrame, openings: DataFrame, rooms: DataFrame) -> DataFrame:
    """A few lines of text a scene."""
    n = lambda df, k: df.groupBy("scene_id").agg(F.count("*").alias(k))
    lines = rooms.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.format_string("  %s: %.2f m2, perimeter %.2f m", "name", rings.area(F.col("polygon"), F.col("holes")), rings.perimeter(F.col("polygon"), F.col("holes"))).alias("l")))), lambda x: x["l"]), "\n").alias("room_lines"))
    out = scenes.select("scene_id", "height", "ceiling_measured").join(n(walls, "w").hint("merge"), S, "left").join(n(rooms, "r").hint("merge"), S, "left").join(n(openings, "o").hint("merge"), S, "left").join(lines.hint("merge"), S, "left").fillna(0, ["w", "r", "o"])
    how = F.when(F.col("ceiling_measured"), "measured").otherwise("default")
    return out.select("scene_id", F.concat_ws("\n", F.format_string("walls: %d  rooms: %d  openings: %d", "w", "r", "o"), F.format_string("ceiling: %.2f m (%s)", F.col("height"), how), "room_lines").alias("summary"))


def wrapped(notes: DataFrame, width: float, size: float = 8.5) -> DataFrame:
    """Notes broken to a column's width, runovers hanging: scene_id, line, indent, text. A note is
    a few lines, so the fold runs per scene."""

    def run(rows):
        out = []
        from ..functions.text import OTHER, REGULAR

        wide = lambda s: sum(REGULAR[ord(c) - 32] if 32 <= ord(c) <= 126 else OTHER for c in s) * size / 1000
        for _, r in rows.sort_values("position").iterrows():
            head = f"{r['position']}. "
            hang, indent, line = wide(head), 0.0, head
            fresh = True
            for word in (r["text"] or "").split():
                while True:
                    trial = line + ("" if fresh else " ") + word
                    if indent + wide(trial) <= width:
                        line, fresh = trial, False
                        break
                    if not fresh:
                        out.append((r["scene_id"], indent, line))
                        indent, line, fresh = hang, "", True
                        continue
                    k = len(word) - 1
                    while k > 1 and indent + wide(line + word[:k] + "-") > width:
                        k -= 1
                    if k < 1:
                        line, fresh = trial, False
                        break
                    out.append((r["scene_id"], indent, line + word[:k] + "-"))
                    indent, line, word = hang, "", word[k:]
            out.append((r["scene_id"], indent, line))
        return pd.DataFrame([(s, i, d, t) for i, (s, d, t) in enumerate(out)], columns=["scene_id", "line", "indent", "text"])

    return notes.groupBy("scene_id").applyInPandas(run, "scene_id string, line int, indent double, text string")

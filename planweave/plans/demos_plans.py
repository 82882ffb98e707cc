"""Operators on whole plans, on scenes whose results have a closed form: every part is a walled
rectangle with a door below and a window above, every customer a building. Each query has the
SQL that states the same numbers from the part's or customer's columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rings
from ..functions.walls import WallColumns
from ..sources import buildings
from . import assemble, demos, metrics, quality, schedules, site, survey

query, table = demos.query, demos.table

#: Scenes in SQL: w and h are the room's sides, dw its door's width, k the part's key.
P = "(SELECT CAST(p_partkey AS VARCHAR) AS scene_id, p_partkey AS k, (3 + p_size % 7)::DOUBLE AS w, (3 + p_size % 5)::DOUBLE AS h, 0.8 + 0.1 * (p_partkey % 3)::DOUBLE AS dw FROM part)"
T = "array<array<struct<x:double,y:double>>>"
HEIGHT = 2.5


def scenes(spark, d):
    p = table(spark, d, "part")
    size = lambda n: (F.col("p_size") % n + 3).cast("double")
    s = p.select(F.col("p_partkey").cast("string").alias("scene_id"), F.col("p_partkey").alias("k"), size(7).alias("w"), size(5).alias("h"), (F.lit(0.8) + F.lit(0.1) * (F.col("p_partkey") % 3)).alias("dw"))
    # a plan is some kilobytes and its row in the file a few bytes: the rows are dealt out before they grow
    return s.repartition(4 * spark.sparkContext.defaultParallelism, "scene_id")


def plan(spark, d):
    """(rooms, walls, openings) of every scene."""
    s = scenes(spark, d)
    w, h, k = F.col("w"), F.col("h"), F.col("k")
    zero, out = F.lit(0.0), F.lit(0.1)
    pt = rings.point
    rooms = s.select("scene_id", F.lit(0).alias("id"), F.lit("room").alias("name"), F.array(pt(zero, zero), pt(w, zero), pt(w, h), pt(zero, h)).alias("polygon"), F.array().cast(T).alias("holes"), (k % 4 != 0).alias("closed"), F.when(k % 3 == 0, 0.4).otherwise(0.9).alias("floor_seen"))
    ends = [(zero, -out, w, -out), (w + out, zero, w + out, h), (w, h + out, zero, h + out), (-out, h, -out, zero)]
    side = [F.struct(F.lit(i).alias("id"), *[c.alias(n) for n, c in zip(("ax", "ay", "bx", "by"), e)], F.lit(0.2).alias("thickness"), F.lit(HEIGHT).alias("height"), F.when((k % 2 == 0) & F.lit(i == 1), 1).otherwise(2).alias("sides_seen"), F.lit(i).alias("line_id"), F.lit(True).alias("exterior")) for i, e in enumerate(ends)]
    walls = s.select("scene_id", F.explode(F.array(*side)).alias("x")).select("scene_id", "x.*")
    hole = lambda i, wall, kind, t0, t1, z0, z1, tag, sure: F.struct(F.lit(i).alias("id"), F.lit(wall).alias("wall_id"), F.lit(kind).alias("kind"), t0.alias("t0"), t1.alias("t1"), F.lit(z0).alias("z0"), F.lit(z1).alias("z1"), F.array(F.lit(0)).alias("rooms"), F.lit(tag).alias("tag"), sure.alias("height_measured"))
    both = F.array(hole(0, 0, "door", F.lit(1.0), F.col("dw") + 1, 0.0, 2.05, "P1", k % 2 == 1), hole(1, 2, "window", F.lit(0.5), F.lit(1.7), 0.9, 2.1, "V1", F.lit(True)))
    openings = s.select("scene_id", F.explode(both).alias("x")).select("scene_id", "x.*")
    return rooms, walls, openings


def long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*names, to=6):
    return [(F.round(n, to) + 0.0).alias(n) for n in names]


# -- schedules and dimensions -----------------------------------------------------------------


@query(f"""SELECT scene_id, round(w * h, 6) AS useful_m2, round(0.4 * (w + h), 6) AS walls_m2, round(w * h + 0.4 * (w + h), 6) AS gross_m2, round(2 * (w + h), 6) AS wall_length_m FROM {P}""")
def plan_areas(spark, d):
    """Useful, wall and gross area of each plan, common parts once."""
    rooms, walls, _ = plan(spark, d)
    return schedules.area_summary(rooms, walls).select("scene_id", *rounded("useful_m2", "walls_m2", "gross_m2", "wall_length_m"))


@query(f"""SELECT scene_id, round(w * h, 6) AS area_m2 FROM {P}""")
def plan_floor_area(spark, d):
    """Floor of each scene, a second room over the first counted once."""
    rooms, _, _ = plan(spark, d)
    return assemble.area_of(rooms.unionByName(rooms.withColumn("id", F.lit(1)))).select("scene_id", *rounded("area_m2"))


@query(f"""SELECT scene_id, 0::BIGINT AS position, 'room' || CASE WHEN k % 4 = 0 THEN ' *' ELSE '' END AS name, printf('%.2f m²', w * h) AS area, printf('%.2f m', 2 * (w + h)) AS perimeter, CASE WHEN k % 3 = 0 THEN '40 %' ELSE '90 %' END AS floor_seen FROM {P}
UNION ALL SELECT scene_id, 1000000, 'useful', printf('%.2f m²', w * h), NULL, NULL FROM {P} UNION ALL SELECT scene_id, 1000001, 'walls', printf('%.2f m²', 0.4 * (w + h)), printf('%.2f m', 2 * (w + h)), NULL FROM {P}
UNION ALL SELECT scene_id, 1000002, 'gross', printf('%.2f m²', w * h + 0.4 * (w + h)), NULL, NULL FROM {P}""")
def plan_area_schedule(spark, d):
    rooms, walls, _ = plan(spark, d)
    return schedules.area_schedule(rooms, walls).select("scene_id", *long("position"), "name", "area", "perimeter", "floor_seen")


@query(f"""SELECT scene_id, 1::BIGINT AS position, 'P1' AS tag, 'door' AS kind, printf('%.2f m', dw) AS width, '2.05 m' AS height, '-' AS sill, 'M1' AS wall FROM {P}
UNION ALL SELECT scene_id, 2, 'V1', 'window', '1.20 m', '1.20 m', '0.90 m', 'M3' FROM {P}""")
def plan_opening_schedule(spark, d):
    return schedules.opening_schedule(plan(spark, d)[2]).select("scene_id", *long("position"), "tag", "kind", "width", "height", "sill", "wall")


@query(f"""SELECT scene_id, i::BIGINT AS id, CASE WHEN i % 2 = 0 THEN w ELSE h END AS length, w * h AS plus, 0.0::DOUBLE AS minus FROM {P}, range(4) r(i)""")
def plan_sides(spark, d):
    """Area of the room on either side of each wall."""
    rooms, walls, _ = plan(spark, d)
    return schedules.sides(walls, rooms).select("scene_id", *long("id"), *rounded("length", "plus", "minus"))


@query(f"""SELECT scene_id, i::BIGINT AS id, 1.0::DOUBLE AS side FROM {P}, range(2) r(i)""")
def plan_swings(spark, d):
    rooms, walls, openings = plan(spark, d)
    return schedules.swing_sides(openings, walls, rooms).select("scene_id", *long("id"), "side")


@query(f"""SELECT scene_id, i::BIGINT AS wall, -1.0::DOUBLE AS side, 0.6::DOUBLE AS "offset", false AS inside, CASE i WHEN 0 THEN 4 WHEN 2 THEN 4 ELSE 2 END::BIGINT AS n,
round(CASE i WHEN 0 THEN 2 + dw + w WHEN 2 THEN 2.2 + w ELSE h END, 6) AS total FROM {P}, range(4) r(i)""")
def plan_chains(spark, d):
    """Dimension chains outside every wall, with the stations of its openings."""
    rooms, walls, openings = plan(spark, d)
    c = schedules.chains(walls, openings, rooms)
    return c.select("scene_id", *long("wall"), "side", *rounded("offset"), "inside", F.size("stations").cast("long").alias("n"), F.round(F.aggregate("stations", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""SELECT scene_id, 'x' AS orientation, 'A' AS name, -0.1::DOUBLE AS position FROM {P} UNION ALL SELECT scene_id, 'x', 'B', round(w + 0.1, 6) FROM {P}
UNION ALL SELECT scene_id, 'y', '1', round(h + 0.1, 6) FROM {P} UNION ALL SELECT scene_id, 'y', '2', -0.1 FROM {P}""")
def plan_axes(spark, d):
    return schedules.reference_axes(plan(spark, d)[1]).select("scene_id", "orientation", "name", *rounded("position"))


@query(f"""SELECT scene_id, 'x' AS orientation, round(w + 0.2, 6) AS span FROM {P} UNION ALL SELECT scene_id, 'y', round(h + 0.2, 6) FROM {P}""")
def plan_axis_chains(spark, d):
    c = schedules.axis_chains(plan(spark, d)[1])
    return c.select("scene_id", "orientation", F.round(F.element_at("positions", -1) - F.get("positions", F.lit(0)), 6).alias("span"))


@query(f"""SELECT scene_id, round(1.8 / dw, 6) AS factor, round(w * 1.8 / dw, 6) AS width, round((1 + dw) * 1.8 / dw, 6) AS door_end, round(w * h * (1.8 / dw) * (1.8 / dw), 4) AS area FROM {P}""")
def plan_scaled(spark, d):
    """Plans brought to a door width: walls, openings and rooms multiplied by one factor."""
    rooms, walls, openings = plan(spark, d)
    f = schedules.door_factors(openings, 1.8)
    w, o, r = schedules.scaled(walls, openings, rooms, f)
    wide = w.filter("id = 0").select("scene_id", *[F.round("bx", 6).alias("width")])
    end = o.filter("kind = 'door'").select("scene_id", F.round("t1", 6).alias("door_end"))
    area = r.select("scene_id", F.round(rings.area(F.col("polygon"), F.col("holes")), 4).alias("area"))
    return f.select("scene_id", *rounded("factor")).join(wide, "scene_id").join(end, "scene_id").join(area, "scene_id")


@query(f"""SELECT scene_id, CASE WHEN k % 3 = 0 THEN 'R' || k WHEN k % 3 = 1 THEN 'hall' ELSE 'room' END AS name FROM {P}""")
def plan_renamed(spark, d):
    """Rooms named anew by number, by old name, or not at all."""
    s, k = scenes(spark, d), F.col("k")
    none = F.lit(None).cast("string")
    names = s.filter(k % 3 == 0).select("scene_id", F.lit(0).alias("id"), none.alias("old"), F.concat(F.lit("R"), k.cast("string")).alias("new"))
    names = names.unionByName(s.filter(k % 3 != 0).select("scene_id", F.lit(None).cast("int").alias("id"), F.lit("room").alias("old"), F.when(k % 3 == 1, "hall").otherwise("").alias("new")))
    return schedules.renamed(plan(spark, d)[0], names).select("scene_id", "name")


@query(f"""SELECT scene_id, 'walls: 4  rooms: 1  openings: 2' || chr(10) || 'ceiling: 2.50 m (' || CASE WHEN k % 2 = 0 THEN 'measured' ELSE 'default' END || ')' || chr(10) || printf('  room: %.2f m2, perimeter %.2f m', w * h, 2 * (w + h)) AS summary FROM {P}""")
def plan_summary(spark, d):
    rooms, walls, openings = plan(spark, d)
    s = scenes(spark, d).select("scene_id", F.lit(HEIGHT).alias("height"), (F.col("k") % 2 == 0).alias("ceiling_measured"))
    return schedules.summary(s, walls, openings, rooms)


@query(f"""SELECT scene_id, round(w / 2, 6) AS x, round(h / 2, 6) AS y, starts_with('room', 'room') AS named FROM {P}""")
def plan_labels(spark, d):
    """Where each room's label stands and whether its name leads it."""
    r = schedules.room_labels(plan(spark, d)[0])
    return r.select("scene_id", *rounded("x", "y"), F.get("lines", F.lit(0))["text"].startswith("room").alias("named"))


@query(f"""SELECT scene_id, i::BIGINT AS wall_id, 1.0::DOUBLE AS side, round(CASE i WHEN 0 THEN (1 + dw + w) / 2 WHEN 1 THEN w - 0.28 WHEN 2 THEN w - (1.7 + w) / 2 ELSE 0.28 END, 6) AS x,
round(CASE i WHEN 0 THEN 0.28 WHEN 2 THEN h - 0.28 ELSE h / 2 END, 6) AS y FROM {P}, range(4) r(i) WHERE w > 3""")
def plan_wall_tags(spark, d):
    """Tags beside the longest solid stretch of each wall, inside the room."""
    rooms, walls, openings = plan(spark, d)
    t = schedules.wall_tags(walls, openings, rooms)
    return t.join(scenes(spark, d).filter("w > 3").select("scene_id").hint("merge"), "scene_id").select("scene_id", *long("wall_id"), "side", *[F.round(f"p.{c}", 6).alias(c) for c in "xy"])


@query(f"""SELECT scene_id, -0.2::DOUBLE AS x0, -0.2::DOUBLE AS y0, round(w + 0.2, 6) AS x1, round(h + 0.2, 6) AS y1,
(SELECT min(s) FROM (SELECT unnest([20, 25, 50, 75, 100, 125, 150, 200, 250, 500]) AS s) WHERE (w + 3.1) * 1000 / s <= 273 AND (h + 3.1) * 1000 / s <= 186)::DOUBLE AS scale FROM {P}""")
def plan_print_scale(spark, d):
    """Extent of each plan and the first standard scale at which it fits the sheet."""
    rooms, walls, _ = plan(spark, d)
    return schedules.print_scale(schedules.bounds(walls, rooms)).select("scene_id", *rounded("x0", "y0", "x1", "y1"), "scale")


@query(f"""WITH RECURSIVE s AS (SELECT *, [w * 50, h * 50, w * 50, h * 50] AS ws FROM {P}),
f(scene_id, ws, i, x, begins, "row") AS (SELECT scene_id, ws, 0, ws[1] + 60, 0.0::DOUBLE, 0 FROM s
UNION ALL SELECT scene_id, ws, i + 1, CASE WHEN x + ws[i + 2] > 1000 THEN ws[i + 2] + 60 ELSE x + ws[i + 2] + 60 END, CASE WHEN x + ws[i + 2] > 1000 THEN 0 ELSE x END, CASE WHEN x + ws[i + 2] > 1000 THEN "row" + 1 ELSE "row" END FROM f WHERE i < 3)
SELECT scene_id, i::BIGINT AS id, "row"::BIGINT AS "row", round(begins, 6) AS x FROM f""")
def plan_elevations(spark, d):
    """Walls seen face on, packed into rows of a sheet."""
    return schedules.elevation_rows(plan(spark, d)[1]).select("scene_id", *long("id", "row"), *rounded("x"))


# -- solids -------------------------------------------------------------------------------------


@query(f"""SELECT scene_id, i::BIGINT AS wall_id, CASE i WHEN 0 THEN 3 WHEN 2 THEN 4 ELSE 1 END::BIGINT AS n, round(CASE i WHEN 0 THEN w * 2.5 - dw * 2.05 WHEN 2 THEN w * 2.5 - 1.44 ELSE h * 2.5 END, 6) AS face_m2 FROM {P}, range(4) r(i)""")
def plan_wall_pieces(spark, d):
    """Solid boxes of each wall around its openings."""
    _, walls, openings = plan(spark, d)
    p = schedules.wall_pieces(walls, openings)
    return p.groupBy("scene_id", F.col("wall_id").cast("long").alias("wall_id")).agg(F.count("*").alias("n"), F.round(F.sum((F.col("t1") - F.col("t0")) * (F.col("z1") - F.col("z0"))), 6).alias("face_m2"))


@query(f"""SELECT scene_id, 4::BIGINT AS geometries, 240::BIGINT AS vertices, 60::BIGINT AS faces FROM {P}""")
def plan_model(spark, d):
    rooms, walls, openings = plan(spark, d)
    return schedules.scene_stats(schedules.model_faces(walls, openings, rooms)).select("scene_id", *long("geometries", "vertices", "faces"))


@query(f"""SELECT scene_id, kind, n::BIGINT AS n, NULL::BIGINT AS bad FROM {P}, (VALUES ('wall', 45), ('door', 5), ('window', 5), ('floor', 5), ('ceiling', 1)) f(kind, n)""")
def plan_painted(spark, d):
    """Faces in painter's order: how many of each kind, and any that stands before a farther one."""
    rooms, walls, openings = plan(spark, d)
    p = schedules.painted(schedules.model_faces(walls, openings, rooms, ceiling=HEIGHT))
    nearer = F.lag("depth").over(Window.partitionBy("scene_id").orderBy("rank"))
    each = p.select("scene_id", "kind", (F.col("depth") > nearer + 1e-9).alias("wrong")).groupBy("scene_id", "kind").agg(F.count("*").alias("n"), F.count_if("wrong").alias("some"))
    kinds = each.withColumn("bad", F.sum("some").over(Window.partitionBy("scene_id")))
    return kinds.select("scene_id", "kind", "n", F.nullif(F.col("bad"), F.lit(0)).cast("long").alias("bad"))


@query(f"""SELECT scene_id, round(w - 0.15, 6) AS ax, round(h, 6) AS ay, 0.15::DOUBLE AS bx, round(h, 6) AS b_y FROM {P} WHERE k % 4 = 0""")
def plan_open_edges(spark, d):
    """The side that was not scanned: the upper wall is missing."""
    rooms, walls, _ = plan(spark, d)
    e = schedules.open_edges(rooms, walls.filter("id <> 2"))
    return e.select("scene_id", F.round("a.x", 6).alias("ax"), F.round("a.y", 6).alias("ay"), F.round("b.x", 6).alias("bx"), F.round("b.y", 6).alias("b_y"))


@query("""SELECT p_partkey, 5.0::DOUBLE AS length, round((p_size + 0.7)::DOUBLE, 6) AS x, round((p_partkey % 5 + 2.6)::DOUBLE, 6) AS y, 1.4::DOUBLE AS station, -0.2::DOUBLE AS "offset", 1.0::DOUBLE AS body, round((p_size + 0.9)::DOUBLE, 6) AS mid_x FROM part""")
def wall_frame(spark, d):
    """Length, points, stations and footprint of walls of direction (0.6, 0.8)."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("ax"), (F.col("p_partkey") % 5).cast("double").alias("ay"), F.lit(0.2).alias("thickness"))
    p = p.withColumns({"bx": F.col("ax") + 3, "by": F.col("ay") + 4})
    w = WallColumns()
    at = w.at(F.lit(2.5), 1.0)
    hole = w.rectangle(F.lit(1.0), F.lit(2.0), F.lit(0.5))
    return p.select("p_partkey", F.round(w.length, 6).alias("length"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"), F.round(w.station(F.col("ax") + 1, F.col("ay") + 1), 6).alias("station"), F.round(w.offset(F.col("ax") + 1, F.col("ay") + 1), 6).alias("offset"), F.round(rings.area(w.body), 6).alias("body"), F.round(rings.centroid(hole)["x"], 6).alias("mid_x"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS scene_id, l_linenumber::BIGINT AS wall_id, CASE kind WHEN 'door' THEN 'P' WHEN 'window' THEN 'V' ELSE 'A' END || n AS tag, id::BIGINT AS id FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY l_linenumber, t0) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, t0, kind) - 1 AS id FROM (
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'door' WHEN 'N' THEN 'window' ELSE 'passage' END AS kind, l_extendedprice + l_partkey / 1e6 + l_suppkey / 1e9 AS t0 FROM lineitem))""")
def tag_counter(spark, d):
    """Running tags by kind: doors P1, P2, windows V1 of each plan."""
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "door").when(F.col("l_returnflag") == "N", "window").otherwise("passage")
    t0 = F.col("l_extendedprice") + F.col("l_partkey") / 1e6 + F.col("l_suppkey") / 1e9
    o = li.select(F.col("l_orderkey").cast("string").alias("scene_id"), F.col("l_linenumber").alias("wall_id"), kind.alias("kind"), t0.alias("t0"), (t0 + 1).alias("t1"), F.lit(0.0).alias("z0"), F.lit(2.0).alias("z1"), F.array(F.lit(0)).alias("rooms"), F.lit(True).alias("height_measured"))
    return assemble.tagged(o).select("scene_id", *long("wall_id"), "tag", *long("id"))


# -- findings -------------------------------------------------------------------------------------


def reports(spark, d):
    """One row a scene of what its reconstruction reported."""
    s, k = scenes(spark, d), F.col("k")
    none = lambda t: F.lit(None).cast(t)
    chunk = F.when(k % 11 == 0, F.array(F.lit(0.4), F.lit(1.0))).when(k % 13 == 0, F.array(F.lit(3.0), F.lit(3.0), F.lit(3.0)))
    return s.select("scene_id", (k % 2 == 0).alias("ceiling_measured"), F.when(k % 7 == 0, "network").otherwise("scan").alias("source"), none("double").alias("scale_factor"), (k % 3 * 6).cast("int").alias("views"), (F.col("w") * F.col("h")).alias("footprint_m2"), none("double").alias("video_fps"), none("double").alias("sample_fps"), none("int").alias("video_frames"), chunk.alias("chunk_scales"), F.when(k % 17 == 0, 0.05).alias("mask_fraction"))


_BAD = "CASE WHEN k % 11 = 0 THEN 1 WHEN k % 13 = 0 THEN 3 ELSE 0 END"
_FINDINGS = f"""SELECT scene_id, k, 'open_room' AS key, 'warn' AS level, 'rooms without a closed outline: room' AS text FROM {P} WHERE k % 4 = 0
UNION ALL SELECT scene_id, k, 'too_few_frames', 'warn', (k % 3 * 6) || ' frames over ' || CAST(w * h AS BIGINT) || printf(' m2, %.1f a square metre; ', round_even((k % 3 * 6) / (w * h), 1)) || CAST(ceil(1.5 * w * h) AS BIGINT) || ' are wanted' FROM {P} WHERE k % 3 > 0 AND (k % 3 * 6) / (w * h) < 1.5
UNION ALL SELECT scene_id, k, 'floor_seen', 'warn', 'outlines drawn over floor that was not seen: room (40 %)' FROM {P} WHERE k % 3 = 0
UNION ALL SELECT scene_id, k, 'thickness', CASE WHEN k % 2 = 0 THEN 'info' ELSE 'ok' END, CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END || ' of 4 walls have an assumed thickness' FROM {P}
UNION ALL SELECT scene_id, k, 'ceiling', 'warn', 'the ceiling was not seen; its height is the default' FROM {P} WHERE k % 2 = 1
UNION ALL SELECT scene_id, k, 'unreliable', 'warn', {_BAD} || ' of ' || CASE WHEN k % 11 = 0 THEN 3 WHEN k % 13 = 0 THEN 4 ELSE 1 END || ' stretches lost their scale; ' || CASE WHEN k % 17 = 0 THEN 5 ELSE 100 END || ' % of a frame was kept' FROM {P} WHERE {_BAD} > 0 OR k % 17 = 0
UNION ALL SELECT scene_id, k, 'scale_chain', 'warn', 'over 3 links the scale drifted 27 times' FROM {P} WHERE k % 13 = 0 AND k % 11 <> 0
UNION ALL SELECT scene_id, k, 'scale', 'warn', 'the scale is not calibrated' FROM {P} WHERE k % 7 = 0
UNION ALL SELECT scene_id, k, 'door_height', 'info', 'door heights are assumed: P1' FROM {P} WHERE k % 2 = 0
UNION ALL SELECT scene_id, k, 'no_windows', 'info', 'no window was found' FROM {P} WHERE k % 5 = 0"""


def _found(spark, d):
    rooms, walls, openings = plan(spark, d)
    blind = scenes(spark, d).filter("k % 5 = 0").select("scene_id", F.lit("window").alias("kind"))
    return quality.findings(reports(spark, d), rooms, walls, openings.join(blind, ["scene_id", "kind"], "left_anti"))


@query(f"SELECT scene_id, key, level, text FROM ({_FINDINGS})")
def qa_rules(spark, d):
    """Every check of every plan with its message."""
    return quality.with_messages(_found(spark, d)).select("scene_id", "key", "level", "text")


@query(f"""SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY o, text) AS position, text FROM (
SELECT scene_id, 0 AS o, 'M2: thickness 0.20 m assumed' AS text FROM {P} WHERE k % 2 = 0 UNION ALL SELECT scene_id, 1, text FROM ({_FINDINGS}) WHERE level <> 'ok' AND key <> 'thickness')""")
def plan_notes(spark, d):
    """General notes of a sheet in order."""
    return quality.notes(_found(spark, d), plan(spark, d)[1]).select("scene_id", *long("position"), "text")


@query(f"""SELECT scene_id, CASE WHEN k % 13 = 0 AND k % 11 <> 0 THEN 'stamp_chain' WHEN {_BAD} > 0 OR k % 17 = 0 THEN 'stamp_unreliable' ELSE 'stamp' END AS stamp FROM {P} WHERE {_BAD} > 0 OR k % 17 = 0 OR k % 7 = 0""")
def plan_stamps(spark, d):
    return quality.stamps(reports(spark, d))


# -- accuracy -------------------------------------------------------------------------------------


@query(f"""SELECT scene_id, 0::BIGINT AS truth, 0::BIGINT AS found, round((w - 1) / (w + 1), 6) AS iou FROM {P}""")
def room_matches(spark, d):
    """Rooms matched with copies moved by a metre, by common over covered area."""
    rooms = plan(spark, d)[0]
    moved = rooms.withColumn("polygon", F.transform("polygon", lambda p: rings.point(p["x"] + 1, p["y"])))
    return metrics.matched_rooms(rooms, moved).select("scene_id", *long("truth", "found"), *rounded("iou"))


@query("""SELECT n_nationkey AS scene, CASE WHEN n_nationkey % 4 <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, CASE WHEN n_nationkey % 4 <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision FROM nation""")
def wall_recall(spark, d):
    """Wall cells found again within one cell, the drawing being some rows off."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("scene"), F.col("n_nationkey").cast("string").alias("scene_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("ix"))
    truth = n.withColumn("iy", F.lit(0).cast("long"))
    drawn = n.withColumn("iy", (F.col("scene") % 4).cast("long"))
    out = metrics.wall_scores(truth, drawn, 1)
    return out.select(F.col("scene_id").cast("int").alias("scene"), "recall", "precision")


@query("""SELECT p_partkey, round((p_size / 20.0 - 1) * 100, 6) AS error_pct, round((p_size / 20.0 * 0.81 - 1) * 100, 6) AS shape_pct FROM part""")
def area_errors(spark, d):
    """Area errors before and after the scale is put right."""
    a = table(spark, d, "part").select("p_partkey", F.lit(20.0).alias("truth_m2"), F.col("p_size").cast("double").alias("plan_m2"), F.lit(0.9).alias("scale"))
    return metrics.area_report(a).select("p_partkey", *rounded("error_pct", "shape_pct"))


# -- sites ------------------------------------------------------------------------------------------

LAT, LON = 40.0, -3.0
#: Buildings in SQL: sides a (east) and b (north) in metres of the local frame.
C = """(SELECT *, radians(0.0001 * (1 + c_custkey % 4)) * 6378137.0 / sqrt(1 - e2 * sin(radians(40)) ** 2) * cos(radians(40)) AS a, radians(0.0001 * (1 + c_custkey % 3)) * 6378137.0 * (1 - e2) / (1 - e2 * sin(radians(40)) ** 2) ** 1.5 AS b,
CASE c_custkey % 3 WHEN 0 THEN 7.5 WHEN 1 THEN 3.0 * (1 + c_custkey % 5) ELSE 3.0 END::DOUBLE AS height, CASE c_custkey % 3 WHEN 0 THEN 'measured' WHEN 1 THEN 'levels' ELSE 'default' END AS how FROM (SELECT *, 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2 FROM customer))"""


def lots_of(spark, d):
    """A rectangle for every customer, its south-western corner at the origin."""
    k = F.col("c_custkey")
    e, n = F.lit(LON) + F.lit(0.0001) * (k % 4 + 1), F.lit(LAT) + F.lit(0.0001) * (k % 3 + 1)
    corner = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    ring = F.array(corner(F.lit(LON), F.lit(LAT)), corner(e, F.lit(LAT)), corner(e, n), corner(F.lit(LON), n))
    none = F.lit(None).cast("string")
    c = table(spark, d, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    return c.select(F.concat(F.lit("way/"), k.cast("string")).alias("id"), F.lit("osm").alias("source"), ring.alias("footprint"), F.array().cast("array<array<struct<lon:double,lat:double>>>").alias("holes"), F.when(k % 3 == 0, 7.5).alias("height_m"), F.when(k % 3 == 1, k % 5 + 1).cast("long").alias("levels"), none.alias("roof_shape"), F.col("c_name").alias("name"), F.lit("x").alias("license"), F.lit("y").alias("attribution"))


@query(f"""SELECT 'way/' || c_custkey AS id, round_even(height, 2) AS height_m, how AS height_source, 4::BIGINT AS vertices, round(a * b, 1) AS area, round(2 * (a + b), 1) AS outline, round(a * b * height, 0) AS volume FROM {C}""")
def site_buildings(spark, d):
    """Height by rule, area, outline and volume of each building in its local frame."""
    x = buildings.describe(lots_of(spark, d), LAT, LON)
    return x.select("id", "height_m", "height_source", *long("vertices"), F.round("footprint_area_m2", 1).alias("area"), F.round("perimeter_m", 1).alias("outline"), F.round("volume_m3", 0).alias("volume"))


@query(f"""SELECT 'way/' || c_custkey AS id, 4::BIGINT AS corners, round(a * b, 4) AS area_m2, round(a * b / 10000, 8) AS area_ha, round(2 * (a + b), 4) AS perimeter_m, 0.0::DOUBLE AS closure_m, 30::BIGINT AS zone, 'T' AS band, 'N' AS hemisphere, 32630::BIGINT AS epsg FROM {C}""")
def site_lots(spark, d):
    """Survey of each lot: area, outline, closure error and UTM zone."""
    x = survey.lots(lots_of(spark, d), LAT, LON)
    return x.select("id", *long("corners"), *rounded("area_m2", to=4), *rounded("area_ha", to=8), *rounded("perimeter_m", to=4), *rounded("closure_m"), *long("zone"), "band", "hemisphere", *long("epsg"))


@query(f"""SELECT 'way/' || c_custkey AS id, k::BIGINT AS "from", (k % 4 + 1)::BIGINT AS "to", round(CASE WHEN k % 2 = 1 THEN b ELSE a END, 4) AS length_m, CASE k WHEN 1 THEN 180.0 WHEN 2 THEN 90.0 WHEN 3 THEN 0.0 ELSE 270.0 END::DOUBLE AS azimuth FROM {C}, range(1, 5) r(k)""")
def site_sides(spark, d):
    """Sides of each lot from its north-western corner, with azimuths."""
    s = survey.sides(survey.vertices(lots_of(spark, d), LAT, LON))
    return s.select("id", *long("from", "to"), *rounded("length_m", to=4), (F.pmod(F.round("azimuth_deg", 3), F.lit(360.0)) + 0.0).alias("azimuth"))


@query(f"""SELECT 'way/' || c_custkey AS scene_id, kind, n::BIGINT AS faces, round(CASE kind WHEN 'floor' THEN 0 ELSE height END, 6) AS top FROM {C}, (VALUES ('ceiling', 1), ('floor', 1), ('wall', 4)) f(kind, n)""")
def site_prisms(spark, d):
    """Footprints raised to their height."""
    f = site.prisms(lots_of(spark, d).withColumn("relevance", F.lit(1)), LAT, LON)
    return f.groupBy("scene_id", "kind").agg(F.count("*").alias("faces"), F.round(F.max(F.array_max(F.transform("face", lambda p: p["z"]))), 6).alias("top"))


@query(f"""SELECT 'way/' || c_custkey AS scene_id, 1::BIGINT AS outlines, 4::BIGINT AS corners, 4::BIGINT AS lengths, printf('%.1f', a) AS east FROM {C}""")
def site_drawing(spark, d):
    """Primitives of each site plan: outline, corner names and side lengths."""
    p = site.drawing(lots_of(spark, d), LAT, LON)
    east = F.max(F.when(F.col("kind") == "polygon", F.format_string("%.1f", F.array_max(F.transform("points", lambda q: q["x"])))))
    return p.groupBy("scene_id").agg(F.count_if(F.col("kind") == "polygon").alias("outlines"), F.count_if(F.col("text").startswith("V")).alias("corners"), F.count_if(F.col("text").endswith(" m")).alias("lengths"), east.alias("east"))

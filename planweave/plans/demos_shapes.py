"""Rooms at any angle on the relational tables: each part is an L or a U turned by its number, eight
parts are a scene. The SQL knows the shapes in their own frames and counts the cells whose centres
they hold; the queries cut, sort and stitch outlines and count the cells of the rings that come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rings
from ..operators import polygons
from . import metrics
from .demos import query, table

CELL, DX, DY = 0.25, 0.1234567, 0.0765432
LS, US = ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)), ((0, 0), (3, 0), (3, 2), (2, 2), (2, 1), (1, 1), (1, 2), (0, 2))
_ROOMS = "SELECT p_partkey // 8 AS scene, p_partkey % 2 AS layer, p_partkey % 3 = 0 AS u, 1 + (p_size % 5) * 0.3 AS s, radians(p_partkey * 37 % 360) AS t, (p_partkey * 7 % 5) * 0.8 AS cx, (p_partkey * 11 % 7) * 0.6 AS cy FROM part"
_CELLS = f"""WITH r AS ({_ROOMS}), g AS (SELECT i * {CELL} + {DX} AS x, j * {CELL} + {DY} AS y FROM range(-32, 48) a(i), range(-32, 48) b(j)),
h AS (SELECT scene, layer, x, y, u, CASE WHEN u THEN 0.7 * s ELSE s END AS q, (x - cx) * cos(t) + (y - cy) * sin(t) AS a, (y - cy) * cos(t) - (x - cx) * sin(t) AS b FROM r, g
      WHERE abs(x - cx) < 8 AND abs(y - cy) < 8),
k AS (SELECT scene, x, y, bool_or(layer = 0) AS l, bool_or(layer = 1) AS r FROM h WHERE a > 0 AND b > 0 AND
      CASE WHEN u THEN a < 3 * q AND b < 2 * q AND (b < q OR a < q OR a > 2 * q) ELSE (a < 2 * q AND b < q) OR (a < q AND b < 2 * q) END GROUP BY scene, x, y)
SELECT scene, count(*) AS cells FROM k WHERE """


def _parts(spark, d):
    """Numbers of the parts, dealt out by scene before outlines and slabs are made of them."""
    return table(spark, d, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, F.floor(F.col("p_partkey") / 8))


def rooms(spark, d):
    """scene, layer, polygon, holes of every part."""
    k = F.col("p_partkey")
    p = _parts(spark, d).select(F.floor(k / 8).alias("scene"), (k % 2).cast("int").alias("layer"), (k % 3 == 0).alias("u"), (1 + (F.col("p_size") % 5) * 0.3).alias("s"), F.radians((k * 37 % 360).cast("double")).alias("t"), (k * 7 % 5 * 0.8).alias("cx"), (k * 11 % 7 * 0.6).alias("cy"))
    cos, sin = F.cos("t"), F.sin("t")
    at = lambda a, b, q: rings.point(F.col("cx") + q * (a * cos - b * sin), F.col("cy") + q * (a * sin + b * cos))
    shape = lambda corners, q: F.array(*[at(a, b, q) for a, b in corners])
    return p.select("scene", "layer", F.when(F.col("u"), shape(US, 0.7 * F.col("s"))).otherwise(shape(LS, F.col("s"))).alias("polygon"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"))


def _counted(found):
    """Cells of rings, those of holes taken away: rows of cells between the places where an outline crosses them."""
    box = rings.bounds(F.col("ring"))
    row = F.explode(F.sequence(F.floor((box["y0"] - DY) / CELL), F.floor((box["y1"] - DY) / CELL) + 1))
    lines = found.select("scene", "ring", F.signum("area").alias("sign"), row.alias("j")).withColumn("cuts", rings.crossings(F.col("ring"), F.col("j") * CELL + DY))
    before = lambda v: F.floor((v - DX) / CELL)
    n = F.aggregate(F.transform("cuts", lambda v, i: F.when(i % 2 == 1, before(v)).otherwise(-before(v))), F.lit(0).cast("long"), lambda a, v: a + v)
    return lines.groupBy("scene").agg(F.sum(n * F.col("sign")).cast("long").alias("cells")).filter("cells > 0")


def _combined(spark, d, op):
    every = rooms(spark, d)
    side = lambda k: polygons.outlines(every.filter(F.col("layer") == k), ["scene"])
    return _counted(polygons.combine(side(0), side(1), ["scene"], op))


@query(_CELLS + "true GROUP BY scene")
def rooms_united(spark, d):
    """Cells of what the rooms of each scene cover together."""
    return _combined(spark, d, "union")


@query(_CELLS + "l AND r GROUP BY scene")
def rooms_shared(spark, d):
    """Cells that rooms of even and of odd parts share."""
    return _combined(spark, d, "intersection")


@query(_CELLS + "l AND NOT r GROUP BY scene")
def rooms_left(spark, d):
    """Cells of rooms of even parts that those of odd ones leave."""
    return _combined(spark, d, "difference")


@query("SELECT CAST(p_partkey AS VARCHAR) AS scene_id, round((w - 1) / (w + 1), 5) AS iou FROM (SELECT p_partkey, 3 + p_size % 7 AS w FROM part)")
def turned_room_iou(spark, d):
    """Common over covered area of each room, turned by its part's number, and itself moved a metre along its side."""
    k = F.col("p_partkey")
    p = _parts(spark, d).select(k.cast("string").alias("scene_id"), (F.col("p_size") % 7 + 3).alias("w"), (F.col("p_size") % 5 + 3).alias("h"), F.radians((k * 37 % 360).cast("double")).alias("t"))

    def turned(by):
        at = lambda a, b: rings.point((a + by) * F.cos("t") - b * F.sin("t"), (a + by) * F.sin("t") + b * F.cos("t"))
        zero = F.lit(0.0)
        ring = F.array(at(zero, zero), at(F.col("w"), zero), at(F.col("w"), F.col("h")), at(zero, F.col("h")))
        return p.select("scene_id", F.lit(0).alias("id"), ring.alias("polygon"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"))

    return metrics.room_iou(turned(0.0), turned(1.0)).select("scene_id", F.round("iou", 5).alias("iou"))

"""Boundary surveys of building footprints, as a surveyor lists them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rings, site
from ..functions.vec import bearing
from ..sources.buildings import local_ring


def vertices(buildings: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Corners counter-clockwise from the north-western-most: id, vertex, x, y, lat, lon, UTM."""
    r = rings.counter_clockwise(local_ring(F.col("footprint"), F.lit(lon0), F.lit(lat0)))
    first = F.array_sort(F.transform("r", lambda p, i: F.struct((p["x"] - p["y"]).alias("k"), i.alias("i"))))[0]["i"]
    on = buildings.select("id", r.alias("r")).withColumn("r", rings.vertices_from(F.col("r"), first)).select("id", F.posexplode("r").alias("k", "p"))
    wgs = site.to_wgs84(F.col("p.x"), F.col("p.y"), F.lit(lon0), F.lit(lat0))
    out = on.select("id", (F.col("k") + 1).alias("vertex"), "p.x", "p.y", wgs.alias("g")).withColumn("u", site.utm(F.col("g.lat"), F.col("g.lon")))
    return out.select("id", "vertex", "x", "y", "g.lat", "g.lon", F.col("u.easting").alias("utm_e"), F.col("u.northing").alias("utm_n"), "u.zone", "u.band")


def sides(corners: DataFrame) -> DataFrame:
    """Sides between corners with length and azimuth: id, from, to, length_m, azimuth_deg."""
    held = corners.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("vertex", "x", "y"))).alias("v"))
    pairs = held.select("id", F.posexplode(F.zip_with("v", rings.turned(F.col("v")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "e"))
    dx, dy = F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")
    return pairs.select("id", F.col("e.a.vertex").alias("from"), F.col("e.b.vertex").alias("to"), F.hypot(dx, dy).alias("length_m"), bearing(dx, dy).alias("azimuth_deg"))


def lots(buildings: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """One row a footprint: area, hectares, perimeter, closure error of its sides, UTM zone."""
    r = local_ring(F.col("footprint"), F.lit(lon0), F.lit(lat0))
    holes = F.transform("holes", lambda h: local_ring(h, F.lit(lon0), F.lit(lat0)))
    area = buildings.select("id", rings.area(r, holes).alias("area_m2"), rings.perimeter(r, holes).alias("perimeter_m"))
    s = sides(vertices(buildings, lat0, lon0))
    go = lambda f: F.sum(F.col("length_m") * f(F.radians("azimuth_deg")))
    closure = s.groupBy("id").agg(F.hypot(go(F.sin), go(F.cos)).alias("closure_m"), F.count("*").alias("corners"))
    u = site.utm(F.lit(lat0), F.lit(lon0))
    return area.join(closure, "id").select("id", "corners", "area_m2", (F.col("area_m2") / 10_000).alias("area_ha"), "perimeter_m", "closure_m", u["zone"].alias("zone"), u["band"].alias("band"), u["hemisphere"].alias("hemisphere"), u["epsg"].alias("epsg"))

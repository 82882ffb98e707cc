"""Building footprints: map JSON, map Parquet, and a registry of sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rings, site
from ..functions.text import quantity, whole

LICENSE, CREDIT = "ODbL 1.0", "© OpenStreetMap contributors"
POINTS = "array<struct<lat:double,lon:double>>"
ELEMENT = f"array<struct<type:string,id:long,tags:map<string,string>,geometry:{POINTS},members:array<struct<type:string,role:string,geometry:{POINTS}>>>>"


def _xy(r: Column) -> Column:
    return F.transform(r, lambda p: rings.point(p["lon"], p["lat"]))


def _closed(r: Column) -> Column:
    return (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1))


def _opened(r: Column) -> Column:
    return F.transform(F.slice(r, 1, F.size(r) - 1), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))


def parse_overpass(documents: DataFrame, text: str = "value") -> DataFrame:
    """Answers of the map API (one JSON document a row) -> buildings. A building has the tag, a
    closed ring of four or more points (the largest one of a relation) and holes inside it."""
    el = documents.select(F.explode(F.from_json(text, f"struct<elements:{ELEMENT}>")["elements"]).alias("e")).select("e.*").filter(F.map_contains_key("tags", "building"))
    ways = F.filter(F.coalesce("members", F.array().cast(f"array<struct<type:string,role:string,geometry:{POINTS}>>")), lambda m: (m["type"] == "way") & m["geometry"].isNotNull())
    none = F.array().cast(f"array<{POINTS}>")
    outer = F.when(F.col("type") == "way", F.when(F.col("geometry").isNotNull(), F.array("geometry")).otherwise(none)).otherwise(F.transform(F.filter(ways, lambda m: F.coalesce(m["role"], F.lit("")) != "inner"), lambda m: m["geometry"]))
    inner = F.when(F.col("type") == "relation", F.transform(F.filter(ways, lambda m: m["role"] == "inner"), lambda m: m["geometry"])).otherwise(none)
    sized = el.withColumns({"_outer": F.filter(outer, _closed), "_inner": F.filter(inner, lambda r: F.size(r) >= 4)}).filter(F.size("_outer") > 0)
    order = F.array_sort(F.transform("_outer", lambda r, i: F.struct((-rings.area(_xy(r))).alias("a"), i.alias("i"), r.alias("r"))))
    chosen = sized.withColumn("_ring", F.get(order, F.lit(0))["r"])
    within = lambda h: F.forall(h, lambda p: rings.contains(_xy(F.col("_ring")), p["lon"], p["lat"]))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    measured = quantity(tag("height"))
    return chosen.select(
        F.concat_ws("/", "type", "id").alias("id"), F.lit("osm").alias("source"), _opened(F.col("_ring")).alias("footprint"),
        F.transform(F.filter("_inner", within), _opened).alias("holes"),
        F.coalesce(F.nullif(measured, F.lit(0.0)), quantity(tag("building:height"))).alias("height_m"), whole(tag("building:levels")).alias("levels"),
        tag("roof:shape").alias("roof_shape"), tag("name").alias("name"), "tags", F.lit(LICENSE).alias("license"), F.lit(CREDIT).alias("attribution"),
    )


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Saved answers."""
    return parse_overpass(spark.read.text(path, wholetext=True))


def overpass_query(lat: float, lon: float, radius: float) -> str:
    return f"[out:json][timeout:60];(way[building](around:{radius},{lat},{lon});relation[building](around:{radius},{lat},{lon}););out geom;"


def fetch_overpass(spark: SparkSession, lat: float, lon: float, radius: float, url: str = "https://overpass-api.de/api/interpreter") -> DataFrame:
    """One request from the driver, parsed by Spark."""
    from urllib.parse import urlencode
    from urllib.request import urlopen

    with urlopen(url, urlencode({"data": overpass_query(lat, lon, radius)}).encode(), timeout=90) as r:
        return parse_overpass(spark.createDataFrame([(r.read().decode(),)], "value string"))


def wkb_rings(wkb: bytes) -> list[list[np.ndarray]]:
    """Polygons of a WKB polygon or multipolygon: each a list of rings (a row a point), the outer one
    first; coordinates beyond x and y are left out. Other geometries have none."""
    order, at = "<", 0

    def number() -> int:
        nonlocal at
        at += 4
        return int(np.frombuffer(wkb, f"{order}u4", 1, at - 4)[0])

    def geometry() -> list[list[np.ndarray]]:
        nonlocal order, at
        order = "<" if wkb[at] == 1 else ">"
        at += 1
        kind = number()
        if kind & 0x20000000:  # a reference system's number stands before the rest
            number()
        if kind & 0xF0000000:
            wide = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        else:
            wide = (2, 3, 3, 4)[kind // 1000 % 4]
        kind = kind & 0x0FFFFFFF
        if kind % 1000 == 6:
            return [p for _ in range(number()) for p in geometry()]
        if kind % 1000 != 3:
            return []
        rings_ = []
        for _ in range(number()):
            n = number()
            rings_.append(np.frombuffer(wkb, f"{order}f8", n * wide, at).reshape(n, wide)[:, :2].astype(float))
            at += 8 * n * wide
        return [rings_] if rings_ else []

    return geometry()


def _ring_area(r: np.ndarray) -> float:
    """Area of a closed ring, taken from its first point for the digits."""
    x, y = (r - r[0]).T
    return abs(float(x[:-1] @ y[1:] - x[1:] @ y[:-1])) / 2


def _largest(geometries: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Largest polygon of each WKB value without its closing points, a batch of values at a time."""
    points = lambda r: [{"lon": x, "lat": y} for x, y in r[:-1].tolist()]
    for batch in geometries:
        footprints, holes = [], []
        for wkb in batch:
            parts = [p for p in (wkb_rings(bytes(wkb)) if wkb is not None else []) if len(p[0]) > 3]
            best = max(parts, key=lambda p: _ring_area(p[0]), default=None)
            footprints.append(None if best is None else points(best[0]))
            holes.append(None if best is None else [points(r) for r in best[1:]])
        yield pd.DataFrame({"footprint": footprints, "holes": holes})


def read_overture(spark: SparkSession, path: str, lat: float, lon: float, radius: float) -> DataFrame:
    """Footprints of a map release in Parquet (id, geometry WKB, bbox, height, num_floors, names,
    roof_shape, class, subtype, sources). The box predicates reach the row groups' statistics;
    only the columns named are read. The largest part of a multipolygon counts."""
    w, s, e, n = site.search_box(lat, lon, radius)
    rows = spark.read.parquet(path).filter((F.col("bbox.xmin") <= e) & (F.col("bbox.xmax") >= w) & (F.col("bbox.ymin") <= n) & (F.col("bbox.ymax") >= s))

    largest = F.pandas_udf(_largest, "footprint array<struct<lon:double,lat:double>>, holes array<array<struct<lon:double,lat:double>>>")
    sets = F.array_join(F.array_sort(F.array_distinct(F.transform("sources", lambda x: F.coalesce(x["dataset"], F.lit("?"))))), ", ")
    shaped = rows.withColumn("_g", largest("geometry")).filter("_g.footprint is not null")
    return shaped.select(
        F.col("id"), F.lit("overture").alias("source"), "_g.footprint", "_g.holes", F.col("height").cast("double").alias("height_m"), F.col("num_floors").cast("long").alias("levels"), "roof_shape", F.col("names.primary").alias("name"),
        F.create_map(F.lit("datasets"), sets, F.lit("class"), F.col("class"), F.lit("subtype"), F.col("subtype")).alias("tags"),
        F.lit("ODbL 1.0 / CDLA-Permissive-2.0 (per source dataset)").alias("license"), F.concat(F.lit("Overture Maps Foundation ("), sets, F.lit(")")).alias("attribution"),
    )


def local_ring(footprint: Column, lon0: Column, lat0: Column) -> Column:
    return F.transform(footprint, lambda p: site.to_local(p["lon"], p["lat"], lon0, lat0))


def by_relevance(buildings: DataFrame, lat: float, lon: float) -> DataFrame:
    """Adds ``relevance`` (1 is the building at the point, then by distance): a sorted report."""
    from pyspark.sql import Window

    r = local_ring(F.col("footprint"), F.lit(lon), F.lit(lat))
    zero = F.lit(0.0)
    ranked = buildings.withColumns({"_in": rings.contains(r, zero, zero), "distance_m": rings.distance(r, zero, zero)})
    w = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("_in"), 0).otherwise(1), "distance_m", "id")
    return ranked.withColumn("relevance", F.row_number().over(w)).drop("_in")


SOURCES = {"osm": fetch_overpass}


def fetch(spark: SparkSession, lat: float, lon: float, radius: float = 60.0, source: str = "osm", **options) -> DataFrame:
    """Buildings around a point from a registered source; an unknown name is a KeyError."""
    if source == "overture":
        found = read_overture(spark, options["path"], lat, lon, radius)
    elif source in SOURCES:
        found = SOURCES[source](spark, lat, lon, radius)
    else:
        raise KeyError(f"unknown source {source!r}; there are {sorted([*SOURCES, 'overture'])}")
    return by_relevance(found, lat, lon)


def height(level_height: float = 3.0, default: float = 3.0) -> Column:
    """``struct<h, how>``: measured, else by levels, else the default."""
    return (
        F.when(F.col("height_m") > 0, F.struct(F.col("height_m").alias("h"), F.lit("measured").alias("how")))
        .when(F.col("levels") > 0, F.struct((F.col("levels") * level_height).alias("h"), F.lit("levels").alias("how")))
        .otherwise(F.struct(F.lit(float(default)).alias("h"), F.lit("default").alias("how")))
    )


def describe(buildings: DataFrame, lat0: float, lon0: float, level_height: float = 3.0) -> DataFrame:
    """Flat record of each building with area, outline and volume in its local frame."""
    h = height(level_height)
    r = local_ring(F.col("footprint"), F.lit(lon0), F.lit(lat0))
    holes = F.transform("holes", lambda x: local_ring(x, F.lit(lon0), F.lit(lat0)))
    area = rings.area(r, holes)
    return buildings.select(
        "id", "source", "name", F.bround(h["h"], 2).alias("height_m"), h["how"].alias("height_source"), "levels", "roof_shape", "license", "attribution", F.size("footprint").alias("vertices"),
        F.bround(area, 2).alias("footprint_area_m2"), F.bround(rings.perimeter(r, holes), 2).alias("perimeter_m"), F.bround(area * h["h"], 2).alias("volume_m3"),
    )

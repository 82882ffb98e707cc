"""Plan documents: JSON in and out, one document a scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rings
from ..functions.walls import WallColumns

XY = "array<double>"
WALL = f"struct<id:int,a:{XY},b:{XY},thickness:double,height:double,sides_seen:int,line_id:int,exterior:boolean>"
DOCUMENT = (
    f"struct<version:int,units:string,ceiling_height:double,ceiling_measured:boolean,transform:array<array<double>>,north_deg:double,project:map<string,string>,"
    f"walls:array<{WALL}>,extra_walls:array<{WALL}>,openings:array<struct<id:int,wall_id:int,kind:string,t0:double,t1:double,z0:double,z1:double,rooms:array<int>,tag:string,height_measured:boolean>>,"
    f"rooms:array<struct<id:int,name:string,polygon:array<{XY}>,holes:array<array<{XY}>>,closed:boolean,floor_seen:double>>,"
    "meta:struct<source:string,scale_factor:double,views:int,cloud_footprint_m2:double,video_fps:double,sample_fps:double,video_frames:int,chunk_scales:array<double>,mask_fraction:double>>"
)


def decode(documents: DataFrame, text: str = "value", scene: str = "scene_id") -> dict[str, DataFrame]:
    """JSON texts -> plans, walls, extra_walls, openings, rooms. Unknown keys are dropped, missing
    optional ones get their defaults."""
    d = documents.select(F.col(scene).alias("scene_id"), F.from_json(text, DOCUMENT).alias("d"))
    pt = lambda p: rings.point(p[0], p[1])

    def walls(name):
        w = d.select("scene_id", F.inline(F.col(f"d.{name}")))
        return w.select("scene_id", "id", F.col("a")[0].alias("ax"), F.col("a")[1].alias("ay"), F.col("b")[0].alias("bx"), F.col("b")[1].alias("by"), "thickness", "height", F.coalesce("sides_seen", F.lit(1)).alias("sides_seen"), F.coalesce("line_id", F.lit(-1)).alias("line_id"), F.coalesce("exterior", F.lit(False)).alias("exterior"))

    o = d.select("scene_id", F.inline("d.openings"))
    openings = o.withColumns({"rooms": F.coalesce("rooms", F.array().cast("array<int>")), "tag": F.coalesce("tag", F.lit("")), "height_measured": F.coalesce("height_measured", F.lit(False))})
    r = d.select("scene_id", F.inline("d.rooms"))
    rooms = r.withColumns({"polygon": F.transform("polygon", pt), "holes": F.transform(F.coalesce("holes", F.array().cast(f"array<array<{XY}>>")), lambda h: F.transform(h, pt)), "closed": F.coalesce("closed", F.lit(True))})
    plans = d.select(
        "scene_id", "d.ceiling_height", F.coalesce("d.ceiling_measured", F.lit(True)).alias("ceiling_measured"), "d.transform", F.coalesce("d.units", F.lit("m")).alias("units"), "d.north_deg", F.coalesce("d.project", F.create_map().cast("map<string,string>")).alias("project"), F.coalesce("d.version", F.lit(1)).alias("version"),
        F.col("d.meta.source").alias("source"), F.col("d.meta.scale_factor").alias("scale_factor"), F.col("d.meta.views").alias("views"), F.col("d.meta.cloud_footprint_m2").alias("footprint_m2"), F.col("d.meta.video_fps").alias("video_fps"), F.col("d.meta.sample_fps").alias("sample_fps"), F.col("d.meta.video_frames").alias("video_frames"), F.col("d.meta.chunk_scales").alias("chunk_scales"), F.col("d.meta.mask_fraction").alias("mask_fraction"),
    )
    return {"plans": plans, "walls": walls("walls"), "extra_walls": walls("extra_walls"), "openings": openings, "rooms": rooms}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Documents below a path, named by their file."""
    texts = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.json)?$", 1).alias("scene_id"))
    return decode(texts)


def encode(plans: DataFrame, walls: DataFrame, openings: DataFrame, rooms: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """scene_id, value: one JSON text a scene, with derived areas, outlines, lengths and widths."""
    w = WallColumns()

    def wall_rows(df, name):
        row = F.struct("id", F.array("ax", "ay").alias("a"), F.array("bx", "by").alias("b"), "thickness", "height", "sides_seen", "line_id", "exterior", F.round(w.length, 4).alias("length_m"))
        return df.groupBy("scene_id").agg(F.array_sort(F.collect_list(row)).alias(name))

    opening = F.struct("id", "wall_id", "kind", "t0", "t1", "z0", "z1", "rooms", "tag", "height_measured", F.round(F.col("t1") - F.col("t0"), 4).alias("width_m"))
    xy = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    room = F.struct("id", "name", xy(F.col("polygon")).alias("polygon"), F.transform("holes", xy).alias("holes"), "closed", "floor_seen", F.round(rings.area(F.col("polygon"), F.col("holes")), 4).alias("area_m2"), F.round(rings.perimeter(F.col("polygon"), F.col("holes")), 4).alias("perimeter_m"))
    out = plans.join(wall_rows(walls, "walls"), "scene_id", "left")
    out = out.join(openings.groupBy("scene_id").agg(F.array_sort(F.collect_list(opening)).alias("openings")), "scene_id", "left")
    out = out.join(rooms.groupBy("scene_id").agg(F.array_sort(F.collect_list(room)).alias("rooms")), "scene_id", "left")
    if extra is not None:
        out = out.join(wall_rows(extra, "extra_walls"), "scene_id", "left")
    meta = [c for c in ("source", "scale_factor", "views", "video_fps", "sample_fps", "video_frames", "chunk_scales", "mask_fraction") if c in plans.columns]
    if "footprint_m2" in plans.columns:
        meta.append(F.col("footprint_m2").alias("cloud_footprint_m2"))
    fields = [F.lit(1).alias("version"), "ceiling_height", "ceiling_measured", "transform", *[c for c in ("units", "north_deg", "project") if c in plans.columns], "walls", "openings", "rooms", *(["extra_walls"] if extra is not None else [])]
    if meta:
        fields.append(F.struct(*meta).alias("meta"))
    return out.select("scene_id", F.to_json(F.struct(*fields)).alias("value"))


def write(documents: DataFrame, path: str) -> DataFrame:
    """One file a scene; returns scene_id, path."""
    from .sinks import write_files

    return write_files(documents.select("scene_id", F.lit("json").alias("format"), F.encode("value", "utf-8").alias("content")), path)

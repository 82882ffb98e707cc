"""Walls, openings and rooms of a plan from its lines: numbering, rebasing, repairs, tags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cells, ordered, polygons
from ..operators.graph import checkpointed
from . import tidy

S = ["scene_id"]
WALL = ["ax", "ay", "bx", "by", "thickness", "height", "sides_seen", "line_id", "exterior"]
WALL_T = "struct<ax:double,ay:double,bx:double,by:double,thickness:double,height:double,sides_seen:int,line_id:int,exterior:boolean>"
OPEN_T = "struct<wall:int,kind:string,t0:double,t1:double,z0:double,z1:double,height_measured:boolean,rooms:array<int>>"
GAP_T = "struct<ax:double,ay:double,bx:double,by:double,nx:double,ny:double,thickness:double,length:double,room:int>"


def walls_of(lines: DataFrame, openings: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walls bridge the doors in them; openings are measured from their wall's start."""
    key = ["scene_id", "line_id"]
    spans = lines.select(*key, F.explode("intervals").alias("i")).select(*key, "i.t0", "i.t1").unionByName(openings.filter("kind <> 'window'").select(*key, "t0", "t1"))
    bridged = ordered.interval_union(spans, key, bridge=1e-6).join(lines.select(*key, "alpha", "s", "thickness", "sides_seen", "exterior"), key).join(scenes.select("scene_id", "height"), S)
    at = lambda t: ((F.col("s") * F.cos("alpha") - t * F.sin("alpha")), (F.col("s") * F.sin("alpha") + t * F.cos("alpha")))
    (ax, ay), (bx, by) = at(F.col("t0")), at(F.col("t1"))
    id_ = F.row_number().over(Window.partitionBy("scene_id").orderBy("line_id", "t0")) - 1
    walls = bridged.select("scene_id", id_.cast("int").alias("id"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), "thickness", "height", "sides_seen", "line_id", "exterior", F.col("t0").alias("w0"), F.col("t1").alias("w1"))
    on = openings.join(walls.select("scene_id", "line_id", F.col("id").alias("wall_id"), "w0", "w1"), key).filter((F.col("t0") >= F.col("w0") - 1e-6) & (F.col("t1") <= F.col("w1") + 1e-6))
    return walls.drop("w0", "w1"), on.select("scene_id", "wall_id", "kind", (F.col("t0") - F.col("w0")).alias("t0"), (F.col("t1") - F.col("w0")).alias("t1"), "z0", "z1", F.col("measured").alias("height_measured"))


def gathered(walls: DataFrame, openings: DataFrame, rooms: DataFrame) -> DataFrame:
    """One row a scene with its plan as arrays (tens of elements), in id order."""
    w = walls.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("id", *WALL))).alias("walls"))
    o = openings.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("wall_id", "t0", "kind", "t1", "z0", "z1", "height_measured"))).alias("openings"))
    r = rooms.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("id", "polygon", "holes", "closed"))).alias("rooms"))
    return w.join(o, S, "left").join(r, S, "left")


def _plan(walls, openings, rooms):
    walls = [dict(zip(["id", *WALL], (w[c] for c in ["id", *WALL]))) for w in walls]
    at = {w.pop("id"): k for k, w in enumerate(walls)}
    rooms = list(rooms) if rooms is not None else []
    found = [{"wall": at[o["wall_id"]], **{c: o[c] for c in ("kind", "t0", "t1", "z0", "z1", "height_measured")}, "rooms": []} for o in (openings if openings is not None else [])]
    return walls, found, rooms


def tidied(plans: DataFrame, o) -> DataFrame:
    """Repairs in order; scene_id, walls, openings, extra, gaps as arrays."""

    def run(batches):
        for b in batches:
            out = []
            for scene, walls, openings, rooms in b[["scene_id", "walls", "openings", "rooms"]].itertuples(index=False):
                walls, openings, rooms = _plan(walls, openings, rooms)
                areas = tidy.regions(rooms)
                extra: list[dict] = []
                gaps: list[dict] = []
                openings = [{**x, "rooms": tidy.touching(walls[x["wall"]], x, areas)} for x in openings]
                if o.tidy:
                    for step in (
                        lambda w, p: tidy.bound_to_rooms(w, p, areas, o.wall_attach_dist, o.wall_trim_margin, o.min_wall_len),  # noqa: B023
                        lambda w, p: tidy.without_stubs(w, p, o.stub_max_len),
                        tidy.without_ghosts,
                    ):
                        walls, openings, aside = step(walls, openings)
                        extra += aside
                    walls, openings = tidy.squared(walls, openings)
                    gaps = tidy.outline_gaps(walls, rooms, areas, o.door_min, 2.5, default_thickness=o.default_interior_thickness)
                out.append((scene, walls, openings, extra, gaps))
            yield pd.DataFrame(out, columns=["scene_id", "walls", "openings", "extra", "gaps"])

    return plans.mapInPandas(run, f"scene_id string, walls array<{WALL_T}>, openings array<{OPEN_T}>, extra array<{WALL_T}>, gaps array<{GAP_T}>")


def assemble(lines: DataFrame, openings: DataFrame, rooms: DataFrame, scenes: DataFrame, free: DataFrame, grid: DataFrame, o) -> dict[str, DataFrame]:
    """walls, openings, rooms, extra_walls of every scene, repaired and tagged."""
    walls, on = walls_of(lines, openings, scenes)
    plan = checkpointed(tidied(gathered(walls, on, rooms), o))
    wall = plan.select("scene_id", F.posexplode("walls").alias("id", "w")).select("scene_id", F.col("id").cast("int").alias("id"), "w.*")
    opening = plan.select("scene_id", F.posexplode("openings").alias("n", "p")).select("scene_id", "n", "p.*").withColumnRenamed("wall", "wall_id")
    extra = plan.select("scene_id", F.posexplode("extra").alias("id", "w")).select("scene_id", F.col("id").cast("int").alias("id"), "w.*")
    gap = plan.select("scene_id", F.posexplode("gaps").alias("g", "p")).select("scene_id", "g", "p.*")
    seen = cells.share_along(gap, free, grid, S, ["g"], 9, 0.1, 0.9)
    new = gap.join(seen, ["scene_id", "g"]).filter(F.col("share") >= o.free_min)
    base = wall.groupBy("scene_id").agg((F.max("id") + 1).alias("base"))
    new = new.join(base, S).join(scenes.select("scene_id", "height"), S)
    new = new.withColumn("id", (F.col("base") + F.row_number().over(Window.partitionBy("scene_id").orderBy("g")) - 1).cast("int"))
    added = new.select("scene_id", "id", *[(F.col(c) + F.col(f"n{c[1]}")).alias(c) for c in ("ax", "ay", "bx", "by")], "thickness", "height", F.lit(1).alias("sides_seen"), F.lit(-1).alias("line_id"), F.lit(False).alias("exterior"))
    kind = F.when(F.col("length") <= o.door_max, "door").otherwise("passage")
    doors = new.select("scene_id", (F.lit(1_000_000) + F.col("g")).alias("n"), F.col("id").alias("wall_id"), kind.alias("kind"), F.lit(0.0).alias("t0"), F.col("length").alias("t1"), F.lit(0.0).alias("z0"), F.least(F.when(kind == "door", F.lit(o.default_door_height)).otherwise(F.col("height")), F.col("height")).alias("z1"), F.lit(False).alias("height_measured"), F.array("room").alias("rooms"))
    every = opening.unionByName(doors)
    return {"walls": wall.unionByName(added), "openings": tagged(every), "rooms": rooms, "extra_walls": extra}


PREFIX = {"door": "P", "window": "V", "passage": "A"}


def tagged(openings: DataFrame) -> DataFrame:
    """Openings with ids and tags: P1, P2 doors, V1 windows, A1 passages, in wall order."""
    letter = F.coalesce(*[F.when(F.col("kind") == k, p) for k, p in PREFIX.items()], F.lit("O"))
    w = Window.partitionBy("scene_id", "kind").orderBy("wall_id", "t0")
    order = Window.partitionBy("scene_id").orderBy("wall_id", "t0", "kind")
    out = openings.withColumns({"tag": F.concat(letter, F.row_number().over(w).cast("string")), "id": (F.row_number().over(order) - 1).cast("int")})
    return out.select("scene_id", "id", "wall_id", "kind", "t0", "t1", "z0", "z1", "rooms", "tag", "height_measured")


def area_of(rooms: DataFrame) -> DataFrame:
    """Floor of each scene, shared parts once, at any angle: scene_id, area_m2."""
    cut = polygons.edges(polygons.outlines(rooms, ["scene_id"]), ["scene_id"], "ring", 0, F.col("hole"))
    found = polygons.areas(polygons.trapezoids(cut, ["scene_id"], 1.0), ["scene_id"], ["union"])
    return rooms.select("scene_id").distinct().join(found, "scene_id", "left").select("scene_id", F.coalesce("union", F.lit(0.0)).alias("area_m2"))

"""Block models and drawings of building sites."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from ..sources import buildings as b
from ..sources import sinks


def prisms(found: DataFrame, lat0: float, lon0: float, level_height: float = 3.0, only_first: bool = False) -> DataFrame:
    """Faces of footprints raised to their height: scene_id, kind, face; ``only_first`` keeps the
    building with relevance 1."""
    rows = found.filter("relevance = 1") if only_first else found
    ring = rings.counter_clockwise(b.local_ring(F.col("footprint"), F.lit(lon0), F.lit(lat0)))
    on = rows.select(F.col("id").alias("scene_id"), ring.alias("r"), b.height(level_height)["h"].alias("h"))
    at = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z"))
    zero = F.lit(0.0)
    top = on.select("scene_id", F.lit("ceiling").alias("kind"), F.transform("r", lambda p: at(p, F.col("h"))).alias("face"))
    floor = on.select("scene_id", F.lit("floor").alias("kind"), F.transform("r", lambda p: at(p, zero)).alias("face"))
    side = on.select("scene_id", "h", F.explode(rings.edges(F.col("r"))).alias("e")).select("scene_id", F.lit("wall").alias("kind"), F.array(at(F.col("e.a"), zero), at(F.col("e.b"), zero), at(F.col("e.b"), F.col("h")), at(F.col("e.a"), F.col("h"))).alias("face"))
    return top.unionByName(floor).unionByName(side)


def drawing(found: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Footprints with the names of their corners and sides of a metre or more, as primitives."""
    from . import survey

    ring = b.local_ring(F.col("footprint"), F.lit(lon0), F.lit(lat0))
    none = F.lit(None).cast("string")
    base = found.select(F.col("id").alias("scene_id"), F.lit(0).alias("seq"), F.lit("polygon").alias("kind"), ring.alias("points"), none.alias("text"), F.lit("room").alias("layer"))
    v = survey.vertices(found, lat0, lon0)
    corner = v.select(F.col("id").alias("scene_id"), F.col("vertex").alias("seq"), F.lit("text").alias("kind"), F.array(rings.point(F.col("x"), F.col("y"))).alias("points"), F.concat(F.lit("V"), F.col("vertex").cast("string")).alias("text"), F.lit("label").alias("layer"))
    side = survey.sides(v).filter("length_m >= 1").join(v.select("id", F.col("vertex").alias("from"), "x", "y").hint("merge"), ["id", "from"]).join(v.select("id", F.col("vertex").alias("to"), F.col("x").alias("x2"), F.col("y").alias("y2")).hint("merge"), ["id", "to"])
    length = side.select(F.col("id").alias("scene_id"), (F.col("from") + 10_000).alias("seq"), F.lit("text").alias("kind"), F.array(rings.point((F.col("x") + F.col("x2")) / 2, (F.col("y") + F.col("y2")) / 2)).alias("points"), F.format_string("%.2f m", "length_m").alias("text"), F.lit("label").alias("layer"))
    return base.unionByName(corner).unionByName(length)


def export(found: DataFrame, lat0: float, lon0: float, folder: str, formats: tuple = ("svg", "dxf", "obj", "glb", "pdf", "png", "iso.svg")) -> DataFrame:
    """Files of every building of a ranked table; its id (with slashes as dashes) names them."""
    named = found.withColumn("id", F.translate("id", "/", "-"))
    prims, faces = drawing(named, lat0, lon0), prisms(named, lat0, lon0)
    raw = lambda df: df.select("scene_id", F.encode("value", "utf-8").alias("content"))
    makers = {"svg": lambda: raw(sinks.svg(prims, 12.0)), "dxf": lambda: raw(sinks.dxf(prims)), "obj": lambda: sinks.obj(faces), "glb": lambda: sinks.glb(faces), "pdf": lambda: sinks.pdf(prims, 500), "png": lambda: sinks.png(prims, 12.0), "iso.svg": lambda: raw(sinks.isometric_svg(faces, 12.0))}
    out = None
    for f in formats:
        part = makers[f]().select("scene_id", F.lit(f).alias("format"), "content")
        out = part if out is None else out.unionByName(part)
    return sinks.write_files(out, folder)


def footprints(points: DataFrame, directions: int = 64) -> DataFrame:
    """Convex hull area of each scene's points on the ground: scene_id, footprint_m2. Only the
    furthest point in each of ``directions`` directions leaves the aggregate, whatever the size of
    the cloud; the hull through them is a gauge, within a tenth of a percent for round shapes."""
    two_pi = 2 * np.pi
    best = [F.max_by(F.struct("x", "y"), F.col("x") * float(np.cos(two_pi * k / directions)) + F.col("y") * float(np.sin(two_pi * k / directions))).alias(f"d{k}") for k in range(directions)]
    ends = points.groupBy("scene_id").agg(*best).select("scene_id", F.array(*[f"d{k}" for k in range(directions)]).alias("p"))

    def run(batches):
        for batch in batches:
            out = []
            for scene, pts in batch[["scene_id", "p"]].itertuples(index=False):
                q = sorted({(p["x"], p["y"]) for p in pts})
                half = []
                for seq in (q, q[::-1]):
                    hull: list = []
                    for p in seq:
                        while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) <= (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]):
                            hull.pop()
                        hull.append(p)
                    half += hull[:-1]
                a = np.array(half)
                n = np.roll(a, -1, 0)
                out.append((scene, float(abs((a[:, 0] * n[:, 1] - n[:, 0] * a[:, 1]).sum()) / 2) if len(a) > 2 else 0.0))
            yield pd.DataFrame(out, columns=["scene_id", "footprint_m2"])

    return ends.mapInPandas(run, "scene_id string, footprint_m2 double")

"""Parametric apartments with exact truth: the fixtures of the geometry tests.

Surfaces are a few dozen rows a scene; Spark fills each with uniform random points, so a
table of any number of scenes and any density is generated in parallel."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gap:
    """Opening in the plane axis = at, from t0 to t1 along the wall."""

    axis: str
    at: float
    t0: float
    t1: float
    z0: float = 0.0
    z1: float = 2.05
    kind: str = "door"


@dataclass(frozen=True)
class Flat:
    rooms: tuple
    gaps: tuple = ()
    height: float = 2.5
    inner: float = 0.12
    outer: float = 0.25
    names: tuple = field(default=())


# Rooms as x0, y0, x1, y1; fixed values of the published fixtures.
SCENES = {
    "two_rooms": Flat(((0, 0, 4, 3), (4.12, 0, 7, 3)), (Gap("x", 4.0, 1.0, 1.9), Gap("y", 0, 0.6, 1.5), Gap("y", 3, 1.2, 2.6, 0.9, 2.1, "window"), Gap("y", 3, 5.0, 6.2, 0.9, 2.1, "window"))),
    "three_rooms": Flat(((0, 0, 4, 3), (4.12, 0, 7.5, 3), (0, 3.12, 7.5, 5)), (Gap("y", 3, 0.8, 1.7), Gap("y", 3, 5.5, 6.4), Gap("x", 4, 0.9, 1.8), Gap("x", 7.5, 3.6, 4.6, 0.9, 2.0, "window"), Gap("y", 0, 2.0, 3.2, 0.9, 2.0, "window"))),
    "a_room_and_a_view": Flat(((0, 0, 4, 4), (4.12, -2, 9, 6)), (Gap("x", 4, 1.2, 2.8),)),
}


def scenes() -> list[str]:
    return sorted(SCENES)


def surfaces(flat: Flat, density: float = 900.0) -> list[dict]:
    """Origin, two sides, normal, points, room and the holes of every face."""
    out = []

    def face(o, u, v, n, room, share=1.0, holes=()):
        size = math.dist((0, 0, 0), u) * math.dist((0, 0, 0), v)
        out.append({"o": list(map(float, o)), "u": list(map(float, u)), "v": list(map(float, v)), "n": list(map(float, n)), "count": int(density * size * share), "room": room, "holes": [[float(x) for x in h] for h in holes]})

    h = flat.height
    for k, (x0, y0, x1, y1) in enumerate(flat.rooms):
        for axis, at, n, t0, t1 in (("x", x0, 1, y0, y1), ("x", x1, -1, y0, y1), ("y", y0, 1, x0, x1), ("y", y1, -1, x0, x1)):
            here = [g for g in flat.gaps if g.axis == axis and abs(g.at - at) <= flat.outer + 1e-6 and g.t0 >= t0 - 1e-6 and g.t1 <= t1 + 1e-6]
            normal = (n, 0, 0) if axis == "x" else (0, n, 0)
            holes = [((g.t0 - t0) / (t1 - t0), (g.t1 - t0) / (t1 - t0), g.z0 / h, g.z1 / h) for g in here]
            o, u = ((at, t0, 0), (0, t1 - t0, 0)) if axis == "x" else ((t0, at, 0), (t1 - t0, 0, 0))
            face(o, u, (0, 0, h), normal, k, holes=holes)
            for g in here:  # reveals across the wall
                shared = sum(1 for r in flat.rooms if abs((r[0] if axis == "x" else r[1]) - g.at) <= flat.outer + 1e-6 or abs((r[2] if axis == "x" else r[3]) - g.at) <= flat.outer + 1e-6) > 1
                th = (flat.inner if shared else flat.outer) * -n
                for t, sign in ((g.t0, 1), (g.t1, -1)):
                    o = (at, t, g.z0) if axis == "x" else (t, at, g.z0)
                    face(o, (th, 0, 0) if axis == "x" else (0, th, 0), (0, 0, g.z1 - g.z0), (0, sign, 0) if axis == "x" else (sign, 0, 0), k, 0.5)
        w, d = x1 - x0, y1 - y0
        face((x0, y0, 0), (w, 0, 0), (0, d, 0), (0, 0, 1), k)
        face((x0, y0, h), (w, 0, 0), (0, d, 0), (0, 0, -1), k, 0.6)
        bx, by, bw, bd, bh = x0 + w * 0.4, y0 + d * 0.35, min(1.2, w / 3), min(0.6, d / 4), 0.7  # a table
        face((bx, by, bh), (bw, 0, 0), (0, bd, 0), (0, 0, 1), k)
        face((bx, by, 0), (bw, 0, 0), (0, 0, bh), (0, -1, 0), k)
        face((bx, by + bd, 0), (bw, 0, 0), (0, 0, bh), (0, 1, 0), k)
    for g in flat.gaps:  # ground outside an outer door, seen only through it
        own = sides_of(flat, g)
        if g.kind == "door" and len(own) == 1:
            x0, y0, x1, y1 = flat.rooms[own[0]]
            low = abs((x0 if g.axis == "x" else y0) - g.at) < abs((x1 if g.axis == "x" else y1) - g.at)
            a, mid = g.at + (-3.3 if low else 0.3), (g.t0 + g.t1) / 2 - 1.5
            o, u, v = ((a, mid, 0), (3, 0, 0), (0, 3, 0)) if g.axis == "x" else ((mid, a, 0), (3, 0, 0), (0, 3, 0))
            face(o, u, v, (0, 0, 1), -1, 0.4)
    return out


def sides_of(flat: Flat, g: Gap) -> list[int]:
    """Rooms whose wall carries an opening: two for an inner door."""
    out = []
    for k, (x0, y0, x1, y1) in enumerate(flat.rooms):
        ends, span = ((x0, x1), (y0, y1)) if g.axis == "x" else ((y0, y1), (x0, x1))
        if min(abs(e - g.at) for e in ends) <= flat.outer + 1e-6 and span[0] - 1e-6 <= g.t0 and g.t1 <= span[1] + 1e-6:
            out.append(k)
    return out


def looks(flat: Flat, cams: list, room: int) -> list[dict]:
    """Cameras of other rooms (or of any, from outside) with the doors they look at ``room`` through."""
    out = []
    for g in flat.gaps:
        own = sides_of(flat, g)
        if g.kind != "door" or not (room in own and len(own) == 2 or room == -1 and len(own) == 1):
            continue
        for v, r, t in cams:
            if r in own and r != room:
                out.append({"view": v, "x": t[0][3], "y": t[1][3], "z": t[2][3], "ax": g.axis == "x", "at": float(g.at), "t0": float(g.t0), "t1": float(g.t1), "z0": float(g.z0), "z1": float(g.z1)})
    return out


def cameras(flat: Flat, per_room: int = 3, walked: tuple | None = None) -> list[tuple[int, int, list]]:
    """(view, room, pose) at eye height, spread over the rooms that are walked."""
    out = []
    for k, (x0, y0, x1, y1) in enumerate(flat.rooms):
        for i in range(per_room if walked is None or k in walked else 0):
            f = (i + 1) / (per_room + 1)
            yaw = 2 * math.pi * f
            c, s = math.cos(yaw), math.sin(yaw)
            x, y = x0 + (x1 - x0) * f, y0 + (y1 - y0) * (0.3 + 0.4 * ((i * 2) % 3) / 2)
            out.append((len(out), k, [[s, 0.0, c, x], [-c, 0.0, s, y], [0.0, -1.0, 0.0, 1.4], [0.0, 0.0, 0.0, 1.0]]))
    return out


def sample(spark: SparkSession, names: list[str], density: float = 900.0, noise: float = 0.008, per_room: int = 3, seed: int = 0, copies: int = 1, through_doors: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``points`` and ``cameras`` of scenes, each repeated ``copies`` times under its own scene_id.
    A point is seen by a camera of its room; of those that a camera elsewhere sees through a
    doorway, the share ``through_doors`` is that camera's."""
    rows, views = [], []
    for name in names:
        flat = SCENES[name]
        cams = cameras(flat, per_room)
        for c in range(copies):
            scene = name if copies == 1 else f"{name}-{c}"
            for k, s in enumerate(surfaces(flat, density)):
                ids = [v for v, r, _ in cams if r == s["room"]] or ([v for v, _, _ in cams] if s["room"] >= 0 else [])
                rows.append((scene, k, s["o"], s["u"], s["v"], s["n"], s["count"], s["room"], s["holes"], ids, looks(flat, cams, s["room"])))
            views += [(scene, v, t) for v, _, t in cams]
    src = spark.createDataFrame(rows, "scene_id string, surface int, o array<double>, u array<double>, v array<double>, n array<double>, count int, room int, holes array<array<double>>, ids array<int>, looks array<struct<view:int,x:double,y:double,z:double,ax:boolean,at:double,t0:double,t1:double,z0:double,z1:double>>")
    pts = src.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.col("count"), F.lit(1)))))

    def uniform(tag: int):
        bits = F.xxhash64("scene_id", "surface", "k", F.lit(seed * 1000 + tag))
        return (F.shiftrightunsigned(bits, 11).cast("double") + 0.5) / float(1 << 53)

    def normal(tag: int):
        return F.sqrt(-2 * F.ln(uniform(tag))) * F.cos(2 * math.pi * uniform(tag + 1)) * noise

    pts = pts.withColumns({"a": uniform(1), "b": uniform(2)}).filter(~F.exists("holes", lambda h: (F.col("a") >= h[0]) & (F.col("a") <= h[1]) & (F.col("b") >= h[2]) & (F.col("b") <= h[3])))
    at = [F.col("o")[i] + F.col("a") * F.col("u")[i] + F.col("b") * F.col("v")[i] + normal(10 + 2 * i) for i in range(3)]
    pts = pts.withColumns({n: x for n, x in zip("xyz", at)})

    def through(c):
        across, eye = F.when(c["ax"], F.col("x")).otherwise(F.col("y")), F.when(c["ax"], c["x"]).otherwise(c["y"])
        beside, eye_t = F.when(c["ax"], F.col("y")).otherwise(F.col("x")), F.when(c["ax"], c["y"]).otherwise(c["x"])
        f = (c["at"] - eye) / F.when(F.abs(across - eye) > 1e-9, across - eye)
        t, z = eye_t + f * (beside - eye_t), c["z"] + f * (F.col("z") - c["z"])
        return F.coalesce((f > 0) & (f < 1) & t.between(c["t0"], c["t1"]) & z.between(c["z0"], c["z1"]), F.lit(False))

    pts = pts.withColumn("seen", F.filter("looks", through))
    other = F.get("seen", F.floor(uniform(4) * F.size("seen")).cast("int"))["view"]
    own = F.get("ids", F.floor(uniform(3) * F.size("ids")).cast("int"))
    view = F.when((F.size("seen") > 0) & ((uniform(5) < through_doors) | (F.size("ids") == 0)), other).otherwise(own)
    pts = pts.withColumn("view_id", view).filter("view_id is not null")
    points = pts.select(
        "scene_id", (F.col("surface").cast("long") * 10_000_000 + F.col("k")).alias("point_id"), "x", "y", "z", *[F.col("n")[i].alias(f"n{c}") for i, c in enumerate("xyz")],
        F.lit(None).cast("short").alias("r"), F.lit(None).cast("short").alias("g"), F.lit(None).cast("short").alias("b"), "view_id",
    )
    return points, spark.createDataFrame(views, "scene_id string, view_id int, T array<array<double>>")


def rigid(tilt_deg: float = 9.0, yaw_deg: float = 23.0, offset=(3.0, -2.0, 0.7)) -> list[list[float]]:
    """A tilt about the y axis after a yaw, and a shift: a 4x4 pose."""
    t, y = math.radians(tilt_deg), math.radians(yaw_deg)
    ct, st, cy, sy = math.cos(t), math.sin(t), math.cos(y), math.sin(y)
    r = [[ct * cy, -ct * sy, st], [sy, cy, 0.0], [-st * cy, st * sy, ct]]
    return [[*r[i], float(offset[i])] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]]


def moved(points: DataFrame, cams: DataFrame, pose: list[list[float]]) -> tuple[DataFrame, DataFrame]:
    """Points, normals and cameras under a rigid motion."""
    from ..functions.vec import compose, matrix

    row = lambda i, c, w: sum((F.col(n) * pose[i][j] for j, n in enumerate(c)), F.lit(pose[i][3] * w))
    p = points.withColumns({**{n: row(i, "xyz", 1.0) for i, n in enumerate("xyz")}, **{f"n{n}": row(i, ("nx", "ny", "nz"), 0.0) for i, n in enumerate("xyz")}})
    return p, cams.withColumn("T", compose(matrix(pose), F.col("T")))

"""From point clouds to plan tables, many scenes at once.

Points only meet aggregates, equi-joins and windows on (scene, family, side, ...); what
reaches a Python group is a histogram, the runs of one family or the plan of one scene.

    points, cameras -> aligned -> wall points -> faces -> lines -> openings -> rooms -> plan
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import aggregate, cells, join, ordered, select
from ..operators.graph import cell_components, checkpointed
from . import shapes


@dataclass
class Options:
    """Distances are metres. ``manhattan`` rotates each scene to its main direction."""

    manhattan: bool = True
    up_hint: tuple | None = None
    voxel: float | None = 0.02
    cell: float = 0.02
    coverage_cell: float = 0.10
    station_bin: float = 0.10
    z_band: float = 0.15
    min_coverage_frac: float = 0.35
    cell_coverage_frac: float = 0.25
    wall_z_min: float = 0.10
    wall_top_margin: float = 0.10
    wall_max_nz: float = 0.35
    angle_tol_deg: float = 20.0
    s_bin: float = 0.03
    s_tol: float = 0.06
    gap_tol: float = 0.30
    min_wall_len: float = 0.40
    min_peak_points: int = 30
    min_thickness: float = 0.04
    max_thickness: float = 0.45
    default_interior_thickness: float = 0.10
    default_exterior_thickness: float = 0.20
    snap_dist: float = 0.45
    door_min: float = 0.55
    door_max: float = 1.30
    free_min: float = 0.35
    unseen_merge_max: float = 2.5
    default_door_height: float = 2.05
    default_ceiling: float = 2.50
    min_room_area: float = 1.5
    min_room_inside_frac: float = 0.25
    room_fallback: bool = True
    room_min_jog: float = 0.9
    room_snap_dist: float = 2.5
    room_close_r: float = 0.6
    rooms_from: str = "floor"
    room_wall_evidence: float = 0.35
    room_wall_blocked: float = 0.55
    tidy: bool = True
    wall_attach_dist: float = 0.20
    wall_trim_margin: float = 0.10
    stub_max_len: float = 0.6
    detect_windows: bool = True
    max_rays: int = 150_000
    rooms_clipped_by_low_walls: bool = False
    room_clip_bridge: float = 0.5
    free_blocked_by_walls: bool = False
    free_guard: float = 0.5
    seed: int = 0

    def record(self) -> dict:
        return asdict(self)


S = ["scene_id"]


# -- alignment -----------------------------------------------------------------------------


def level_of(hist: pd.DataFrame, lo: float | None = None, hi: float | None = None, highest: bool = False) -> tuple[float, int] | None:
    """Height and support of the lowest (or highest) strong peak of a 2 cm histogram."""
    if not len(hist):
        return None
    bins = np.arange(hist["bin"].min() - 1, hist["bin"].max() + 2)
    n = np.zeros(len(bins))
    n[hist["bin"].to_numpy() - bins[0]] = hist["n"]
    sm = np.convolve(n, [0.25, 0.5, 0.25], "same")
    at = (bins + 0.5) * 0.02
    found = ordered.peak_indices(sm, max(20.0, 0.05 * sm.max()), 5, 0.02 * sm.max())
    found = [p for p in found if (lo is None or at[p] >= lo) and (hi is None or at[p] <= hi)]
    if not found:
        return None
    strong = [p for p in found if sm[p] >= 0.15 * max(sm[q] for q in found)]
    p = (max if highest else min)(strong, key=lambda q: at[q])
    near = slice(max(0, p - 2), p + 3)  # a level may lie on the border of two bins
    return float((at[near] * n[near]).sum() / n[near].sum()), int(n[p])


def gravity(points: DataFrame, cameras: DataFrame, o: Options) -> DataFrame:
    """Upward direction, floor and ceiling of every scene: scene_id, ux, uy, uz, floor_z, ceiling,
    floor_support, ceiling_support."""
    if o.up_hint is not None:
        hint = points.select("scene_id").distinct().select("scene_id", vec.normalize(vec.vector(*o.up_hint)).alias("hint"))
    else:
        ups = cameras.select("scene_id", vec.camera_up(F.col("T")).alias("u")).groupBy("scene_id").agg(*[F.avg(F.col("u")[i]).alias(f"u{i}") for i in range(3)])
        hint = points.select("scene_id").distinct().join(ups, "scene_id", "left").select("scene_id", vec.normalize(F.when(F.col("u0").isNotNull(), F.array("u0", "u1", "u2")).otherwise(vec.vector(0, 0, 1))).alias("hint"))
    up = checkpointed(aggregate.cone_mean_normal(points.join(hint, S), S, F.col("hint")))  # a row a scene, asked for four times below
    h = F.col("x") * F.col("ux") + F.col("y") * F.col("uy") + F.col("z") * F.col("uz")
    nh = F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz")
    heights = points.join(up, S).select("scene_id", h.alias("h"), nh.alias("nh"))
    kind = F.when(F.col("nh") > 0.9, "up").when(F.col("nh") < -0.9, "down")
    flat = heights.withColumn("kind", kind).filter("kind is not null")
    mm = lambda c: F.round(c, 3)  # noqa: E731  an exact percentile keeps every distinct value: few of them, to the millimetre
    ends = flat.groupBy("scene_id", "kind").agg(F.percentile(mm("h"), F.array(F.lit(0.005), F.lit(0.995))).alias("p"), F.count("*").alias("total")).select("scene_id", "kind", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"), "total")
    hist = flat.join(ends.filter("total > 100"), ["scene_id", "kind"]).filter(F.col("h").between(F.col("lo") - 0.02, F.col("hi") + 0.04)).groupBy("scene_id", "kind", F.floor(F.col("h") / 0.02).cast("long").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    low = heights.groupBy("scene_id").agg(F.percentile(mm("h"), F.lit(0.01)).alias("p1"))

    def levels(rows):
        base = float(rows["p1"].iloc[0])
        floor = level_of(rows[rows["kind"] == "up"])
        z, support = floor if floor else (base, 0)
        top = level_of(rows[rows["kind"] == "down"], z + 1.8, z + 6.0, highest=True)
        return pd.DataFrame({"scene_id": [rows["scene_id"].iloc[0]], "floor_z": [z], "ceiling": [top[0] - z if top else np.nan], "floor_support": [support], "ceiling_support": [top[1] if top else 0]})

    found = low.join(hist, S, "left").groupBy("scene_id").applyInPandas(levels, "scene_id string, floor_z double, ceiling double, floor_support long, ceiling_support long")
    return up.join(found, S).withColumn("ceiling", F.when(F.isnan("ceiling"), None).otherwise(F.col("ceiling")))


def _moved(points: DataFrame, r, dz=None) -> DataFrame:
    """Points and normals under the rotation column ``r`` and a drop along z."""
    p, n = vec.rotate(r, F.array("x", "y", "z")), vec.rotate(r, F.array("nx", "ny", "nz"))
    out = points.withColumns({"_p": p, "_n": n})
    z = F.col("_p")[2] - (dz if dz is not None else 0.0)
    return out.withColumns({"x": F.col("_p")[0], "y": F.col("_p")[1], "z": z, "nx": F.col("_n")[0], "ny": F.col("_n")[1], "nz": F.col("_n")[2]}).drop("_p", "_n")


def align(points: DataFrame, cameras: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, cameras, scenes) with up along z, the floor at 0 and walls along the axes."""
    grav = checkpointed(gravity(points, cameras, o))
    scenes = grav.withColumn("rot", vec.rotation_between(F.array("ux", "uy", "uz"), vec.vector(0, 0, 1))).withColumn("ceiling_measured", F.col("ceiling").isNotNull())
    scenes = scenes.withColumn("height", F.coalesce("ceiling", F.lit(o.default_ceiling))).withColumn("z_top", F.when(F.col("ceiling_measured"), F.col("ceiling") - o.wall_top_margin).otherwise(3.5))
    up = _moved(points.join(scenes.select("scene_id", "rot", "floor_z", "z_top"), S), F.col("rot"), F.col("floor_z"))
    up = up.withColumn("is_wall", (F.abs("nz") < o.wall_max_nz) & (F.col("z") > o.wall_z_min) & (F.col("z") < F.col("z_top")))
    if o.manhattan:
        turn = aggregate.dominant_direction(up.filter("is_wall").select("scene_id", "nx", "ny"), S)
        quarter = math.pi / 2
        scenes = scenes.join(turn, S, "left").withColumn("phi", F.coalesce(F.pmod(F.col("angle") + quarter / 2, F.lit(quarter)) - quarter / 2, F.lit(0.0))).drop("angle")
    else:
        scenes = scenes.withColumn("phi", F.lit(0.0))
    scenes = checkpointed(scenes)
    c, s = F.cos("phi"), F.sin("phi")
    flat = lambda x, y: {x: F.col(x) * c + F.col(y) * s, y: F.col(y) * c - F.col(x) * s}
    out = up.join(scenes.select("scene_id", "phi"), S).withColumns({**flat("x", "y"), **flat("nx", "ny")}).drop("rot", "floor_z", "phi")
    total = vec.compose(vec.pose(vec.rotation_z(-F.col("phi")), vec.vector(0, 0, 0)), vec.pose(F.col("rot"), vec.vector(0, 0, -F.col("floor_z"))))
    scenes = scenes.withColumn("transform", total)
    cams = cameras.join(scenes.select("scene_id", "transform"), S).withColumn("T", vec.compose(F.col("transform"), F.col("T"))).drop("transform")
    return out, cams, scenes


# -- faces and lines ------------------------------------------------------------------------


def wall_points(points: DataFrame, scenes: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(all wall points, scenes with band limits and family angles): unit normals in the plane, and
    which points stand on a cell that is covered high enough."""
    raw = points.filter("is_wall").withColumn("_l", F.hypot("nx", "ny")).withColumns({"nx": F.col("nx") / F.col("_l"), "ny": F.col("ny") / F.col("_l")}).drop("_l")
    seen = raw.groupBy("scene_id").agg(F.percentile(F.round("z", 3), F.lit(0.95)).alias("p95"), F.count("*").alias("wall_points"))
    scenes = scenes.join(seen, S).withColumn("z_seen_top", F.least("z_top", "p95")).withColumn("bands", (F.col("z_seen_top") - o.wall_z_min) / o.z_band)
    scenes = scenes.withColumns({"min_bands": F.greatest(F.lit(2.0), F.col("bands") * o.min_coverage_frac), "cell_bands": F.greatest(F.lit(2.0), F.col("bands") * o.cell_coverage_frac)})
    if o.manhattan:
        scenes = scenes.withColumn("alphas", F.array(F.lit(0.0), F.lit(math.pi / 2)))
    else:
        angle = raw.select("scene_id", F.floor(F.pmod(F.atan2("ny", "nx"), F.lit(math.pi)) / math.pi * 1800).alias("bin")).groupBy("scene_id", "bin").count()

        def families(rows):
            a = np.repeat((rows["bin"].to_numpy() + 0.5) * np.pi / 1800, rows["count"].to_numpy())
            return pd.DataFrame({"scene_id": [rows["scene_id"].iloc[0]], "alphas": [aggregate.direction_families(a)]})

        scenes = scenes.join(angle.groupBy("scene_id").applyInPandas(families, "scene_id string, alphas array<double>"), S)
    scenes = checkpointed(scenes)
    grid = cells.grid_of(points.select("scene_id", "x", "y"), S, o.coverage_cell)
    at = cells.index(raw, grid, S)
    cover = cells.coverage(at.join(scenes.select("scene_id", F.col("z_top").alias("zt")), S), S, "z", o.z_band, F.col("zt"))
    kept = at.join(cover.withColumnRenamed("value", "cover"), ["scene_id", "ix", "iy"]).join(scenes.select("scene_id", "cell_bands"), S)
    return kept.withColumn("covered", F.col("cover") >= F.col("cell_bands")).drop("ix", "iy", "cover", "cell_bands"), scenes


FACE = ["scene_id", "alpha", "sign"]


def faces(walls: DataFrame, scenes: DataFrame, o: Options) -> DataFrame:
    """Runs of points on one plane, with a verdict: scene_id, alpha, sign, s, t0, t1, n_pts, coverage,
    accepted. Runs that fail on height only are kept as low evidence."""
    fam = walls.filter("covered").join(scenes.select("scene_id", F.explode("alphas").alias("alpha")), S)
    dotp = F.col("nx") * F.cos("alpha") + F.col("ny") * F.sin("alpha")
    fam = fam.withColumn("_d", dotp).filter(F.abs("_d") >= math.cos(math.radians(o.angle_tol_deg))).select(
        "scene_id", "alpha", F.signum("_d").cast("int").alias("sign"), (F.col("x") * F.cos("alpha") + F.col("y") * F.sin("alpha")).alias("s"), (F.col("y") * F.cos("alpha") - F.col("x") * F.sin("alpha")).alias("t"), "z"
    )
    fam = checkpointed(fam)
    hist = aggregate.smoothed_histogram(fam, FACE, "s", o.s_bin)
    peaks = ordered.peaks(hist, FACE, "bin", "smooth", float(o.min_peak_points), 3, 0.5 * o.min_peak_points)
    peaks = peaks.select(*FACE, F.col("rank").alias("peak"), ((F.col("bin") + 0.5) * o.s_bin).alias("s0"))
    # A point may serve two planes: a range join, no claim.
    first = join.range_join(fam, peaks, FACE, F.col("s"), F.col("s0"), o.s_tol)
    centre = first.groupBy(*FACE, "peak").agg(F.median("s").alias("s0"), F.count("*").alias("n")).filter(F.col("n") >= o.min_peak_points).drop("n")
    near = join.range_join(fam, centre, FACE, F.col("s"), F.col("s0"), o.s_tol)
    keys = [*FACE, "peak", "s0"]
    marked = ordered.with_islands(near, keys, "t", o.gap_tol, ["z"])
    run = [*keys, "island"]
    ends = marked.groupBy(*run).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n_pts")).filter((F.col("n_pts") >= 5) & (F.col("t1") - F.col("t0") >= o.min_wall_len))
    rows = marked.join(ends, run).join(scenes.select("scene_id", "z_seen_top", "ceiling_measured", "bands", "min_bands"), S)
    per_bin = aggregate.station_coverage(rows, run, "t", "z", o.station_bin, o.z_band).groupBy(*run).agg(F.median("bands").alias("coverage"))
    top = rows.filter(F.col("z") >= F.col("z_seen_top") - 0.5).groupBy(*run).agg(F.count_distinct(F.floor((F.col("t") - F.col("t0")) / o.station_bin)).alias("top_bins"))
    whole = ends.join(per_bin, run).join(top, run, "left").join(scenes.select("scene_id", "ceiling_measured", "bands", "min_bands"), S)
    n_bins = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / o.station_bin))
    tall = ~F.col("ceiling_measured") | (F.coalesce("top_bins", F.lit(0)) / n_bins >= 0.20) | (F.col("coverage") >= 0.75 * F.col("bands"))
    return whole.select("scene_id", "alpha", "sign", F.col("s0").alias("s"), "t0", "t1", "n_pts", "coverage", ((F.col("coverage") >= F.col("min_bands")) & tall).alias("accepted"))


LINE = "scene_id string, line_id int, alpha double, s double, thickness double, sides_seen int, face_sign int, face_s double, faces array<struct<sign:int,s:double>>, intervals array<struct<t0:double,t1:double>>"


def pair_faces(rows: pd.DataFrame, o: Options) -> list[dict]:
    """Walls of one family: each far face takes the unused near face that gives the thinnest
    possible body; lone faces stand for a wall of the default thickness. Walls in line
    are joined, offsets weighted by points."""
    rows = rows.sort_values(["s", "t0"])
    back, front = rows[rows["sign"] < 0].to_dict("records"), rows[rows["sign"] > 0].to_dict("records")
    used: set[int] = set()
    found = []
    for f in back:
        options = []
        for k, g in enumerate(front):
            th = g["s"] - f["s"]
            cover = min(f["t1"], g["t1"]) - max(f["t0"], g["t0"])
            if k not in used and o.min_thickness <= th <= o.max_thickness and cover >= min(0.30, 0.5 * min(f["t1"] - f["t0"], g["t1"] - g["t0"])):
                options.append((th, k))
        if options:
            th, k = min(options)
            used.add(k)
            found.append(((f["s"] + front[k]["s"]) / 2, th, 2, [f, front[k]]))
        else:
            found.append((f["s"] + o.default_interior_thickness / 2, o.default_interior_thickness, 1, [f]))
    found += [(g["s"] - o.default_interior_thickness / 2, o.default_interior_thickness, 1, [g]) for k, g in enumerate(front) if k not in used]
    lines: list[dict] = []
    for s, th, sides, own in sorted(found, key=lambda r: r[0]):
        n = sum(f["n_pts"] for f in own)
        line = next((x for x in lines if abs(x["s"] - s) <= 0.04 and (x["sides"] == sides or abs(x["th"] - th) <= 0.03)), None)
        if line is None:
            lines.append({"s": s, "th": th, "sides": sides, "n": n, "faces": list(own)})
            continue
        share = n / (line["n"] + n)
        line["s"] += (s - line["s"]) * share
        if sides == 2:
            line["th"] = line["th"] + (th - line["th"]) * share if line["sides"] == 2 else th
            line["sides"] = 2
        line["n"] += n
        line["faces"] += own
    return lines


def wall_lines(accepted: DataFrame, o: Options) -> DataFrame:
    """Wall lines of every scene (``LINE``)."""

    def run(rows):
        out = []
        scene = rows["scene_id"].iloc[0]
        for alpha, part in rows.groupby("alpha"):
            for x in pair_faces(part, o):
                f = x["faces"][0]
                iv = shapes.merge([(g["t0"], g["t1"]) for g in x["faces"]], 0.12)
                out.append((scene, len(out), alpha, x["s"], x["th"], x["sides"], int(f["sign"]), f["s"], [{"sign": int(g["sign"]), "s": g["s"]} for g in x["faces"]], [{"t0": a, "t1": b} for a, b in iv]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LINE.replace("array<struct<sign:int,s:double>>", "a").replace("array<struct<t0:double,t1:double>>", "a").split(", ")])

    return accepted.groupBy("scene_id").applyInPandas(run, LINE)


def _points_of(s, t, alpha="alpha"):
    return s * F.cos(alpha) - t * F.sin(alpha), s * F.sin(alpha) + t * F.cos(alpha)


def exterior(lines: DataFrame, seen: DataFrame, grid: DataFrame, o: Options) -> DataFrame:
    """Lines with ``exterior``: a lone face behind which nothing was seen. Their thickness and
    centreline follow."""
    lone = lines.filter("sides_seen = 1").select("scene_id", "line_id", "alpha", "face_sign", "face_s", F.explode("intervals").alias("i"))
    n = F.greatest(F.lit(3), ((F.col("i.t1") - F.col("i.t0")) / 0.15).cast("int") + 1)
    probes = lone.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("off", F.explode(F.array(*[F.lit(0.25 + 0.35 / 3 * i) for i in range(4)])))
    t = F.col("i.t0") + (F.col("i.t1") - F.col("i.t0")) * F.col("k") / (n - 1)
    x, y = _points_of(F.col("face_s") - F.col("face_sign") * F.col("off"), t)
    at = cells.index(probes.withColumns({"x": x, "y": y}), grid, S, clip=False)
    share = join.lookup(at, seen.select("scene_id", "ix", "iy", F.lit(1.0).alias("value")), S).groupBy("scene_id", "line_id").agg(F.avg("value").alias("behind"))
    out = lines.join(share, ["scene_id", "line_id"], "left").withColumn("exterior", (F.col("sides_seen") == 1) & (F.coalesce("behind", F.lit(0.0)) < 0.10)).drop("behind")
    th = F.when(F.col("sides_seen") == 2, F.col("thickness")).when(F.col("exterior"), o.default_exterior_thickness).otherwise(o.default_interior_thickness)
    return out.withColumn("thickness", th).withColumn("s", F.when(F.col("sides_seen") == 1, F.col("face_s") - F.col("face_sign") * F.col("thickness") / 2).otherwise(F.col("s")))


def samples_on(lines: DataFrame, walls: DataFrame, o: Options) -> DataFrame:
    """Unfiltered wall points on the faces of each line: scene_id, line_id, t, z."""
    face = lines.select("scene_id", "line_id", "alpha", F.explode("faces").alias("f")).select("scene_id", "line_id", "alpha", F.col("f.sign").alias("sign"), F.col("f.s").alias("fs"))
    families = lines.select("scene_id", "alpha").distinct()
    dotp = F.col("nx") * F.cos("alpha") + F.col("ny") * F.sin("alpha")
    fam = walls.join(families, S).withColumn("_d", dotp).filter(F.abs("_d") >= math.cos(math.radians(o.angle_tol_deg)))
    fam = fam.select("scene_id", "point_id", "alpha", F.signum("_d").cast("int").alias("sign"), (F.col("x") * F.cos("alpha") + F.col("y") * F.sin("alpha")).alias("ps"), (F.col("y") * F.cos("alpha") - F.col("x") * F.sin("alpha")).alias("t"), "z")
    return join.range_join(fam, face, FACE, F.col("ps"), F.col("fs"), o.s_tol).select("scene_id", "line_id", "point_id", "t", "z").distinct()


# -- openings -------------------------------------------------------------------------------


def refine(edges: DataFrame, samples: DataFrame, ids: list[str], search: float = 0.25, bin_m: float = 0.01, solid: int = 2) -> DataFrame:
    """``edges(scene_id, line_id, ids, a, b, z_lo, z_hi)`` with a and b moved to the first solid
    station on each side of the middle; kept where that leaves under 0.2 m."""
    near = samples.join(edges, ["scene_id", "line_id"]).filter(F.col("z").between(F.col("z_lo"), F.col("z_hi")) & F.col("t").between(F.col("a") - search, F.col("b") + search))
    k = F.floor((F.col("t") - (F.col("a") - search)) / bin_m).cast("long")
    keys = ["scene_id", "line_id", *ids]
    bins = near.groupBy(*keys, "a", "b", k.alias("_bin")).agg(F.count("*").alias("n")).filter(F.col("n") >= solid)
    mid = F.floor(((F.col("a") + F.col("b")) / 2 - (F.col("a") - search)) / bin_m)
    ends = bins.groupBy(*keys).agg(F.max(F.when(F.col("_bin") < mid, F.col("a") - search + (F.col("_bin") + 1) * bin_m)).alias("na"), F.min(F.when(F.col("_bin") > mid, F.col("a") - search + F.col("_bin") * bin_m)).alias("nb"))
    out = edges.join(ends, keys, "left").withColumns({"na": F.coalesce("na", "a"), "nb": F.coalesce("nb", "b")})
    good = F.col("nb") - F.col("na") >= 0.2
    return out.withColumns({"a": F.when(good, F.col("na")).otherwise(F.col("a")), "b": F.when(good, F.col("nb")).otherwise(F.col("b"))}).drop("na", "nb")


OPENING = ["scene_id", "line_id", "kind", "t0", "t1", "z0", "z1", "measured"]


def resolve_gaps(lines: DataFrame, samples: DataFrame, free: DataFrame, grid: DataFrame, scenes: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(intervals, openings). Each gap between neighbouring intervals decides alone: closed when
    short or unseen, a door or passage when one looked through it, else left open."""
    iv = lines.select("scene_id", "line_id", "alpha", "s", F.posexplode("intervals").alias("k", "i")).select("scene_id", "line_id", "alpha", "s", "k", "i.t0", "i.t1")
    w = Window.partitionBy("scene_id", "line_id").orderBy("k")
    gaps = iv.withColumns({"a": F.col("t1"), "b": F.lead("t0").over(w)}).filter("b is not null")
    (ax, ay), (bx, by) = _points_of(F.col("s"), F.col("a")), _points_of(F.col("s"), F.col("b"))
    share = cells.share_along(gaps.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by}), free, grid, S, ["line_id", "k"])
    gaps = gaps.join(share, ["scene_id", "line_id", "k"]).withColumn("gap", F.col("b") - F.col("a"))
    seen = (F.col("gap") >= o.door_min) & (F.col("share") >= o.free_min)
    shut = (F.col("gap") < o.door_min) | (~seen & (F.col("gap") <= o.unseen_merge_max))
    gaps = checkpointed(gaps.withColumns({"seen": seen, "shut": shut, "kind": F.when(F.col("gap") <= o.door_max, "door").otherwise("passage")}))
    doors = gaps.filter("seen")
    over = samples.join(doors.select("scene_id", "line_id", "k", "a", "b"), ["scene_id", "line_id"]).filter(F.col("t").between(F.col("a") + 0.05, F.col("b") - 0.05))
    lintel = aggregate.floor_of_samples(over, ["scene_id", "line_id", "k"], "z", 1.7, 5, o.default_door_height)
    doors = doors.join(lintel, ["scene_id", "line_id", "k"], "left").join(scenes.select("scene_id", "height"), S)
    z1 = F.when((F.col("kind") == "passage") & ~F.coalesce("measured", F.lit(False)), F.col("height")).otherwise(F.coalesce("z1", F.lit(o.default_door_height)))
    doors = doors.withColumns({"z1": F.least(z1, F.col("height")), "measured": F.coalesce("measured", F.lit(False))})
    doors = refine(doors.withColumns({"z_lo": F.lit(0.3), "z_hi": F.greatest(F.lit(0.6), F.col("z1") - 0.2)}).select("scene_id", "line_id", "k", "kind", "a", "b", "z1", "measured", "z_lo", "z_hi"), samples, ["k"])
    doors = checkpointed(doors)
    openings = doors.select("scene_id", "line_id", "kind", F.col("a").alias("t0"), F.col("b").alias("t1"), F.lit(0.0).alias("z0"), "z1", "measured")
    # intervals: joined over shut gaps, cut back to the refined jambs
    after = iv.join(gaps.select("scene_id", "line_id", "k", "shut"), ["scene_id", "line_id", "k"], "left")
    after = after.join(doors.select("scene_id", "line_id", "k", F.col("a").alias("ra"), F.col("b").alias("rb")), ["scene_id", "line_id", "k"], "left")
    after = after.withColumns({"t1": F.coalesce("ra", "t1"), "t0": F.coalesce(F.lag("rb").over(w), F.col("t0")), "new": F.coalesce((~F.lag("shut").over(w)).cast("int"), F.lit(0))})
    after = after.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = after.groupBy("scene_id", "line_id", "part").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return joined.groupBy("scene_id", "line_id").agg(F.array_sort(F.collect_list(F.struct("t0", "t1"))).alias("intervals")), openings


def snap_corners(lines: DataFrame, o: Options) -> DataFrame:
    """Intervals stretched to the walls they run into: L corners and T junctions of each scene, in
    line order (an earlier stretch is seen by later ones)."""

    def run(rows):
        rows = rows.sort_values("line_id").reset_index(drop=True)
        iv = [[[i["t0"], i["t1"]] for i in r] for r in rows["intervals"]]

        def end_near(k, t):
            return next(((n, 0) if a - o.snap_dist <= t < a else (n, 1) for n, (a, b) in enumerate(iv[k]) if a - o.snap_dist <= t < a or b < t <= b + o.snap_dist), None)

        def on(k, t):
            slack = rows["thickness"][k] / 2
            return any(a - slack <= t <= b + slack for a, b in iv[k])

        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                turn = rows["alpha"][j] - rows["alpha"][i]
                den = math.sin(turn)
                if abs(den) < 0.3:
                    continue
                ti = (rows["s"][j] - rows["s"][i] * math.cos(turn)) / den
                tj = -(rows["s"][i] - rows["s"][j] * math.cos(turn)) / den
                ei, ej = end_near(i, ti), end_near(j, tj)
                oi, oj = on(i, ti), on(j, tj)
                if ei and (ej or oj):
                    iv[i][ei[0]][ei[1]] = ti
                if ej and (ei or oi):
                    iv[j][ej[0]][ej[1]] = tj
        return rows.assign(intervals=[[{"t0": a, "t1": b} for a, b in x] for x in iv])

    return lines.groupBy("scene_id").applyInPandas(run, lines.schema)


def windows(lines: DataFrame, samples: DataFrame, scenes: DataFrame, t_bin: float = 0.05, least: float = 0.40) -> DataFrame:
    """Windows: stretches seen below and above a band and not inside it (``OPENING``)."""
    iv = lines.select("scene_id", "line_id", F.posexplode("intervals").alias("k", "i")).select("scene_id", "line_id", "k", F.col("i.t0").alias("i0"), F.col("i.t1").alias("i1"))
    on = samples.join(iv, ["scene_id", "line_id"]).filter(F.col("t").between(F.col("i0"), F.col("i1"))).join(scenes.select("scene_id", F.least(F.lit(1.95), F.col("height") - 0.35).alias("high")), S)
    key = ["scene_id", "line_id", "k"]
    bins = on.groupBy(*key, "i0", "high", F.floor((F.col("t") - F.col("i0")) / t_bin).cast("long").alias("bin")).agg(
        F.bool_or(F.col("z").between(0.12, 0.75)).alias("low"), F.bool_or(F.col("z") >= F.col("high")).alias("top"), F.count_if(F.col("z").between(0.95, 1.80)).alias("mid")
    )
    runs = ordered.islands(bins.filter("low and top and mid <= 1"), [*key, "i0", "high"], "bin", 1.0).withColumns({"a": F.col("i0") + F.col("t0") * t_bin, "b": F.col("i0") + (F.col("t1") + 1) * t_bin}).filter(F.col("b") - F.col("a") >= least - 1e-9)
    runs = checkpointed(runs.select("scene_id", "line_id", "k", "island", "a", "b", "high"))
    inside = samples.join(runs, ["scene_id", "line_id"]).filter(F.col("t").between(F.col("a"), F.col("b")))
    id_ = [*key, "island", "a", "b", "high"]
    low, high = F.when(F.col("z") < 0.95, F.col("z")), F.when(F.col("z") > 1.80, F.col("z"))
    sized = inside.groupBy(*id_).agg(F.coalesce(F.percentile(low, F.lit(0.95)), F.lit(0.75)).alias("z0"), F.coalesce(F.percentile(high, F.lit(0.05)), F.first("high")).alias("z1")).filter("z1 - z0 >= 0.4")
    fine = refine(sized.withColumns({"z_lo": F.col("z0") + 0.1, "z_hi": F.col("z1") - 0.1}).select("scene_id", "line_id", "k", "island", "a", "b", "z0", "z1", "z_lo", "z_hi"), samples, ["k", "island"])
    return fine.select("scene_id", "line_id", F.lit("window").alias("kind"), F.col("a").alias("t0"), F.col("b").alias("t1"), "z0", "z1", F.lit(True).alias("measured"))


# -- rooms ----------------------------------------------------------------------------------

RECT = "scene_id string, stage int, part int, x0 double, y0 double, x1 double, y1 double"


def bodies_of(rows) -> np.ndarray:
    """Boxes of axis-parallel wall pieces (alpha, s, thickness, t0, t1)."""
    out = []
    for alpha, s, th, t0, t1 in rows:
        if abs(math.cos(alpha)) > 0.7:
            out.append((s - th / 2, t0, s + th / 2, t1))
        else:  # direction is -x for a normal along +y
            out.append((-t1, s - th / 2, -t0, s + th / 2))
    return shapes.boxes(out)


def pockets(solids: DataFrame, o: Options) -> DataFrame:
    """Free boxes between wall bodies with doors bricked up: stage 1 as they are, stage 2 with gaps
    of twice ``room_close_r`` bridged. Parts that reach the rim or are too small are out."""

    def run(rows):
        solid = bodies_of(rows[["alpha", "s", "thickness", "t0", "t1"]].itertuples(index=False))
        rim = np.array([solid[:, 0].min() - 0.5, solid[:, 1].min() - 0.5, solid[:, 2].max() + 0.5, solid[:, 3].max() + 0.5])
        out = []
        for stage, r in ((1, 0.0), (2, o.room_close_r)):
            domain = shapes.boxes([rim + np.array([-r, -r, r, r])])
            for part in shapes.parts(shapes.minus(domain, shapes.grow(solid, r))):
                if (part[:, 0] <= domain[0, 0]).any() or (part[:, 1] <= domain[0, 1]).any() or (part[:, 2] >= domain[0, 2]).any() or (part[:, 3] >= domain[0, 3]).any():
                    continue
                whole = shapes.grow(part, r) if r else part
                if shapes.area(whole) >= o.min_room_area:
                    k = 1 + max([x[2] for x in out], default=-1)
                    out += [(rows["scene_id"].iloc[0], stage, k, *map(float, b)) for b in whole]
        return pd.DataFrame(out, columns=["scene_id", "stage", "part", "x0", "y0", "x1", "y1"])

    return solids.groupBy("scene_id").applyInPandas(run, RECT)


def floor_parts(inside: DataFrame, solids: DataFrame, grid: DataFrame, o: Options) -> DataFrame:
    """Stage 3: connected parts of the seen floor between walls, as runs of cells (boxes). Bays up to
    a metre are filled before the walls are taken out, slivers under 0.3 m after."""
    r_close, r_open = round(0.5 / o.cell), max(1, round(0.15 / o.cell))
    body = solids.select("scene_id", "alpha", (F.col("s")).alias("s"), "t0", "t1", "thickness")
    ws = body.join(grid, S)
    half = F.col("thickness") / 2 + F.col("cell")
    upright = F.abs(F.cos("alpha")) > 0.7
    bx0, bx1 = F.when(upright, F.col("s") - half).otherwise(-F.col("t1")), F.when(upright, F.col("s") + half).otherwise(-F.col("t0"))
    by0, by1 = F.when(upright, F.col("t0")).otherwise(F.col("s") - half), F.when(upright, F.col("t1")).otherwise(F.col("s") + half)
    to = lambda v, c0: F.floor((v - F.col(c0)) / F.col("cell")).cast("long")
    wall = ws.select("scene_id", F.explode(F.sequence(to(bx0, "x0"), to(bx1, "x0"))).alias("ix"), to(by0, "y0").alias("j0"), to(by1, "y0").alias("j1")).withColumn("iy", F.explode(F.sequence("j0", "j1"))).select("scene_id", "ix", "iy")
    cand = cells.opening(cells.minus(cells.closing(inside, S, r_close), wall, S), S, r_open)
    comp = checkpointed(cell_components(checkpointed(cand), S))
    size = comp.groupBy("scene_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") * o.cell * o.cell >= o.min_room_area)
    kept = comp.join(size, ["scene_id", "label"])
    runs = ordered.islands(kept, ["scene_id", "label", "ix"], "iy", 1.0)
    rows = runs.join(grid, S)
    x0 = F.col("x0") + F.col("ix") * F.col("cell")
    boxed = rows.select("scene_id", "label", x0.alias("bx0"), (F.col("y0") + F.col("t0") * F.col("cell")).alias("by0"), (x0 + F.col("cell")).alias("bx1"), (F.col("y0") + (F.col("t1") + 1) * F.col("cell")).alias("by1"))
    part = F.dense_rank().over(Window.partitionBy("scene_id").orderBy("label")) + 100_000
    return boxed.select("scene_id", F.lit(3).alias("stage"), part.cast("int").alias("part"), F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"))


ROOM = "scene_id string, id int, name string, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, closed boolean, floor_seen double"


def _boxes_share(rects: DataFrame, raster: DataFrame, grid: DataFrame, ids: list[str]) -> DataFrame:
    """Share of the cells of each part's boxes that are set."""
    on = rects.join(grid.select("scene_id", F.col("x0").alias("g0"), F.col("y0").alias("h0"), "cell", "nx", "ny"), S)
    # a cell belongs to a box when its centre does
    first = lambda v, g: F.ceil((F.col(v) - F.col(g)) / F.col("cell") - 0.5).cast("long")
    on = on.withColumns({"i0": F.greatest(F.lit(0), first("x0", "g0")), "i1": F.least(F.col("nx"), first("x1", "g0")), "j0": F.greatest(F.lit(0), first("y0", "h0")), "j1": F.least(F.col("ny"), first("y1", "h0"))}).filter("i1 > i0 and j1 > j0")
    wide = on.withColumn("ix", F.explode(F.sequence(F.col("i0"), F.col("i1") - 1)))
    area = on.groupBy(*ids).agg(F.sum((F.col("i1") - F.col("i0")) * (F.col("j1") - F.col("j0"))).alias("area"))
    hit = wide.join(raster.select("scene_id", "ix", "iy"), ["scene_id", "ix"]).filter((F.col("iy") >= F.col("j0")) & (F.col("iy") < F.col("j1"))).groupBy(*ids).agg(F.count("*").alias("n"))
    return area.join(hit, ids, "left").select(*ids, (F.coalesce("n", F.lit(0)) / F.col("area")).alias("share"))


def rooms_from_floor(rects: DataFrame, solids: DataFrame, cams: DataFrame, shares: DataFrame, o: Options) -> DataFrame:
    """Rooms of each scene from pockets: closed ones that were looked into; then bridged ones and
    seen floor that are walked or walled and not yet covered. One group a scene: its boxes."""
    walls = solids.filter("wall").groupBy("scene_id").agg(F.collect_list(F.struct("alpha", "s", "thickness", "t0", "t1")).alias("walls"))
    solid = solids.groupBy("scene_id").agg(F.collect_list(F.struct("alpha", "s", "thickness", "t0", "t1")).alias("solid"))
    eyes = cams.groupBy("scene_id").agg(F.collect_list(F.struct(vec.cell(F.col("T"), 0, 3).alias("x"), vec.cell(F.col("T"), 1, 3).alias("y"))).alias("eyes"))
    part = rects.join(shares, ["scene_id", "stage", "part"], "left").groupBy("scene_id").agg(F.collect_list(F.struct("stage", "part", "x0", "y0", "x1", "y1", F.coalesce("share", F.lit(0.0)).alias("share"))).alias("boxes"))
    rows = part.join(walls, S).join(solid, S).join(eyes, S, "left")

    def scene(boxes, walls_, solid_, eyes_):
        key = lambda r: (r["alpha"], r["s"], r["thickness"], r["t0"], r["t1"])
        body, full = bodies_of(map(key, walls_)), bodies_of(map(key, solid_))
        near = full + np.array([-0.15, -0.15, 0.15, 0.15])
        eyes_ = [(e["x"], e["y"]) for e in (eyes_ if eyes_ is not None else [])]
        segs = []
        for w in walls_:
            c, s = math.cos(w["alpha"]), math.sin(w["alpha"])
            segs.append(((w["s"] * c - w["t0"] * s, w["s"] * s + w["t0"] * c), (w["s"] * c - w["t1"] * s, w["s"] * s + w["t1"] * c), w["thickness"]))
        frame = pd.DataFrame(list(boxes))
        found: list[tuple[np.ndarray, bool]] = []
        for (stage, _), rows_ in sorted(frame.groupby(["stage", "part"]), key=lambda g: g[0]):
            region = shapes.union(rows_[["x0", "y0", "x1", "y1"]].to_numpy())
            if stage < 3 and rows_["share"].iloc[0] < o.min_room_inside_frac:
                continue
            if stage > 1:
                if not o.room_fallback:
                    continue
                if stage == 3:
                    ring = shapes.without_jogs(shapes.outline(region)[0], o.room_min_jog)
                    ring = shapes.snapped(ring, segs, o.room_snap_dist)
                    pieces = shapes.parts(shapes.minus(shapes.region_of(ring), body))
                    if not pieces or shapes.area(pieces[0]) < o.min_room_area:
                        continue
                    region = shapes.region_of(shapes.without_jogs(shapes.outline(pieces[0])[0], o.room_min_jog))
                taken = shapes.union(*[r for r, _ in found]) if found else shapes.EMPTY
                if shapes.area(shapes.common(region, taken)) > 0.5 * shapes.area(region):
                    continue
                ring = shapes.outline(region)[0]
                length = cover = 0.0
                for a, b in zip(ring, ring[1:] + ring[:1]):
                    length += math.dist(a, b)
                    cover += sum(y - x for x, y in shapes.along(near, a, b))
                walled = cover / max(length, 1e-9)
                walked = any(shapes.contains(region, *e) for e in eyes_)
                if not ((walked and walled >= 0.2) or walled >= 0.5):
                    continue
            found.append((region, stage == 1))
        return found

    return _rooms(rows, scene, ["boxes", "walls", "solid", "eyes"])


def rooms_from_walls(lines_solid: DataFrame, cams: DataFrame, inside: DataFrame, grid: DataFrame, o: Options) -> DataFrame:
    """Rooms as groups of the rectangles that the wall lines cut: interior by the share of seen cells,
    joined across edges that no wall covers."""
    walls = lines_solid.filter("wall")

    def cut(rows):
        body = bodies_of(rows[["alpha", "s", "thickness", "t0", "t1"]].itertuples(index=False))
        lo, hi = body[:, :2].min(0) - 0.3, body[:, 2:].max(0) + 0.3
        axes = []
        for axis, upright in ((0, True), (1, False)):
            out: list[float] = []
            for v in sorted({float(s) for a, s in zip(rows["alpha"], rows["s"]) if (abs(math.cos(a)) > 0.7) == upright}):
                if lo[axis] < v < hi[axis]:
                    if out and v - out[-1] < 0.20:
                        out[-1] = (out[-1] + v) / 2
                    else:
                        out.append(v)
            axes.append([float(lo[axis]), *out, float(hi[axis])])
        xs, ys = axes
        return pd.DataFrame([(rows["scene_id"].iloc[0], 0, i * 10_000 + j, xs[i], ys[j], xs[i + 1], ys[j + 1]) for i in range(len(xs) - 1) for j in range(len(ys) - 1)], columns=["scene_id", "stage", "part", "x0", "y0", "x1", "y1"])

    rects = checkpointed(walls.groupBy("scene_id").applyInPandas(cut, RECT))
    shares = _boxes_share(rects, inside, grid, ["scene_id", "stage", "part"])
    boxes = rects.join(shares, ["scene_id", "stage", "part"], "left").groupBy("scene_id").agg(F.collect_list(F.struct("part", "x0", "y0", "x1", "y1", F.coalesce("share", F.lit(0.0)).alias("share"))).alias("boxes"))
    body = walls.groupBy("scene_id").agg(F.collect_list(F.struct("alpha", "s", "thickness", "t0", "t1")).alias("walls"))
    eyes = cams.groupBy("scene_id").agg(F.collect_list(F.struct(vec.cell(F.col("T"), 0, 3).alias("x"), vec.cell(F.col("T"), 1, 3).alias("y"))).alias("eyes"))

    def scene(boxes_, walls_, eyes_):
        solid = bodies_of((w["alpha"], w["s"], w["thickness"], w["t0"], w["t1"]) for w in walls_)
        eyes_ = [(e["x"], e["y"]) for e in (eyes_ if eyes_ is not None else [])]
        by = {(b["part"] // 10_000, b["part"] % 10_000): b for b in boxes_}
        nx, ny = 1 + max(k[0] for k in by), 1 + max(k[1] for k in by)
        m = np.zeros((nx, ny), bool)
        wall_x, wall_y = np.zeros((nx - 1, ny), bool), np.zeros((nx, ny - 1), bool)
        for (i, j), b in by.items():
            m[i, j] = b["share"] >= o.room_wall_evidence
            cover = lambda p, q: sum(y - x for x, y in shapes.along(solid, p, q)) >= o.room_wall_blocked * math.dist(p, q)
            if i < nx - 1:
                wall_x[i, j] = cover((b["x1"], b["y0"]), (b["x1"], b["y1"]))
            if j < ny - 1:
                wall_y[i, j] = cover((b["x0"], b["y1"]), (b["x1"], b["y1"]))
        lab = shapes.labels(m, wall_x, wall_y)
        found = []
        for k in range(lab.max() + 1):
            region = shapes.boxes([(by[i, j]["x0"], by[i, j]["y0"], by[i, j]["x1"], by[i, j]["y1"]) for i, j in zip(*np.nonzero(lab == k))])
            if shapes.area(region) < o.min_room_area or (eyes_ and not any(shapes.contains(region + np.array([-0.3, -0.3, 0.3, 0.3]), *e) for e in eyes_)):
                continue
            ring = shapes.outline(region)[0]
            near = solid + np.array([-0.05, -0.05, 0.05, 0.05])
            length = sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1]))
            cover = sum(y - x for a, b in zip(ring, ring[1:] + ring[:1]) for x, y in shapes.along(near, a, b))
            found.append((region, cover > 0.85 * length))
        return found

    return _rooms(boxes.join(body, S).join(eyes, S, "left"), scene, ["boxes", "walls", "eyes"])


def unshare(rooms: list[tuple[np.ndarray, bool]]) -> list[tuple[np.ndarray, bool]]:
    """No floor in two rooms: the smaller keeps it, the larger its biggest remaining part."""
    out = list(rooms)
    order = sorted(range(len(out)), key=lambda i: shapes.area(out[i][0]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if shapes.area(shapes.common(out[i][0], out[j][0])) > 1e-6:
                left = shapes.parts(shapes.minus(out[j][0], out[i][0]))
                if left:
                    out[j] = (left[0], out[j][1])
    return out


def _rooms(rows: DataFrame, scene, columns: list[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for name, *args in b[["scene_id", *columns]].itertuples(index=False):
                found = unshare(sorted(scene(*args), key=lambda r: -shapes.area(r[0])))
                for k, (region, closed) in enumerate(found):
                    rings = [[{"x": x, "y": y} for x, y in r] for r in shapes.outline(shapes.union(region))]
                    out.append((name, k, f"Room {k + 1}", rings[0], rings[1:], bool(closed), None))
            yield pd.DataFrame(out, columns=["scene_id", "id", "name", "polygon", "holes", "closed", "floor_seen"]).astype({"floor_seen": "float64"})

    return rows.select("scene_id", *columns).mapInPandas(run, ROOM)


def clip_rooms(rooms: DataFrame, runs: DataFrame, cams: DataFrame, o: Options, half: float = 0.05) -> DataFrame:
    """Rooms cut along runs that were too low to become walls, ends within reach of each other
    bridged; of the pieces the walked ones stay (else the largest), and a cut that would take a
    whole room is none. Bridges that are not axis-parallel are boxed by their steps."""
    blades = runs.groupBy("scene_id").agg(F.collect_list(F.struct("alpha", "s", "t0", "t1")).alias("runs"))
    held = rooms.groupBy("scene_id").agg(F.collect_list(F.struct("id", "polygon", "holes", "closed")).alias("rooms"))
    eyes = cams.groupBy("scene_id").agg(F.collect_list(F.struct(vec.cell(F.col("T"), 0, 3).alias("x"), vec.cell(F.col("T"), 1, 3).alias("y"))).alias("eyes"))

    def scene(rooms_, runs_, eyes_):
        cutters, ends = [], []
        for k, r in enumerate(runs_ if runs_ is not None else []):
            c, s = math.cos(r["alpha"]), math.sin(r["alpha"])
            a, b = [(r["s"] * c - t * s, r["s"] * s + t * c) for t in (r["t0"], r["t1"])]
            cutters.append((min(a[0], b[0]) - half * abs(c), min(a[1], b[1]) - half * abs(s), max(a[0], b[0]) + half * abs(c), max(a[1], b[1]) + half * abs(s)))
            ends += [(k, a), (k, b)]
        for n, (k, p) in enumerate(ends):
            for m, q in ends[n + 1 :]:
                if k != m and 0 < math.dist(p, q) <= o.room_clip_bridge:
                    steps = max(1, int(math.dist(p, q) / half))
                    for t in range(steps + 1):
                        x, y = (p[i] + (q[i] - p[i]) * t / steps for i in (0, 1))
                        cutters.append((x - half, y - half, x + half, y + half))
        blade = shapes.boxes(cutters)
        eyes_ = [(e["x"], e["y"]) for e in (eyes_ if eyes_ is not None else [])]
        out = []
        for r in sorted(rooms_, key=lambda r: r["id"]):
            whole = shapes.region_of([(p["x"], p["y"]) for p in r["polygon"]], [[(p["x"], p["y"]) for p in h] for h in r["holes"]])
            pieces = [p for p in shapes.parts(shapes.minus(whole, blade)) if shapes.area(p) >= o.min_room_area]
            walked = [p for p in pieces if any(shapes.contains(p + np.array([-0.3, -0.3, 0.3, 0.3]), *e) for e in eyes_)]
            out += [(p, r["closed"]) for p in (walked or (pieces if eyes_ else pieces[:1]) or [whole])]
        return out

    return _rooms(held.join(blades, S, "left").join(eyes, S, "left"), scene, ["rooms", "runs", "eyes"])


# -- the whole ------------------------------------------------------------------------------


def plan(points: DataFrame, cameras: DataFrame, o: Options | None = None) -> dict[str, DataFrame]:
    """Plan tables of every scene: scenes, faces, lines, openings (on lines), rooms, walls,
    wall_openings, extra_walls and the rasters. Scenes with too few wall points are left out and
    listed in ``thin`` (scene_id, wall_points); a job of nothing else raises."""
    from . import assemble

    o = o or Options()
    pts = select.voxel_thin(points, S, o.voxel, seed=o.seed) if o.voxel else points
    if "nx" not in points.columns:
        from ..operators import normals

        pts = pts.join(normals.estimate(pts, S), ["scene_id", "point_id"])
        pts = normals.orient(pts.join(cameras.select("scene_id", "view_id", vec.camera_centre(F.col("T")).alias("c")), ["scene_id", "view_id"]).withColumns({"cx": F.col("c")[0], "cy": F.col("c")[1], "cz": F.col("c")[2]})).drop("c", "cx", "cy", "cz")
    pts = checkpointed(pts)
    aligned, cams, scenes = align(pts, cameras, o)
    aligned = checkpointed(aligned)
    walls, scenes = wall_points(aligned, scenes, o)
    wall_count = aligned.select("scene_id").distinct().join(scenes.select("scene_id", "wall_points"), S, "left").fillna(0, ["wall_points"])
    thin = checkpointed(wall_count.filter(F.col("wall_points") < o.min_peak_points))
    few = [r.scene_id for r in thin.limit(2).collect()]
    if few:
        if not scenes.filter(F.col("wall_points") >= o.min_peak_points).head(1):
            raise ValueError(f"too few wall points in {few[0]}: is the cloud metric and roughly upright?")
        aligned, cams, walls, scenes = (x.join(thin.select("scene_id"), S, "left_anti") for x in (aligned, cams, walls, scenes))
    walls = checkpointed(walls)
    runs = checkpointed(faces(walls, scenes, o))
    grid = checkpointed(cells.grid_of(aligned.select("scene_id", "x", "y"), S, o.cell))
    floor = checkpointed(cells.index(aligned.filter("nz > 0.9 and abs(z) < 0.08").select("scene_id", "x", "y"), grid, S).select("scene_id", "ix", "iy").distinct())
    eye = cams.select("scene_id", "view_id", vec.cell(F.col("T"), 0, 3).alias("cx"), vec.cell(F.col("T"), 1, 3).alias("cy"))
    lit = select.sample_cap(aligned.select("scene_id", "point_id", "x", "y", "view_id"), S, o.max_rays, "point_id", o.seed).join(eye, ["scene_id", "view_id"])
    blocked = cells.runs(runs.filter("not accepted"), grid, S) if o.free_blocked_by_walls else None
    free = checkpointed(cells.rays(lit, grid, S, blocked=blocked))
    inside = checkpointed(cells.union(floor, free, S))
    strict = cells.union(floor, cells.intersection(free, cells.dilate(floor, S, max(1, round(o.free_guard / o.cell))), S), S)
    lines = checkpointed(exterior(wall_lines(runs.filter("accepted"), o), inside, grid, o))
    samples = checkpointed(samples_on(lines, walls, o))
    intervals, openings = resolve_gaps(lines, samples, free, grid, scenes, o)
    lines = lines.drop("intervals").join(intervals, ["scene_id", "line_id"])
    lines = checkpointed(snap_corners(lines, o))
    if o.detect_windows:
        openings = openings.unionByName(windows(lines, samples, scenes))
    openings = checkpointed(openings)
    piece = lines.select("scene_id", "line_id", "alpha", "s", "thickness", F.explode("intervals").alias("i")).select("scene_id", "alpha", "s", "thickness", "i.t0", "i.t1", F.lit(True).alias("wall"))
    bricks = openings.filter("kind <> 'window'").join(lines.select("scene_id", "line_id", "alpha", "s", "thickness"), ["scene_id", "line_id"]).select("scene_id", "alpha", "s", "thickness", "t0", "t1", F.lit(False).alias("wall"))
    solids = checkpointed(piece.unionByName(bricks))
    if o.rooms_from == "walls":
        rooms = rooms_from_walls(solids, cams, inside, grid, o)
    else:
        rects = pockets(solids, o)
        if o.room_fallback:
            rects = rects.unionByName(floor_parts(strict, solids.filter("wall"), grid, o))
        rects = checkpointed(rects)
        shares = _boxes_share(rects.filter("stage < 3"), inside, grid, ["scene_id", "stage", "part"])
        rooms = rooms_from_floor(rects, solids, cams, shares, o)
    if o.rooms_clipped_by_low_walls:
        rooms = clip_rooms(rooms, runs, cams, o)
    rooms = checkpointed(rooms)
    seen = seen_floor(rooms, floor, grid, o)
    rooms = checkpointed(rooms.drop("floor_seen").join(seen, ["scene_id", "id"], "left"))
    out = assemble.assemble(lines, openings, rooms, scenes, free, grid, o)
    return {**out, "thin": thin, "scenes": scenes, "faces": runs, "lines": lines, "line_openings": openings, "grid": grid, "floor": floor, "free": free, "inside": inside, "points": aligned, "cameras": cams}


def seen_floor(rooms: DataFrame, floor: DataFrame, grid: DataFrame, o: Options, reach: float = 0.10) -> DataFrame:
    """Share of each room's cells in a block of ``reach`` that holds any floor point: id, floor_seen."""
    pooled = cells.pool(floor, S, max(1, round(reach / o.cell)))
    return cells.share_in_ring(rooms, pooled, grid, S, ["id"], "polygon").withColumnRenamed("share", "floor_seen")

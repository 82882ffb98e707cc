"""Histograms, coverage counts, robust measures. Sums and counts combine on the map side;
exact percentiles run per small key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import circular_distance, circular_mean, wrap
from .ordered import peak_indices, smooth


def histogram(df: DataFrame, keys: list[str], value: str, width: float, lo: float | None = None, weight: str | None = None) -> DataFrame:
    """Counts (or weights) by bin of a fixed width: keys, bin, n. ``bin`` is floor((v - lo) / width)."""
    b = F.floor((F.col(value) - F.lit(lo or 0.0)) / width).cast("long")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("n"))


def dense(hist: DataFrame, keys: list[str], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A histogram with its empty bins: one row a bin between the first and last of each key."""
    ends = hist.groupBy(*keys).agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    bins = ends.select(*keys, F.explode(F.sequence(first if first is not None else F.col("a"), last if last is not None else F.col("b"))).alias("bin"))
    return bins.join(hist, [*keys, "bin"], "left").fillna(0.0, ["n"])


def smoothed_histogram(df: DataFrame, keys: list[str], value: str, width: float, radius: int = 1, trim: tuple[float, float] | None = None) -> DataFrame:
    """Dense histogram with a triangular smoothing; ``trim`` drops values outside two percentiles."""
    src = df
    if trim:
        ends = df.groupBy(*keys).agg(F.percentile(value, F.lit(trim[0])).alias("_lo"), F.percentile(value, F.lit(trim[1])).alias("_hi"))
        src = df.join(ends, keys).filter(F.col(value).between(F.col("_lo") - width, F.col("_hi") + width)).drop("_lo", "_hi")
    return smooth(dense(histogram(src, keys, value, width), keys), keys, "bin", "n", radius)


def band_coverage(df: DataFrame, cell: list[str], height: str, band: float) -> DataFrame:
    """Distinct height bands hit in each cell: a two-step count distinct, map-side combined twice."""
    return df.select(*cell, F.floor(F.col(height) / band).cast("long").alias("band")).distinct().groupBy(*cell).agg(F.count("*").alias("bands"))


def station_coverage(df: DataFrame, keys: list[str], t: str, z: str, t_bin: float, band: float) -> DataFrame:
    """Distinct bands by station bin of a run: keys, station, bands."""
    binned = df.withColumn("station", F.floor(F.col(t) / t_bin).cast("long"))
    return band_coverage(binned, [*keys, "station"], z, band)


def dominant_direction(df: DataFrame, keys: list[str], nx: str = "nx", ny: str = "ny", weight: str | None = None, bin_deg: float = 1.0, refine_deg: float = 8.0, fewest: int = 10) -> DataFrame:
    """Main wall-normal angle in [0, 90) degrees, as radians: mode of the folded, circularly
    smoothed histogram, then the circular mean of the angles near it. keys, angle."""
    quarter = math.pi / 2
    n = round(90 / bin_deg)
    angled = df.select(*keys, wrap(F.atan2(F.col(ny), F.col(nx)), quarter).alias("ang"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    bins = angled.groupBy(*keys, F.least(F.floor(F.col("ang") / (quarter / n)), F.lit(n - 1)).cast("long").alias("bin")).agg(F.sum("w").alias("n"))
    # each bin adds to itself and three neighbours on either side, around the circle
    spread = bins.select(*keys, "bin", "n", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("d"))
    circle = spread.groupBy(*keys, F.pmod(F.col("bin") + F.col("d"), F.lit(n)).alias("bin")).agg(F.sum(F.col("n") * (4 - F.abs("d"))).alias("s"))
    mode = circle.groupBy(*keys).agg(F.max_by("bin", F.struct("s", -F.col("bin"))).alias("bin")).withColumn("a", (F.col("bin") + 0.5) * (quarter / n)).drop("bin")
    near = angled.join(mode, keys) if keys else angled.crossJoin(F.broadcast(mode))
    near = near.withColumn("d", circular_distance(F.col("ang"), F.col("a"), quarter)).filter(F.col("d") <= math.radians(refine_deg))
    mean = near.groupBy(*keys, "a").agg(circular_mean(F.col("ang"), quarter, F.col("w")).alias("m"), F.count("*").alias("c"))
    return mean.select(*keys, F.when(F.col("c") >= fewest, F.col("m")).otherwise(F.col("a")).alias("angle"))


def direction_families(angles, bin_deg: float = 2.0, min_frac: float = 0.06, merge_deg: float = 12.0) -> list[float]:
    """Normal angles (modulo 180 degrees) of the wall families of one scene, strongest first."""
    import numpy as np

    ang = np.mod(np.asarray(angles, float), np.pi)
    n = round(180 / bin_deg)
    hist = np.histogram(ang, bins=n, range=(0, np.pi))[0].astype(float)
    kernel = np.array([1, 2, 3, 2, 1]) / 9
    sm = sum(k * np.roll(hist, i - 2) for i, k in enumerate(kernel))
    out: list[float] = []
    apart = math.radians(merge_deg)
    circ = lambda a, b: abs((a - b + np.pi / 2) % np.pi - np.pi / 2)
    for p in peak_indices(sm, min_frac * sm.max(), int(merge_deg / bin_deg)):
        a = (p + 0.5) * np.pi / n
        near = ang[circ(ang, a) <= apart / 2]
        if len(near):
            a = float(np.mod(np.arctan2(np.sin(2 * near).sum(), np.cos(2 * near).sum()) / 2, np.pi))
        if all(circ(a, b) > apart for b in out):
            out.append(a)
    return out or [0.0, math.pi / 2]


def cone_mean_normal(df: DataFrame, keys: list[str], hint: Column, cones: tuple = (30.0, 15.0, 8.0), fewest: int = 50) -> DataFrame:
    """Mean normal within narrowing cones about a hint, opposite normals flipped: keys, ux, uy, uz.
    One pass of sums a cone; a cone with too few normals ends the refinement."""
    up = df.select(*keys, hint.getItem(0).alias("ux"), hint.getItem(1).alias("uy"), hint.getItem(2).alias("uz")).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("ux", "uy", "uz")]).withColumn("_open", F.lit(True))
    for cone in cones:
        joined = df.select(*keys, "nx", "ny", "nz").join(up, keys)
        d = F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz")
        inside = F.when((F.abs(d) >= math.cos(math.radians(cone))) & F.col("_open"), F.signum(d))
        sums = joined.groupBy(*keys, "ux", "uy", "uz", "_open").agg(F.count(inside).alias("c"), *[F.sum(inside * F.col(n)).alias(n) for n in ("nx", "ny", "nz")])
        length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
        good = F.col("_open") & (F.col("c") >= fewest)
        up = sums.select(*keys, *[F.when(good, F.col(n) / length).otherwise(F.col(u)).alias(u) for n, u in (("nx", "ux"), ("ny", "uy"), ("nz", "uz"))], good.alias("_open"))
    return up.drop("_open")


def spearman(df: DataFrame, keys: list[str], a: str, b: str, ties: list[str]) -> DataFrame:
    """Rank correlation by position (ties broken by ``ties``); null below three rows."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, *ties)).cast("double")
    ranked = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, rank(a).alias("ra"), rank(b).alias("rb"))
    return ranked.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.corr("ra", "rb")).alias("rho"), F.count("*").alias("n"))


def floor_of_samples(df: DataFrame, keys: list[str], z: str, at_least: float, fewest: int, default: float, percentile: float = 0.05) -> DataFrame:
    """A measured height where enough samples are high enough, else the default: keys, z1, measured."""
    high = F.when(F.col(z) >= at_least, F.col(z))
    return df.groupBy(*keys).agg(F.count(high).alias("n"), F.percentile(high, F.lit(percentile)).alias("p")).select(*keys, F.when(F.col("n") >= fewest, F.col("p")).otherwise(default).alias("z1"), (F.col("n") >= fewest).alias("measured"))


def sill_and_head(df: DataFrame, keys: list[str], z: str, mid: tuple[float, float], sill: float, head: float, least: float = 0.4) -> DataFrame:
    """Window sill (p95 of what lies below the middle) and head (p5 above): keys, z0, z1."""
    low, high = F.when(F.col(z) < mid[0], F.col(z)), F.when(F.col(z) > mid[1], F.col(z))
    out = df.groupBy(*keys).agg(F.coalesce(F.percentile(low, F.lit(0.95)), F.lit(sill)).alias("z0"), F.coalesce(F.percentile(high, F.lit(0.05)), F.lit(head)).alias("z1"))
    return out.filter(F.col("z1") - F.col("z0") >= least)


def median_factor(df: DataFrame, keys: list[str], width: str, true_width: float = 0.9) -> DataFrame:
    """Scale that brings the median width to a known one: keys, factor (1 without a width)."""
    return df.groupBy(*keys).agg(F.coalesce(F.lit(true_width) / F.median(width), F.lit(1.0)).alias("factor"))


def median_disagreement(df: DataFrame, keys: list[str], residual: Column, scale: Column) -> DataFrame:
    """Median relative residual; infinite where nothing is compared."""
    return df.groupBy(*keys).agg(F.coalesce(F.median(F.abs(residual / scale)), F.lit(math.inf)).alias("disagreement"))


def sharpness(pixels: DataFrame, keys: list[str], row: str = "v", column: str = "u", grey: str = "grey") -> DataFrame:
    """Variance of the Laplacian of pictures given as pixel rows: keys, sharpness. Borders mirror
    the pixel next to the edge."""
    across, down = Window.partitionBy(*keys, row).orderBy(column), Window.partitionBy(*keys, column).orderBy(row)
    g = F.col(grey).cast("double")
    both = lambda w: F.coalesce(F.lag(g).over(w), F.lead(g).over(w)) + F.coalesce(F.lead(g).over(w), F.lag(g).over(w))
    return pixels.withColumn("_l", both(across) + both(down) - 4 * g).groupBy(*keys).agg(F.var_pop("_l").alias("sharpness"))


def flatness(pixels: DataFrame, keys: list[str], grey: str = "grey", span: int = 9) -> DataFrame:
    """Largest share of pixels in any ``span`` neighbouring grey levels: keys, flatness."""
    levels = pixels.groupBy(*keys, F.col(grey).cast("int").alias("level")).agg(F.count("*").alias("n"))
    # every level adds to the windows that contain it: at most 256 x span small rows a picture
    windows = levels.select(*keys, "n", F.explode(F.sequence(F.greatest(F.col("level") - (span - 1), F.lit(0)), F.col("level"))).alias("from")).groupBy(*keys, "from").agg(F.sum("n").alias("n"))
    whole = levels.groupBy(*keys).agg(F.sum("n").alias("all"))
    return windows.groupBy(*keys).agg(F.max("n").alias("n")).join(whole, keys).select(*keys, (F.col("n") / F.col("all")).alias("flatness"))


def video_profile(probes: DataFrame, keys: list[str], index: str, window: int, min_sharpness: float = 20.0, flat_max: float = 0.6) -> DataFrame:
    """Report of a clip's probes (index, sharpness, flatness): usable, blurry and flat windows,
    median and tenth percentile of the sharpness outside flat frames."""
    flat = F.col("flatness") > flat_max
    score = F.when(flat, 0.0).otherwise(F.col("sharpness"))
    windows = probes.withColumns({"_flat": flat, "_s": score}).groupBy(*keys, F.floor(F.col(index) / window).alias("_w")).agg(F.max("_s").alias("best"), F.bool_and("_flat").alias("flat"))
    verdict = windows.groupBy(*keys).agg(
        F.count_if(F.col("best") >= min_sharpness).alias("usable_frames"), F.count_if(F.col("flat")).alias("flat_windows"), F.count("*").alias("_n")
    ).withColumn("blurry_windows", F.col("_n") - F.col("usable_frames") - F.col("flat_windows")).drop("_n")
    room = F.when(~flat, F.col("sharpness"))
    scores = probes.groupBy(*keys).agg(F.coalesce(F.median(room), F.lit(0.0)).alias("sharpness_median"), F.coalesce(F.percentile(room, F.lit(0.1)), F.lit(0.0)).alias("sharpness_p10"))
    return verdict.join(scores, keys)


def video_warnings(profile: DataFrame, fps: float) -> DataFrame:
    """``warnings array<string>`` from duration_s, width, height and the columns of ``video_profile``."""
    notes = [
        F.when(F.col("duration_s") < 20, "too_short"),
        F.when(F.least("width", "height") < 700, "low_resolution"),
        F.when(F.col("sharpness_median") < 40, "mostly_blurry"),
        F.when(F.col("flat_windows") > 0, F.concat(F.lit("blank_seconds="), F.bround(F.col("flat_windows") / fps).cast("int").cast("string"))),
        F.when(F.col("usable_frames") < 12, F.concat(F.lit("few_usable="), F.col("usable_frames").cast("string"))),
    ]
    return profile.withColumn("warnings", F.filter(F.array(*notes), lambda x: x.isNotNull()))

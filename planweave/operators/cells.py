"""Sparse rasters: a grid is ``(x0, y0, cell, nx, ny)`` a scene and a raster is its set cells
``(keys, ix, iy)``; an absent row is false or 0. Set operations are joins on (keys, ix, iy),
morphology is separable, and everything shards by cell, so a scene may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_of(points: DataFrame, keys: list[str], cell: float, margin: float = 0.5) -> DataFrame:
    """Extent of the points with a margin: one row a scene, from minimums and maximums."""
    ends = points.groupBy(*keys).agg(*[f(c).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.min, "y", "y0"), (F.max, "x", "x1"), (F.max, "y", "y1"))])
    side = lambda a, b: (F.ceil((F.col(b) - F.col(a) + 2 * margin) / cell) + 1).cast("long")
    return ends.select(*keys, (F.col("x0") - margin).alias("x0"), (F.col("y0") - margin).alias("y0"), F.lit(float(cell)).alias("cell"), side("x0", "x1").alias("nx"), side("y0", "y1").alias("ny"))


def index(points: DataFrame, grid: DataFrame, keys: list[str], clip: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the cell they are in; outside ones are clipped to the rim or dropped."""
    named = grid.select(*keys, *[F.col(c).alias(f"_g_{c}") for c in ("x0", "y0", "cell", "nx", "ny")])  # points may have normals nx, ny
    joined = points.join(named, keys) if keys else points.crossJoin(F.broadcast(named))
    g = lambda c: F.col(f"_g_{c}")
    ix, iy = F.floor((F.col(x) - g("x0")) / g("cell")).cast("long"), F.floor((F.col(y) - g("y0")) / g("cell")).cast("long")
    if clip:
        ix, iy = F.greatest(F.lit(0), F.least(ix, g("nx") - 1)), F.greatest(F.lit(0), F.least(iy, g("ny") - 1))
        return joined.withColumns({"ix": ix, "iy": iy}).drop(*[f"_g_{c}" for c in ("x0", "y0", "cell", "nx", "ny")])
    inside = (ix >= 0) & (ix < g("nx")) & (iy >= 0) & (iy < g("ny"))
    return joined.filter(inside).withColumns({"ix": ix, "iy": iy}).drop(*[f"_g_{c}" for c in ("x0", "y0", "cell", "nx", "ny")])


def centre(ix: Column, iy: Column) -> Column:
    """Centre of a cell, next to its grid's columns."""
    return F.struct((F.col("x0") + (ix + 0.5) * F.col("cell")).alias("x"), (F.col("y0") + (iy + 0.5) * F.col("cell")).alias("y"))


def counts(indexed: DataFrame, keys: list[str]) -> DataFrame:
    return indexed.groupBy(*keys, "ix", "iy").agg(F.count("*").alias("value"))


def coverage(indexed: DataFrame, keys: list[str], z: str, band: float, z_max: Column | float) -> DataFrame:
    """Distinct height bands in each cell, the last band taking what is above."""
    top = F.greatest(F.lit(0), F.ceil((z_max if isinstance(z_max, Column) else F.lit(float(z_max))) / band) - 1)
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(z) / band), top)).cast("long")
    return indexed.select(*keys, "ix", "iy", b.alias("_b")).distinct().groupBy(*keys, "ix", "iy").agg(F.count("*").alias("value"))


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "ix", "iy").unionByName(b.select(*keys, "ix", "iy")).distinct()


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "ix", "iy").join(b.select(*keys, "ix", "iy").distinct(), [*keys, "ix", "iy"], "left_semi")


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "ix", "iy").join(b.select(*keys, "ix", "iy").distinct(), [*keys, "ix", "iy"], "left_anti")


def iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Common over covered cells: keys, inter, total, iou."""
    tagged = a.select(*keys, "ix", "iy", F.lit(1).alias("s")).unionByName(b.select(*keys, "ix", "iy", F.lit(2).alias("s")))
    cells = tagged.groupBy(*keys, "ix", "iy").agg(F.bit_or("s").alias("s"))
    return cells.groupBy(*keys).agg(F.count_if(F.col("s") == 3).alias("inter"), F.count("*").alias("total")).withColumn("iou", F.col("inter") / F.col("total"))


def _runs(cells: DataFrame, keys: list[str], axis: str, gap: int) -> DataFrame:
    """First and last cell of every run along an axis, gaps up to ``gap`` cells closed."""
    other = "iy" if axis == "ix" else "ix"
    w = Window.partitionBy(*keys, other).orderBy(axis)
    new = F.coalesce((F.col(axis) - F.lag(axis).over(w) > gap).cast("int"), F.lit(0))
    marked = cells.select(*keys, "ix", "iy").withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, other, "_run").agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))


def dilate(cells: DataFrame, keys: list[str], r: int) -> DataFrame:
    """Dilation by a square of radius ``r``, along x and then along y. Runs whose grown ends would
    meet are joined first, so every cell of the result is made once whatever the radius."""
    out = cells
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        runs = _runs(out, keys, axis, 2 * r + 1)
        out = runs.select(*keys, other, F.explode(F.sequence(F.col("_a") - r, F.col("_b") + r)).alias(axis))
    return out.select(*keys, "ix", "iy")


def erode(cells: DataFrame, keys: list[str], r: int) -> DataFrame:
    """Cells whose whole square of radius ``r`` is set: runs shortened along x, then along y."""
    out = cells
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        runs = _runs(out, keys, axis, 1).filter(F.col("_b") - F.col("_a") >= 2 * r)
        out = runs.select(*keys, other, F.explode(F.sequence(F.col("_a") + r, F.col("_b") - r)).alias(axis))
    return out.select(*keys, "ix", "iy")


def closing(cells: DataFrame, keys: list[str], r: int) -> DataFrame:
    return erode(dilate(cells, keys, r), keys, r)


def opening(cells: DataFrame, keys: list[str], r: int) -> DataFrame:
    return dilate(erode(cells, keys, r), keys, r)


def pool(cells: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Blocks of factor x factor cells of which any is set, spread back over their cells."""
    blocks = cells.select(*keys, F.floor(F.col("ix") / factor).alias("_bx"), F.floor(F.col("iy") / factor).alias("_by")).distinct()
    span = F.sequence(F.lit(0), F.lit(factor - 1))
    return blocks.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span)).select(*keys, (F.col("_bx") * factor + F.col("_i")).cast("long").alias("ix"), (F.col("_by") * factor + F.col("_j")).cast("long").alias("iy"))


def rays(points: DataFrame, grid: DataFrame, keys: list[str], stop_short: float = 0.06, blocked: DataFrame | None = None, ray: str = "point_id") -> DataFrame:
    """Cells that sight lines cross from (cx, cy) to (x, y), the last ``stop_short`` metres left
    out. Every ray is stepped along its whole own length. With ``blocked`` cells a ray ends
    before the first of them."""
    src = points.join(grid, keys) if keys else points.crossJoin(F.broadcast(grid))
    length = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    src = src.withColumn("_len", length).filter(F.col("_len") > stop_short + F.col("cell"))
    n = (F.ceil((F.col("_len") - stop_short) / (F.col("cell") * 0.7)) + 1).cast("int")
    src = src.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    frac = F.col("_k") / F.greatest(F.col("_n") - 1, F.lit(1)) * ((F.col("_len") - stop_short) / F.col("_len"))
    px, py = F.col("cx") + (F.col("x") - F.col("cx")) * frac, F.col("cy") + (F.col("y") - F.col("cy")) * frac
    cells = src.select(*keys, ray, "_k", "nx", "ny", F.floor((px - F.col("x0")) / F.col("cell")).cast("long").alias("ix"), F.floor((py - F.col("y0")) / F.col("cell")).cast("long").alias("iy")).filter("ix >= 0 and ix < nx and iy >= 0 and iy < ny")
    if blocked is None:
        return cells.select(*keys, "ix", "iy").distinct()
    marked = cells.join(blocked.select(*keys, "ix", "iy", F.lit(1).alias("_occ")).distinct(), [*keys, "ix", "iy"], "left")
    along = Window.partitionBy(*keys, ray).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_seen", F.sum(F.coalesce("_occ", F.lit(0))).over(along)).filter("_seen = 0").select(*keys, "ix", "iy").distinct()


def runs(segments: DataFrame, grid: DataFrame, keys: list[str], half_width: float = 0.06) -> DataFrame:
    """Cells under fitted runs (alpha, s, t0, t1), ``half_width`` to either side."""
    src = segments.join(grid, keys) if keys else segments.crossJoin(F.broadcast(grid))
    n = F.greatest(F.lit(2), (F.ceil((F.col("t1") - F.col("t0")) / (F.col("cell") * 0.7)) + 1).cast("int"))
    m = (F.floor(2 * half_width / F.col("cell")) + 1).cast("int")
    src = src.withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), m)))
    t = F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("_k") / (n - 1)
    s = F.col("s") - half_width + F.col("_j") * F.col("cell")
    x, y = s * F.cos("alpha") - t * F.sin("alpha"), s * F.sin("alpha") + t * F.cos("alpha")
    return src.select(*keys, "nx", "ny", F.floor((x - F.col("x0")) / F.col("cell")).cast("long").alias("ix"), F.floor((y - F.col("y0")) / F.col("cell")).cast("long").alias("iy")).filter("ix >= 0 and ix < nx and iy >= 0 and iy < ny").select(*keys, "ix", "iy").distinct()


def share_along(segments: DataFrame, cells: DataFrame, grid: DataFrame, keys: list[str], ids: list[str], n: int = 12, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Share of ``n`` samples of a segment (ax, ay, bx, by) that lie on set cells; samples off the
    grid don't count, none on it gives 0: keys, ids, share."""
    src = segments.select(*keys, *ids, "ax", "ay", "bx", "by").join(grid, keys)
    f = lo + (hi - lo) * F.col("_k") / max(1, n - 1)
    src = src.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ix = F.floor((F.col("ax") + (F.col("bx") - F.col("ax")) * f - F.col("x0")) / F.col("cell")).cast("long")
    iy = F.floor((F.col("ay") + (F.col("by") - F.col("ay")) * f - F.col("y0")) / F.col("cell")).cast("long")
    hit = src.withColumns({"ix": ix, "iy": iy}).join(cells.select(*keys, "ix", "iy", F.lit(1.0).alias("_v")).distinct(), [*keys, "ix", "iy"], "left")
    on = (F.col("ix") >= 0) & (F.col("ix") < F.col("nx")) & (F.col("iy") >= 0) & (F.col("iy") < F.col("ny"))
    return hit.groupBy(*keys, *ids).agg(F.coalesce(F.avg(F.when(on, F.coalesce("_v", F.lit(0.0)))), F.lit(0.0)).alias("share"))


def share_in_ring(rings: DataFrame, cells: DataFrame, grid: DataFrame, keys: list[str], ids: list[str], ring: str) -> DataFrame:
    """Share of the cells whose centre a polygon contains that are set: keys, ids, share."""
    from ..functions.rings import bounds, contains

    src = rings.select(*keys, *ids, ring).join(grid, keys).withColumn("_b", bounds(F.col(ring)))
    lo = lambda v, o: F.greatest(F.lit(0), F.floor((F.col(v) - F.col(o)) / F.col("cell"))).cast("long")
    src = src.withColumn("ix", F.explode(F.sequence(lo("_b.x0", "x0"), F.least(lo("_b.x1", "x0"), F.col("nx") - 1)))).withColumn("iy", F.explode(F.sequence(lo("_b.y0", "y0"), F.least(lo("_b.y1", "y0"), F.col("ny") - 1))))
    inside = src.filter(contains(F.col(ring), F.col("x0") + (F.col("ix") + 0.5) * F.col("cell"), F.col("y0") + (F.col("iy") + 0.5) * F.col("cell"))).select(*keys, *ids, "ix", "iy")
    hit = inside.join(cells.select(*keys, "ix", "iy", F.lit(1.0).alias("_v")).distinct(), [*keys, "ix", "iy"], "left")
    share = hit.groupBy(*keys, *ids).agg(F.avg(F.coalesce("_v", F.lit(0.0))).alias("share"))
    return rings.select(*keys, *ids).join(share, [*keys, *ids], "left").fillna(0.0, ["share"])


def share_in_box(boxes: DataFrame, cells: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Share of set cells in index boxes (i0, j0, i1, j1; upper ends open), the box side being the
    key of an interval join on whole cells: keys, ids, share."""
    wide = boxes.withColumn("ix", F.explode_outer(F.when(F.col("i1") > F.col("i0"), F.sequence(F.col("i0"), F.col("i1") - 1))))
    hit = wide.join(cells.select(*keys, "ix", "iy").distinct(), [*keys, "ix"], "left")
    inside = F.count_if((F.col("iy") >= F.col("j0")) & (F.col("iy") < F.col("j1")))
    area = F.greatest(F.lit(0), (F.col("i1") - F.col("i0")) * (F.col("j1") - F.col("j0")))
    return hit.groupBy(*keys, *ids, "i0", "j0", "i1", "j1").agg(inside.alias("_n")).select(*keys, *ids, F.when(area > 0, F.col("_n") / area).otherwise(0.0).alias("share"))


def boundary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Unit edges between a set and an unset cell: keys, ix, iy, side (E, W, N, S)."""
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in (("E", 1, 0), ("W", -1, 0), ("N", 0, 1), ("S", 0, -1))])
    wide = cells.select(*keys, "ix", "iy", F.explode(sides).alias("e"))
    there = cells.select(*keys, F.col("ix").alias("_x"), F.col("iy").alias("_y"))
    return wide.withColumns({"_x": F.col("ix") + F.col("e.dx"), "_y": F.col("iy") + F.col("e.dy")}).join(there, [*keys, "_x", "_y"], "left_anti").select(*keys, "ix", "iy", "e.side")


def give_to_smaller(cells: DataFrame, keys: list[str], owner: str, size: str) -> DataFrame:
    """Cells claimed by several owners stay with the smallest of them."""
    w = Window.partitionBy(*keys, "ix", "iy").orderBy(size, owner)
    return cells.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

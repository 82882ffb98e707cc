"""Joins that Spark does not have as such: nearest as-of with tolerance, bucketed range join,
spatial joins over grids of several sizes. Each turns into an equi-join on (keys, bucket), which hash
or sort-merge join and AQE's skew handling can carry; no theta join is left to a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, tolerance: float, columns: list[str], ties: list[str] | None = None) -> DataFrame:
    """Each left row with the right row nearest in time, the earlier of two equally near; columns
    are null beyond ``tolerance``. One shuffle on the keys and stretches of time as long as the
    tolerance, so one key's history never meets in one task: both sides are unioned, right rows in
    the stretches next to theirs too, and a forward and a backward window carry neighbours along."""
    reach = max(float(tolerance), 1e-9)
    left = left.withColumn("_k_", F.floor(F.col(left_t).cast("double") / reach))
    right = right.withColumn("_k_", F.explode(F.array(*[F.floor(F.col(right_t).cast("double") / reach) + d for d in (-1, 0, 1)])))
    keys = [*keys, "_k_"]
    payload = F.struct(F.col(right_t).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_t).cast("double").alias("_t"), payload.alias("_r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties or [])])
    lf = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_t).cast("double").alias("_t"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_tie{i}") for i, c in enumerate(ties or [])])
    both = r.unionByName(lf)
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_t", F.col("_l").isNotNull(), *[f"_tie{i}" for i in range(len(ties or []))])
    back = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumns({"_b": back, "_a": ahead}).filter("_l is not null")
    db, da = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    pick = F.when(F.col("_a").isNull() | (db <= da), F.col("_b")).otherwise(F.col("_a"))
    chosen = seen.withColumn("_p", F.coalesce(pick, F.col("_a"), F.col("_b"))).withColumn("_p", F.when(F.abs(F.col("_p.t") - F.col("_t")) <= tolerance, F.col("_p")))
    return chosen.select("_l.*", F.col("_p.t").alias(f"{right_t}_nearest"), *[F.col(f"_p.c{i}").alias(c) for i, c in enumerate(columns)]).drop("_k_")


def offset_search(left: DataFrame, right: DataFrame, keys: list[str], t: str, offsets: list[float], tolerance: float, columns: list[str]) -> DataFrame:
    """``nearest`` at every clock offset (a short literal list exploded onto the left): adds offset."""
    shifted = left.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn("_shifted", F.col(t) + F.col("offset"))
    return nearest(shifted.withColumnRenamed("offset", "clock_offset"), right.withColumn("clock_offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))), [*keys, "clock_offset"], "_shifted", t, tolerance, columns).drop("_shifted")


def dealt(left: DataFrame, right: DataFrame, on: list[str], tasks: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out to so many tasks by what they are joined on (None: as Spark sees fit). Spark judges by
    the size of the sides, which says nothing of a join that makes thousands of pairs of each row: from
    two small files all come out of one task."""
    if tasks is None:
        return left, right
    return left.repartition(tasks, *on), right.repartition(tasks, *on).hint("merge")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], a: Column, b: Column, reach: float, condition: Column | None = None, deal: int | None = None) -> DataFrame:
    """Rows of both sides with equal keys whose ``a`` (left) and ``b`` (right) differ by at most
    ``reach``. Left rows fall in one bucket as wide as the reach, right rows in three. ``deal``: see ``dealt``."""
    lf = left.withColumn("_bucket", F.floor(a / reach).cast("long")).withColumn("_a", a)
    rt = right.withColumn("_b", b).withColumn("_bucket", F.explode(F.array(*[(F.floor(b / reach) + d).cast("long") for d in (-1, 0, 1)])))
    lf, rt = dealt(lf, rt, [*keys, "_bucket"], deal)
    joined = lf.join(rt, [*keys, "_bucket"]).filter(F.abs(F.col("_a") - F.col("_b")) <= reach).drop("_bucket", "_a", "_b")
    return joined if condition is None else joined.filter(condition)


def _levels(*sizes: DataFrame) -> list[int]:
    """Distinct levels of objects' sizes: a power of two of the smallest tile each, so there are few."""
    every = sizes[0]
    for more in sizes[1:]:
        every = every.unionByName(more)
    return sorted(r[0] for r in every.select("_level").distinct().collect() if r[0] is not None)


def _level(size: Column, tile: float) -> Column:
    """Level of the first tile, of twice the size each, that is no smaller than ``size``."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(tile)) / tile))).cast("int")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], t: Column, lo: Column, hi: Column, bucket: float) -> DataFrame:
    """Left points inside right intervals. An interval goes to the one or two buckets it covers of
    those that are as long as it is, a power of two of ``bucket``; a point asks once for every length
    there is. Empty and unbounded intervals (``hi`` below ``lo``, infinite ends) are judged as written."""
    ends = right.withColumns({"_lo": lo.cast("double"), "_hi": hi.cast("double")}).filter("_lo <= _hi")
    whole = (F.col("_lo") > float("-inf")) & (F.col("_hi") < float("inf"))
    sized = ends.withColumn("_level", F.when(whole, _level(F.col("_hi") - F.col("_lo"), bucket)).otherwise(-1))
    levels = _levels(sized)
    wide = F.when(F.col("_level") < 0, F.lit(float("inf"))).otherwise(bucket * F.pow(F.lit(2.0), F.col("_level")))
    lf = left.withColumn("_t", t.cast("double")).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    lf = lf.withColumn("_bucket", F.when(F.col("_level") < 0, F.lit(0)).otherwise(F.floor(F.col("_t") / wide)).cast("long"))
    rt = sized.withColumn("_bucket", F.explode(F.when(F.col("_level") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col("_lo") / wide).cast("long"), F.floor(F.col("_hi") / wide).cast("long")))))
    return lf.join(rt, [*keys, "_level", "_bucket"]).filter((F.col("_t") >= F.col("_lo")) & (F.col("_t") <= F.col("_hi"))).drop("_t", "_lo", "_hi", "_level", "_bucket")


def box_join(left: DataFrame, right: DataFrame, keys: list[str], left_box: Column, right_box: Column, tile: float, condition: Column | None = None, deal: int | None = None) -> DataFrame:
    """Pairs whose boxes (``struct<x0,y0,x1,y1>``) touch. A box lives on a grid whose tiles are as large
    as it is, a power of two of ``tile``, where it covers four at most, and also shows itself on every
    coarser grid that is in use; a pair meets on the coarser of its two grids, in the tile of the
    corner where their common part begins, so it comes out once without a distinct. ``deal``: see ``dealt``."""
    def sized(df, box, name):
        side = F.greatest(F.col(f"{name}.x1") - F.col(f"{name}.x0"), F.col(f"{name}.y1") - F.col(f"{name}.y0"))
        return df.withColumn(name, box).withColumn("_level", _level(side, tile)).filter(F.col("_level").isNotNull())

    lf, rt = sized(left, left_box, "_lb"), sized(right, right_box, "_rb")
    levels = F.array(*[F.lit(v) for v in _levels(lf.select("_level"), rt.select("_level"))]).cast("array<int>")
    wide = tile * F.pow(F.lit(2.0), F.col("_grid"))

    def tiles(df, name):
        span = lambda lo, hi: F.sequence(F.floor(lo / wide).cast("long"), F.floor(hi / wide).cast("long"))
        shown = df.withColumn("_grid", F.explode(F.filter(levels, lambda g: g >= F.col("_level")))).withColumn(f"{name}own", F.col("_grid") == F.col("_level")).drop("_level")
        return shown.withColumn("_tx", F.explode(span(F.col(f"{name}.x0"), F.col(f"{name}.x1")))).withColumn("_ty", F.explode(span(F.col(f"{name}.y0"), F.col(f"{name}.y1"))))

    on = [*keys, "_grid", "_tx", "_ty"]
    lt, rt = dealt(tiles(lf, "_lb"), tiles(rt, "_rb"), on, deal)
    joined = lt.join(rt, on).filter(F.col("_lbown") | F.col("_rbown"))
    x, y = F.greatest("_lb.x0", "_rb.x0"), F.greatest("_lb.y0", "_rb.y0")
    meets = (x <= F.least("_lb.x1", "_rb.x1")) & (y <= F.least("_lb.y1", "_rb.y1"))
    owner = (F.floor(x / wide) == F.col("_tx")) & (F.floor(y / wide) == F.col("_ty"))
    out = joined.filter(meets & owner).drop("_grid", "_tx", "_ty", "_lb", "_rb", "_lbown", "_rbown")
    return out if condition is None else out.filter(condition)


def anti_near(df: DataFrame, keys: list[str], order: str, reach: float, better: str, id_: str) -> DataFrame:
    """Rows that have no better row of the same keys within ``reach``: a range join and an anti-join."""
    lf = df.select(*keys, F.col(id_).alias("_id"), F.col(order).cast("double").alias("_x"), F.col(better).alias("_q"))
    rt = df.select(*keys, F.col(id_).alias("_id2"), F.col(order).cast("double").alias("_x2"), F.col(better).alias("_q2"))
    beaten = range_join(lf, rt, keys, F.col("_x"), F.col("_x2"), reach, (F.col("_id") != F.col("_id2")) & ((F.col("_q2") > F.col("_q")) | ((F.col("_q2") == F.col("_q")) & (F.col("_id2") < F.col("_id")))))
    return df.join(beaten.select(F.col("_id").alias(id_)).distinct(), id_, "left_anti")


def lookup(points: DataFrame, cells: DataFrame, keys: list[str], ix: str = "ix", iy: str = "iy", value: str = "value", default: float = 0.0) -> DataFrame:
    """Value of each point's cell, the default where the sparse raster has none."""
    return points.join(cells.select(*keys, ix, iy, value), [*keys, ix, iy], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def point_in_polygon(points: DataFrame, rings: DataFrame, keys: list[str], x: str, y: str, ring: str, tile: float | None = None) -> DataFrame:
    """Points with the polygons that contain them. With a ``tile`` the candidates meet on a grid."""
    from ..functions.rings import bounds, contains

    if tile is None:
        return points.join(rings, keys).filter(contains(F.col(ring), F.col(x), F.col(y)))
    box = bounds(F.col(ring))
    dot = F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    return box_join(points, rings, keys, dot, box, tile, contains(F.col(ring), F.col(x), F.col(y)))


def _tasks(df: DataFrame) -> int:
    """Four tasks a core: parts of a table that a few rows have made."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def greedy_pairs(candidates: DataFrame, keys: list[str], left: str, right: str, score: list[Column]) -> DataFrame:
    """One-to-one assignment within the keys: best score first (smallest, then by ``left`` and
    ``right``), each side used once.

    In rounds: a candidate that is the best of both its sides is what the greedy order would come to
    before any other of theirs, whatever lies between, so all such are taken at once and what they
    used goes. Each round is two aggregates with map-side combine, no group is gathered; the order
    is total, so every round takes one candidate a key at least, in practice a large part of them (a
    chain in which each score beats the one before needs a round a link). Rows alike in key, sides
    and score are one candidate; a null score comes last."""
    from .graph import checkpointed

    order = [f"_s{i}" for i in range(len(score))]
    named = candidates.select(*keys, F.col(left).alias("_l"), F.col(right).alias("_r"), *[F.coalesce(s.cast("double"), F.lit(float("inf"))).alias(o) for s, o in zip(score, order)])
    best = F.min(F.struct(*order, "_l", "_r")).alias("_b")
    # many candidates come of few rows, so they may stand in one partition
    open_, taken = checkpointed(named.repartition(_tasks(named), *keys, "_l")), None
    while True:
        by_left = open_.groupBy(*keys, "_l").agg(best).select(*keys, "_b.*")
        by_right = open_.groupBy(*keys, "_r").agg(best).select(*keys, "_b.*")
        both = checkpointed(by_left.join(by_right.hint("merge"), [*keys, *order, "_l", "_r"], "left_semi").select(*keys, "_l", "_r"))
        if not both.head(1):
            break
        taken = both if taken is None else taken.unionByName(both)
        rest = open_.join(both.select(*keys, "_l").hint("merge"), [*keys, "_l"], "left_anti").join(both.select(*keys, "_r").hint("merge"), [*keys, "_r"], "left_anti")
        open_ = checkpointed(rest)
    taken = both if taken is None else taken
    return taken.select(*keys, F.col("_l").alias(left), F.col("_r").alias(right))


def unmatched(df: DataFrame, pairs: DataFrame, keys: list[str], id_: str, side: str) -> DataFrame:
    """Rows that no pair uses."""
    return df.join(pairs.select(*keys, F.col(side).alias(id_)), [*keys, id_], "left_anti")

"""Choosing rows: thinning, spread top-k, sampling caps, first matching rules, overflow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_hash(id_: str, seed: int) -> Column:
    """A repeatable shuffle order."""
    return F.xxhash64(F.lit(seed), F.col(id_))


def voxel_thin(points: DataFrame, keys: list[str], size: float, id_: str = "point_id", seed: int = 0, axes: tuple = ("x", "y", "z")) -> DataFrame:
    """One row a voxel, the one with the smallest hash: an aggregate with map-side combine, so a
    dense voxel never meets in one task before it is reduced."""
    voxel = [F.floor(F.col(a) / size).cast("long").alias(f"_v{i}") for i, a in enumerate(axes)]
    picked = points.groupBy(*keys, *voxel).agg(F.min_by(F.struct(*points.columns), F.struct(by_hash(id_, seed), F.col(id_))).alias("_p"))
    return picked.select("_p.*")


def window_best(frames: DataFrame, keys: list[str], index: str, window: int, score: str, least: float | None = None) -> DataFrame:
    """Row of the highest score in every window of ``window`` indices; ties keep the first."""
    best = frames.groupBy(*keys, F.floor(F.col(index) / window).cast("long").alias("window")).agg(F.max_by(F.struct(*frames.columns), F.struct(F.col(score), -F.col(index))).alias("_b"))
    out = best.select("window", "_b.*")
    return out if least is None else out.filter(F.col(score) >= least)


def spread_top(rows: DataFrame, keys: list[str], index: str, score: str, k: int, total: Column | int) -> DataFrame:
    """At most ``k`` rows a key, spread over ``k`` equal stretches of the index: the best of each
    stretch, then the best of what is left; groups of at most ``k`` rows stay whole."""
    n = total if isinstance(total, Column) else F.lit(total)
    stretch = F.least(F.lit(k - 1), F.floor(F.col(index) * k / F.greatest(n, F.lit(1)))).cast("long")
    placed = rows.withColumn("_s", stretch)
    # The best of each stretch is an aggregate; the rest only matter as each key's top k, which
    # Spark cuts before the shuffle (a rank filter becomes a group limit).
    best = placed.groupBy(*keys, "_s").agg(F.max_by(index, F.struct(F.col(score), -F.col(index))).alias("_i"))
    marked = placed.join(best, [*keys, "_s"]).withColumn("_first", F.col(index) == F.col("_i"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_first"), F.desc(score), index)
    return marked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_s", "_first", "_r", "_i")


def sample_cap(rows: DataFrame, keys: list[str], most: int, id_: str, seed: int = 0) -> DataFrame:
    """At most ``most`` rows a key, chosen by hash (a sampling operator)."""
    w = Window.partitionBy(*keys).orderBy(by_hash(id_, seed), id_)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def every_nth(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") - 1) % n == 0).drop("_r")


def first_rule(text: Column, rules: list[tuple[str, Column]]) -> Column:
    """Value of the first rule whose pattern (any case) is found; null if none."""
    out = None
    for pattern, value in rules:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def with_overflow(rows: DataFrame, keys: list[str], order: list, most: int, label: str, text: str) -> DataFrame:
    """The first rows of each key and one that says how many more there are: keys, label."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(w))  # the rank filter cuts each key before its shuffle
    kept = ranked.filter(F.col("_r") <= most).select(*keys, "_r", F.col(label).cast("string").alias("label"))
    more = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys, F.lit(most + 1).alias("_r"), F.format_string(text, F.col("_n") - most).alias("label"))
    return kept.unionByName(more).withColumnRenamed("_r", "position")


def long_sides(sides: DataFrame, keys: list[str], length: str, least: float = 1.0, many: int = 16) -> DataFrame:
    """Sides worth a label: at least ``least`` long, and of many only the longest."""
    w = Window.partitionBy(*keys).orderBy(F.desc(length))
    all_ = Window.partitionBy(*keys)
    ranked = sides.withColumns({"_n": F.count("*").over(all_), "_r": F.row_number().over(w)})
    return ranked.filter((F.col(length) >= least) & ((F.col("_n") <= many) | (F.col("_r") <= many))).drop("_n", "_r")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out once a row. The optimizer pulls the text of a column into all that use it, filters
    and lambdas too, where it would run once for every use or element; it pulls none through an explode."""
    held = rows.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return held.withColumns({n: F.col(f"_once.{n}") for n in columns}).drop("_once")


def largest(rows: DataFrame, keys: list[str], size: str, least: float = 0.0, ties: list[str] | None = None) -> DataFrame:
    """Row of the largest part of each key, if it is large enough. Of parts alike in size the one with the
    smallest numbers ``ties``, or any."""
    rank = F.when(F.col(size).isNotNull(), F.struct(F.col(size), *[-F.col(t) for t in ties])) if ties else F.col(size)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), rank).alias("_b")).select("_b.*")
    return best.filter(F.col(size) >= least)


def first_fitting(rows: DataFrame, candidates: list[float], fits: Column, name: str = "scale") -> DataFrame:
    """Smallest candidate for which ``fits`` (an expression over the row and ``name``) holds; the
    largest if none does. A short literal list exploded in the row."""
    wide = rows.withColumn("_row", F.struct("*")).withColumn(name, F.explode(F.array(*[F.lit(float(c)) for c in candidates])))
    ok = F.when(fits, F.col(name))
    return wide.groupBy("_row").agg(F.coalesce(F.min(ok), F.max(name)).alias(name)).select("_row.*", name)

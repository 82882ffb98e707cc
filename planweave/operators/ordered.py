"""Ordered analytics over keyed rows: islands, interval unions, smoothing, peaks, running
products. Everything is a window over the given keys, so one shuffle on them serves a
chain of operators; no window is ever global. Only the greedy folds (non-maximum
suppression, running clusters) run per group, over rows already reduced to candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: str, gap: float, least: int = 1, min_length: float = 0.0, ties: list[str] | None = None) -> DataFrame:
    """Runs of rows no more than ``gap`` apart along ``order``: keys, island, t0, t1, n. Runs of
    fewer than ``least`` rows or shorter than ``min_length`` are dropped."""
    return (
        with_islands(df, keys, order, gap, ties)
        .groupBy(*keys, "island")
        .agg(F.min(order).alias("t0"), F.max(order).alias("t1"), F.count("*").alias("n"))
        .filter((F.col("n") >= least) & ((F.col("t1") - F.col("t0")) >= min_length))
    )


def with_islands(df: DataFrame, keys: list[str], order: str, gap: float, ties: list[str] | None = None) -> DataFrame:
    """Rows numbered by run."""
    w = Window.partitionBy(*keys).orderBy(order, *(ties or []))
    brk = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_break", brk).withColumn("island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def interval_union(df: DataFrame, keys: list[str], a: str = "t0", b: str = "t1", bridge: float = 0.0) -> DataFrame:
    """Union of intervals, gaps up to ``bridge`` closed: keys, t0, t1, n."""
    w = Window.partitionBy(*keys).orderBy(a, b)
    reach = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.coalesce((F.col(a) > reach + bridge).cast("int"), F.lit(0)))
    marked = opened.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_k").agg(F.min(a).alias("t0"), F.max(b).alias("t1"), F.count("*").alias("n")).drop("_k")


def interval_difference(whole: DataFrame, cuts: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """What is left of ``whole(keys, t0, t1)`` (one row a key) after ``cuts(keys, t0, t1)``."""
    joined = whole.select(*keys, F.col("t0").alias("w0"), F.col("t1").alias("w1")).join(cuts, keys, "left")
    clipped = joined.withColumns({"c0": F.greatest("t0", "w0"), "c1": F.least("t1", "w1")}).withColumns({"c0": F.when(F.col("c1") > F.col("c0"), F.col("c0")), "c1": F.when(F.col("c1") > F.col("c0"), F.col("c1"))})
    merged = clipped.groupBy(*keys, "w0", "w1").agg(F.array_sort(F.collect_list(F.when(F.col("c0").isNotNull(), F.struct("c0", "c1")))).alias("cuts"))
    # a fold over the sorted cuts of one key: (cursor, pieces)
    start = F.struct(F.col("w0").alias("at"), F.array().cast("array<struct<t0:double,t1:double>>").alias("out"))
    step = lambda s, c: F.struct(F.greatest(s["at"], c["c1"]).alias("at"), F.when(c["c0"] - s["at"] > least, F.concat(s["out"], F.array(F.struct(s["at"].alias("t0"), c["c0"].alias("t1"))))).otherwise(s["out"]).alias("out"))
    done = lambda s: F.struct(s["at"].alias("at"), s["out"].alias("out"))
    folded = merged.withColumn("f", F.aggregate("cuts", start, step, done))
    rest = F.when(F.col("w1") - F.col("f.at") > least, F.array(F.struct(F.col("f.at").alias("t0"), F.col("w1").alias("t1")))).otherwise(F.array().cast("array<struct<t0:double,t1:double>>"))
    return folded.select(*keys, F.explode(F.concat("f.out", rest)).alias("p")).select(*keys, "p.t0", "p.t1")


def smooth(df: DataFrame, keys: list[str], order: str, value: str, radius: int = 1, name: str = "smooth") -> DataFrame:
    """Triangular smoothing of a dense series, zero beyond its ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    weight = (radius + 1) ** 2
    parts: Column = F.col(value) * float(radius + 1)
    for k in range(1, radius + 1):
        parts = parts + (F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) + F.coalesce(F.lead(value, k).over(w), F.lit(0.0))) * float(radius + 1 - k)
    return df.withColumn(name, parts / weight)


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str, min_height: float = -math.inf) -> DataFrame:
    """Rows not below their left and above their right neighbour."""
    w = Window.partitionBy(*keys).orderBy(order)
    low = F.lit(float("-inf"))
    marked = df.withColumns({"_l": F.coalesce(F.lag(value).over(w), low), "_r": F.coalesce(F.lead(value).over(w), low)})
    return marked.filter((F.col(value) >= F.col("_l")) & (F.col(value) > F.col("_r")) & (F.col(value) >= min_height)).drop("_l", "_r")


def peak_indices(y, min_height: float, min_distance: int = 1, prominence: float = 0.0) -> list[int]:
    """Peaks of one array, strongest first: local maxima whose rise above the higher of the
    two valleys next to them is enough, kept if no stronger kept one is within the distance."""
    import numpy as np

    y = np.asarray(y, dtype=float)
    if not len(y):
        return []
    padded = np.concatenate([[-np.inf], y, [-np.inf]])
    top = np.flatnonzero((y >= padded[:-2]) & (y > padded[2:]) & (y >= min_height))

    def valley(i: int, step: int) -> float:
        """Lowest value up to the next higher one; the array's end counts as falling to zero."""
        side = y[i + 1 :] if step > 0 else y[:i][::-1]
        higher = np.flatnonzero(side > y[i])
        if len(higher):
            return float(min(y[i], side[: higher[0]].min(initial=y[i])))
        return float(min(0.0, y[i], side.min(initial=y[i])))

    if prominence > 0:
        top = np.array([i for i in top if y[i] - max(valley(i, -1), valley(i, 1)) >= prominence], dtype=int)
    kept: list[int] = []
    for i in sorted(top.tolist(), key=lambda i: (-y[i], i)):
        if all(abs(i - j) >= min_distance for j in kept):
            kept.append(i)
    return kept


def peaks(df: DataFrame, keys: list[str], order: str, value: str, min_height: float, min_distance: int = 1, prominence: float = 0.0) -> DataFrame:
    """``peak_indices`` of each series: keys, order, value, rank (0 is the strongest). A series
    is one histogram, whose bins bound the group."""
    schema = df.select(*keys, order, value).schema.add("rank", "integer")

    def run(rows):
        rows = rows.sort_values(order).reset_index(drop=True)
        found = peak_indices(rows[value].to_numpy(), min_height, min_distance, prominence)
        return rows.loc[found, [*keys, order, value]].assign(rank=range(len(found)))

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def running_product(df: DataFrame, keys: list[str], order: str, value: str, name: str = "product") -> DataFrame:
    """Cumulative product of positive values, by the sum of their logarithms."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.exp(F.sum(F.ln(value)).over(w)))


def running_total(df: DataFrame, keys: list[str], block: str, order: list, value: str, name: str = "total") -> DataFrame:
    """Cumulative sum of ``value`` by ``order`` within the keys, which may be null. ``block`` cuts the
    order into stretches: no task sees more of a key than a block of it. Nulls count nothing; rows
    that ``order`` doesn't tell apart come in any order."""
    sums = df.groupBy(*keys, block).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, block]], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_ahead"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, block]]
    within = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(ahead, same).withColumn(name, F.col("_ahead") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return joined.drop("_ahead", *[f"_of_{k}" for k in [*keys, block]])


def chain_spread(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """How far apart the sizes along a chain of factors came, starting from 1: keys, spread, links."""
    run = running_product(df.filter(F.col(value) > 0), keys, order, value)
    return run.groupBy(*keys).agg((F.greatest(F.max("product"), F.lit(1.0)) / F.least(F.min("product"), F.lit(1.0))).alias("spread"), F.count("*").alias("links"))


def running_clusters(values: Column, tol: float, strict: bool = False) -> Column:
    """Sorted numbers of an array clustered in order: one closer than ``tol`` to the last
    cluster moves it half way. A fold inside the row (cuts, axes: a few dozen values)."""
    close = (lambda d: d < tol) if strict else (lambda d: d <= tol)
    last = lambda out: F.element_at(out, -1)
    head = lambda out: F.slice(out, 1, F.size(out) - 1)
    fold = lambda out, v: F.when((F.size(out) > 0) & close(v - F.coalesce(F.get(out, F.size(out) - 1), F.lit(math.inf))), F.concat(head(out), F.array((last(out) + v) / 2))).otherwise(F.concat(out, F.array(v)))
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), fold)


def cuts(values: Column, lo: Column, hi: Column, merge: float = 0.2) -> Column:
    """Cut coordinates between two bounds, near ones merged, the bounds at either end."""
    inner = F.filter(values, lambda v: (v > lo) & (v < hi))
    return F.concat(F.array(lo), running_clusters(inner, merge, strict=True), F.array(hi))


def stations(length: Column, openings: Column) -> Column:
    """Sorted distinct stations of a wall: its ends and those of ``array<struct<t0,t1>>``."""
    ends = F.flatten(F.transform(openings, lambda o: F.array(F.greatest(F.lit(0.0), o["t0"]), F.least(length, o["t1"]))))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), length), F.coalesce(ends, F.array().cast("array<double>")))))


def hopping(df: DataFrame, order: Column, size: int, overlap: int, name: str = "chunk") -> DataFrame:
    """Each row once for every hopping window of ``size`` rows, ``overlap`` shared, it belongs to."""
    step = max(1, size - overlap)
    first = F.greatest(F.lit(0), F.ceil((order - size + 1) / step)).cast("long")
    return df.withColumn(name, F.explode(F.sequence(first, F.floor(order / step).cast("long"))))


def neighbours(df: DataFrame, keys: list[str], order: str, reach: int, columns: list[str]) -> DataFrame:
    """Pairs of rows at most ``reach`` places apart: an explode and an equi-join, no theta join."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    left = ranked.select(*keys, "_k", *[F.col(c).alias(f"{c}_i") for c in columns], F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_d")).filter("_d <> 0").withColumn("_k", F.col("_k") + F.col("_d"))
    right = ranked.select(*keys, "_k", *[F.col(c).alias(f"{c}_j") for c in columns])
    return left.join(right, [*keys, "_k"]).drop("_k", "_d")

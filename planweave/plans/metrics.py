"""Accuracy of plans against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from ..functions.text import shape_error
from ..operators import cells, join, polygons
from ..operators.graph import checkpointed

S = ["scene_id"]


def room_iou(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Common over covered area of every overlapping pair of rooms, at any angle: scene_id, truth,
    found, iou. Pairs whose boxes meet are cut into slabs, each under its own key."""
    keys = ["scene_id", "truth", "found"]
    t = truth.select("scene_id", F.col("id").alias("truth"), F.col("polygon").alias("_t"), F.col("holes").alias("_th"))
    f = found.select("scene_id", F.col("id").alias("found"), F.col("polygon").alias("_f"), F.col("holes").alias("_fh"))
    near = checkpointed(join.box_join(t, f.hint("merge"), S, rings.bounds(F.col("_t")), rings.bounds(F.col("_f")), 4.0))
    both = polygons.iou(polygons.outlines(near, keys, "_t", "_th"), polygons.outlines(near, keys, "_f", "_fh"), keys)
    return both.filter("intersection > 0").select(*keys, "iou")


def matched_rooms(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One-to-one matches, the best first."""
    pairs = checkpointed(room_iou(truth, found))  # asked twice
    return join.greedy_pairs(pairs, S, "truth", "found", [-F.col("iou")]).join(pairs.hint("merge"), ["scene_id", "truth", "found"])


def territories(truth_cells: DataFrame, found: DataFrame, grid: DataFrame, least: float = 0.20) -> DataFrame:
    """Each true room with the found room that covers most of its cells, if enough: scene_id, room,
    found, share."""
    from ..functions.rings import contains

    centred = truth_cells.join(grid, S).withColumns({"cx": F.col("x0") + (F.col("ix") + 0.5) * F.col("cell"), "cy": F.col("y0") + (F.col("iy") + 0.5) * F.col("cell")})
    total = truth_cells.groupBy("scene_id", "room").agg(F.count("*").alias("all"))
    hit = centred.join(found.select("scene_id", F.col("id").alias("found"), "polygon"), S).filter(contains(F.col("polygon"), F.col("cx"), F.col("cy"))).groupBy("scene_id", "room", "found").agg(F.count("*").alias("n"))
    best = hit.join(total, ["scene_id", "room"]).withColumn("share", F.col("n") / F.col("all")).filter(F.col("share") >= least)
    return best.groupBy("scene_id", "room").agg(F.max_by(F.struct("found", "share"), F.struct("share", -F.col("found"))).alias("b")).select("scene_id", "room", "b.found", "b.share")


def room_counts(truth: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """Fused, missed and spurious rooms of each scene."""
    fused = matches.groupBy("scene_id", "found").agg(F.count("*").alias("n")).filter("n > 1").groupBy("scene_id").agg(F.count("*").alias("fused"))
    missed = truth.select("scene_id", "room").distinct().join(matches, ["scene_id", "room"], "left_anti").groupBy("scene_id").agg(F.count("*").alias("missed"))
    extra = found.select("scene_id", F.col("id").alias("found")).join(matches, ["scene_id", "found"], "left_anti").groupBy("scene_id").agg(F.count("*").alias("spurious"))
    return truth.select("scene_id").distinct().join(fused, S, "left").join(missed, S, "left").join(extra, S, "left").fillna(0)


def wall_scores(truth: DataFrame, drawn: DataFrame, reach: int) -> DataFrame:
    """Recall and precision of wall cells within ``reach`` cells of each other: scene_id, recall, precision."""
    share = lambda a, b: a.select("scene_id", "ix", "iy").distinct().join(cells.dilate(b, S, reach).withColumn("v", F.lit(1.0)), ["scene_id", "ix", "iy"], "left").groupBy("scene_id").agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("s"))
    return share(truth, drawn).withColumnRenamed("s", "recall").join(share(drawn, truth).withColumnRenamed("s", "precision"), S, "full").fillna(0.0)


def partitions(room_cells: DataFrame, wall_cells: DataFrame, reach: int) -> DataFrame:
    """Wall cells with two or more rooms within ``reach``: walls between rooms."""
    near = cells.dilate(room_cells.select("scene_id", "room", "ix", "iy"), ["scene_id", "room"], reach)
    return near.groupBy("scene_id", "ix", "iy").agg(F.count_distinct("room").alias("rooms")).filter("rooms >= 2").join(wall_cells.select("scene_id", "ix", "iy").distinct(), ["scene_id", "ix", "iy"], "left_semi").select("scene_id", "ix", "iy")


def area_report(areas: DataFrame) -> DataFrame:
    """``areas(scene_id, truth_m2, plan_m2, scale)`` with raw and shape errors in percent; an area
    error without a scale is refused."""
    raw = (F.col("plan_m2") / F.col("truth_m2") - 1) * 100
    return areas.withColumns({"error_pct": raw, "shape_pct": shape_error(raw, F.col("scale"))})


def floor_rooms(floor: DataFrame, keys: list[str], erode_r: int, smallest_core: int = 20, largest_hole: int = 0) -> DataFrame:
    """Rooms of a seen floor: holes up to ``largest_hole`` cells filled, the largest connected part
    eroded until doorways break, and every cell given to the core that grows to it first (ties:
    the smaller label): keys, ix, iy, room. Rounds are as many as the erosion is deep."""
    from pyspark.sql import Window

    from ..operators.graph import cell_components, checkpointed

    cells_ = checkpointed(floor.select(*keys, "ix", "iy").distinct())
    if largest_hole:
        box = cells_.groupBy(*keys).agg(F.min("ix").alias("i0"), F.max("ix").alias("i1"), F.min("iy").alias("j0"), F.max("iy").alias("j1"))
        grid = box.withColumn("ix", F.explode(F.sequence(F.col("i0") - 1, F.col("i1") + 1))).withColumn("iy", F.explode(F.sequence(F.col("j0") - 1, F.col("j1") + 1)))
        rim = (F.col("ix") < F.col("i0")) | (F.col("ix") > F.col("i1")) | (F.col("iy") < F.col("j0")) | (F.col("iy") > F.col("j1"))
        empty = checkpointed(cell_components(checkpointed(cells.minus(grid, cells_, keys)), keys))
        marked = empty.join(grid.select(*keys, "ix", "iy", rim.alias("rim")), [*keys, "ix", "iy"])
        hole = marked.groupBy(*keys, "label").agg(F.bool_or("rim").alias("rim"), F.count("*").alias("n")).filter((~F.col("rim")) & (F.col("n") <= largest_hole))
        cells_ = checkpointed(cells.union(cells_, empty.join(hole.select(*keys, "label"), [*keys, "label"]), keys))

    def parts(c: DataFrame) -> DataFrame:
        comp = checkpointed(cell_components(c, keys))
        return comp.join(comp.groupBy(*keys, "label").agg(F.count("*").alias("n")), [*keys, "label"])

    whole = parts(cells_)
    most = whole.groupBy(*keys).agg(F.max_by("label", "n").alias("label"))
    body = checkpointed(whole.join(most, [*keys, "label"]).select(*keys, "ix", "iy"))
    cores = parts(cells.erode(body, keys, erode_r)).filter(F.col("n") >= smallest_core)
    number = cores.select(*keys, "label").distinct().withColumn("room", F.row_number().over(Window.partitionBy(*keys).orderBy("label")))
    held = checkpointed(cores.join(number, [*keys, "label"]).select(*keys, "ix", "iy", "room"))
    step = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    while True:
        rest = body.join(held.select(*keys, "ix", "iy"), [*keys, "ix", "iy"], "left_anti")
        reach = held.withColumn("s", F.explode(step)).select(*keys, (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), "room")
        new = checkpointed(rest.join(reach, [*keys, "ix", "iy"]).groupBy(*keys, "ix", "iy").agg(F.min("room").alias("room")))
        if not new.head(1):
            return held
        held = checkpointed(held.unionByName(new))


def doorways(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rooms whose cells touch, with how many edges they share: keys, a, b, edges."""
    beside = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1))])
    there = rooms.select(*keys, "ix", "iy", F.col("room").alias("other"))
    near = rooms.withColumn("s", F.explode(beside)).select(*keys, (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), "room")
    pairs = near.join(there, [*keys, "ix", "iy"]).filter("room <> other")
    return pairs.groupBy(*keys, F.least("room", "other").alias("a"), F.greatest("room", "other").alias("b")).agg(F.count("*").alias("edges"))

"""Set operations on polygons at any angle, by slabs.

The plane is cut at every x at which an edge begins, ends or crosses another. Within such a slab no
two edges cross, so they have an order; a running sum of their windings, from the lowest up, tells
which layers cover what lies between one edge and the next, and each such strip is a trapezoid. Unions,
intersections and differences are predicates over these sums, areas are sums of trapezoids, outlines
are the edges at which the predicate changes. Everything is a join or a window keyed by (keys, strip,
slab): a strip is a stretch of x as wide as asked, so that one scene of any size is shared out, and a
crossing is found by a box join of edges, never by all pairs.

Coordinates are rounded to ``SNAP``; what lies closer is one. Rings are simple, without a closing
point, in either direction; a hole is a ring that takes away from its own layer's cover.

Joins ask for a merge: tables that are cut into edges and slabs outgrow what Spark knows of their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings
from .graph import checkpointed, release, stored
from .join import box_join
from .select import once

SNAP = 6  # decimals
BLOCK = 16  # slabs that an edge meets at once


def _snapped(c: Column) -> Column:
    return F.round(c, SNAP) + 0.0  # no negative zero


def edges(shapes: DataFrame, keys: list[str], ring: str, layer: Column | int = 0, hole: Column | bool = False) -> DataFrame:
    """``(keys, layer, x0, y0, x1, y1, w)``: edges of the rings from left to right. ``w`` is what the cover
    grows by above the edge: outlines count 1 inside whatever their direction, holes -1. Upright
    edges bound no slab from below and go. Null rings, points and lines have no edges."""
    layer = layer if isinstance(layer, Column) else F.lit(layer)
    hole = hole if isinstance(hole, Column) else F.lit(hole)
    snap = lambda p: rings.point(_snapped(p["x"].cast("double")), _snapped(p["y"].cast("double")))
    turned = shapes.select(*keys, layer.cast("int").alias("layer"), hole.alias("_hole"), F.col(ring).alias("_given"))
    turned = once(turned, _ring=F.transform("_given", snap)).drop("_given")
    turned = once(turned, _area=rings.signed_area(F.col("_ring")))
    each = turned.filter("_area <> 0").withColumn("_e", F.explode(rings.edges(F.col("_ring"))))
    a, b = F.col("_e.a"), F.col("_e.b")
    rightward = b["x"] > a["x"]
    inside_above = rightward == (F.col("_area") > 0)  # counter-clockwise outlines have their inside to the left
    w = F.when(inside_above, 1).otherwise(-1) * F.when(F.col("_hole"), -1).otherwise(1)
    pick = lambda f: (F.when(rightward, a[f]).otherwise(b[f]), F.when(rightward, b[f]).otherwise(a[f]))
    (x0, x1), (y0, y1) = pick("x"), pick("y")
    return each.filter(a["x"] != b["x"]).select(*keys, "layer", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), w.alias("w"))


def outlines(shapes: DataFrame, keys: list[str], ring: str = "polygon", holes: str = "holes") -> DataFrame:
    """Outline and holes of each shape as rows: keys, ring, hole."""
    one = lambda r, is_hole: F.struct(r.alias("ring"), F.lit(is_hole).alias("hole"))
    every = F.concat(F.array(one(F.col(ring), False)), F.transform(F.coalesce(holes, F.array()), lambda h: one(h, True)))
    return shapes.select(*keys, F.explode(every).alias("_r")).select(*keys, "_r.ring", "_r.hole")


def _at(x: Column) -> Column:
    """Height of an edge at x, exact at its ends."""
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return F.when(x == F.col("x0"), F.col("y0")).when(x == F.col("x1"), F.col("y1")).otherwise(F.col("y0") + slope * (x - F.col("x0")))


def trapezoids(cut: DataFrame, keys: list[str], tile: float, strip: float | None = None) -> DataFrame:
    """Edges -> ``(keys, strip, block, slab, edge, place, x0, x1, low0, low1, high0, high1, a, b)``: strips of every slab
    between one edge and the next, with the cover of layers 0 and 1 and the edge below. The outermost, above all
    edges, has null heights at the top. Edges meet the slabs by blocks of these, and all that follows within
    a slab is done where they met: the strips, far more than either, are never shuffled. ``tile`` is the size of box that crossings are looked for in, ``strip`` the
    width of a stretch of x (None: one for each of the keys)."""
    numbered = stored(cut.withColumn("edge", F.monotonically_increasing_id()))
    by = [*keys, "strip"]
    # where edges cross in their inside
    box = F.struct(F.col("x0").alias("x0"), F.least("y0", "y1").alias("y0"), F.col("x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
    mine = numbered.select(*keys, "edge", "x0", "y0", "x1", "y1")
    theirs = mine.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("edge", "x0", "y0", "x1", "y1")])
    their_box = F.struct(F.col("_x0").alias("x0"), F.least("_y0", "_y1").alias("y0"), F.col("_x1").alias("x1"), F.greatest("_y0", "_y1").alias("y1"))
    met = box_join(mine, theirs.hint("merge"), keys, box, their_box, tile, F.col("edge") < F.col("_edge"))
    s, t = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")), (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0"))
    x = _snapped((F.col("_y0") - F.col("y0") + s * F.col("x0") - t * F.col("_x0")) / (s - t))
    inner = (s != t) & (x > F.greatest("x0", "_x0")) & (x < F.least("x1", "_x1"))
    crossings = met.filter(inner).select(*keys, x.alias("x"))

    wide = F.lit(float(strip)) if strip else None
    of = (lambda c: F.floor(c / wide).cast("long")) if strip else (lambda c: F.lit(0).cast("long"))
    ends = numbered.select(*keys, F.explode(F.array("x0", "x1")).alias("x")).unionByName(crossings)
    # an edge in every strip it reaches, cut at the strip's sides
    last = F.when(F.col("x1") == of(F.col("x1")) * wide, of(F.col("x1")) - 1).otherwise(of(F.col("x1"))) if strip else F.lit(0).cast("long")
    spread = numbered.withColumn("strip", F.explode(F.sequence(of(F.col("x0")), last)))
    left = F.greatest(F.col("x0"), F.col("strip") * wide) if strip else F.col("x0")
    right = F.least(F.col("x1"), (F.col("strip") + 1) * wide) if strip else F.col("x1")
    spread = spread.withColumns({"from_x": left, "to_x": right})
    stops = ends.select(*keys, of(F.col("x")).alias("strip"), "x").unionByName(spread.select(*by, F.explode(F.array("from_x", "to_x")).alias("x"))).distinct()
    order = Window.partitionBy(*by).orderBy("x")
    slabs = stored(stops.withColumns({"slab": F.row_number().over(order), "next_x": F.lead("x").over(order)}))
    begins = slabs.select(*by, F.col("x").alias("from_x"), F.col("slab").alias("_first"))
    stands = slabs.select(*by, F.col("x").alias("to_x"), F.col("slab").alias("_last"))
    spans = spread.join(begins.hint("merge"), [*by, "from_x"]).join(stands.hint("merge"), [*by, "to_x"])
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    spans = spans.withColumn("block", F.explode(F.sequence(block("_first"), F.floor((F.col("_last") - 1) / BLOCK).cast("int"))))
    met = spans.join(slabs.filter("next_x is not null").withColumn("block", block("slab")).hint("merge"), [*by, "block"]).filter("slab >= _first and slab < _last")
    placed = met.withColumns({"y_left": _snapped(_at(F.col("x"))), "y_right": _snapped(_at(F.col("next_x")))})
    by = [*by, "block"]
    # edges that coincide in a slab are one
    wa, wb = (F.sum(F.when(F.col("layer") == k, F.col("w")).otherwise(0)) for k in (0, 1))
    lines = placed.groupBy(*by, "slab", "x", "next_x", "y_left", "y_right").agg(wa.alias("_wa"), wb.alias("_wb"), F.min("edge").alias("edge"))
    up = Window.partitionBy(*by, "slab").orderBy("_mid", "y_left", "y_right")
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    # where edges cross in a rounded place, the upper one is no lower than the one below
    lines = lines.withColumn("_mid", F.col("y_left") + F.col("y_right"))
    lines = lines.withColumns({"_left": F.max("y_left").over(so_far), "_right": F.max("y_right").over(so_far)})
    lines = lines.drop("y_left", "y_right").withColumnsRenamed({"_left": "y_left", "_right": "y_right"})
    up = Window.partitionBy(*by, "slab").orderBy("_mid", "y_left", "y_right")
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    strips = lines.select(
        *by, "slab", "edge", F.row_number().over(up).alias("place"), F.col("x").alias("x0"), F.col("next_x").alias("x1"), F.col("y_left").alias("low0"), F.col("y_right").alias("low1"),
        F.lead("y_left").over(up).alias("high0"), F.lead("y_right").over(up).alias("high1"), F.sum("_wa").over(so_far).alias("a"), F.sum("_wb").over(so_far).alias("b"),
    )
    return strips.filter("high0 is null or high0 > low0 or high1 > low1")  # nothing lies between edges that coincide


def covered(op: str, a: Column, b: Column) -> Column:
    """Whether a set operation of layers 0 and 1 holds where they cover ``a`` and ``b`` times."""
    ina, inb = a > 0, b > 0
    return {"left": ina, "right": inb, "union": ina | inb, "intersection": ina & inb, "difference": ina & ~inb, "xor": ina != inb, "overlap": (a > 1) | (b > 1)}[op]


def areas(parts: DataFrame, keys: list[str], ops: list[str]) -> DataFrame:
    """Area of each operation: keys and a column an operation."""
    size = (F.col("x1") - F.col("x0")) * ((F.col("high0") - F.col("low0")) + (F.col("high1") - F.col("low1"))) / 2
    return parts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(covered(op, F.col("a"), F.col("b")), size)), F.lit(0.0)).alias(op) for op in ops])


def iou(left: DataFrame, right: DataFrame, keys: list[str], tile: float = 1.0, strip: float | None = None) -> DataFrame:
    """Share that two sets of ``outlines`` of the same keys have in common: keys, union, intersection,
    iou (0 where there is nothing)."""
    cut = edges(left, keys, "ring", 0, F.col("hole")).unionByName(edges(right, keys, "ring", 1, F.col("hole")))
    both = areas(trapezoids(cut, keys, tile, strip), keys, ["union", "intersection"])
    return both.withColumn("iou", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(0.0))


def _longer(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Pieces ``(xa, ya)`` to ``(xb, yb)`` of one edge and direction as one where each goes on where the last ended."""
    on = Window.partitionBy(*by, "edge", "dir").orderBy("xa")
    goes_on = lambda xa, ya, xb, yb: F.coalesce((xa == xb) & (ya == yb), F.lit(False))
    ends = pieces.withColumns({
        "_first": ~goes_on(F.col("xa"), F.col("ya"), F.lag("xb").over(on), F.lag("yb").over(on)),
        "_last": ~goes_on(F.lead("xa").over(on), F.lead("ya").over(on), F.col("xb"), F.col("yb")),
    }).filter("_first or _last")
    to = lambda c: F.when(F.col("_last"), F.col(c)).otherwise(F.lead(c).over(on))
    return ends.withColumns({"_xb": to("xb"), "_yb": to("yb")}).filter("_first").drop("xb", "yb", "_first", "_last").withColumnsRenamed({"_xb": "xb", "_yb": "yb"})


def outline(parts: DataFrame, keys: list[str], op: str) -> DataFrame:
    """Directed pieces ``(keys, ax, ay, bx, by)`` of the outline of an operation, its inside to the left. A piece is
    as long as its edge bounds the operation on the same side, whatever slabs it goes through."""
    inside = covered(op, F.col("a"), F.col("b"))
    by = [*keys, "strip", "block"]
    up = Window.partitionBy(*by, "slab").orderBy("place")
    held = parts.withColumn("_in", F.coalesce(inside, F.lit(False)))
    turned = held.withColumn("_was", F.coalesce(F.lag("_in").over(up), F.lit(False))).filter("_in <> _was")
    way = F.when(F.col("_in"), 1).otherwise(-1)
    pieces = turned.select(*by, "edge", way.alias("dir"), F.col("x0").alias("xa"), F.col("low0").alias("ya"), F.col("x1").alias("xb"), F.col("low1").alias("yb"))
    long = stored(_longer(_longer(pieces, by).drop("strip", "block"), keys))
    p, q = F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y"))
    out = F.col("dir") > 0
    slanted = long.select(*keys, F.when(out, p).otherwise(q).alias("p"), F.when(out, q).otherwise(p).alias("q"))
    # upright where more is inside on the left than on the right (up) or less (down): what goes on counts on both sides
    ends = F.explode(F.array(F.struct(p.alias("at"), (-F.col("dir")).alias("d")), F.struct(q.alias("at"), F.col("dir").alias("d"))))
    marks = long.select(*keys, ends.alias("m")).groupBy(*keys, F.col("m.at.x").alias("x"), F.col("m.at.y").alias("y")).agg(F.sum("m.d").alias("d")).filter("d <> 0")
    along = Window.partitionBy(*keys, "x").orderBy("y")
    stood = marks.withColumns({"to": F.lead("y").over(along), "d": F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))}).filter("d <> 0 and to is not null")
    p, q = F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), F.col("to").alias("y"))
    upright = stood.select(*keys, F.when(F.col("d") > 0, p).otherwise(q).alias("p"), F.when(F.col("d") > 0, q).otherwise(p).alias("q"))
    pieces = slanted.unionByName(upright)
    return pieces.select(*keys, F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def assemble(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Rings of an outline: keys, ring_id, ring (``array<struct<x,y>>``), area; outer rings run
    counter-clockwise and have a positive area, holes a negative one. Where rings touch in a point, each
    keeps to itself. Places in a ring come from pointer doubling: rounds grow with the logarithm of
    the longest ring, and no ring is gathered before it is one."""
    named = stored(pieces.withColumn("id", F.monotonically_increasing_id()))
    ahead = named.select(*keys, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("id").alias("next"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("_out"))
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    turn = F.pmod(F.col("_back") - F.col("_out"), F.lit(2 * 3.141592653589793))
    met = named.withColumn("_back", back).join(ahead.hint("merge"), [*keys, "bx", "by"]).withColumn("_turn", F.when(turn < 1e-12, 7.0).otherwise(turn))
    of = stored(met.groupBy(*keys, "id").agg(F.min_by("next", "_turn").alias("jump")))
    # the smallest piece of each ring and how many steps it is ahead
    links, span = of.select(*keys, "id", "jump", F.when(F.col("jump") < F.col("id"), F.struct(F.col("jump").alias("low"), F.lit(1).alias("off"))).otherwise(F.struct(F.col("id").alias("low"), F.lit(0).alias("off"))).alias("best")), 1
    last = of
    while True:
        ask = links.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("best").alias("_best"))
        nearer = F.when(F.col("_best.low") < F.col("best.low"), F.struct(F.col("_best.low").alias("low"), (F.col("_best.off") + span).alias("off"))).otherwise(F.col("best"))
        after = stored(links.join(ask.hint("merge"), "jump").select(*keys, "id", F.col("_jump").alias("jump"), nearer.alias("best"), (F.col("_best.low") < F.col("best.low")).alias("moved")))
        release(last)
        last, links, span = after, after.drop("moved"), 2 * span
        if span > 2 and not after.filter("moved").head(1):
            break
    points = links.join(named.select("id", "ax", "ay").hint("merge"), "id")
    at = F.when(F.col("best.off") == 0, F.lit(-(1 << 31))).otherwise(-F.col("best.off"))
    gathered = points.groupBy(*keys, F.col("best.low").alias("ring_id")).agg(F.array_sort(F.collect_list(F.struct(at.alias("k"), F.col("ax").alias("x"), F.col("ay").alias("y")))).alias("_p"))
    # each step is written down: merged into one expression they would work out the ring hundreds of times
    out = stored(gathered.select(*keys, "ring_id", F.transform("_p", lambda p: rings.point(p["x"], p["y"])).alias("ring")))
    release(named, last)
    out = _straightened(checkpointed(out.withColumn("ring", rings.dedupe(F.col("ring"), 5 * 10**-SNAP))), 2 * 10**-SNAP)
    return out.withColumn("area", rings.signed_area(F.col("ring"))).filter(F.abs("area") > 10**-SNAP)


def _straightened(df: DataFrame, tol: float) -> DataFrame:
    """``ring`` without the vertices that slabs have made: from the lowest corner of the left on, one no
    farther than ``tol`` from the line between the last kept and the next goes. One after the other,
    for of two that are close together at a corner only one may go."""
    r = F.col("ring")
    df = df.withColumn("_low", F.array_position(r, F.array_min(r)).cast("int"))
    df = checkpointed(df.withColumn("ring", F.concat(F.slice(r, F.col("_low"), F.size(r)), F.slice(r, F.lit(1), F.col("_low") - 1))))
    df = df.withColumn("_pairs", F.zip_with(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.concat(F.slice(r, 3, F.greatest(F.size(r) - 2, F.lit(0))), F.slice(r, 1, 1)), lambda b, c: F.struct(b.alias("b"), c.alias("c"))))

    def step(out, e):
        a, b, c = F.element_at(out, -1), e["b"], e["c"]
        turn = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
        return F.when(F.abs(turn) > tol * F.hypot(c["x"] - a["x"], c["y"] - a["y"]), F.concat(out, F.array(b))).otherwise(out)

    df = checkpointed(df.withColumn("_kept", F.aggregate("_pairs", F.slice(r, 1, 1), step)))
    return df.withColumn("ring", F.when(F.size("_kept") >= 3, F.col("_kept")).otherwise(r)).drop("_low", "_pairs", "_kept")


def combine(left: DataFrame, right: DataFrame | None, keys: list[str], op: str, tile: float = 1.0, strip: float | None = None) -> DataFrame:
    """Rings of a set operation of two sets of ``outlines`` (or of one with itself): see ``assemble``."""
    cut = edges(left, keys, "ring", 0, F.col("hole"))
    if right is not None:
        cut = cut.unionByName(edges(right, keys, "ring", 1, F.col("hole")))
    return assemble(outline(trapezoids(cut, keys, tile, strip), keys, op), keys)

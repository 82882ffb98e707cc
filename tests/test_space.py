"""Neighbours at any density, set operations on polygons at any angle, joins of objects of any size,
pairing in rounds, running totals of a hot key: each against brute force."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planweave.functions import rings
from planweave.operators import join, knn, ordered, polygons

R = "array<struct<x:double,y:double>>"


def neighbours(spark, xy, k, leaf, axes=("x", "y")):
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "id": np.arange(len(xy)), **{a: xy[:, i] for i, a in enumerate(axes)}}))
    found = knn.k_nearest(df, ["s"], "id", list(axes), k, leaf).toPandas().sort_values(["id", "rank"])
    return {i: (g["other"].tolist(), g["distance"].to_numpy()) for i, g in found.groupby("id")}


def nearest_by_force(xy, i, k):
    d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
    d[i] = np.inf
    order = np.lexsort((np.arange(len(xy)), d))[: min(k, len(xy) - 1)]
    return order.tolist(), d[order]


rng = np.random.default_rng(0)
CLOUDS = {
    "uniform": rng.random((600, 2)),
    "lattice of ties": np.round(rng.random((500, 2)), 1),
    "dense corner and an outlier": np.concatenate([rng.random((400, 2)) * 1e-6, [[1e5, 1e5]]]),
    "one spot": np.zeros((150, 2)),
    "one spot among others": np.concatenate([np.zeros((150, 2)), rng.random((150, 2))]),
    "fewer than k": rng.random((3, 2)),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_nearest_against_brute_force(spark, name):
    xy = CLOUDS[name]
    found = neighbours(spark, xy, 5, 30)
    for i in range(len(xy)):
        others, far = nearest_by_force(xy, i, 5)
        assert found[i][0] == others and np.allclose(found[i][1], far)


def test_nearest_in_space_with_flat_sides(spark):
    xyz = np.c_[np.zeros(300), np.arange(300) % 7, rng.random(300)]
    found = neighbours(spark, xyz, 4, 20, ("x", "y", "z"))
    assert all(found[i][0] == nearest_by_force(xyz, i, 4)[0] for i in range(300))


def test_points_without_a_place_have_no_neighbours(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, None, 0.0), ("a", 3, float("nan"), 0.0), ("a", 4, float("inf"), 1.0), ("a", 5, 1.0, 0.0), ("b", 6, 0.0, 0.0)], "s string, id long, x double, y double")
    got = {(r.id, r.other) for r in knn.k_nearest(df, ["s"], "id", ["x", "y"], 3).collect()}
    assert got == {(1, 5), (5, 1)} and not knn.k_nearest(df.limit(0), ["s"], "id", ["x", "y"], 3).collect()


def test_a_dense_corner_costs_what_even_points_do(spark):
    even = rng.random((20_000, 2))

    def seconds(xy):
        began = time.perf_counter()
        assert len(neighbours(spark, xy, 5, 1000)) == len(xy)
        return time.perf_counter() - began

    seconds(even[:2000])
    assert seconds(np.concatenate([even * 1e-3, [[1e4, 1e4]]])) < 2 * seconds(even) + 2


def star(cx, cy, r, n):
    turn = (np.arange(n) + 0.8 * rng.random(n)) * 2 * math.pi / n
    corners = [(round(float(cx + q * math.cos(t)), 3), round(float(cy + q * math.sin(t)), 3)) for t, q in zip(turn, r * (0.4 + 0.6 * rng.random(n)))]
    return corners if rng.random() < 0.5 else corners[::-1]


def square(x, y, w, h):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


SCENES = {f"stars {i}": ([star(*(rng.random(2) * 4), 1.5, 7) for _ in range(4)], [star(*(rng.random(2) * 4), 1.5, 6) for _ in range(3)]) for i in range(4)} | {
    "an L": ([[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]], [square(1, 1, 2, 2)]),
    "the same twice": ([square(0, 0, 4, 2)], [square(0, 0, 4, 2)[::-1]]),
    "touching corners": ([square(0, 0, 1, 1), square(1, 1, 1, 1)], []),
    "a frame": ([square(0, 0, 4, 1), square(0, 3, 4, 1), square(0, 0, 1, 4), square(3, 0, 1, 4)], [[(1.5, 1.5), (2.5, 1.5), (2.0, 2.5)]]),
    "a shared side": ([square(0, 0, 1, 1)], [square(1, 0, 1, 1)]),
}


def inside(corners, x, y):
    c = np.zeros(x.shape, bool)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            c ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return c


@pytest.mark.parametrize("strip", [None, 0.7])
def test_set_operations_against_a_raster(spark, strip):
    side = lambda k: spark.createDataFrame([(n, p) for n, s in SCENES.items() for p in s[k]], f"s string, ring {R}")
    parts = polygons.trapezoids(polygons.edges(side(0), ["s"], "ring", 0).unionByName(polygons.edges(side(1), ["s"], "ring", 1)), ["s"], 0.5, strip).persist()
    ops = {"union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "xor": lambda a, b: a ^ b}
    areas = {r.s: r for r in polygons.areas(parts, ["s"], list(ops)).collect()}
    found = {op: polygons.assemble(polygons.outline(parts, ["s"], op), ["s"]).collect() for op in list(ops)[:3]}
    at = np.arange(-2, 6.5, 0.02) + 0.0037
    x, y = np.meshgrid(at, at)
    for name, (left, right) in SCENES.items():
        a, b = (np.any([inside(p, x, y) for p in side], axis=0) if side else np.zeros(x.shape, bool) for side in (left, right))
        for op, rule in ops.items():
            assert areas[name][op] == pytest.approx(rule(a, b).sum() * 0.0004, abs=0.03)
        for op, out in found.items():
            mine = [r for r in out if r.s == name]
            cover = sum((np.where(inside([(p.x, p.y) for p in r.ring], x, y), 1 if r.area > 0 else -1, 0) for r in mine), np.zeros(x.shape, int))
            assert ((cover == 1) == ops[op](a, b)).mean() > 1 - 2e-5 and cover.min() >= 0 and cover.max() <= 1
            assert sum(r.area for r in mine) == pytest.approx(areas[name][op], abs=2e-4)
    corners = {op: sorted(len(r.ring) for r in out if r.s == "an L") for op, out in found.items()}
    assert corners == {"union": [8], "intersection": [6], "difference": [10]}
    assert len([r for r in found["union"] if r.s == "touching corners"]) == 2
    assert sorted(np.sign(r.area) for r in found["difference"] if r.s == "a frame") == [-1, 1]
    parts.unpersist()


def test_holes_and_shapes_without_area(spark):
    rows = [("h", square(0, 0, 4, 4), [square(1, 1, 1, 1)[::-1]]), ("h", square(1, 1, 1, 1), []), ("flat", [(0.0, 0.0), (1.0, 1.0)], []), ("none", None, None), ("empty", [], [])]
    df = spark.createDataFrame(rows, f"s string, polygon {R}, holes array<{R}>")
    cut = polygons.edges(polygons.outlines(df, ["s"]), ["s"], "ring", 0, F.col("hole"))
    assert [(r.s, r.union) for r in polygons.areas(polygons.trapezoids(cut, ["s"], 1.0), ["s"], ["union"]).collect()] == [("h", 16.0)]
    other = spark.createDataFrame([("h", square(0, 0, 4, 2), [])], f"s string, polygon {R}, holes array<{R}>")
    only = df.filter("s = 'h' and size(holes) > 0")
    assert polygons.iou(polygons.outlines(only, ["s"]), polygons.outlines(other, ["s"]), ["s"]).first().iou == pytest.approx(7 / 16)


def test_interval_join_takes_intervals_of_any_length(spark):
    points = spark.createDataFrame([("k", float(x)) for x in (-3, 0, 0.05, 7, 1e6, 2e7)], "k string, t double")
    spans = [(0, 0.0, 0.1), (1, -5.0, 1e7), (2, 7.0, 7.0), (3, 9.0, 8.0), (4, float("-inf"), 0.0), (5, 1e6, float("inf")), (6, None, 1.0)]
    right = spark.createDataFrame([("k", *s) for s in spans], "k string, i int, lo double, hi double")
    got = sorted((r.t, r.i) for r in join.interval_join(points, right, ["k"], F.col("t"), F.col("lo"), F.col("hi"), 0.1).collect())
    want = sorted((p.t, i) for p in points.collect() for i, lo, hi in spans if lo is not None and lo <= p.t <= hi)
    assert got == want


def test_box_join_takes_boxes_of_any_size(spark):
    r = np.random.default_rng(4)
    boxes = [(i, *(float(v) for v in c), *(float(v) for v in c + r.random(2) * size)) for i, (c, size) in enumerate((r.random(2) * 50, 10.0 ** r.integers(-2, 4)) for _ in range(60))]
    df = spark.createDataFrame(boxes, "i int, x0 double, y0 double, x1 double, y1 double")
    box = F.struct("x0", "y0", "x1", "y1")
    got = sorted((a.i, a.j) for a in join.box_join(df.select("i", box.alias("b")), df.select(F.col("i").alias("j"), box.alias("c")), [], F.col("b"), F.col("c"), 0.5).collect())
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if max(a[1], b[1]) <= min(a[3], b[3]) and max(a[2], b[2]) <= min(a[4], b[4]))
    assert got == want


def test_pairing_in_rounds_is_the_greedy_one(spark):
    r = np.random.default_rng(8)
    rows = [(k, int(a), int(b), float(s)) for k in ("p", "q") for a, b, s in zip(r.integers(0, 40, 400), r.integers(0, 40, 400), np.round(r.random(400), 2))] + [("p", 99, 99, None), ("p", 1, 99, 0.5)]
    df = spark.createDataFrame(rows, "k string, a int, b int, d double")
    want = set()
    for k in ("p", "q"):
        used_a, used_b = set(), set()
        for a, b, _ in sorted(((a, b, math.inf if s is None else s) for kk, a, b, s in rows if kk == k), key=lambda x: (x[2], x[0], x[1])):
            if a not in used_a and b not in used_b:
                used_a.add(a), used_b.add(b), want.add((k, a, b))
    assert {tuple(x) for x in join.greedy_pairs(df, ["k"], "a", "b", [F.col("d")]).collect()} == want
    assert not join.greedy_pairs(df.limit(0), ["k"], "a", "b", [F.col("d")]).collect()


def test_running_total_in_blocks(spark):
    rows = [("hot" if i % 3 else None, i // 10, i, i % 5 if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, block int, i int, v int")
    got = {(r.k, r.i): r.total for r in ordered.running_total(df, ["k"], "block", ["i"], "v").collect()}
    sums = {}
    for k, _, i, v in rows:
        sums[k] = sums.get(k, 0) + (v or 0)
        assert got[(k, i)] == sums[k]


def test_ring_helpers_agree(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)],)], f"ring {R}")
    assert df.select(rings.signed_area(F.col("ring"))).first()[0] == 2.0


def test_flood_against_plain_search(spark):
    """Nearest seed by steps, ties to the smaller owner, over tiles of 16 cells on both sides of zero."""
    import heapq

    from planweave.operators import graph

    r = np.random.default_rng(3)
    ys, xs = np.nonzero(r.random((60, 70)) < 0.68)
    free = {(int(x) - 20, int(y) - 15) for x, y in zip(xs, ys)}
    seeds = [(*p, o) for p, o in zip(sorted(free)[::400], [5, 3, 3, 9, 1, 7, 2, 8, 4, 6, 11, 12])]
    best, heap = {}, [(0, o, x, y) for x, y, o in seeds]
    heapq.heapify(heap)
    while heap:
        d, o, x, y = heapq.heappop(heap)
        if (x, y) not in best:
            best[x, y] = (d, o)
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in free and p not in best:
                    heapq.heappush(heap, (d + 1, o, *p))
    cells = spark.createDataFrame([("k", *p) for p in free], "k string, ix long, iy long")
    start = spark.createDataFrame([("k", *s) for s in seeds] + [("none", 0, 0, 1)], "k string, ix long, iy long, owner long")
    assert {(c.ix, c.iy): (c.steps, c.owner) for c in graph.flood(cells, ["k"], start, 16).collect()} == best
    assert not graph.flood(cells, ["k"], start.limit(0), 16).collect() and not graph.flood(cells.limit(0), ["k"], start, 16).collect()


def test_a_path_of_ten_thousand_steps_takes_as_many_rounds_as_tiles(spark, monkeypatch):
    from planweave.operators import graph

    rounds, checkpointed = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or checkpointed(df))
    rows = [(x, y) for y in range(201) for x in range(100) if y % 2 == 0 or x == (99 if y % 4 == 1 else 0)]
    cells = spark.createDataFrame([("k", *p) for p in rows], "k string, ix long, iy long")
    assert graph.grid_path(cells, ["k"], (0, 0), (99, 200)).first().steps == 10_199
    assert len(rounds) < 40


@pytest.mark.parametrize("n", [1, 40])
def test_outlines_have_no_piece_a_slab(spark, n):
    """What lies inside cuts the plane into more slabs, not the outline into more pieces."""
    big = [dict(x=x, y=y) for x, y in ((0.0, 0.0), (10.0, 1.0), (9.0, 11.0), (-1.0, 10.0))]
    small = [[dict(x=x, y=y) for x, y in ((a, 5.0), (a + 0.05, 5.01), (a, 5.02))] for a in (1 + 0.17 * i for i in range(n))]
    R = "array<struct<x:double,y:double>>"
    side = lambda rings_: polygons.outlines(spark.createDataFrame([("s", r, []) for r in rings_], f"s string, polygon {R}, holes array<{R}>"), ["s"])
    cut = polygons.edges(side([big]), ["s"], "ring", 0).unionByName(polygons.edges(side(small), ["s"], "ring", 1))
    assert polygons.outline(polygons.trapezoids(cut, ["s"], 1.0), ["s"], "union").count() == 4
    (ring,) = polygons.combine(side([big]), side(small), ["s"], "union").collect()
    assert len(ring.ring) == 4 and ring.area == pytest.approx(101)

"""Operators on small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.operators import aggregate, align, cells, fusion, graph, join, normals, ordered, select


def grid(spark, nx=60, ny=40, cell=0.1):
    return spark.createDataFrame([("s", 0.0, 0.0, cell, nx, ny)], "scene_id string, x0 double, y0 double, cell double, nx long, ny long")


def cell_rows(spark, cells_):
    return spark.createDataFrame([("s", int(i), int(j)) for i, j in cells_], "scene_id string, ix long, iy long")


def got(df):
    return {(r.ix, r.iy) for r in df.collect()}


def test_peaks_and_smoothing():
    assert ordered.peak_indices([0, 1, 5, 1, 0, 0, 3, 0, 0, 8, 0], 2, 2) == [9, 2, 6]
    assert ordered.peak_indices([0, 5, 4.5, 5.2, 0], 1, 1, 2.0) == [3]
    assert ordered.peak_indices([], 1) == []


def test_interval_union_and_difference(spark):
    iv = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.05, 2.0), ("a", 3.0, 4.0)], "k string, t0 double, t1 double")
    out = sorted((r.t0, r.t1) for r in ordered.interval_union(iv, ["k"], bridge=0.1).collect())
    assert out == [(0.0, 2.0), (3.0, 4.0)]
    whole = spark.createDataFrame([("a", -1.0, 5.0)], "k string, t0 double, t1 double")
    left = sorted((r.t0, r.t1) for r in ordered.interval_difference(whole, iv, ["k"], 0.1).collect())
    assert left == [(-1.0, 0.0), (2.0, 3.0), (4.0, 5.0)]


def test_chain_spread(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.6] * 5 + [1 / 0.6] * 5)], "k string, i int, v double")
    r = ordered.chain_spread(rows, ["k"], "i", "v").first()
    assert r.spread == pytest.approx(0.6**-5) and r.links == 10


def test_running_clusters_and_stations(spark):
    r = spark.range(1).select(
        ordered.running_clusters(F.array(*[F.lit(x) for x in (3.0, 0.0, 0.2, 0.35)]), 0.3).alias("c"),
        ordered.cuts(F.array(F.lit(1.0), F.lit(1.1), F.lit(9.0)), F.lit(0.0), F.lit(5.0)).alias("k"),
        ordered.stations(F.lit(4.0), F.array(F.struct(F.lit(1.0).alias("t0"), F.lit(1.9).alias("t1")))).alias("s"),
    ).first()
    assert r.c == [pytest.approx(0.225), 3.0] and r.k == [0.0, pytest.approx(1.05), 5.0] and r.s == [0.0, 1.0, 1.9, 4.0]


def test_hopping_windows(spark):
    rows = ordered.hopping(spark.range(46).withColumn("k", F.col("id")), F.col("k"), 24, 4).groupBy("chunk").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("chunk").collect()
    assert [(r.a, r.b) for r in rows][:2] == [(0, 23), (20, 43)] and rows[2].a == 40


def test_voxel_thinning_keeps_one(spark):
    p = spark.createDataFrame([(0, 0.001, 0.0, 0.0), (1, 0.005, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, -0.001, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert select.voxel_thin(p, [], 0.02).count() == 3
    a = {r.point_id for r in select.voxel_thin(p, [], 0.02, seed=5).collect()}
    assert a == {r.point_id for r in select.voxel_thin(p.repartition(3), [], 0.02, seed=5).collect()}


def test_spread_top_fills_up(spark):
    rows = [(i, 100.0 - i if i < 50 else 0.0 + (i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, s double").withColumn("k", F.lit(0))
    out = {r.i for r in select.spread_top(df, ["k"], "i", "s", 5, 100).collect()}
    assert len(out) == 5 and {0, 20, 40} <= out


def test_nearest_prefers_earlier_and_respects_tolerance(spark):
    a = spark.createDataFrame([("k", 1.0), ("k", 5.0), ("k", 20.0)], "k string, t double")
    b = spark.createDataFrame([("k", 0.0, "x"), ("k", 2.0, "y"), ("k", 5.5, "z")], "k string, u double, v string")
    out = {r.t: r.v for r in join.nearest(a, b, ["k"], "t", "u", 2.0, ["v"]).collect()}
    assert out == {1.0: "x", 5.0: "z", 20.0: None}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    t, u = rng.uniform(0, 100, 200), np.unique(rng.uniform(0, 100, 80))
    a = spark.createDataFrame([("k", float(x)) for x in t], "k string, t double")
    b = spark.createDataFrame([("k", float(x), i) for i, x in enumerate(u)], "k string, u double, i int")
    for r in join.nearest(a, b, ["k"], "t", "u", 1.0, ["i"]).collect():
        k = int(np.abs(u - r.t).argmin())
        assert r.i == (k if abs(u[k] - r.t) <= 1 else None)


def test_range_join_has_no_nested_loop(spark):
    a, b = spark.range(100).select(F.lit(1).alias("k"), (F.col("id") * 1.7).alias("x")), spark.range(100).select(F.lit(1).alias("k"), (F.col("id") * 2.3).alias("y"))
    out = join.range_join(a, b, ["k"], F.col("x"), F.col("y"), 0.5)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    want = {(i, j) for i in range(100) for j in range(100) if abs(i * 1.7 - j * 2.3) <= 0.5}
    assert {(round(r.x / 1.7), round(r.y / 2.3)) for r in out.collect()} == want


def test_greedy_pairs(spark):
    c = spark.createDataFrame([("s", 1, 1, 0.5), ("s", 1, 2, 0.1), ("s", 2, 2, 0.2), ("s", 2, 1, 0.9)], "k string, a int, b int, d double")
    assert {(r.a, r.b) for r in join.greedy_pairs(c, ["k"], "a", "b", [F.col("d")]).collect()} == {(1, 2), (2, 1)}


def test_coverage(spark):
    pts = [(0.15, 0.15, z) for z in np.linspace(0.1, 2.4, 10)] + [(0.25, 0.25, 0.5)] * 10
    p = spark.createDataFrame([("s", float(x), float(y), float(z)) for x, y, z in pts], "scene_id string, x double, y double, z double")
    at = cells.index(p, grid(spark), ["scene_id"])
    out = {(r.ix, r.iy): r.value for r in cells.coverage(at, ["scene_id"], "z", 0.25, 2.5).collect()}
    assert out == {(1, 1): 10, (2, 2): 1}


def test_one_sight_line_crosses_every_cell(spark):
    p = spark.createDataFrame([("s", 0, 3.0, 1.0, 0.5, 1.0), ("s", 1, 1.5, 2.0, 0.5, 2.0)], "scene_id string, point_id long, x double, y double, cx double, cy double")
    free = got(cells.rays(p, grid(spark), ["scene_id"]))
    assert (6, 10) in free and (25, 10) in free and (30, 10) not in free
    assert {(i, 20) for i in range(5, 14)} <= free  # a short ray beside a long one is still whole
    stopped = got(cells.rays(p, grid(spark), ["scene_id"], blocked=cell_rows(spark, [(15, 10)])))
    assert (14, 10) in stopped and (15, 10) not in stopped and (20, 10) not in stopped


def test_morphology_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.random((20, 20)) < 0.6
    src = cell_rows(spark, list(zip(*np.nonzero(m))))
    pad = np.pad(m, 1)
    near = np.stack([pad[1 + a : 21 + a, 1 + b : 21 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)])
    assert got(cells.erode(src, ["scene_id"], 1)) == set(zip(*map(lambda x: x.tolist(), np.nonzero(near.all(0)))))
    inside = {c for c in got(cells.dilate(src, ["scene_id"], 1)) if 0 <= c[0] < 20 and 0 <= c[1] < 20}
    assert inside == set(zip(*map(lambda x: x.tolist(), np.nonzero(near.any(0)))))


def test_components_and_path(spark):
    ring = [(i, 0) for i in range(6)] + [(5, j) for j in range(1, 4)] + [(i, 4) for i in range(6)] + [(9, 9), (9, 10)]
    comp = graph.cell_components(cell_rows(spark, ring), ["scene_id"]).groupBy("label").count().collect()
    assert sorted(r["count"] for r in comp) == [2, 15]
    steps = graph.grid_path(cell_rows(spark, ring), ["scene_id"], (0, 0), (0, 4)).first().steps
    assert steps == 14
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(50)] + [(0, 100, 101)], "k int, a int, b int")
    assert {r.label for r in graph.components(edges, ["k"]).collect()} == {0, 100}


def test_shares(spark):
    c = cell_rows(spark, [(i, 10) for i in range(10, 20)])
    seg = spark.createDataFrame([("s", 1, 1.05, 1.05, 2.95, 1.05)], "scene_id string, id int, ax double, ay double, bx double, by double")
    assert cells.share_along(seg, c, grid(spark), ["scene_id"], ["id"], 20).first().share == pytest.approx(0.5, abs=0.06)
    box = spark.createDataFrame([("s", 1, 10, 9, 14, 11)], "scene_id string, id int, i0 long, j0 long, i1 long, j1 long")
    assert cells.share_in_box(box, c, ["scene_id"], ["id"]).first().share == pytest.approx(0.5)


def test_plane_normals(spark):
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([("s", i, float(x), float(y), 0.0) for i, (x, y) in enumerate(rng.uniform(0, 2, (500, 2)))], "scene_id string, point_id long, x double, y double, z double")
    n = normals.estimate(p, ["scene_id"], 10).toPandas()
    assert len(n) == 500 and (n["nz"].abs() > 0.99).all()


def test_main_direction(spark):
    angles = [17.0] * 100 + [107.0] * 100 + [197.0] * 50
    p = spark.createDataFrame([("s", math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles], "scene_id string, nx double, ny double")
    assert math.degrees(aggregate.dominant_direction(p, ["scene_id"]).first().angle) == pytest.approx(17)
    fam = aggregate.direction_families(np.radians([10.0] * 100 + [70.0] * 60))
    assert [round(math.degrees(a)) for a in fam] == [10, 70]


def test_sharpness_and_flatness(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (12, 12))
    px = spark.createDataFrame([("c", int(v), int(u), int(img[v, u])) for v in range(12) for u in range(12)], "k string, v int, u int, grey int")
    pad = np.pad(img.astype(float), 1, mode="reflect")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * img
    assert aggregate.sharpness(px, ["k"]).first().sharpness == pytest.approx(lap.var())
    counts = np.bincount(img.ravel(), minlength=264)
    want = max(counts[i : i + 9].sum() for i in range(256)) / img.size
    assert aggregate.flatness(px, ["k"]).first().flatness == pytest.approx(want)


def test_umeyama_recovers(spark):
    rng = np.random.default_rng(2)
    src = rng.normal(size=(30, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    r = q * np.sign(np.linalg.det(q))
    dst = 1.7 * src @ r.T + [1, 2, 3]
    df = spark.createDataFrame([("s", *map(float, a), *map(float, b)) for a, b in zip(src, dst)], "k string, sx double, sy double, sz double, dx double, dy double, dz double")
    out = align.umeyama(df, ["k"]).first()
    assert out.scale == pytest.approx(1.7) and out.rms == pytest.approx(0, abs=1e-6)
    np.testing.assert_allclose(np.array(out.r).reshape(3, 3), r, atol=1e-9)


def room_view(at, yaw, h=24, w=32):
    """Depth picture of a 4 x 3 x 2.5 m box from inside."""
    f = np.array([math.cos(yaw), math.sin(yaw), 0.0])
    down = np.array([0.0, 0.0, -1.0])
    rot = np.stack([np.cross(down, f), down, f], 1)
    k = np.array([[w / 2, 0, w / 2], [0, w / 2, h / 2], [0, 0, 1.0]])
    u, v = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    d = np.stack([(u - k[0, 2]) / k[0, 0], (v - k[1, 2]) / k[1, 1], np.ones_like(u)], -1) @ rot.T
    with np.errstate(divide="ignore"):
        t = np.where(d > 0, (np.array([4, 3, 2.5]) - at) / d, -np.array(at) / d)
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = rot, at
    return np.abs(t).min(-1), k, pose


def test_depth_scales_recovered(spark):
    factors = [0.5, 0.55, 0.45, 0.6, 0.5, 0.48, 0.65, 0.42]
    rows = []
    for i, f in enumerate(factors):
        at = 0.2 + 0.2 * i
        depth, k, pose = room_view(np.array([2 + 0.7 * math.cos(at), 1.5 + 0.7 * math.sin(at), 1.3]), at + 0.5, 48, 64)
        rows.append(("s", i, 48, 64, (depth / f).ravel().tolist(), [True] * depth.size, k.tolist(), pose.tolist()))
    v = spark.createDataFrame(rows, align.VIEW)
    out = {r.view_id: r for r in align.depth_scales(v).collect()}
    assert all(out[i].estimable for i in out)
    np.testing.assert_allclose([out[i].depth_scale for i in range(8)], factors, rtol=0.05)
    still = spark.createDataFrame([(r[0], r[1], *r[2:7], rows[0][7]) for r in rows], align.VIEW)
    assert not any(r.estimable for r in align.depth_scales(still).collect())


def test_chunks_chain(spark):
    true = {i: room_view(np.array([0.6 + 0.2 * i, 1.0 + 0.05 * i, 1.2]), 0.2 + 0.1 * i) for i in range(8)}
    rows = []
    for c, ids in enumerate([range(0, 4), range(2, 6), range(4, 8)]):
        s = 1 + 0.2 * c
        for i in ids:
            d, k, pose = true[i]
            moved = pose.copy()
            moved[:3, 3] = pose[:3, 3] / s
            rows.append(("s", i, 24, 32, (d / s).ravel().tolist(), [True] * d.size, k.tolist(), moved.tolist(), c))
    out = align.chain_chunks(spark.createDataFrame(rows, align.VIEW + ", chunk_id int")).collect()
    assert len(out) == 8
    for r in out:
        np.testing.assert_allclose(np.array(r["T"])[:3, 3], true[r.view_id][2][:3, 3], atol=1e-5)


def test_fusing_a_wall(spark):
    k = [[500.0, 0.0, 319.5], [0.0, 500.0, 239.5], [0.0, 0.0, 1.0]]
    row = ("s", 0, 60, 80, [2.0] * 4800, [True] * 4800, k, np.eye(4).tolist())
    p = fusion.fuse(spark.createDataFrame([row], align.VIEW), voxel=None, smooth=True).toPandas()
    assert len(p) > 50 and np.allclose(p["z"], 2) and np.allclose(p["nz"], -1)


def test_flat_pictures_are_dropped(spark):
    k = [[40.0, 0.0, 16.0], [0.0, 40.0, 12.0], [0.0, 0.0, 1.0]]
    d, kk, pose = room_view(np.array([1.0, 1.0, 1.2]), 0.4)
    rows = [("s", 0, 24, 32, [0.6] * 768, [True] * 768, k, np.eye(4).tolist()), ("s", 1, 24, 32, d.ravel().tolist(), [True] * 768, kk.tolist(), pose.tolist())]
    assert [r.view_id for r in align.drop_flat_views(spark.createDataFrame(rows, align.VIEW)).collect()] == [1]


def test_floor_rooms_and_doorways(spark):
    from planweave.plans import metrics

    left, right, door = [(i, j) for i in range(12) for j in range(12)], [(i, j) for i in range(14, 26) for j in range(12)], [(i, j) for i in (12, 13) for j in (5, 6)]
    hole = {(4, 4)}
    stray = [(40, 40), (41, 40)]
    rooms = metrics.floor_rooms(cell_rows(spark, [c for c in left + right + door + stray if c not in hole]), ["scene_id"], 2, largest_hole=3)
    out = {(r.ix, r.iy): r.room for r in rooms.collect()}
    assert len(out) == 12 * 12 * 2 + 4 and out[(0, 0)] != out[(25, 11)] and (4, 4) in out and (40, 40) not in out
    pair = metrics.doorways(rooms, ["scene_id"]).collect()
    assert len(pair) == 1 and pair[0].edges == 2


def similarity(r):
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    return float(r.uniform(0.9, 1.1)), q * np.sign(np.linalg.det(q)), r.normal(size=3)


def test_products_of_a_long_chain(spark):
    """A thousand links and the links of short chains, by blocks and by a plain fold."""
    r = np.random.default_rng(11)
    rows, want = [], {}
    for chain, n in (("long", 1000), ("one", 1), ("block", 64), ("more", 65)):
        scale, turn, shift = 1.0, np.eye(3), np.zeros(3)
        for k in range(n):
            s, q, t = similarity(r)
            rows.append((chain, k, s, q.ravel().tolist(), t.tolist()))
            shift = shift + scale * turn @ t
            scale, turn = scale * s, turn @ q
            want[chain, k] = (scale, turn.ravel(), shift)
    links = spark.createDataFrame(rows, f"chain string, place int, {align.SIMILARITY}").repartition(5)
    got = {(x.chain, x.place): x for x in align.prefix_similarities(links, ["chain"], "place").collect()}
    assert got.keys() == want.keys()
    for key, (scale, turn, shift) in want.items():
        np.testing.assert_allclose(got[key].scale, scale, rtol=1e-9)
        np.testing.assert_allclose(got[key].r, turn, atol=1e-9)
        np.testing.assert_allclose(got[key].t, shift, rtol=1e-7, atol=1e-7)


def chained_by_fold(rows):
    """(T, scale) of each view: chunk after chunk, each onto what is solved so far."""
    solved = {}
    for c in sorted({x[8] for x in rows}):
        part = sorted((x for x in rows if x[8] == c), key=lambda x: x[1])
        shared = [x for x in part if x[1] in solved]
        scale, turn, shift = 1.0, np.eye(3), np.zeros(3)
        if len(shared) >= 2:
            ratio = float(np.median([np.median(np.array(solved[x[1]][2]) / np.array(x[4])) for x in shared]))
            scale, turn, shift = align.pose_similarity([np.array(x[7]) for x in shared], [solved[x[1]][0] for x in shared], ratio)
        for x in part:
            solved.setdefault(x[1], (align.moved(np.array(x[7]), scale, turn, shift), scale, (np.array(x[4]) * scale).tolist()))
    return solved


def test_chunks_chain_as_a_fold_does(spark):
    """Sixty noisy chunks, one of which shares too little and begins anew."""
    r = np.random.default_rng(12)
    rows, at = [], 0
    for c in range(60):
        if c == 40:
            at += 3  # shares one view only
        for i in range(at, at + 6):
            d, k, pose = room_view(np.array([0.5 + 0.01 * i, 1.0, 1.2]), 0.2 + 0.02 * i, 12, 20)
            s = 1 + 0.02 * (c % 5)
            pose = pose.copy()
            pose[:3, 3] = pose[:3, 3] / s + r.normal(0, 1e-3, 3)
            rows.append(("s", i, 12, 20, (d / s).ravel().tolist(), [True] * d.size, k.tolist(), pose.tolist(), c))
        at += 3 if c != 39 else 2
    out = align.chain_chunks(spark.createDataFrame(rows, align.VIEW + ", chunk_id int").repartition(4)).collect()
    want = chained_by_fold(rows)
    assert {x.view_id for x in out} == want.keys()
    for x in out:
        np.testing.assert_allclose(np.array(x["T"]), want[x.view_id][0], atol=1e-8)
        assert x.chunk_scale == pytest.approx(want[x.view_id][1]) and np.allclose(x.depth, want[x.view_id][2])

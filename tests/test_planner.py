"""Plans of synthetic scenes against their exact truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.functions import rings
from planweave.plans import metrics, planner, quality, schedules
from planweave.sources import plans, sinks, synthetic


def truth(spark, name):
    flat = synthetic.SCENES[name]
    rows = [(name, i, [{"x": float(x), "y": float(y)} for x, y in ((a, b), (c, b), (c, d), (a, d))], []) for i, (a, b, c, d) in enumerate(flat.rooms)]
    return spark.createDataFrame(rows, "scene_id string, id int, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")


@pytest.fixture(scope="module")
def flat(spark):
    points, cameras = synthetic.sample(spark, ["two_rooms"], density=700.0)
    tables = planner.plan(points, cameras)
    return {k: v.cache() if k in ("walls", "openings", "rooms", "extra_walls", "scenes") else v for k, v in tables.items()}


def test_rooms_match(spark, flat):
    found = metrics.matched_rooms(truth(spark, "two_rooms"), flat["rooms"]).collect()
    assert len(found) == 2 and all(r.iou >= 0.90 for r in found)
    assert all(r.closed for r in flat["rooms"].collect())


def test_heights_and_thickness(flat):
    scene = flat["scenes"].first()
    assert scene.ceiling == pytest.approx(2.5, abs=0.03) and scene.ceiling_measured
    inner = flat["walls"].filter("sides_seen = 2").collect()
    assert len(inner) == 1 and inner[0].thickness == pytest.approx(0.12, abs=0.03)


def test_openings(flat):
    found = flat["openings"].collect()
    doors = sorted(r.t1 - r.t0 for r in found if r.kind == "door")
    assert len(doors) == 2 and all(abs(w - 0.9) <= 0.20 for w in doors)
    panes = sorted((r.t1 - r.t0, r.z0, r.z1) for r in found if r.kind == "window")
    assert [round(p[0], 1) for p in panes] == [1.2, 1.4] and all(abs(p[1] - 0.9) < 0.1 and abs(p[2] - 2.1) < 0.1 for p in panes)
    assert {r.tag for r in found} == {"P1", "P2", "V1", "V2"}
    assert all(r.height_measured for r in found)


def test_reports_of_the_plan(spark, flat):
    got = {r.name: r for r in schedules.area_schedule(flat["rooms"], flat["walls"]).collect()}
    assert got["Room 1"].area == "12.00 m²" and got["useful"].area == "20.64 m²"
    keys = {r.key for r in quality.findings(flat["scenes"].select("scene_id", "ceiling_measured", *[F.lit(None).cast(t).alias(n) for n, t in META]), flat["rooms"], flat["walls"], flat["openings"]).collect()}
    assert keys == {"thickness"}
    assert "walls: 5  rooms: 2" in schedules.summary(flat["scenes"], flat["walls"], flat["openings"], flat["rooms"]).first().summary


META = [("source", "string"), ("scale_factor", "double"), ("views", "int"), ("footprint_m2", "double"), ("video_fps", "double"), ("sample_fps", "double"), ("video_frames", "int"), ("chunk_scales", "array<double>"), ("mask_fraction", "double")]


def test_exports_and_round_trip(spark, flat, tmp_path):
    held = flat["scenes"].select("scene_id", F.col("height").alias("ceiling_height"), "ceiling_measured", "transform", F.lit("m").alias("units"))
    out = sinks.export({"walls": flat["walls"], "openings": flat["openings"], "rooms": flat["rooms"], "plans": held}, str(tmp_path)).collect()
    assert {r.format for r in out} == set(sinks.FORMATS) and all(r.bytes > 200 for r in out)
    assert (tmp_path / "two_rooms.pdf").read_bytes().startswith(b"%PDF") and (tmp_path / "two_rooms.glb").read_bytes()[:4] == b"glTF" and (tmp_path / "two_rooms.png").read_bytes()[1:4] == b"PNG"
    assert "Room 1 12.00 m²" in (tmp_path / "two_rooms.svg").read_text() and "3DFACE" in (tmp_path / "two_rooms.dxf3d").read_text()
    assert bytes(sinks.debug_png(flat).first().content)[1:4] == b"PNG"
    (tmp_path / "docs").mkdir()
    (tmp_path / "two_rooms.json").rename(tmp_path / "docs" / "two_rooms.json")
    back = plans.read(spark, str(tmp_path / "docs"))
    assert back["walls"].count() == 5 and back["openings"].count() == 4
    assert back["rooms"].select(F.sum(rings.area(F.col("polygon"))).alias("a")).first().a == pytest.approx(20.64, abs=0.1)


def test_tilted_cloud_comes_back(spark):
    points, cameras = synthetic.moved(*synthetic.sample(spark, ["two_rooms"], density=300.0), synthetic.rigid())
    o = planner.Options()
    aligned, _, scenes = planner.align(points, cameras, o)
    s = scenes.first()
    assert s.ceiling == pytest.approx(2.5, abs=0.03)
    t = np.array(s.transform) @ np.array(synthetic.rigid())
    assert t[2, 2] > math.cos(math.radians(1)) and t[2, 3] == pytest.approx(0, abs=0.03)
    off = math.degrees(math.atan2(t[1, 0], t[0, 0])) % 90
    assert min(off, 90 - off) < 1
    assert aligned.filter("nz > 0.95 and abs(z) < 0.05").count() > 1000


def test_no_walls_raises(spark):
    rng = np.random.default_rng(0)
    rows = [("s", i, float(x), float(y), 0.0, 0.0, 0.0, 1.0, None, None, None, 0) for i, (x, y) in enumerate(rng.uniform(0, 4, (2000, 2)))]
    points = spark.createDataFrame(rows, "scene_id string, point_id long, x double, y double, z double, nx double, ny double, nz double, r short, g short, b short, view_id int")
    cameras = spark.createDataFrame([("s", 0, [[0.0, 0.0, 1.0, 1.0], [-1.0, 0.0, 0.0, 1.0], [0.0, -1.0, 0.0, 1.4], [0.0, 0.0, 0.0, 1.0]])], "scene_id string, view_id int, T array<array<double>>")
    with pytest.raises(ValueError, match="too few wall points"):
        planner.plan(points, cameras)


def test_rooms_from_walls(spark, flat):
    o = planner.Options(rooms_from="walls")
    piece = flat["lines"].select("scene_id", "alpha", "s", "thickness", F.explode("intervals").alias("i")).select("scene_id", "alpha", "s", "thickness", "i.t0", "i.t1", F.lit(True).alias("wall"))
    rooms = planner.rooms_from_walls(piece, flat["cameras"], flat["inside"], flat["grid"], o)
    found = metrics.matched_rooms(truth(spark, "two_rooms"), rooms).collect()
    assert len(found) == 2 and all(r.iou >= 0.8 for r in found)
    assert rooms.select(F.bool_and(rings.is_rectilinear(F.col("polygon"))).alias("r")).first().r


def test_rooms_clipped_by_low_runs(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 6.0, "y": 0.0}, {"x": 6.0, "y": 3.0}, {"x": 0.0, "y": 3.0}]
    rooms = spark.createDataFrame([("s", 0, "Room 1", ring, [], True, None)], planner.ROOM)
    runs = spark.createDataFrame([("s", 0.0, 3.0, -0.1, 3.1)], "scene_id string, alpha double, s double, t0 double, t1 double")
    eyes = spark.createDataFrame([("s", i, [[1.0, 0.0, 0.0, x], [0.0, 1.0, 0.0, 1.0], [0.0, 0.0, 1.0, 1.4], [0.0, 0.0, 0.0, 1.0]]) for i, x in enumerate((1.0, 5.0))], "scene_id string, view_id int, T array<array<double>>")
    out = planner.clip_rooms(rooms, runs, eyes, planner.Options()).collect()
    assert len(out) == 2

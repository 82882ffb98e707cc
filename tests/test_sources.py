"""Readers, writers, streams and registries."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave import backends
from planweave.plans import survey
from planweave.sources import buildings, lists, ply, video
from planweave.streaming import frames


def test_ply_round_trip(spark, tmp_path):
    ply.register(spark)
    rng = np.random.default_rng(0)
    rows = [(f"{i}", float(x), float(y), float(z), 0.0, 0.0, 1.0, i % 256, 3) for i, (x, y, z) in enumerate(rng.normal(size=(1000, 3)))]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double, nx double, ny double, nz double, r int, view_id int").drop("k")
    df.coalesce(2).write.format("ply").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("ply").load(str(tmp_path / "out"))
    assert back.count() == 1000 and {"scene_id", "point_id", "view_id", "r"} <= set(back.columns)
    assert back.agg(F.sum("x")).first()[0] == pytest.approx(sum(r[1] for r in rows), abs=1e-3)


def test_ply_cameras_ascii_and_lists(spark, tmp_path):
    ply.register(spark)
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement camera 1\n" + "".join(f"property float m{i}{j}\n" for i in range(3) for j in range(4)) + "end_header\n"
    (tmp_path / "a.ply").write_bytes(head.encode() + struct.pack("<6f", *range(6)) + struct.pack("<12f", *range(12)))
    cam = spark.read.format("ply").option("element", "camera").load(str(tmp_path / "a.ply")).first()
    assert (cam.m00, cam.m23, cam.view_id) == (0.0, 11.0, 0)
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 1 2\n3 4 5\n6 7 8\n3 0 1 2\n")
    rows = spark.read.format("ply").load(str(tmp_path / "b.ply")).orderBy("point_id").collect()
    assert [(r.x, r.y, r.r) for r in rows] == [(0, 1, 2), (3, 4, 5), (6, 7, 8)]


def test_recording(spark, tmp_path):
    seq = tmp_path / "rgbd_dataset_freiburg2_desk"
    seq.mkdir()
    (seq / "depth.txt").write_text("# c\n1.00 depth/1.png\n1.10 depth/2.png\n1.20 depth/3.png\n5.0 depth/4.png\n")
    (seq / "rgb.txt").write_text("1.005 rgb/1.png\n1.11 rgb/2.png\n1.19 rgb/3.png\n5.0 rgb/4.png\n")
    (seq / "groundtruth.txt").write_text("1.001 1 2 3 0 0 0 1\n1.10 1 2 4 0 0 0 1\n1.20 1 2 5 0 0 0 1\n")
    out = lists.sequence(spark, f"file://{seq}").orderBy("t").collect()
    assert [(r.depth, r.rgb) for r in out] == [("depth/1.png", "rgb/1.png"), ("depth/2.png", "rgb/2.png"), ("depth/3.png", "rgb/3.png")]
    assert out[1].pose[2][3] == 4.0 and out[0].intrinsics.fx == 520.9
    assert lists.sequence(spark, f"file://{seq}", stride=2, max_frames=1).count() == 1


def movie(model):
    box = lambda k, d: struct.pack(">I4s", len(d) + 8, k) + d
    key = b"com.apple.quicktime.model"
    keys = box(b"keys", struct.pack(">II", 0, 1) + struct.pack(">I4s", len(key) + 8, b"mdta") + key)
    item = box(struct.pack(">I", 1), box(b"data", struct.pack(">II", 1, 0) + model.encode()))
    meta = box(b"meta", box(b"hdlr", bytes(24)) + keys + box(b"ilst", item))
    return box(b"ftyp", b"qt  ") + box(b"mdat", bytes(1000)) + box(b"moov", box(b"mvhd", bytes(20)) + meta)


def test_phone_from_video(spark, tmp_path):
    paths = []
    for name, model in (("a", "iPhone 15 Pro"), ("b", "SM-S911B"), ("c", "Fairphone 5")):
        (tmp_path / f"{name}.mov").write_bytes(movie(model))
        paths.append(str(tmp_path / f"{name}.mov"))
    out = {r.model: r for r in video.with_focal(video.metadata(spark, paths), 1024).collect()}
    assert out["iPhone 15 Pro"].focal_px == pytest.approx(1024 * 24 / 34.6, rel=1e-3)
    assert out["SM-S911B"].phone.name.startswith("Galaxy S23") and out["Fairphone 5"].phone is None
    assert len(video.PHONES) == 33


ANSWER = {
    "elements": [
        {"type": "way", "id": 1, "tags": {"building": "yes", "building:levels": "2"}, "geometry": [{"lat": 41.0, "lon": 2.0}, {"lat": 41.0, "lon": 2.0002}, {"lat": 41.0001, "lon": 2.0002}, {"lat": 41.0001, "lon": 2.0}, {"lat": 41.0, "lon": 2.0}]},
        {"type": "way", "id": 2, "tags": {"building": "house", "height": "12.5 m"}, "geometry": [{"lat": 41.001, "lon": 2.001}, {"lat": 41.001, "lon": 2.0012}, {"lat": 41.0011, "lon": 2.0011}, {"lat": 41.001, "lon": 2.001}]},
        {"type": "node", "id": 3, "tags": {"building": "no"}},
    ]
}


def test_buildings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ANSWER))
    b = buildings.read_overpass(spark, str(tmp_path / "a.json"))
    ranked = buildings.by_relevance(b, 41.00005, 2.0001).orderBy("relevance").collect()
    assert [r.id for r in ranked] == ["way/1", "way/2"] and ranked[0].distance_m == 0
    rows = {r.id: r for r in buildings.describe(b, 41.0, 2.0).collect()}
    assert (rows["way/1"].height_m, rows["way/1"].height_source) == (6.0, "levels") and rows["way/2"].height_m == 12.5
    assert rows["way/1"].footprint_area_m2 == pytest.approx(16.8 * 11.1, rel=0.01)
    lot = {r.id: r for r in survey.lots(b, 41.0, 2.0).collect()}
    assert lot["way/1"].closure_m == pytest.approx(0, abs=1e-6) and lot["way/1"].epsg == 32631
    v = survey.vertices(b, 41.0, 2.0).filter("id = 'way/1'").orderBy("vertex").collect()
    assert v[0].x == pytest.approx(0, abs=1e-6) and v[0].y > 10
    az = [r.azimuth_deg for r in survey.sides(survey.vertices(b, 41.0, 2.0)).filter("id = 'way/1'").orderBy("from").collect()]
    assert az == pytest.approx([180, 90, 0, 270], abs=0.01)
    with pytest.raises(KeyError):
        buildings.fetch(spark, 41.0, 2.0, source="nowhere")


def test_map_parquet(spark, tmp_path):
    ring = [(2.0, 41.0), (2.001, 41.0), (2.001, 41.001), (2.0, 41.001), (2.0, 41.0)]
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<2d", *p) for p in ring)
    row = (bytearray(wkb), "b1", (2.0, 2.001, 41.0, 41.001), 7.5, 2, ("Home",), "flat", "house", "residential", [("osm",)])
    schema = "geometry binary, id string, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, height double, num_floors int, names struct<primary:string>, roof_shape string, class string, subtype string, sources array<struct<dataset:string>>"
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "m"))
    found = buildings.read_overture(spark, str(tmp_path / "m"), 41.0005, 2.0005, 100)
    r = found.first()
    assert (r.id, r.height_m, r.name, len(r.footprint)) == ("b1", 7.5, "Home", 4)
    assert buildings.read_overture(spark, str(tmp_path / "m"), 10.0, 2.0, 100).count() == 0
    assert "PushedFilters: [" in found._jdf.queryExecution().toString()


def packed(parts, order="<", wide=2, extended=0):
    """WKB of polygons: lists of rings of points."""
    mark = {"<": 1, ">": 0}[order]
    kind = lambda k: k | 0x80000000 if extended and wide == 3 else k + 1000 * (wide == 3)
    point = lambda p: struct.pack(f"{order}{wide}d", *p, *[7.0] * (wide - 2))
    one = lambda rings: struct.pack(f"{order}BII", mark, kind(3), len(rings)) + b"".join(struct.pack(f"{order}I", len(r)) + b"".join(map(point, r)) for r in rings)
    return one(parts[0]) if len(parts) == 1 else struct.pack(f"{order}BII", mark, kind(6), len(parts)) + b"".join(map(one, parts))


@pytest.mark.parametrize("order, wide, extended", [("<", 2, 0), (">", 2, 0), ("<", 3, 0), (">", 3, 1)])
def test_polygons_in_binary(order, wide, extended):
    small, large, hole = [(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (9, 5), (9, 9), (5, 9), (5, 5)], [(6, 6), (7, 6), (7, 7), (6, 6)]
    parts = buildings.wkb_rings(packed([[small], [large, hole]], order, wide, extended))
    assert [[r.tolist() for r in p] for p in parts] == [[[list(map(float, q)) for q in r] for r in p] for p in ([small], [large, hole])]
    assert buildings.wkb_rings(struct.pack("<BI2d", 1, 1, 2.0, 3.0)) == []


def test_largest_part_of_each_footprint(spark):
    small, large, hole = [(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (9, 5), (9, 9), (5, 9), (5, 5)], [(6, 6), (7, 6), (7, 7), (6, 6)]
    import pandas as pd

    out = next(buildings._largest(iter([pd.Series([packed([[small], [large, hole]]), None, struct.pack("<BI2d", 1, 1, 2.0, 3.0), packed([[small]])])])))
    assert [f and len(f) for f in out["footprint"]] == [4, None, None, 3] and out["holes"][0] == [[{"lon": 6.0, "lat": 6.0}, {"lon": 7.0, "lat": 6.0}, {"lon": 7.0, "lat": 7.0}]]


def test_stream_equals_batch(spark, tmp_path):
    base = spark.range(600).select(F.lit("c").alias("clip"), F.col("id").alias("frame_idx"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / 10).alias("ts"), (F.col("id") * 37 % 101).cast("double").alias("sharpness"))
    base.orderBy("frame_idx").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = frames.best_frames(spark.read.parquet(str(tmp_path / "in")), ["clip"])
    stream = frames.best_frames(spark.readStream.schema(base.schema).parquet(str(tmp_path / "in")), ["clip"])
    query = stream.writeStream.format("memory").queryName("best").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want, got = {tuple(r) for r in batch.collect()}, {tuple(r) for r in spark.table("best").collect()}
    assert len(want) >= 60 and got == want


def test_backend_registry():
    assert backends.names() == ["chunks", "rgbd"] and backends.get("rgbd", stride=2).stride == 2
    with pytest.raises(KeyError):
        backends.get("none")


def test_site_models(spark, tmp_path):
    from planweave.plans import site

    (tmp_path / "a.json").write_text(json.dumps(ANSWER))
    found = buildings.by_relevance(buildings.read_overpass(spark, str(tmp_path / "a.json")), 41.00005, 2.0001)
    faces = site.prisms(found, 41.0, 2.0).groupBy("scene_id").count().collect()
    assert {r.scene_id: r["count"] for r in faces} == {"way/1": 6, "way/2": 5}
    out = site.export(found, 41.0, 2.0, str(tmp_path / "out")).collect()
    assert len(out) == 14 and "V1" in (tmp_path / "out" / "way-1.svg").read_text()
    rng = np.random.default_rng(0)
    pts = spark.createDataFrame([("s", float(x), float(y)) for x, y in rng.uniform(0, 4, (3000, 2))], "scene_id string, x double, y double")
    assert site.footprints(pts).first().footprint_m2 == pytest.approx(16, rel=0.03)

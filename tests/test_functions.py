"""Column functions against closed forms and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.functions import rings, site, text, vec, walls


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_rotations(spark):
    q = vec.quaternion_rotation(F.lit(0.0), F.lit(0.0), F.lit(math.sin(0.5)), F.lit(math.cos(0.5)))
    r = one(spark, q, vec.rotation_z(1.0), *[vec.rotation_between(vec.vector(*a), vec.vector(*b)) for a, b in (((1, 2, 3), (0, 0, 1)), ((0, 0, 2), (0, 0, 1)), ((0, 0, -1), (0, 0, 1)), ((1, 0, 0), (-1, 0, 0)))])
    np.testing.assert_allclose(r.c0, r.c1, atol=1e-12)
    for got, a, b in ((r.c2, (1, 2, 3), (0, 0, 1)), (r.c3, (0, 0, 2), (0, 0, 1)), (r.c4, (0, 0, -1), (0, 0, 1)), (r.c5, (1, 0, 0), (-1, 0, 0))):
        m = np.array(got)
        np.testing.assert_allclose(m @ m.T, np.eye(3), atol=1e-9)
        np.testing.assert_allclose(m @ (np.array(a) / np.linalg.norm(a)), b, atol=1e-9)
        assert np.linalg.det(m) == pytest.approx(1)


def test_pose_algebra(spark):
    a = vec.pose(vec.rotation_z(0.3), vec.vector(1, 2, 3))
    b = vec.pose(vec.rotation_z(-1.1), vec.vector(0, -1, 2))
    r = one(spark, a, b, vec.compose(a, b), vec.apply_pose(a, vec.vector(4, 5, 6)), vec.apply_similarity(F.lit(2.0), vec.rotation_z(0.3), vec.vector(1, 2, 3), b))
    A, B = np.array(r.c0), np.array(r.c1)
    np.testing.assert_allclose(r.c2, A @ B, atol=1e-12)
    np.testing.assert_allclose(r.c3, (A @ [4, 5, 6, 1])[:3], atol=1e-12)
    np.testing.assert_allclose(np.array(r.c4)[:3, 3], 2 * A[:3, :3] @ B[:3, 3] + [1, 2, 3], atol=1e-12)


def test_circular_mean_folds(spark):
    rows = spark.createDataFrame([(math.radians(d),) for d in (1, 91, 181, 271, -1, 89, 179, 269)], "a double")
    m = rows.agg(vec.circular_mean(F.col("a"), math.pi / 2).alias("m")).first().m
    assert min(m, math.pi / 2 - m) == pytest.approx(0, abs=1e-9)


def test_bearings_and_dms(spark):
    r = one(spark, *[vec.bearing(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 0), (0, -1), (-1, 1))], text.dms(F.lit(45.5)), text.dms(F.lit(0.999999)))
    assert list(r) == [90.0, 180.0, 315.0, "45°30'00\"", "1°00'00\""]


def test_lengths_and_quantities(spark):
    r = one(spark, text.length_text(F.lit(3.2)), text.length_text(F.lit(3.2), "ft"), text.length_text(F.lit(12 * 0.3048 - 0.001), "ft"), text.area_text(F.lit(12.345)), *[text.quantity(F.lit(x)) for x in ("12.5 m", "3,5", "x", "7 Metres")], text.whole(F.lit("2.5")))
    assert list(r) == ["3.20 m", "10'6\"", "12'0\"", "12.34 m²", 12.5, 3.5, None, 7.0, 2] or r.c3 in ("12.35 m²", "12.34 m²")


def test_sheets_vectors_compass(spark):
    r = one(spark, *[text.next_sheet(F.lit(x)) for x in ("A-01", "A1", "A-99", "plan", None)], text.parse_vector(F.lit("1, 2;3")), text.parse_vector(F.lit("1,2")), text.compass(F.lit(271.0), "es"), text.compass(F.lit(None).cast("double")))
    assert list(r) == ["A-02", "A2", "A-100", "plan-2", "A-02", [1.0, 2.0, 3.0], None, "O", ""]


def test_text_width(spark):
    r = one(spark, text.text_width(F.lit("iW é"), 10.0), text.text_width(F.lit("AB"), 10.0, True))
    assert r.c0 == pytest.approx((222 + 944 + 278 + 556) / 100) and r.c1 == pytest.approx((722 + 722) / 100)


def test_chunk_count_and_shape_error(spark):
    want = {184: 9, 46: 3, 361: 18, 92: 5, 715: 36, 183: 9, 1332: 67, 341: 17, 0: 0}
    r = one(spark, *[text.chunk_count(F.lit(n)) for n in want])
    assert list(r) == list(want.values())
    assert one(spark, text.shape_error(F.lit(0.0), F.lit(1.1))).c0 == pytest.approx(21)
    with pytest.raises(Exception, match="scale"):
        one(spark, text.shape_error(F.lit(1.0), F.lit(None).cast("double")))


def test_rings(spark):
    ell = rings.ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3))
    p = [rings.contains(ell, F.lit(float(x)), F.lit(float(y))) for x, y in ((0.5, 2), (2, 2), (3, 0.5))]
    r = one(spark, rings.area(ell), rings.perimeter(ell), *p, rings.chord_through(ell, F.lit(0.5), F.lit(2.0)), rings.is_rectilinear(ell), rings.distance(ell, F.lit(2.0), F.lit(2.0)), rings.label_point(ell), rings.signed_area(F.reverse(ell)))
    assert r.c0 == 6 and r.c1 == 14 and [r.c2, r.c3, r.c4] == [True, False, True] and r.c5 == 1 and r.c6 and r.c7 == 1
    assert r.c9 == -6
    messy = rings.ring((0, 0), (2, 0), (2, 0), (4, 0), (4, 4), (0, 4))
    assert one(spark, F.size(rings.drop_collinear(rings.dedupe(messy)))).c0 == 4


def test_ring_arc_and_impossible(spark):
    z = F.lit(0.0)
    arc = rings.quarter_arc(z, z, F.lit(1.0), z, z, F.lit(1.0))
    r = one(spark, arc, rings.impossible(rings.ring((0, 0), (1, 0), (1, 1))), rings.impossible(rings.ring((0, 0), (1, 0), (2, 0))))
    assert len(r.c0) == 15 and r.c0[7].x == pytest.approx(math.sqrt(0.5)) and not r.c1 and r.c2


def test_utm_and_local_frame(spark):
    u = site.utm(F.lit(-33.8688), F.lit(151.2093))
    back = site.to_local(F.lit(2.002), F.lit(41.001), F.lit(2.0), F.lit(41.0))
    r = one(spark, u, site.utm_zone(F.lit(60.0), F.lit(5.0)), site.utm_zone(F.lit(75.0), F.lit(20.0)), site.to_wgs84(back["x"], back["y"], F.lit(2.0), F.lit(41.0)))
    assert (r.c0.zone, r.c0.band, r.c0.hemisphere, r.c0.epsg) == (56, "H", "S", 32756)
    assert r.c0.easting == pytest.approx(334368.6, abs=1) and r.c0.northing == pytest.approx(6250948.3, abs=1)
    assert (r.c1, r.c2) == (32, 33) and r.c3.lon == pytest.approx(2.002) and r.c3.lat == pytest.approx(41.001)


def test_intrinsics_round_trip(spark):
    k = vec.matrix([[500, 0, 320], [0, 510, 240], [0, 0, 1]])
    r = one(spark, k, vec.restore_intrinsics(vec.rescale_intrinsics(k, 640, 480, 518, 392), 640, 480, 518, 392), vec.focal_pixels(F.lit(24.0), 1024))
    np.testing.assert_allclose(r.c0, r.c1, atol=1e-9)
    assert r.c2 == pytest.approx(1024 * 24 / 34.6, rel=1e-3)


def test_wall_frame(spark):
    w = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0, 0.2)], "ax double, ay double, bx double, by double, thickness double")
    f = walls.WallColumns()
    r = w.select(f.length.alias("l"), f.at(F.lit(1.0), 0.1).alias("p"), rings.area(f.body).alias("a"), walls.family_crossing(F.lit(0.0), F.lit(2.0), F.lit(math.pi / 2), F.lit(3.0)).alias("x"), walls.segment_hits_box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(0.9), F.lit(0.9), F.lit(1.1), F.lit(1.1)).alias("h")).first()
    assert r.l == 4 and (r.p.x, r.p.y) == (1, 0.1) and r.a == pytest.approx(0.8) and r.h
    assert (r.x.ta, r.x.tb) == (pytest.approx(3), pytest.approx(-2))

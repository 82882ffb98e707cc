"""Sheets, drawings with layers, edits and the command line."""

import re

import pytest
from pyspark.sql import functions as F

from planweave import cli
from planweave.plans import quality, schedules
from planweave.sources import sheets, sinks

WALL = "scene_id string, id int, ax double, ay double, bx double, by double, thickness double, height double, sides_seen int, line_id int, exterior boolean"
OPENING = "scene_id string, id int, wall_id int, kind string, t0 double, t1 double, z0 double, z1 double, rooms array<int>, tag string, height_measured boolean"
ROOM = "scene_id string, id int, name string, polygon array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, closed boolean, floor_seen double"


@pytest.fixture(scope="module")
def plan(spark):
    ends = [(0.0, -0.1, 5.0, -0.1), (5.1, 0.0, 5.1, 4.0), (5.0, 4.1, 0.0, 4.1), (-0.1, 4.0, -0.1, 0.0)]
    walls = spark.createDataFrame([("s", i, *map(float, e), 0.2, 2.5, 2 - (i == 1), i, True) for i, e in enumerate(ends)], WALL)
    openings = spark.createDataFrame([("s", 0, 0, "door", 1.0, 1.9, 0.0, 2.05, [0], "P1", False), ("s", 1, 2, "window", 0.5, 1.7, 0.9, 2.1, [0], "V1", True)], OPENING)
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (5.0, 0.0), (5.0, 4.0), (0.0, 4.0))]
    rooms = spark.createDataFrame([("s", 0, "room", ring, [], True, 0.9)], ROOM)
    report = spark.createDataFrame([("s", False, "network", None, None, 20.0, None, None, None, None, None)], "scene_id string, ceiling_measured boolean, source string, scale_factor double, views int, footprint_m2 double, video_fps double, sample_fps double, video_frames int, chunk_scales array<double>, mask_fraction double")
    info = spark.createDataFrame([("s", "House <1>", "A-03", 30.0, 50.0)], "scene_id string, project string, sheet string, north_deg double, scale double")
    return {"walls": walls, "openings": openings, "rooms": rooms, "info": info, "findings": quality.findings(report, rooms, walls, openings), "stamps": quality.stamps(report)}


def test_sheet(spark, plan, tmp_path):
    out = sinks.export(plan, f"file://{tmp_path}", ("sheet.svg", "sheet.dxf", "sheet.pdf", "iso.png", "elevations.pdf"), lang="es")
    assert {r.format for r in out.collect()} == {"sheet.svg", "sheet.dxf", "sheet.pdf", "iso.png", "elevations.pdf"}
    svg = (tmp_path / "s.sheet.svg").read_text()
    words = re.findall(r">([^<>]+)</text>", svg)
    for said in ("20.00 m²", "0.90 m", "4.00 m", "3.10 m", "P1", "V1", "M1", "M4", "A", "B", "1", "2", "Superficie útil", "puerta", "ventana", "Proyecto: House &lt;1&gt;", "Plano: A-03", "Escala: 1:50", "N", "SIN ESCALA: la escala no está calibrada", "1. M2: espesor de 0.20 m supuesto"):
        assert said in words, said
    for layer in ("room", "wall", "opening", "swing", "dims", "axis", "label", "table", "title", "stamp"):
        assert f'class="{layer}"' in svg
    dxf = (tmp_path / "s.sheet.dxf").read_text().split("\n")
    codes = list(zip(dxf[::2], dxf[1::2]))
    assert len(dxf) % 2 and ("9", "$INSUNITS") in codes and codes[-1] == ("0", "EOF")
    declared = {b for (a, b), (p, q) in zip(codes[1:], codes) if a == "2" and (p, q) == ("0", "LAYER")}
    used = {b for a, b in codes if a == "8"}
    assert used == declared and "DIMS" in used
    assert sum(c == ("0", "SECTION") for c in codes) == sum(c == ("0", "ENDSEC") for c in codes) == 3
    assert (tmp_path / "s.iso.png").read_bytes().startswith(b"\x89PNG") and (tmp_path / "s.elevations.pdf").read_bytes().startswith(b"%PDF")


def test_door_swing_ends_at_the_jamb(spark, plan):
    leaf, arc = (p.first() for p in sheets.door_swings(plan["openings"], plan["walls"], plan["rooms"]))
    assert [(round(p.x, 6), round(p.y, 6)) for p in leaf.points] == [(1.0, -0.1), (1.0, 0.8)]
    assert (round(arc.points[-1].x, 6), round(arc.points[-1].y, 6)) == (1.9, -0.1) and len(arc.points) == 15


def test_edits(spark, plan):
    names = spark.createDataFrame([("s", 0, None, "Kitchen")], "scene_id string, id int, old string, new string")
    w, o, r = schedules.edited(plan["walls"], plan["openings"], plan["rooms"], names, door_width=1.8)
    assert r.first().name == "Kitchen" and w.filter("id = 0").first().bx == pytest.approx(10.0) and o.filter("kind = 'door'").first().t1 == pytest.approx(3.8)
    assert schedules.edited(plan["walls"], plan["openings"], plan["rooms"])[0] is plan["walls"]
    with pytest.raises(ValueError):
        schedules.edited(plan["walls"], plan["openings"], plan["rooms"], scale=0.0)


def test_command_line(spark, plan, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    probes = spark.createDataFrame([("c", i, float(i % 7 * 10)) for i in range(60)], "clip_id string, frame_idx int, sharpness double")
    probes.write.parquet(f"{tmp_path}/probes")
    assert cli.main(["frames", f"{tmp_path}/probes", f"{tmp_path}/best", "--window", "20"]) == 0
    assert spark.read.parquet(f"{tmp_path}/best").count() == 3
    p = cli.argparse.ArgumentParser()
    cli.edits(p)
    a = p.parse_args(["--name", "0=Hall", "--name", "x=Y", "--scale", "2", "--project", "P", "--north", "10", "--lang", "es"])
    done = cli.with_edits(spark, plan, a)
    assert done["rooms"].first().name == "Hall" and done["info"].select("project", "north_deg").first() == ("P", 10.0)
    assert done["walls"].agg(F.max("bx")).first()[0] == pytest.approx(10.2)

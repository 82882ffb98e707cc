"""Command line: ``python -m planweave COMMAND``; thin wrappers for spark-submit."""

from __future__ import annotations

import argparse

from .session import session


def edits(p: argparse.ArgumentParser) -> None:
    """Options that change a plan after it is made, or how its sheets look."""
    p.add_argument("--name", action="append", default=[], metavar="ROOM=NAME", help="new name of a room, by its number or old name")
    p.add_argument("--scale", type=float, help="factor of every length")
    p.add_argument("--door-width", type=float, help="true width of the median door, in metres")
    p.add_argument("--project")
    p.add_argument("--sheet")
    p.add_argument("--north", type=float, help="degrees clockwise from the sheet's upward direction")
    p.add_argument("--paper", default="A4")
    p.add_argument("--units", choices=("m", "ft"), default="m")
    p.add_argument("--lang", choices=("en", "es"), default="en")


def with_edits(spark, tables: dict, a) -> dict:
    """Plan tables after the options of ``edits``, with the title block's ``info``."""
    from pyspark.sql import functions as F

    from .plans import schedules

    scenes = tables["walls"].select("scene_id").distinct()
    names = None
    if a.name:
        pairs = [x.partition("=")[::2] for x in a.name]
        rows = [(int(k), None, v) if k.isdigit() else (None, k, v) for k, v in pairs]
        names = scenes.join(spark.createDataFrame(rows, "id int, old string, new string"))  # a few names for each scene
    walls, openings, rooms = schedules.edited(tables["walls"], tables["openings"], tables["rooms"], names, a.scale, a.door_width)
    extents = schedules.print_scale(schedules.bounds(walls, rooms), a.paper)
    text = lambda v, kind: F.lit(v).cast(kind)
    info = extents.select("scene_id", text(a.project, "string").alias("project"), text(a.sheet, "string").alias("sheet"), text(a.north, "double").alias("north_deg"), "scale")
    return {**tables, "walls": walls, "openings": openings, "rooms": rooms, "info": info}


def write(spark, tables: dict, a, ceiling: float | None = None) -> None:
    from .sources import sinks

    done = with_edits(spark, tables, a)
    sinks.export(done, a.out, tuple(a.formats.split(",")), ceiling, a.units, a.lang, a.paper).show(100, False)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="planweave")
    sub = p.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("demo", help="plan a synthetic scene and export it")
    demo.add_argument("out")
    demo.add_argument("--scene", default="two_rooms")
    plan = sub.add_parser("plan", help="plan the point clouds of a folder")
    plan.add_argument("clouds", help="PLY files, or Parquet in the points schema")
    plan.add_argument("cameras", help="Parquet in the cameras schema")
    plan.add_argument("out")
    plan.add_argument("--rooms-from", choices=("floor", "walls"), default="floor")
    render = sub.add_parser("render", help="export stored plan documents")
    render.add_argument("plans")
    render.add_argument("out")
    model = sub.add_parser("model", help="solid models of stored plan documents")
    model.add_argument("plans")
    model.add_argument("out")
    model.add_argument("--ceiling", type=float)
    for command in (demo, plan, render, model):
        command.add_argument("--formats", default="obj,glb,dxf3d,iso.svg" if command is model else "svg,dxf,obj,glb,html,sheet.svg,sheet.pdf")
        edits(command)
    tum = sub.add_parser("tum", help="frames of an RGB-D recording, matched by time")
    tum.add_argument("folder")
    tum.add_argument("out")
    tum.add_argument("--stride", type=int, default=1)
    frames = sub.add_parser("frames", help="the sharpest frame of every window (Parquet: clip_id, frame_idx, sharpness)")
    frames.add_argument("probes")
    frames.add_argument("out")
    frames.add_argument("--window", type=int, default=30)
    frames.add_argument("--least", type=float, default=20.0)
    rebuild = sub.add_parser("reconstruct", help="points of depth views (Parquet in the views schema)")
    rebuild.add_argument("views")
    rebuild.add_argument("out")
    rebuild.add_argument("--voxel", type=float, default=0.02)
    site = sub.add_parser("site", help="survey saved building footprints")
    site.add_argument("answers")
    site.add_argument("--lat", type=float, required=True)
    site.add_argument("--lon", type=float, required=True)
    phone = sub.add_parser("phone", help="phone and focal length of videos")
    phone.add_argument("videos", nargs="+")
    phone.add_argument("--width", type=int, default=1920)
    check = sub.add_parser("check", help="usable windows of probed clips (Parquet: clip_id, frame_idx, sharpness, flatness)")
    check.add_argument("probes")
    check.add_argument("--window", type=int, default=30)
    sub.add_parser("doctor", help="what this installation can do")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.command == "version":
        from . import __version__

        print(__version__)
        return 0
    spark = session()
    if a.command == "doctor":
        from . import backends
        from .sources import synthetic

        print(f"spark {spark.version}; backends {', '.join(backends.names())}; scenes {', '.join(synthetic.scenes())}")
    elif a.command in ("demo", "plan"):
        from .plans import planner
        from .sources import ply, synthetic

        if a.command == "demo":
            points, cameras = synthetic.sample(spark, [a.scene])
            options = planner.Options()
        else:
            ply.register(spark)
            points = spark.read.format("ply").load(a.clouds) if a.clouds.endswith(".ply") else spark.read.parquet(a.clouds)
            cameras = spark.read.parquet(a.cameras)
            options = planner.Options(rooms_from=a.rooms_from)
        t = planner.plan(points, cameras, options)
        for name in ("walls", "openings", "rooms", "extra_walls"):
            t[name].write.mode("overwrite").parquet(f"{a.out}/{name}")
        write(spark, {k: t[k] for k in ("walls", "openings", "rooms")}, a)
    elif a.command in ("render", "model"):
        from .sources import plans

        write(spark, plans.read(spark, a.plans), a, getattr(a, "ceiling", None))
    elif a.command == "tum":
        from .sources import lists

        lists.sequence(spark, a.folder, stride=a.stride).write.mode("overwrite").parquet(a.out)
    elif a.command == "frames":
        from .operators import select

        select.window_best(spark.read.parquet(a.probes), ["clip_id"], "frame_idx", a.window, "sharpness", a.least).write.mode("overwrite").parquet(a.out)
    elif a.command == "reconstruct":
        from .operators import fusion

        fusion.fuse(spark.read.parquet(a.views), voxel=a.voxel).write.mode("overwrite").parquet(a.out)
    elif a.command == "site":
        from .plans import survey
        from .sources import buildings

        found = buildings.by_relevance(buildings.read_overpass(spark, a.answers), a.lat, a.lon)
        buildings.describe(found, a.lat, a.lon).show(40, False)
        survey.lots(found, a.lat, a.lon).show(40, False)
    elif a.command == "phone":
        from .sources import video

        video.with_focal(video.metadata(spark, a.videos), a.width).select("path", "model", "make", "phone.name", "focal_px").show(100, False)
    elif a.command == "check":
        from .operators import aggregate

        aggregate.video_profile(spark.read.parquet(a.probes), ["clip_id"], "frame_idx", a.window).show(100, False)
    return 0

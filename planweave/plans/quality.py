"""Checks that a plan must pass before it is trusted: one row a finding.

Every rule is an expression over one row a scene that yields (key, level, params); nothing is
looped over scenes. ``params`` are texts for a message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings
from ..operators.graph import checkpointed
from . import shapes, tidy

MIN_FRAMES_PER_M2 = 1.5
CHAIN_RANGE_MAX = 10.0
MESSAGES = {
    "open_room": "rooms without a closed outline: {items}",
    "no_rooms": "no room was found",
    "rooms_overlap": "rooms share {m2} m2 of floor",
    "opening_orphan": "openings on no wall: {items}",
    "room_no_way_in": "enclosed rooms without a door: {items}",
    "impossible_geometry": "shapes that cannot be: {items}",
    "sampled_too_sparsely": "{n} of {total} frames were used, {rate} a square metre",
    "too_few_frames": "{n} frames over {m2} m2, {rate} a square metre; {want} are wanted",
    "floor_seen": "outlines drawn over floor that was not seen: {items} ({pct} %)",
    "thickness": "{n} of {m} walls have an assumed thickness",
    "ceiling": "the ceiling was not seen; its height is the default",
    "unreliable": "{bad} of {n} stretches lost their scale; {cover} % of a frame was kept",
    "scale_chain": "over {links} links the scale drifted {times} times",
    "scale": "the scale is not calibrated",
    "door_height": "door heights are assumed: {items}",
    "no_windows": "no window was found",
    "ok": "nothing to report",
}


def _finding(when, key: str, level: str, **params):
    """The finding where it holds, else null."""
    pairs = [x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]
    told = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.when(when, F.struct(F.lit(key).alias("key"), F.lit(level).alias("level"), told.alias("params")))


def _items(rows, name, order=None):
    """Names of the rows of an array in their order."""
    named = F.transform(rows, lambda x: F.struct((x["id"] if order is None else order(x)).alias("o"), name(x).alias("n")))
    return F.array_join(F.transform(F.array_sort(named), lambda x: x["n"]), ", ")


def _scales():
    return F.coalesce("chunk_scales", F.array().cast("array<double>"))


def _unreliable() -> dict:
    """Columns of a report's reconstruction: whether it fell apart, bad links, stretches, kept share."""
    scales = _scales()
    off = lambda lo, hi: F.size(F.filter(scales, lambda s: (s < lo) | (s > hi)))
    spread = F.when((F.size(scales) > 0) & (F.array_min(scales) > 0), F.array_max(scales) / F.array_min(scales)).otherwise(1.0)
    cover, bad = F.coalesce("mask_fraction", F.lit(1.0)), off(0.5, 2.0)
    told = F.col("chunk_scales").isNotNull() | F.col("mask_fraction").isNotNull()
    return {"wrong": told & ((bad > 0) | (spread > 2.5) | (cover < 0.10)), "bad": F.when((bad == 0) & (spread > 2.5), off(0.7, 1.4)).otherwise(bad), "n": F.size(scales) + 1, "cover": cover}


def _drift() -> dict:
    """Columns of how far the running scale came: times, links. A fold inside the row."""
    scales = F.filter(_scales(), lambda s: s > 0)
    start = F.struct(F.lit(1.0).alias("acc"), F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi"))
    step = lambda a, s: F.struct((a["acc"] * s).alias("acc"), F.least(a["lo"], a["acc"] * s).alias("lo"), F.greatest(a["hi"], a["acc"] * s).alias("hi"))
    return {"times": F.aggregate(scales, start, step, lambda a: a["hi"] / a["lo"]), "links": F.size(scales)}


def reliability(plans: DataFrame) -> DataFrame:
    """Scenes whose reconstruction fell apart: bad links, stretches, kept share of a frame."""
    c = _unreliable()
    return plans.filter(c["wrong"]).select("scene_id", *[c[k].alias(k) for k in ("bad", "n", "cover")])


def chain_break(plans: DataFrame) -> DataFrame:
    """Scenes whose running scale left a range of ten: times, links."""
    c = _drift()
    return plans.select("scene_id", c["times"].alias("times"), c["links"].alias("links")).filter(F.col("times") > CHAIN_RANGE_MAX)


def uncalibrated(plans: DataFrame) -> DataFrame:
    return plans.filter("source = 'network' and scale_factor is null").select("scene_id")


def stamps(plans: DataFrame) -> DataFrame:
    """The stamp of a sheet: a lost chain before a broken reconstruction before a missing scale."""
    tag = lambda df, k, o: df.select("scene_id", F.lit(o).alias("o"), F.lit(k).alias("stamp"))
    every = tag(chain_break(plans), "stamp_chain", 0).unionByName(tag(reliability(plans), "stamp_unreliable", 1)).unionByName(tag(uncalibrated(plans), "stamp", 2))
    return every.groupBy("scene_id").agg(F.min_by("stamp", "o").alias("stamp"))


def enclosure(wide: DataFrame) -> DataFrame:
    """Overlap of each scene's rooms and the rooms walled all round with no way in: scene_id,
    overlap, shut. One group a scene, over its plan (``rooms``, ``walls``, ``openings`` as arrays)."""
    ways = F.transform(F.filter("openings", lambda o: o["kind"].isin("door", "passage")), lambda o: o["wall_id"])

    def run(batches):
        for b in batches:
            out = []
            for scene, rms, wls, wys in b[["scene_id", "rooms", "walls", "ways"]].itertuples(index=False):
                areas = tidy.regions(rms)
                overlap = sum(map(shapes.area, areas)) - shapes.area(shapes.union(*areas))
                wls = [x if isinstance(x, dict) else x.asDict() for x in (wls if wls is not None else [])]
                solid = tidy.bodies(wls)
                doors = [tidy.body(x) for x in wls if wys is not None and x["id"] in set(wys)]
                shut = []
                for room, region in zip(rms, areas):
                    grown = region + [-0.35, -0.35, 0.35, 0.35]
                    if any(shapes.area(shapes.common(grown, d)) > 0 for d in doors) or not len(solid):
                        continue
                    ring = shapes.outline(region)[0]
                    near = solid + [-0.10, -0.10, 0.10, 0.10]
                    length = backed = 0.0
                    for p, q in zip(ring, ring[1:] + ring[:1]):
                        length += abs(p[0] - q[0]) + abs(p[1] - q[1])
                        backed += sum(t1 - t0 for t0, t1 in shapes.along(near, p, q))
                    if backed >= 0.90 * length:
                        shut.append(room["name"])
                out.append((scene, float(overlap), shut))
            yield pd.DataFrame(out, columns=["scene_id", "overlap", "shut"])

    held = wide.filter("size(rooms) > 0").select("scene_id", "rooms", "walls", ways.alias("ways"))
    return held.mapInPandas(run, "scene_id string, overlap double, shut array<string>")


def findings(plans: DataFrame, rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Findings of every scene. ``plans`` has a row a scene: scene_id, ceiling_measured, source,
    scale_factor, views, footprint_m2, video_fps, sample_fps, video_frames, chunk_scales,
    mask_fraction (all but the first may be null). A scene with nothing but good news gets ``ok``.

    A plan's rooms, walls and openings come together in one row a scene, which every rule reads."""
    held = lambda df, name, *columns: df.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("id", *columns))).alias(name))
    wide = plans.withColumn("planned", F.lit(True)).join(held(rooms, "rooms", "name", "closed", "floor_seen", "polygon", "holes"), "scene_id", "full")
    wide = wide.join(held(walls, "walls", "ax", "ay", "bx", "by", "thickness", "sides_seen"), "scene_id", "full")
    wide = wide.join(held(openings, "openings", "wall_id", "kind", "tag", "height_measured"), "scene_id", "full")
    none = lambda name: F.coalesce(name, F.array().cast(wide.schema[name].dataType)).alias(name)
    wide = checkpointed(wide.select(*[none(c) if c in ("rooms", "walls", "openings") else c for c in wide.columns]))
    wide = wide.join(enclosure(wide), "scene_id", "left")

    yes = lambda c: F.coalesce(c, F.lit(False))
    planned, name = yes(F.col("planned")), lambda x: x["name"]
    tag = lambda o: F.coalesce(F.nullif(o["tag"], F.lit("")), o["kind"])
    open_ = F.filter("rooms", lambda r: yes(~r["closed"]))
    wall_ids = F.transform("walls", lambda w: w["id"])
    orphan = F.filter("openings", lambda o: ~yes(F.array_contains(wall_ids, o["wall_id"])))
    bad = F.filter("rooms", lambda r: rings.impossible(r["polygon"]))
    flat = F.filter("walls", lambda w: yes((F.hypot(w["bx"] - w["ax"], w["by"] - w["ay"]) <= 0) | (w["thickness"] <= 0)))
    impossible = F.array_join(F.filter(F.array(F.nullif(_items(bad, name), F.lit("")), F.nullif(_items(flat, lambda w: F.concat(F.lit("wall "), w["id"].cast("string"))), F.lit(""))), lambda x: x.isNotNull()), ", ")
    rate = F.col("views") / F.col("footprint_m2")
    sparse = yes((F.col("views") > 0) & (F.col("footprint_m2") > 1.0) & (rate < MIN_FRAMES_PER_M2))
    ours = yes((F.coalesce("video_fps", F.lit(0.0)) > 0) & (F.coalesce("sample_fps", F.lit(0.0)) > 0) & (F.col("video_fps") > 2 * F.col("sample_fps")))
    shown, want = F.format_string("%.1f", F.bround(rate, 1)), F.ceil(F.lit(MIN_FRAMES_PER_M2) * F.col("footprint_m2"))
    thin = F.filter("rooms", lambda r: yes(r["floor_seen"] < 0.5))
    pct = F.bround(100 * F.aggregate(thin, F.lit(0.0), lambda a, r: a + r["floor_seen"]) / F.size(thin)).cast("int")
    assumed, all_ = F.size(F.filter("walls", lambda w: yes(w["sides_seen"] == 1))), F.size("walls")
    lost, drift = _unreliable(), _drift()
    guessed = F.filter("openings", lambda o: yes((o["kind"] == "door") & ~o["height_measured"]))
    every = [
        _finding(F.size(open_) > 0, "open_room", "warn", items=_items(open_, name)),
        _finding(planned & (F.size("rooms") == 0), "no_rooms", "warn"),
        _finding(yes(F.col("overlap") > 1e-6), "rooms_overlap", "warn", m2=F.format_string("%.2f", F.bround("overlap", 2))),
        _finding(F.size(orphan) > 0, "opening_orphan", "warn", items=_items(orphan, tag)),
        _finding(yes(F.size("shut") > 0), "room_no_way_in", "warn", items=F.array_join("shut", ", ")),
        _finding((F.size(bad) > 0) | (F.size(flat) > 0), "impossible_geometry", "warn", items=impossible),
        _finding(sparse & ours, "sampled_too_sparsely", "warn", n=F.col("views"), total=F.coalesce("video_frames", F.lit(0)), rate=shown),
        _finding(sparse & ~ours, "too_few_frames", "warn", n=F.col("views"), m2=F.bround("footprint_m2").cast("int"), rate=shown, want=want),
        _finding(F.size(thin) > 0, "floor_seen", "warn", items=_items(thin, name), pct=pct),
        _finding(assumed > 0, "thickness", "info", n=assumed, m=all_),
        _finding((all_ > 0) & (assumed == 0), "thickness", "ok", n=assumed, m=all_),
        _finding(yes(~F.col("ceiling_measured")), "ceiling", "warn"),
        _finding(yes(lost["wrong"]), "unreliable", "warn", bad=lost["bad"], n=lost["n"], cover=F.bround(100 * lost["cover"]).cast("int")),
        _finding(yes(drift["times"] > CHAIN_RANGE_MAX), "scale_chain", "warn", links=drift["links"], times=F.format_string("%.0f", F.bround(drift["times"]))),
        _finding(yes((F.col("source") == "network") & F.col("scale_factor").isNull()), "scale", "warn"),
        _finding(F.size(guessed) > 0, "door_height", "info", items=_items(guessed, tag)),
        _finding((F.size("rooms") > 0) & ~F.exists("openings", lambda o: yes(o["kind"] == "window")), "no_windows", "info"),
    ]
    told = wide.select("scene_id", "planned", F.array_compact(F.array(*every)).alias("told"))
    fine = planned & F.forall("told", lambda f: f["level"] == "ok")
    return told.select("scene_id", F.explode(F.concat("told", F.array_compact(F.array(_finding(fine, "ok", "ok"))))).alias("f")).select("scene_id", "f.*")


def with_messages(found: DataFrame, lang: str = "en") -> DataFrame:
    """Findings with a ``text`` made from key and params."""
    from ..functions.words import MESSAGES_ES

    table = F.create_map(*[F.lit(x) for kv in (MESSAGES_ES if lang == "es" else MESSAGES).items() for x in kv])
    text = F.element_at(table, F.col("key"))
    for name in ("items", "m2", "n", "total", "rate", "want", "pct", "m", "bad", "cover", "links", "times"):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.try_element_at("params", F.lit(name)), F.lit("")))
    return found.withColumn("text", text)


def notes(found: DataFrame, walls: DataFrame, lang: str = "en") -> DataFrame:
    """General notes of a sheet in order: assumed thicknesses by value, then the findings that are
    not good news: scene_id, position, text."""
    by = walls.filter("sides_seen = 1").groupBy("scene_id", F.bround("thickness", 2).alias("th")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: F.concat(F.lit("M"), (i + 1).cast("string"))), ", ").alias("ids"))
    first = by.select("scene_id", F.lit(0).alias("o"), F.col("th").alias("p"), F.concat("ids", F.format_string(": espesor de %.2f m supuesto" if lang == "es" else ": thickness %.2f m assumed", "th")).alias("text"))
    rest = with_messages(found, lang).filter("level <> 'ok' and key <> 'thickness'").select("scene_id", F.lit(1).alias("o"), F.lit(0.0).alias("p"), "text")
    w = Window.partitionBy("scene_id").orderBy("o", "p", "text")
    return first.unionByName(rest).withColumn("position", F.row_number().over(w)).select("scene_id", "position", "text")

"""Drawings and models of plans as files, one a scene and format.

A drawing is a table of primitives in metres (scene_id, seq, kind, points, text, layer); the
text formats are assembled by Spark expressions, the binary ones by a map over scenes. A
writer task creates its files under their final names in one step and returns what it wrote."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rings, text
from ..functions.walls import WallColumns
from ..plans import schedules

W = WallColumns()
# Layer: stroke, fill (the look of this engine's own sheets).
STYLE = {
    "room": ("#b8b8b8", "#f4f1ea"), "wall": ("#202020", "#404040"), "opening": ("#2a6f97", "#ffffff"), "label": ("#202020", None), "open": ("#c1121f", None), "swing": ("#2a6f97", None), "dims": ("#5a5a5a", None),
    "axis": ("#8a6d3b", "#ffffff"), "table": ("#202020", None), "title": ("#202020", None), "stamp": ("#c1121f", None),
}
DASHED = ("open", "axis")
TEXT_SIZE = 0.15  # metres, where a drawing gives no sizes


def write_files(contents: DataFrame, folder: str) -> DataFrame:
    """``contents(scene_id, format, content binary)`` -> files ``folder/scene.format``."""

    def run(batches):
        from .ply import files_of

        for b in batches:
            out = []
            for scene, kind, raw in b[["scene_id", "format", "content"]].itertuples(index=False):
                uri = f"{folder.rstrip('/')}/{scene}.{kind}"
                files, path = files_of(uri)
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(path, compression=None) as f:
                    f.write(raw)
                out.append((scene, kind, uri, len(raw)))
            yield pd.DataFrame(out, columns=["scene_id", "format", "path", "bytes"])

    return contents.mapInPandas(run, "scene_id string, format string, path string, bytes long")


def drawing(walls: DataFrame, openings: DataFrame, rooms: DataFrame, labelled: bool = True) -> DataFrame:
    """Primitives of a plan: rooms, wall bodies, openings, labels, open sides, back to front."""
    none = F.lit(None).cast("string")
    prim = lambda df, order, layer, kind, pts, txt=none: df.select("scene_id", F.lit(order).alias("o"), F.col("k").cast("long").alias("k"), F.lit(kind).alias("kind"), pts.alias("points"), txt.alias("text"), F.lit(layer).alias("layer"))
    r = rooms.withColumn("k", F.col("id"))
    out = prim(r, 0, "room", "polygon", F.col("polygon"))
    out = out.unionByName(prim(walls.withColumn("k", F.col("id")), 1, "wall", "polygon", W.body))
    on = openings.withColumn("k", F.col("id")).drop("id").join(walls.withColumnRenamed("id", "wall_id").select("scene_id", "wall_id", "ax", "ay", "bx", "by", "thickness"), ["scene_id", "wall_id"])
    out = out.unionByName(prim(on, 2, "opening", "polygon", W.rectangle(F.col("t0"), F.col("t1"), F.col("thickness") / 2 + 0.002)))
    out = out.unionByName(prim(on, 3, "label", "text", F.array(W.at((F.col("t0") + F.col("t1")) / 2, 0.3)), F.col("tag")))
    label = F.concat_ws(" ", "name", text.area_text(rings.area(F.col("polygon"), F.col("holes"))))
    if labelled:
        out = out.unionByName(prim(r, 4, "label", "text", F.array(rings.label_point(F.col("polygon"))), label))
    edge = schedules.open_edges(rooms, walls).withColumn("k", F.col("room"))
    out = out.unionByName(prim(edge, 5, "open", "polyline", F.array("a", "b")))
    from pyspark.sql import Window

    w = Window.partitionBy("scene_id").orderBy("o", "k", "kind")
    return out.withColumn("seq", F.row_number().over(w)).drop("o", "k")


def _size(prims: DataFrame):
    """Height of texts in metres."""
    return F.coalesce("size", F.lit(TEXT_SIZE)) if "size" in prims.columns else F.lit(TEXT_SIZE)


def svg(prims: DataFrame, scale: float = 80.0, margin: float = 60.0) -> DataFrame:
    """scene_id, value: SVG documents made of expressions; y points up in the plan, down on the sheet."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    box = prims.groupBy("scene_id").agg(F.min(F.array_min(xs)).alias("x0"), F.max(F.array_max(xs)).alias("x1"), F.min(F.array_min(ys)).alias("y0"), F.max(F.array_max(ys)).alias("y1"))
    num = lambda c: F.format_string("%.2f", c)
    sx = lambda p: num((p["x"] - F.col("x0")) * scale + margin)
    sy = lambda p: num((F.col("y1") - p["y"]) * scale + margin)
    on = prims.join(box, "scene_id")
    path = F.array_join(F.transform("points", lambda p: F.concat(sx(p), F.lit(","), sy(p))), " ")
    stroke = F.coalesce(*[F.when(F.col("layer") == k, v[0]) for k, v in STYLE.items()])
    fill = F.coalesce(*[F.when(F.col("layer") == k, v[1] or "none") for k, v in STYLE.items()])
    first = F.get("points", F.lit(0))
    el = F.when(F.col("kind") == "text", F.format_string('<text class="%s" x="%s" y="%s" font-family="Helvetica" font-size="%s" text-anchor="middle" fill="%s">%s</text>', "layer", sx(first), sy(first), num(_size(prims) * scale), stroke, text.escape_markup(F.coalesce("text", F.lit("")))))
    el = el.when(F.col("kind") == "polyline", F.format_string('<polyline class="%s" points="%s" fill="none" stroke="%s"%s/>', "layer", path, stroke, F.when(F.col("layer").isin(*DASHED), ' stroke-dasharray="6 4"').otherwise(""))).otherwise(F.format_string('<polygon class="%s" points="%s" fill="%s" stroke="%s"/>', "layer", path, fill, stroke))
    body = on.withColumn("el", el).groupBy("scene_id", "x0", "x1", "y0", "y1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "el"))), lambda e: e["el"]), "\n").alias("body"))
    size = lambda a, b: num((F.col(b) - F.col(a)) * scale + 2 * margin)
    return body.select("scene_id", F.concat(F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%s" height="%s">\n', size("x0", "x1"), size("y0", "y1")), "body", F.lit("\n</svg>\n")).alias("value"))


def _dxf_document(body, layers, unit: float):
    """Header with units, a layer table, the entities."""
    insunits = {1.0: 6, 1000.0: 4, 100.0: 5}.get(float(unit), 0)  # metres, millimetres, centimetres (fixed values)
    header = f"0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1015\n9\n$INSUNITS\n70\n{insunits}\n9\n$MEASUREMENT\n70\n1\n0\nENDSEC\n0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLAYER\n70\n"
    table = F.concat(F.size(layers).cast("string"), F.lit("\n"), F.array_join(F.transform(layers, lambda x: F.concat(F.lit("0\nLAYER\n2\n"), x, F.lit("\n70\n0\n62\n7\n6\nCONTINUOUS\n"))), ""))
    return F.concat(F.lit(header), table, F.lit("0\nENDTAB\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"), body, F.lit("0\nENDSEC\n0\nEOF\n"))


def dxf(prims: DataFrame, unit: float = 1.0) -> DataFrame:
    """scene_id, value: ASCII drawings with units and layers declared; ``unit`` units a metre."""
    num = lambda c: F.format_string("%.6f", c * unit)
    point = lambda p, a, b: F.concat(F.lit(f"{a}\n"), num(p["x"]), F.lit(f"\n{b}\n"), num(p["y"]), F.lit("\n"))
    layer = F.upper("layer")
    poly = F.concat(F.lit("0\nLWPOLYLINE\n8\n"), layer, F.lit("\n90\n"), F.size("points").cast("string"), F.lit("\n70\n"), F.when(F.col("kind") == "polygon", "1").otherwise("0"), F.lit("\n"), F.array_join(F.transform("points", lambda p: point(p, 10, 20)), ""))
    label = F.concat(F.lit("0\nTEXT\n8\n"), layer, F.lit("\n"), point(F.get("points", F.lit(0)), 10, 20), F.lit("40\n"), num(_size(prims)), F.lit("\n1\n"), F.coalesce("text", F.lit("")), F.lit("\n72\n1\n"), point(F.get("points", F.lit(0)), 11, 21))
    rows = prims.withColumn("el", F.when(F.col("kind") == "text", label).otherwise(poly))
    body = rows.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "el"))), lambda e: e["el"]), "").alias("body"), F.sort_array(F.collect_set(layer)).alias("layers"))
    return body.select("scene_id", _dxf_document(F.col("body"), F.col("layers"), unit).alias("value"))


def dxf_solid(faces: DataFrame, unit: float = 1.0) -> DataFrame:
    """scene_id, value: 3D faces; a face of more corners is a fan of triangles."""
    at = lambda p, k: F.concat(*[x for i, c in enumerate("xyz") for x in (F.lit(f"{10 * (i + 1) + k}\n"), F.format_string("%.6f", p[c] * unit), F.lit("\n"))])
    n = F.size("face")
    tri = F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.concat(F.lit("0\n3DFACE\n8\n"), F.upper("kind"), F.lit("\n"), at(F.get("face", F.lit(0)), 0), at(F.get("face", k), 1), at(F.get("face", k + 1), 2), at(F.get("face", k + 1), 3)))
    body = faces.select("scene_id", F.upper("kind").alias("layer"), F.array_join(tri, "").alias("el")).groupBy("scene_id").agg(F.array_join(F.sort_array(F.collect_list("el")), "").alias("body"), F.sort_array(F.collect_set("layer")).alias("layers"))
    return body.select("scene_id", _dxf_document(F.col("body"), F.col("layers"), unit).alias("value"))


def _scenes(df: DataFrame, columns: list[str], make: Callable, order: list[str]) -> DataFrame:
    """scene_id, content: a file made from the rows of one scene (a plan)."""

    def run(rows):
        return pd.DataFrame({"scene_id": [rows["scene_id"].iloc[0]], "content": [make(rows.sort_values(order))]})

    return df.select("scene_id", *columns).groupBy("scene_id").applyInPandas(run, "scene_id string, content binary")


def obj(faces: DataFrame) -> DataFrame:
    def make(rows):
        v, f, at = [], [], 1
        for kind, part in rows.groupby("kind", sort=True):
            f.append(f"g {kind}")
            for face in part["face"]:
                v += [f"v {p['x']:.6f} {p['y']:.6f} {p['z']:.6f}" for p in face]
                f.append("f " + " ".join(str(at + i) for i in range(len(face))))
                at += len(face)
        return ("\n".join([*v, *f]) + "\n").encode()

    return _scenes(faces, ["kind", "face"], make, ["kind"])


def glb(faces: DataFrame) -> DataFrame:
    """Binary glTF, a mesh a kind; an empty scene still gives a valid file."""
    colour = {"wall": [0.9, 0.88, 0.84, 1], "door": [0.6, 0.43, 0.27, 1], "window": [0.63, 0.78, 0.9, 0.5], "floor": [0.8, 0.76, 0.7, 1], "ceiling": [0.95, 0.95, 0.95, 1]}

    def make(rows):
        blob, views, accessors, meshes, materials = b"", [], [], [], []
        for kind, part in rows.groupby("kind", sort=True):
            tri = [(face[0], face[i], face[i + 1]) for face in part["face"] for i in range(1, len(face) - 1)]
            raw = b"".join(struct.pack("<3f", p["x"], p["z"], -p["y"]) for t in tri for p in t)  # y up
            flat = [(p["x"], p["z"], -p["y"]) for t in tri for p in t]
            views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": len(raw)})
            accessors.append({"bufferView": len(views) - 1, "componentType": 5126, "count": len(flat), "type": "VEC3", "min": [min(c) for c in zip(*flat)], "max": [max(c) for c in zip(*flat)]})
            materials.append({"name": kind, "pbrMetallicRoughness": {"baseColorFactor": colour[kind]}, "doubleSided": True})
            meshes.append({"name": kind, "primitives": [{"attributes": {"POSITION": len(accessors) - 1}, "material": len(materials) - 1}]})
            blob += raw
        tree = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(meshes)))}], "nodes": [{"mesh": i, "name": m["name"]} for i, m in enumerate(meshes)], "meshes": meshes, "materials": materials, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(blob)}]}
        head = json.dumps(tree).encode()
        head += b" " * (-len(head) % 4)
        return struct.pack("<4sII", b"glTF", 2, 28 + len(head) + len(blob)) + struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(blob), b"BIN\0") + blob

    return _scenes(faces, ["kind", "face"], make, ["kind"])


def _sheet(rows, scale, margin):
    every = [(p["x"], p["y"]) for ps in rows["points"] for p in ps]
    x0, y0, x1, y1 = min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every)
    to = lambda p: ((p["x"] - x0) * scale + margin, (p["y"] - y0) * scale + margin)
    return to, (x1 - x0) * scale + 2 * margin, (y1 - y0) * scale + 2 * margin


def _rgb(h: str | None):
    return None if h is None else tuple(int(h[i : i + 2], 16) / 255 for i in (1, 3, 5))


def pdf(prims: DataFrame, print_scale: int = 100, paper: str = "A4") -> DataFrame:
    """One-page vector PDF at a print scale, on paper enlarged where the plan needs it."""
    per_metre = 1000 / print_scale * 72 / 25.4
    wide, high = (max(schedules.PAPER[paper]) * 72 / 25.4, min(schedules.PAPER[paper]) * 72 / 25.4)

    def make(rows):
        to, w, h = _sheet(rows, per_metre, 36)
        ops = []
        for kind, points, label, layer, size in rows[["kind", "points", "text", "layer", "size"]].itertuples(index=False):
            stroke, fill = _rgb(STYLE[layer][0]), _rgb(STYLE[layer][1])
            at = [to(p) for p in points]
            if kind == "text":
                safe = (label or "").encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
                ops.append(b"BT /F1 %.2f Tf 0 0 0 rg %.2f %.2f Td (" % (max(4.0, size * per_metre), *at[0]) + safe + b") Tj ET")
                continue
            path = b" ".join([b"%.2f %.2f %s" % (*p, b"l" if i else b"m") for i, p in enumerate(at)])
            ink = b"%.3f %.3f %.3f RG " % stroke + (b"%.3f %.3f %.3f rg " % fill if fill else b"")
            ops.append(ink + path + (b" h B" if kind == "polygon" and fill else b" S"))
        stream = zlib.compress(b"\n".join(ops))
        parts = [
            b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
            b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %.2f %.2f]/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>" % (max(w, wide), max(h, high)),
            b"<</Length %d/Filter/FlateDecode>>stream\n" % len(stream) + stream + b"\nendstream", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>",
        ]
        out, at = b"%PDF-1.4\n", []
        for i, p in enumerate(parts, 1):
            at.append(len(out))
            out += b"%d 0 obj" % i + p + b"endobj\n"
        table = b"".join(b"%010d 00000 n \n" % a for a in at)
        return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + table + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, len(out))

    return _scenes(prims.withColumn("size", _size(prims)), ["seq", "kind", "points", "text", "layer", "size"], make, ["seq"])


def png(prims: DataFrame, scale: float = 80.0) -> DataFrame:
    """Raster of the drawing's shapes (labels stay with the vector formats)."""

    def make(rows):
        import numpy as np

        to, w, h = _sheet(rows, scale, 40)
        img = np.full((math.ceil(h), math.ceil(w), 3), 255, np.uint8)
        for kind, points, layer in rows[["kind", "points", "layer"]].itertuples(index=False):
            if kind == "text":
                continue
            stroke, fill = _rgb(STYLE[layer][0]), _rgb(STYLE[layer][1])
            at = np.array([to(p) for p in points])
            if kind == "polygon" and fill:
                x0, y0 = np.maximum(np.floor(at.min(0)).astype(int), 0)
                x1, y1 = np.ceil(at.max(0)).astype(int) + 1
                gx, gy = np.meshgrid(np.arange(x0, min(x1, img.shape[1])) + 0.5, np.arange(y0, min(y1, img.shape[0])) + 0.5)
                inside = np.zeros(gx.shape, bool)
                for (ax, ay), (bx, by) in zip(at, np.roll(at, -1, 0)):
                    if ay != by:
                        inside ^= ((ay > gy) != (by > gy)) & (gx < (bx - ax) * (gy - ay) / (by - ay) + ax)
                part = img[y0 : y0 + gx.shape[0], x0 : x0 + gx.shape[1]]
                part[inside] = [int(255 * c) for c in fill]
            ring = np.vstack([at, at[:1]]) if kind == "polygon" else at
            for p, q in zip(ring[:-1], ring[1:]):
                n = int(np.abs(q - p).max() * 2) + 2
                xy = np.rint(p + (q - p) * np.linspace(0, 1, n)[:, None]).astype(int)
                ok = (xy[:, 0] >= 0) & (xy[:, 0] < img.shape[1]) & (xy[:, 1] >= 0) & (xy[:, 1] < img.shape[0])
                img[xy[ok, 1], xy[ok, 0]] = [int(255 * c) for c in stroke]
        raw = b"".join(b"\0" + r.tobytes() for r in img[::-1])
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    return _scenes(prims, ["seq", "kind", "points", "layer"], make, ["seq"])


def isometric(faces: DataFrame) -> DataFrame:
    """Primitives of the axonometric view in painter's order."""
    seen = schedules.painted(faces)
    return seen.select("scene_id", F.col("rank").alias("seq"), F.lit("polygon").alias("kind"), F.col("outline").alias("points"), F.lit(None).cast("string").alias("text"), F.when(F.col("kind") == "floor", "room").when(F.col("kind").isin("door", "window"), "opening").otherwise("wall").alias("layer"))


def isometric_svg(faces: DataFrame, scale: float = 60.0) -> DataFrame:
    return svg(isometric(faces), scale)


def elevations(walls: DataFrame, openings: DataFrame, scale: float = 50.0) -> DataFrame:
    """Primitives of every wall face on, packed in rows."""
    at = schedules.elevation_rows(walls, scale).join(walls, ["scene_id", "id"]).withColumns({"ox": F.col("x") / scale, "oy": -F.col("row") * (F.col("height") + 1.9)})
    box = lambda a, b, lo, hi: F.array(*[rings.point(F.col("ox") + x, F.col("oy") + y) for x, y in ((a, lo), (b, lo), (b, hi), (a, hi))])
    zero = F.lit(0.0)
    wall = at.select("scene_id", (F.col("id") * 1000).alias("seq"), F.lit("polygon").alias("kind"), box(zero, W.length, zero, F.col("height")).alias("points"), F.lit(None).cast("string").alias("text"), F.lit("room").alias("layer"))
    name = at.select("scene_id", (F.col("id") * 1000 + 1).alias("seq"), F.lit("text").alias("kind"), F.array(rings.point(F.col("ox") + W.length / 2, F.col("oy") - 0.3)).alias("points"), F.concat(F.lit("M"), (F.col("id") + 1).cast("string")).alias("text"), F.lit("label").alias("layer"))
    on = openings.select("scene_id", F.col("wall_id").alias("id"), F.col("id").alias("n"), "t0", "t1", "z0", "z1").join(at.select("scene_id", "id", "ox", "oy"), ["scene_id", "id"])
    cut = on.select("scene_id", (F.col("id") * 1000 + 2 + F.col("n")).alias("seq"), F.lit("polygon").alias("kind"), box(F.col("t0"), F.col("t1"), F.col("z0"), F.col("z1")).alias("points"), F.lit(None).cast("string").alias("text"), F.lit("opening").alias("layer"))
    return wall.unionByName(name).unionByName(cut)


def html(svgs: DataFrame, areas: DataFrame, openings: DataFrame) -> DataFrame:
    """scene_id, value: a self-contained report with drawing, area and opening tables."""
    cell = lambda c: F.concat(F.lit("<td>"), text.escape_markup(F.coalesce(F.col(c), F.lit(""))), F.lit("</td>"))
    table = lambda df, cols, name: df.withColumn("tr", F.concat(F.lit("<tr>"), *[cell(c) for c in cols], F.lit("</tr>"))).groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "tr"))), lambda r: r["tr"]), "\n").alias(name))
    out = svgs.join(table(areas, ["name", "area", "perimeter", "floor_seen"], "a"), "scene_id", "left").join(table(openings, ["tag", "kind", "width", "height", "sill", "wall"], "o"), "scene_id", "left")
    return out.select("scene_id", F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), text.escape_markup(F.col("scene_id")), F.lit("</title></head><body>\n"), "value", F.lit("\n<table>"), F.coalesce("a", F.lit("")), F.lit("</table>\n<table>"), F.coalesce("o", F.lit("")), F.lit("</table>\n</body></html>\n")).alias("value"))


def debug_png(plan: dict[str, DataFrame], scale: float = 60.0, most: int = 20_000) -> DataFrame:
    """Overlay of a plan's evidence: seen floor (thinned by hash to about ``most`` cells a scene), fitted
    runs and walls. For the eye; nothing is computed from it."""
    none = F.lit(None).cast("string")
    grid = plan["grid"].select("scene_id", "x0", "y0", "cell")
    size = plan["floor"].groupBy("scene_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("long").alias("k"))
    cell = plan["floor"].join(size, "scene_id").filter(F.pmod(F.xxhash64("ix", "iy"), F.col("k")) == 0).join(grid, "scene_id")
    at = lambda i, j: rings.point(F.col("x0") + (F.col("ix") + i) * F.col("cell"), F.col("y0") + (F.col("iy") + j) * F.col("cell"))
    prim = lambda df, o, kind, pts, layer: df.select("scene_id", (F.lit(o) * 1_000_000_000 + F.monotonically_increasing_id() % 1_000_000_000).alias("seq"), F.lit(kind).alias("kind"), pts.alias("points"), none.alias("text"), F.lit(layer).alias("layer"))
    out = prim(cell, 0, "polygon", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)), "room")
    end = lambda t: rings.point(F.col("s") * F.cos("alpha") - F.col(t) * F.sin("alpha"), F.col("s") * F.sin("alpha") + F.col(t) * F.cos("alpha"))
    out = out.unionByName(prim(plan["walls"], 1, "polygon", W.body, "wall")).unionByName(prim(plan["faces"], 2, "polyline", F.array(end("t0"), end("t1")), "open"))
    return png(out, scale)


FORMATS = ("svg", "png", "pdf", "dxf", "dxf3d", "obj", "glb", "json", "html", "iso.svg", "iso.png", "elevations.svg", "elevations.png", "elevations.pdf", "sheet.svg", "sheet.pdf", "sheet.png", "sheet.dxf")


def export(plan: dict[str, DataFrame], folder: str, formats: tuple = FORMATS, ceiling: float | None = None, units: str = "m", lang: str = "en", paper: str = "A4") -> DataFrame:
    """Chosen formats of every scene's plan: scene_id, format, path, bytes. ``plan`` has walls,
    openings, rooms and, for JSON, plans; ``info``, ``findings`` and ``stamps`` fill the sheets."""
    walls, openings, rooms = plan["walls"], plan["openings"], plan["rooms"]
    prims = drawing(walls, openings, rooms)
    faces = schedules.model_faces(walls, openings, rooms, ceiling)
    upright = lambda: elevations(walls, openings)

    @cache
    def whole():
        from . import sheets

        return sheets.sheet(walls, openings, rooms, plan.get("info"), plan.get("findings"), plan.get("stamps"), units, lang)

    raw = lambda df: df.select("scene_id", F.encode("value", "utf-8").alias("content"))
    makers: dict[str, Callable[[], DataFrame]] = {
        "svg": lambda: raw(svg(prims)), "png": lambda: png(prims), "pdf": lambda: pdf(prims, paper=paper), "dxf": lambda: raw(dxf(prims)), "dxf3d": lambda: raw(dxf_solid(faces)), "obj": lambda: obj(faces), "glb": lambda: glb(faces),
        "html": lambda: raw(html(svg(prims), schedules.area_schedule(rooms, walls, units), schedules.opening_schedule(openings, units))), "iso.svg": lambda: raw(isometric_svg(faces)), "iso.png": lambda: png(isometric(faces), 60.0),
        "elevations.svg": lambda: raw(svg(upright(), 50.0)), "elevations.png": lambda: png(upright(), 50.0), "elevations.pdf": lambda: pdf(upright(), 50, paper), "sheet.svg": lambda: raw(svg(whole())), "sheet.pdf": lambda: pdf(whole(), paper=paper), "sheet.png": lambda: png(whole()), "sheet.dxf": lambda: raw(dxf(whole())),
    }
    if "plans" in plan:
        from . import plans

        makers["json"] = lambda: raw(plans.encode(plan["plans"], walls, openings, rooms))
    unknown = set(formats) - set(makers) - {"json"}
    if unknown:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    out = None
    for name in formats:
        if name in makers:
            part = makers[name]().select("scene_id", F.lit(name).alias("format"), "content")
            out = part if out is None else out.unionByName(part)
    return write_files(out, folder)

"""Vectors, cameras, rings, formats, rasters and their joins, each against the SQL of the same
numbers on the relational test tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rings, site, text, vec, walls
from ..operators import aggregate, align, cells, graph, join, normals, ordered, select
from ..streaming import frames
from . import demos

query, table, events = demos.query, demos.table, demos.events

#: Vector (x, y, z) and angle a of each embedding, in SQL and in columns.
V = "(SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (vec_id % 360)::DOUBLE * pi() / 180 AS a FROM embeddings)"


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyz")], F.radians((F.col("vec_id") % 360).cast("double")).alias("a"))


def r6(c, name):
    return (F.round(c, 6) + 0.0).alias(name)


def long(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long").alias(name) if name else c.cast("long")


# -- vectors and cameras ---------------------------------------------------------------------


@query(f"""SELECT vec_id, round(x / l, 6) + 0.0 AS ux, round(z / l, 6) + 0.0 AS uz, round(x * cos(a) - y * sin(a), 6) + 0.0 AS rx, round(x * sin(a) + y * cos(a), 6) + 0.0 AS ry, round(y * 1 - z * 0, 6) + 0.0 AS cz,
round(a - floor(a / 1.5) * 1.5, 6) + 0.0 AS wrapped, round(least(a - floor(a / 1.5) * 1.5, 1.5 - (a - floor(a / 1.5) * 1.5)), 6) + 0.0 AS near FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM {V})""")
def vector_algebra(spark, d):
    """Unit vectors, a turn about z, a cross product, angles of a period."""
    v = vectors(spark, d)
    own = vec.vector(F.col("x"), F.col("y"), F.col("z"))
    u, r = vec.normalize(own), vec.rotate(vec.rotation_z(F.col("a")), own)
    c = vec.cross(vec.vector(0, -1, 0), vec.vector(F.col("y"), F.lit(0.0), F.lit(0.0)))
    return v.select("vec_id", r6(vec.at(u, 0), "ux"), r6(vec.at(u, 2), "uz"), r6(vec.at(r, 0), "rx"), r6(vec.at(r, 1), "ry"), r6(vec.at(c, 2), "cz"), r6(vec.wrap(F.col("a"), 1.5), "wrapped"), r6(vec.circular_distance(F.col("a"), 0.0, 1.5), "near"))


@query(f"""SELECT vec_id, round(z / l, 6) + 0.0 AS tx, round(x / l, 6) + 0.0 AS ty, round(y / l, 6) + 0.0 AS tz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM {V}) WHERE l > 0""")
def rotation_between(spark, d):
    """A vector turned onto another by the rotation between them."""
    v = vectors(spark, d).filter("x * x + y * y + z * z > 0")
    v = v.select("vec_id", vec.vector(F.col("x"), F.col("y"), F.col("z")).alias("a"), vec.vector(F.col("z"), F.col("x"), F.col("y")).alias("b"))
    v = v.select("vec_id", vec.normalize(F.col("a")).alias("u"), vec.rotation_between(F.col("a"), F.col("b")).alias("r"))
    v = v.select("vec_id", vec.rotate(F.col("r"), F.col("u")).alias("t"))
    return v.select("vec_id", *[r6(vec.at(F.col("t"), i), f"t{n}") for i, n in enumerate("xyz")])


@query(f"""SELECT vec_id, round(cos(a) * 1 - sin(a) * 2 + x, 6) + 0.0 AS px, round(sin(a) * 1 + cos(a) * 2 + y, 6) + 0.0 AS py, round(3 + z, 6) + 0.0 AS pz, round(x, 6) + 0.0 AS cx, round(sin(a), 6) + 0.0 AS up_x, 1.0::DOUBLE AS forward_z,
round(cos(a) * x - sin(a) * y + x, 6) + 0.0 AS twice_x, round(2 * z + 1, 6) + 0.0 AS similar_z FROM {V}""")
def camera_poses(spark, d):
    """Poses of cameras turned about z: points carried, centre, up and forward, one after another, scaled."""
    t = vec.vector(F.col("x"), F.col("y"), F.col("z"))
    v = vectors(spark, d).select("vec_id", "a", vec.pose(vec.rotation_z(F.col("a")), t).alias("p"))
    p = F.col("p")
    v = v.select("vec_id", "p", vec.apply_pose(p, vec.vector(1, 2, 3)).alias("point"), vec.compose(p, p).alias("twice"), vec.apply_similarity(F.lit(2.0), vec.rotation_z(F.col("a")), vec.vector(0, 0, 1), p).alias("similar"))
    point = [r6(vec.at(F.col("point"), i), f"p{n}") for i, n in enumerate("xyz")]
    return v.select("vec_id", *point, r6(vec.at(vec.camera_centre(p), 0), "cx"), r6(vec.at(vec.camera_up(p), 0), "up_x"), r6(vec.at(vec.camera_forward(p), 2), "forward_z"), r6(vec.at(vec.camera_centre(F.col("twice")), 0), "twice_x"), r6(vec.at(vec.camera_centre(F.col("similar")), 2), "similar_z"))


@query("""SELECT p_partkey, round((p_size - 320) / 500.0, 6) + 0.0 AS rx, round((p_size % 7 - 240) / 510.0, 6) + 0.0 AS ry, round(p_size::DOUBLE, 6) AS u, round((p_size % 7)::DOUBLE, 6) AS v, 500.0::DOUBLE AS fx, 320.0::DOUBLE AS cx FROM part""")
def pixel_rays(spark, d):
    """Rays of pixels, projected again at a depth of three, and intrinsics there and back."""
    k = vec.matrix([[500, 0, 320], [0, 510, 240], [0, 0, 1]])
    u, v = F.col("p_size").cast("double"), (F.col("p_size") % 7).cast("double")
    ray = vec.pixel_ray(k, u, v)
    pixel = vec.project(k, vec.vector(*(vec.at(ray, i) * 3 for i in range(3))))
    back = vec.restore_intrinsics(vec.rescale_intrinsics(k, 640, 480, 518, 392), 640, 480, 518, 392)
    return table(spark, d, "part").select("p_partkey", r6(vec.at(ray, 0), "rx"), r6(vec.at(ray, 1), "ry"), r6(vec.at(pixel, 0), "u"), r6(vec.at(pixel, 1), "v"), r6(vec.cell(back, 0, 0), "fx"), r6(vec.cell(back, 0, 2), "cx"))


_UTM = """WITH p AS (SELECT c_custkey, (c_custkey % 140 - 70)::DOUBLE AS lat, (c_custkey * 11 % 340 - 170)::DOUBLE + 0.5 AS lon, 6378137.0 AS a, 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2 FROM customer),
z AS (SELECT *, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 ELSE CAST(floor((lon + 180) / 6) AS INT) + 1 END AS zone, radians(lat) AS phi, e2 / (1 - e2) AS ep2 FROM p),
t AS (SELECT *, tan(phi) ** 2 AS t2, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, ep2 * cos(phi) ** 2 AS c, cos(phi) * radians(lon - ((zone - 1) * 6 - 177)) AS g,
 a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - (35 * e2 ** 3 / 3072) * sin(6 * phi)) AS m FROM z)
SELECT c_custkey, zone, round(0.9996 * n * (g + (1 - t2 + c) * g ** 3 / 6 + (5 - 18 * t2 + t2 ** 2 + 72 * c - 58 * ep2) * g ** 5 / 120) + 500000, 3) AS easting,
round(0.9996 * (m + n * tan(phi) * (g ** 2 / 2 + (5 - t2 + 9 * c + 4 * c ** 2) * g ** 4 / 24 + (61 - 58 * t2 + t2 ** 2 + 600 * c - 330 * ep2) * g ** 6 / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS northing,
CASE WHEN lat < 0 THEN 'S' ELSE 'N' END AS hemisphere, round(lat + 0.002, 6) AS back_lat, round(lon + 0.001, 6) AS back_lon FROM t"""


@query(_UTM)
def utm_coordinates(spark, d):
    """UTM of points in both hemispheres; a local frame there and back."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", (k % 140 - 70).cast("double").alias("lat"), ((k * 11) % 340 - 170).cast("double").alias("lon0")).withColumn("lon", F.col("lon0") + 0.5)
    u = site.utm(F.col("lat"), F.col("lon"))
    there = site.to_local(F.col("lon") + 0.001, F.col("lat") + 0.002, F.col("lon"), F.col("lat"))
    back = site.to_wgs84(there["x"], there["y"], F.col("lon"), F.col("lat"))
    return c.select("c_custkey", u["zone"].alias("zone"), F.round(u["easting"], 3).alias("easting"), F.round(u["northing"], 3).alias("northing"), u["hemisphere"].alias("hemisphere"), F.round(back["lat"], 6).alias("back_lat"), F.round(back["lon"], 6).alias("back_lon"))


# -- rings, intervals, texts --------------------------------------------------------------------


@query("""SELECT p_partkey, w * 0.75 < w / 2 AS corner_in, round(w / 4, 6) AS gap, 6::BIGINT AS corners, true AS level, round(w, 6) AS x1, round((w * h * w / 2 - w / 2 * h / 2 * w * 0.75) / (w * h * 0.75), 6) AS cx, round(4 * (w * h * 0.75), 4) AS large, false AS odd
FROM (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice / 100 AS h FROM part) WHERE w <= h""")
def ring_queries(spark, d):
    """An L cut from each part's rectangle, with a repeated and a straight vertex to drop: what it
    contains, how far its missing corner is, its centroid."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), (F.col("p_retailprice") / 100).alias("h")).filter("w <= h")
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    pt = rings.point
    raw = F.array(pt(zero, zero), pt(zero, zero), pt(w / 3, zero), pt(w, zero), pt(w, h / 2), pt(w / 2, h / 2), pt(w / 2, h), pt(zero, h))
    p = p.withColumn("r", rings.drop_collinear(rings.dedupe(raw)))
    r, x, y = F.col("r"), w * 0.75, h * 0.75
    grown = rings.scaled(r, F.lit(2.0))
    return p.select("p_partkey", rings.contains(r, x, y).alias("corner_in"), F.round(rings.distance(r, x, y), 6).alias("gap"), long(F.size(r), "corners"), rings.is_rectilinear(r).alias("level"), F.round(rings.bounds(r)["x1"], 6).alias("x1"), F.round(rings.centroid(r)["x"], 6).alias("cx"), F.round(rings.area(grown), 4).alias("large"), rings.impossible(r).alias("odd"))


@query("""SELECT p_partkey, 15::BIGINT AS n, round(1 + p_size / 10.0::DOUBLE, 6) AS x0, 0.0::DOUBLE AS y0, 1.0::DOUBLE AS x1, round(p_size / 10.0::DOUBLE, 6) AS y1, round(sqrt(0.5) * p_size / 10, 5) AS mid FROM part""")
def door_arcs(spark, d):
    """Way of a door leaf about its hinge at (1, 0), from the wall to across the opening."""
    s = F.col("p_size") / 10
    one, zero = F.lit(1.0), F.lit(0.0)
    arc = rings.quarter_arc(one, zero, one + s, zero, one, s)
    a = table(spark, d, "part").select("p_partkey", arc.alias("a"))
    at = lambda i, c: F.get("a", F.lit(i))[c]
    return a.select("p_partkey", long(F.size("a"), "n"), r6(at(0, "x"), "x0"), r6(at(0, "y"), "y0"), r6(at(14, "x"), "x1"), r6(at(14, "y"), "y1"), F.round(at(7, "y"), 5).alias("mid"))


@query("""SELECT p_partkey, p_size % 10 BETWEEN 2 AND 4 OR p_size % 10 BETWEEN 6 AND 7 AS inside, CASE WHEN p_size % 10 = 1 THEN 0 WHEN p_size % 10 = 5 THEN 0 WHEN p_size % 10 = 8 THEN 1 END::BIGINT AS k, CASE WHEN p_size % 10 = 1 THEN -1 WHEN p_size % 10 IN (5, 8) THEN 1 END::BIGINT AS side,
round(p_size::DOUBLE, 6) AS ta, round(p_size % 7 * 1.0::DOUBLE, 6) + 0.0 AS tb, round(-(p_size % 7) * 1.0::DOUBLE, 6) + 0.0 AS fx FROM part""")
def interval_tests(spark, d):
    """Stations in the intervals [2, 4] and [6, 7] or just outside an end; where two lines cross."""
    t = (F.col("p_size") % 10).cast("double")
    iv = F.array(*[F.struct(F.lit(a).alias("t0"), F.lit(b).alias("t1")) for a, b in ((2.0, 4.0), (6.0, 7.0))])
    near = walls.near_end(iv, t, 1.0)
    zero, quarter = F.lit(0.0), F.lit(math.pi / 2)
    # a line of normal angle 0 at s and one of normal angle 90 degrees at s: (s, s) in either frame
    cross = walls.family_crossing(zero, (F.col("p_size") % 7).cast("double"), quarter, F.col("p_size").cast("double"))
    p = walls.family_point(quarter, F.lit(0.0), (F.col("p_size") % 7).cast("double"))
    return table(spark, d, "part").select("p_partkey", walls.within_any(iv, t).alias("inside"), long(near["k"], "k"), long(near["side"], "side"), r6(cross["ta"], "ta"), r6(F.abs(cross["tb"]), "tb"), r6(p["x"], "fx"))


@query("""SELECT c_custkey, printf('%.2f m', round_even(m, 2)) AS length, printf('%.2f m²', round_even(m, 2)) AS area, CAST(round_even(m / 0.09290304, 0) AS BIGINT) || ' ft²' AS feet, CAST(round_even(c_custkey % 40 / 4.0, 0) AS BIGINT) AS whole, (c_custkey % 9)::DOUBLE AS third,
CASE WHEN c_custkey % 3 = 0 THEN 'puerta' WHEN c_custkey % 3 = 1 THEN 'window' ELSE 'stair' END AS word, round((1 + c_custkey % 50 / 100.0) * 1.21 * 100 - 100, 6) AS shape FROM (SELECT *, (c_custkey % 977 / 64.0)::DOUBLE AS m FROM customer)""")
def quantity_texts(spark, d):
    """Lengths and areas as texts, parsed numbers, words of a language with a fallback, area errors."""
    k = F.col("c_custkey")
    m = k % 977 / 64.0
    words = {"en": {"d": "door", "w": "window"}, "es": {"d": "puerta"}}
    key = F.when(k % 3 == 0, "d").when(k % 3 == 1, "w").otherwise("stair")
    parts = text.parse_vector(F.concat(F.lit("1; 2.5,"), (k % 9).cast("string")))
    return table(spark, d, "customer").select("c_custkey", text.length_text(m).alias("length"), text.area_text(m).alias("area"), text.area_text(m, "ft").alias("feet"), text.whole(F.concat((k % 40 / 4.0).cast("string"), F.lit(" m"))).alias("whole"), vec.at(parts, 2).alias("third"), text.label(words, F.lit("es"), key).alias("word"), F.round(text.shape_error((k % 50).cast("double"), F.lit(1.1)), 6).alias("shape"))


@query("""SELECT o_orderkey, list_element(['N', 'E', 'S', 'W'], CAST(o_orderkey % 4 + 1 AS INT)) AS faces FROM orders""")
def wall_facings(spark, d):
    """Where one looks at walls of four directions from their plus side."""
    k = F.col("o_orderkey") % 4
    dx = F.when(k == 0, -1.0).when(k == 2, 1.0).otherwise(0.0)
    dy = F.when(k == 1, 1.0).when(k == 3, -1.0).otherwise(0.0)
    return table(spark, d, "orders").select("o_orderkey", text.facing(dx, dy, F.lit(1.0), F.lit(0.0)).alias("faces"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), '-') AS first_of FROM events""")
def json_meta(spark, d):
    """Keys of a metadata document, the first present one."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(text.first_key(m, ["missing", "k"]), F.lit("-")).alias("first_of"))


# -- windows, sessions, choices ---------------------------------------------------------------------


@query("""SELECT user_id, "window", event_id, round(value, 6) AS value FROM (
  SELECT user_id, CAST(floor(s / 3600) AS BIGINT) AS "window", event_id, value,
         row_number() OVER (PARTITION BY user_id, floor(s / 3600) ORDER BY value DESC, s, event_id DESC) AS r FROM (SELECT *, floor(epoch_us(ts) / 1e6) AS s FROM events)) WHERE r = 1""")
def window_best_frame(spark, d):
    """Best event of every user and hour: the sharpest frame of every window."""
    ev = events(spark, d).select("user_id", "event_id", "value", F.floor("t").cast("long").alias("s"))
    best = select.window_best(ev, ["user_id"], "s", 3600, "value")
    return best.select("user_id", "window", "event_id", F.round("value", 6).alias("value"))


@query("""SELECT user_id, epoch_us(start) // 1000000 AS start, event_id, round(value, 6) AS value FROM (
  SELECT user_id, date_trunc('hour', ts) AS start, event_id, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""")
def stream_best_frames(spark, d):
    """The aggregate that also runs as a stream: the best event of every user and clock hour."""
    best = frames.best_frames(table(spark, d, "events"), ["user_id"], "ts", "value", "event_id", "1 hour")
    return best.select("user_id", F.unix_seconds("start").alias("start"), "event_id", F.round("value", 6).alias("value"))


@query("""SELECT user_id, epoch_us(start) // 1000000 AS start, event_id, round(value, 6) AS value FROM (
  SELECT user_id, date_trunc('hour', ts) AS start, event_id, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY value DESC, event_id) AS r FROM events)
WHERE r = 1 AND start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def appended_best_frames(spark, d):
    """The same as a stream in append mode: windows that the watermark has passed, read back from what the stream wrote."""
    out = graph.shared_folder(spark, "best-frames")
    stream = frames.files(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    best = frames.best_frames(stream, ["user_id"], "ts", "value", "event_id", "1 hour", "30 minutes")
    frames.write(best, f"{out}/frames", f"{out}/checkpoint").awaitTermination()
    read = spark.read.schema(best.schema).parquet(f"{out}/frames")
    return read.select("user_id", F.unix_seconds("start").alias("start"), "event_id", F.round("value", 6).alias("value"))


@query("""WITH h AS (SELECT user_id, session FROM (SELECT user_id, t, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM (
 SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 3600000000 THEN 1 ELSE 0 END AS b FROM events)))
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, session, count(*) AS n FROM h GROUP BY 1, 2) GROUP BY 1, 2""")
def session_sizes(spark, d):
    return frames.sessions(table(spark, d, "events"), ["user_id"], "ts", "1 hour").groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query("""SELECT event_type, round(coalesce(quantile_cont(value, 0.95) FILTER (value < 20), 0.9), 6) AS z0, round(coalesce(quantile_cont(value, 0.05) FILTER (value > 40), 2.1), 6) AS z1 FROM events GROUP BY 1
HAVING coalesce(quantile_cont(value, 0.05) FILTER (value > 40), 2.1) - coalesce(quantile_cont(value, 0.95) FILTER (value < 20), 0.9) >= 0.4""")
def percentile_sill(spark, d):
    """Sill and head of a window from the heights below and above its middle."""
    out = aggregate.sill_and_head(table(spark, d, "events"), ["event_type"], "value", (20.0, 40.0), 0.9, 2.1)
    return out.select("event_type", F.round("z0", 6).alias("z0"), F.round("z1", 6).alias("z1"))


@query("""SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY 1 HAVING max(o_totalprice) >= 1000""")
def largest_part(spark, d):
    """Largest part of each key, if it is large enough."""
    return select.largest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 1000.0, ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT o_custkey, least(count(*), 5) AS kept, sum(CASE WHEN (r - 1) % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS thirds, sum(CASE WHEN o_totalprice >= 50000 AND (n <= 8 OR p <= 8) THEN 1 ELSE 0 END)::BIGINT AS labelled
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY 1""")
def row_caps(spark, d):
    """Rows left by a sampling cap, by taking every third, and by labelling only long sides."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    n = lambda df, name: df.groupBy("o_custkey").agg(F.count("*").alias(name))
    capped, thirds = n(select.sample_cap(o, ["o_custkey"], 5, "o_orderkey"), "kept"), n(select.every_nth(o, ["o_custkey"], "o_orderkey", 3), "thirds")
    return capped.join(thirds, "o_custkey").join(n(select.long_sides(o, ["o_custkey"], "o_totalprice", 50000.0, 8), "labelled"), "o_custkey", "left").fillna(0, ["labelled"])


@query("""SELECT l_orderkey, list_element(list_sort(list_distinct(c)), 1) AS first, len(c)::BIGINT AS n FROM (SELECT l_orderkey, list_prepend(0.0::DOUBLE, list_append(list_filter(list_sort(list(l_quantity)), lambda x: x > 0 AND x < 60), 60.0)) AS c FROM (SELECT DISTINCT l_orderkey, floor(l_quantity / 10) * 10 + 1 AS l_quantity FROM lineitem) GROUP BY 1)""")
def wall_cuts(spark, d):
    """Cut coordinates between two bounds; none are near enough to merge."""
    held = table(spark, d, "lineitem").select("l_orderkey", (F.floor(F.col("l_quantity") / 10) * 10 + 1).cast("double").alias("q")).distinct().groupBy("l_orderkey").agg(F.collect_list("q").alias("q"))
    c = ordered.cuts(F.col("q"), F.lit(0.0), F.lit(60.0), 0.2)
    return held.select("l_orderkey", F.get(c, F.lit(0)).alias("first"), long(F.size(c), "n"))


@query("""SELECT l_orderkey, l_linenumber, round(sum(x) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS log_scale FROM (SELECT l_orderkey, l_linenumber, ln(max(1 + l_tax)) AS x FROM lineitem GROUP BY 1, 2)""")
def chain_offsets(spark, d):
    """Logarithm of every chunk's scale: a prefix sum over the links before it."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(1 + F.col("l_tax")).alias("f"))
    return align.chain_offsets(li, ["l_orderkey"], "l_linenumber", "f").select("l_orderkey", "l_linenumber", r6(F.col("log_scale"), "log_scale"))


# -- measures ---------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, floor(l_quantity / 7)::BIGINT AS station, count(DISTINCT floor(l_extendedprice / 5000)) AS bands FROM lineitem GROUP BY 1, 2""")
def station_bands(spark, d):
    return aggregate.station_coverage(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 7.0, 5000.0)


@query("""SELECT l_returnflag, l_linestatus, round(median(abs((l_quantity - 25) / 25)), 6) AS disagreement FROM lineitem GROUP BY 1, 2""")
def disagreements(spark, d):
    out = aggregate.median_disagreement(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity") - 25, F.lit(25.0))
    return out.select("l_returnflag", "l_linestatus", F.round("disagreement", 6).alias("disagreement"))


@query("""WITH f AS (SELECT n_nationkey AS k, u, v, ((u * 7 + v * 3 + n_nationkey) % 11)::DOUBLE AS g FROM nation, range(9) a(u), range(7) b(v)),
l AS (SELECT k, coalesce(lag(g) OVER x, lead(g) OVER x) + coalesce(lead(g) OVER x, lag(g) OVER x) + coalesce(lag(g) OVER y, lead(g) OVER y) + coalesce(lead(g) OVER y, lag(g) OVER y) - 4 * g AS l FROM f WINDOW x AS (PARTITION BY k, v ORDER BY u), y AS (PARTITION BY k, u ORDER BY v))
SELECT k, round(var_pop(l), 6) AS sharpness FROM l GROUP BY 1""")
def picture_sharpness(spark, d):
    """Variance of the Laplacian of a small picture for every nation."""
    k = F.col("n_nationkey").alias("k")
    px = table(spark, d, "nation").select(k, F.explode(F.sequence(F.lit(0), F.lit(8))).alias("u")).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(6))))
    px = px.withColumn("grey", ((F.col("u") * 7 + F.col("v") * 3 + F.col("k")) % 11).cast("double"))
    return aggregate.sharpness(px, ["k"]).select("k", F.round("sharpness", 6).alias("sharpness"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 20 THEN 'too_short' END, CASE WHEN p_partkey % 3 = 0 THEN 'low_resolution' END, CASE WHEN p_size * 2 < 40 THEN 'mostly_blurry' END, CASE WHEN p_size % 5 > 0 THEN 'blank_seconds=' || CAST(round_even(p_size % 5 / 2.0, 0) AS INT) END, CASE WHEN p_size % 20 < 12 THEN 'few_usable=' || p_size % 20 END], lambda x: x IS NOT NULL), ' ') AS warnings FROM part""")
def video_notes(spark, d):
    """Warnings of clips by duration, size, sharpness and windows."""
    s = F.col("p_size")
    clip = table(spark, d, "part").select("p_partkey", s.cast("double").alias("duration_s"), F.when(F.col("p_partkey") % 3 == 0, 640).otherwise(1280).alias("width"), F.lit(720).alias("height"), (s * 2.0).alias("sharpness_median"), (s % 5).cast("long").alias("flat_windows"), (s % 20).cast("long").alias("usable_frames"))
    return aggregate.video_warnings(clip, 2.0).select("p_partkey", F.concat_ws(" ", "warnings").alias("warnings"))


@query("""SELECT n_nationkey AS k, round(radians(n_nationkey * 3 % 80 + 5), 6) AS angle FROM nation""")
def dominant_directions(spark, d):
    """Main wall direction of scenes whose walls all have one, in all four quarters."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    a = F.radians((F.col("k") * 3 % 80 + 5).cast("double")) + (F.col("i") % 4) * (math.pi / 2)
    return aggregate.dominant_direction(n.select("k", F.cos(a).alias("nx"), F.sin(a).alias("ny")), ["k"]).select("k", r6(F.col("angle"), "angle"))


@query("""SELECT n_nationkey AS k, round(sin(radians(n_nationkey % 20)), 6) AS ux, 0.0::DOUBLE AS uy, round(cos(radians(n_nationkey % 20)), 6) AS uz FROM nation""")
def floor_normals(spark, d):
    """Up of scenes whose floor leans by up to 20 degrees, half of the normals facing down."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"))
    a, s = F.radians((F.col("k") % 20).cast("double")), F.when(F.col("i") % 2 == 0, 1.0).otherwise(-1.0)
    pts = n.select("k", (F.sin(a) * s).alias("nx"), F.lit(0.0).alias("ny"), (F.cos(a) * s).alias("nz"))
    return aggregate.cone_mean_normal(pts, ["k"], vec.vector(0, 0, 1)).select("k", *[r6(F.col(c), c) for c in ("ux", "uy", "uz")])


@query("""WITH v AS (SELECT l_returnflag, l_linenumber, median(l_quantity * (1 + l_linenumber / 10.0) / l_quantity) AS ratio, count(*) AS n FROM lineitem WHERE l_quantity > 0.05 GROUP BY 1, 2 HAVING count(*) >= 200)
SELECT l_returnflag, round(median(ratio), 6) AS scale, count(*) AS views FROM v GROUP BY 1""")
def depth_scales(spark, d):
    """Scale between two chunks from the depths of the views they share."""
    px = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").alias("depth_new"), (F.col("l_quantity") * (F.col("l_linenumber") / 10 + 1)).alias("depth_old"))
    return align.depth_ratio(px, ["l_returnflag"], "l_linenumber").select("l_returnflag", F.round("scale", 6).alias("scale"), "views")


@query("""SELECT label, round((1 + label % 3 * 0.5)::DOUBLE, 6) AS scale, round(cos(radians(30)), 6) AS r00, round(-sin(radians(30)), 6) AS r01, round(1.0::DOUBLE, 6) AS tx, round(3.0::DOUBLE, 6) AS tz, 0.0::DOUBLE AS rms, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 4""")
def umeyama_fit(spark, d):
    """The similarity by which each label's points were moved, found again."""
    e = table(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(["sx", "sy", "sz"])])
    few = e.groupBy("label").agg(F.count("*").alias("c")).filter("c >= 4").select("label")
    e = e.join(few, "label")
    scale, c, s = 1 + F.col("label") % 3 * 0.5, math.cos(math.radians(30)), math.sin(math.radians(30))
    moved = e.withColumns({"dx": scale * (F.col("sx") * c - F.col("sy") * s) + 1, "dy": scale * (F.col("sx") * s + F.col("sy") * c) + 2, "dz": scale * F.col("sz") + 3})
    out = align.umeyama(moved, ["label"])
    return out.select("label", r6(F.col("scale"), "scale"), r6(F.get("r", F.lit(0)), "r00"), r6(F.get("r", F.lit(1)), "r01"), r6(F.get("t", F.lit(0)), "tx"), r6(F.get("t", F.lit(2)), "tz"), (F.round("rms", 4) + 0.0).alias("rms"), "n")


# -- rasters --------------------------------------------------------------------------------------------

_LI = "(SELECT l_returnflag AS s, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 20000 AS z FROM lineitem)"
_GRID = f"(SELECT s, min(x) - 0.5 AS x0, min(y) - 0.5 AS y0, ceil((max(x) - min(x) + 1) / 2.5)::BIGINT + 1 AS nx, ceil((max(y) - min(y) + 1) / 2.5)::BIGINT + 1 AS ny FROM {_LI} GROUP BY 1)"
_IDX = f"(SELECT p.s, z, x0, y0, greatest(0, least(nx - 1, floor((x - x0) / 2.5)::BIGINT)) AS ix, greatest(0, least(ny - 1, floor((y - y0) / 2.5)::BIGINT)) AS iy FROM {_LI} p JOIN {_GRID} g ON p.s = g.s)"


def _indexed(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("s"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 20000).alias("z"))
    g = cells.grid_of(li, ["s"], 2.5)
    return cells.index(li, g, ["s"]), g


@query(f"SELECT s, ix, iy, count(*) AS value, round(min(x0) + (ix + 0.5) * 2.5, 6) AS cx, round(min(y0) + (iy + 0.5) * 2.5, 6) AS cy FROM {_IDX} GROUP BY 1, 2, 3")
def cell_counts(spark, d):
    """Extent, index, counts and centres of a grid over each flag's rows."""
    on, g = _indexed(spark, d)
    c = cells.centre(F.col("ix"), F.col("iy"))
    return cells.counts(on, ["s"]).join(g, "s").select("s", "ix", "iy", "value", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(f"SELECT s, ix, iy, count(DISTINCT greatest(0, least(floor(z / 0.5), 5))) AS value FROM {_IDX} GROUP BY 1, 2, 3")
def cell_bands(spark, d):
    """Distinct height bands in each cell, the last taking what is above."""
    return cells.coverage(_indexed(spark, d)[0], ["s"], "z", 0.5, 3.0)


@query(f"SELECT p.s, count(*) AS points, round(sum(coalesce(v.value, 0.0)), 3) AS total FROM {_IDX} p LEFT JOIN (SELECT s, ix, iy, count(*)::DOUBLE AS value FROM {_IDX} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 0) v USING (s, ix, iy) GROUP BY 1")
def cell_lookup(spark, d):
    """Each point's cell value, none where the sparse raster has no cell."""
    on, _ = _indexed(spark, d)
    even = cells.counts(on, ["s"]).filter("value % 2 = 0").withColumn("value", F.col("value").cast("double"))
    return join.lookup(on.select("s", "ix", "iy"), even, ["s"]).groupBy("s").agg(F.count("*").alias("points"), F.round(F.sum("value"), 3).alias("total"))


_A = "(SELECT DISTINCT l_suppkey % 23 AS ix, l_partkey % 19 AS iy FROM lineitem WHERE l_returnflag = 'A')"
_B = "(SELECT DISTINCT l_suppkey % 17 AS ix, l_partkey % 29 AS iy FROM lineitem WHERE l_linestatus = 'O')"


def _two(spark, d):
    li = table(spark, d, "lineitem")
    cell = lambda c, m, n: li.filter(c).select((F.col("l_suppkey") % m).alias("ix"), (F.col("l_partkey") % n).alias("iy")).distinct()
    return cell("l_returnflag = 'A'", 23, 19), cell("l_linestatus = 'O'", 17, 29)


@query(f"SELECT 'union' AS op, ix, iy FROM (SELECT * FROM {_A} UNION SELECT * FROM {_B}) UNION ALL SELECT 'common', ix, iy FROM (SELECT * FROM {_A} INTERSECT SELECT * FROM {_B}) UNION ALL SELECT 'minus', ix, iy FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B})")
def cell_algebra(spark, d):
    """Union, intersection and difference of two rasters."""
    a, b = _two(spark, d)
    named = lambda df, n: df.select(F.lit(n).alias("op"), "ix", "iy")
    return named(cells.union(a, b, []), "union").unionByName(named(cells.intersection(a, b, []), "common")).unionByName(named(cells.minus(a, b, []), "minus"))


_D = "(SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM {0} c, (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b)"
_E = "(SELECT c.ix, c.iy FROM {0} c JOIN {0} o ON abs(c.ix - o.ix) <= 1 AND abs(c.iy - o.iy) <= 1 GROUP BY 1, 2 HAVING count(*) = 9)"


_S = "(SELECT DISTINCT p_partkey % 41 AS ix, (p_size % 37)::BIGINT AS iy FROM part)"


@query(f"SELECT 'closed' AS op, ix, iy FROM {_E.format(_D.format(_S))} UNION ALL SELECT 'opened', ix, iy FROM {_D.format(_E.format(_D.format(_S)))}")
def cell_morphology(spark, d):
    """Closing of a sparse raster, and opening of its dilation."""
    c = table(spark, d, "part").select((F.col("p_partkey") % 41).alias("ix"), (F.col("p_size") % 37).cast("long").alias("iy")).distinct()
    named = lambda df, n: df.select(F.lit(n).alias("op"), "ix", "iy")
    return named(cells.closing(c, [], 1), "closed").unionByName(named(cells.opening(cells.dilate(c, [], 1), [], 1), "opened"))


def _strip(spark, d):
    """Cells of a 10 x 10 grid of 0.1 m for each nation, the first k % 10 columns set."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    g = n.select("k", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.1).alias("cell"), F.lit(10).cast("long").alias("nx"), F.lit(10).cast("long").alias("ny"))
    cols = n.filter("k % 10 > 0").withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("k") % 10 - 1).cast("long")))).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return n, g, cols


@query("""SELECT n_nationkey AS k, round((SELECT avg(CASE WHEN floor((0.05 + 0.9 * i / 11) / 0.1) < n_nationkey % 10 THEN 1.0 ELSE 0.0 END) FROM range(12) r(i)), 6) AS along, round(least(n_nationkey % 10, 6) / 6.0::DOUBLE, 6) AS inside, round(least(n_nationkey % 10, 8) / 8.0::DOUBLE, 6) AS boxed FROM nation""")
def cell_shares(spark, d):
    """Share of set cells along a segment, inside a polygon, and in an index box."""
    n, g, set_ = _strip(spark, d)
    seg = n.select("k", F.lit(0).alias("i"), F.lit(0.05).alias("ax"), F.lit(0.55).alias("ay"), F.lit(0.95).alias("bx"), F.lit(0.55).alias("by"))
    ring = n.select("k", F.lit(0).alias("i"), rings.ring((0.0, 0.0), (0.6, 0.0), (0.6, 0.4), (0.0, 0.4)).alias("r"))
    box = n.select("k", F.lit(0).alias("i"), *[F.lit(v).cast("long").alias(c) for c, v in (("i0", 0), ("j0", 2), ("i1", 8), ("j1", 6))])
    named = lambda df, c: df.select("k", F.round("share", 6).alias(c))
    along = cells.share_along(seg, set_, g, ["k"], ["i"], 12)
    inside = cells.share_in_ring(ring, set_, g, ["k"], ["i"], "r")
    return named(along, "along").join(named(inside, "inside"), "k").join(named(cells.share_in_box(box, set_, ["k"], ["i"]), "boxed"), "k")


@query("""SELECT n_nationkey AS k, i AS ix, n_nationkey % 10 AS iy FROM nation, range(5 + n_nationkey % 4) r(i) WHERE n_nationkey % 10 < 10""")
def blocked_rays(spark, d):
    """Cells that level sight lines see before the first blocked one."""
    n, g, _ = _strip(spark, d)
    y = (F.col("k") % 10) * 0.1 + 0.05
    ray = n.select("k", F.lit(1).alias("point_id"), F.lit(0.05).alias("cx"), y.alias("cy"), F.lit(0.99).alias("x"), y.alias("y"))
    wall = n.select("k", (F.col("k") % 4 + 5).cast("long").alias("ix"), (F.col("k") % 10).cast("long").alias("iy"))
    return cells.rays(ray, g, ["k"], blocked=wall).select("k", "ix", F.col("iy").cast("int").alias("iy"))


@query("""WITH f AS (SELECT n_nationkey AS k, 0.31 + n_nationkey % 3 * 0.1 AS s, 0.12::DOUBLE AS t0, 0.6 + n_nationkey % 4 * 0.1 AS t1 FROM nation),
p AS (SELECT k, s - 0.06 + j * 0.1 AS x, t0 + (t1 - t0) * i / (n - 1) AS y FROM (SELECT *, greatest(2, CAST(ceil((t1 - t0) / (0.1 * 0.7)) AS INT) + 1) AS n FROM f), range(3) a(j), range(60) b(i) WHERE i < n)
SELECT DISTINCT k, CAST(floor(x / 0.1) AS BIGINT) AS ix, CAST(floor(y / 0.1) AS BIGINT) AS iy FROM p WHERE x >= 0 AND x < 1 AND y >= 0 AND y < 1""")
def face_raster(spark, d):
    """Cells under upright fitted runs, a hand's breadth to either side."""
    n, g, _ = _strip(spark, d)
    k = F.col("k")
    run = n.select("k", F.lit(0.0).alias("alpha"), (k % 3 * 0.1 + 0.31).alias("s"), F.lit(0.12).alias("t0"), (k % 4 * 0.1 + 0.6).alias("t1"))
    return cells.runs(run, g, ["k"]).select("k", "ix", "iy")


_FLOOR = "SELECT l_orderkey % 40 AS ix, l_partkey % 40 AS iy FROM lineitem GROUP BY 1, 2 HAVING count(*) % 4 <> 0"


@query(f"""WITH RECURSIVE f AS ({_FLOOR}), r(ix, iy, o, d) AS (
  SELECT ix, iy, ix * 40 + iy, 0 FROM f WHERE (ix * 7 + iy * 13) % 97 = 0
  UNION SELECT f.ix, f.iy, r.o, r.d + 1 FROM r JOIN f ON abs(f.ix - r.ix) + abs(f.iy - r.iy) = 1 WHERE r.d < 60)
SELECT ix, iy, min(d)::BIGINT AS steps, arg_min(o, d * 10000 + o)::BIGINT AS owner FROM r GROUP BY ix, iy""")
def floor_territories(spark, d):
    """Each free cell with the nearest of some cells by steps over free ones (in tiles of 16)."""
    cell = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("ix"), (F.col("l_partkey") % 40).alias("iy")).agg(F.count("*").alias("n")).filter("n % 4 <> 0").select("ix", "iy")
    seeds = cell.filter("(ix * 7 + iy * 13) % 97 = 0").withColumn("owner", F.col("ix") * 40 + F.col("iy"))
    return graph.flood(cell, [], seeds, 16).filter("steps <= 60").select("ix", "iy", "steps", "owner")


# -- graphs, neighbours, pairs ----------------------------------------------------------------------------


@query("""SELECT n_nationkey AS k, (2 + n_nationkey % 3)::BIGINT AS steps FROM nation""")
def grid_paths(spark, d):
    """Shortest way between opposite corners of small floors."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    floor = n.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("k") % 3).cast("long")))).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    out = None
    for m in range(3):
        part = graph.grid_path(floor.filter(F.col("k") % 3 == m), ["k"], (0, 0), (m, 2))
        out = part if out is None else out.unionByName(part)
    return out.select("k", long("steps"))


@query("""SELECT p_partkey, round(-sqrt(0.5), 5) AS nx, 0.0::DOUBLE AS ny, round(sqrt(0.5), 5) AS nz FROM part""")
def surface_normals(spark, d):
    """Normals of points on a slope from their neighbours, turned to a camera above."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.lit("s").alias("scene_id"), k.alias("point_id"), (k % 50 * 0.1).alias("x"), (F.floor(k / 50) * 0.1).alias("y")).withColumn("z", F.col("x"))
    n = normals.estimate(p, ["scene_id"], 8)
    seen = normals.orient(p.join(n, ["scene_id", "point_id"]).withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0), "cz": F.lit(1000.0)}))
    five = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return seen.select(F.col("point_id").alias("p_partkey"), five("nx"), five("ny"), five("nz"))


_RANGE = "SELECT a.s_nationkey AS k, a.s_suppkey AS a, b.s_suppkey AS b, round(b.s_acctbal - a.s_acctbal, 4) AS apart FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal - a.s_acctbal BETWEEN 40 AND 900"
_GREEDY = f"""p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY apart, a, b) AS r FROM ({_RANGE})),
g(k, r, ua, ub, a, b) AS (SELECT k, r, [a], [b], a, b FROM p WHERE r = 1 UNION ALL
SELECT p.k, p.r, CASE WHEN list_contains(ua, p.a) OR list_contains(ub, p.b) THEN ua ELSE list_append(ua, p.a) END, CASE WHEN list_contains(ua, p.a) OR list_contains(ub, p.b) THEN ub ELSE list_append(ub, p.b) END,
CASE WHEN list_contains(ua, p.a) OR list_contains(ub, p.b) THEN NULL ELSE p.a END, CASE WHEN list_contains(ua, p.a) OR list_contains(ub, p.b) THEN NULL ELSE p.b END FROM g JOIN p ON p.k = g.k AND p.r = g.r + 1)"""


def _pairs(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"))
    r = s.select("k", F.col("a").alias("b"), F.col("x").alias("y"))
    gap = F.col("y") - F.col("x")
    found = join.range_join(s, r, ["k"], F.col("x"), F.col("y"), 900.0, gap.between(40, 900), deal=4 * spark.sparkContext.defaultParallelism).withColumn("apart", F.round(gap, 4))
    return s, join.greedy_pairs(found, ["k"], "a", "b", [F.col("apart")])


@query(f"WITH RECURSIVE {_GREEDY} SELECT k, a, b FROM g WHERE a IS NOT NULL")
def greedy_pairing(spark, d):
    """One-to-one pairs of a nation's suppliers, the closest first."""
    return _pairs(spark, d)[1].select("k", "a", "b")


@query(f"WITH RECURSIVE {_GREEDY} SELECT s_nationkey AS k, s_suppkey AS a FROM supplier WHERE s_suppkey NOT IN (SELECT a FROM g WHERE a IS NOT NULL)")
def unpaired(spark, d):
    """Suppliers that begin no pair."""
    s, pairs = _pairs(spark, d)
    return join.unmatched(s, pairs, ["k"], "a", "a").select("k", "a")


_PEAKS = """WITH RECURSIVE h AS (SELECT l_returnflag AS f, CAST(floor(l_extendedprice / 2000) AS BIGINT) AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT f, min(bin) AS a, max(bin) AS b FROM h GROUP BY 1), x AS (SELECT e.f, unnest(generate_series(a, b)) AS bin FROM e), y AS (SELECT x.f, x.bin, coalesce(n, 0) AS n FROM x LEFT JOIN h USING (f, bin)),
s AS (SELECT f, bin, (2 * n + coalesce(lag(n) OVER w, 0) + coalesce(lead(n) OVER w, 0)) / 4 AS v FROM y WINDOW w AS (PARTITION BY f ORDER BY bin)),
m AS (SELECT * FROM (SELECT *, coalesce(lag(v) OVER w, -1e300) AS l, coalesce(lead(v) OVER w, -1e300) AS r FROM s WINDOW w AS (PARTITION BY f ORDER BY bin)) WHERE v >= l AND v > r AND v >= 5),
q AS (SELECT m.f, m.bin, m.v, (SELECT max(bin) FROM s WHERE s.f = m.f AND s.bin < m.bin AND s.v > m.v) AS hl, (SELECT min(bin) FROM s WHERE s.f = m.f AND s.bin > m.bin AND s.v > m.v) AS hr FROM m),
p AS (SELECT f, bin, v, CASE WHEN hl IS NULL THEN least(0, v) ELSE least(v, (SELECT coalesce(min(s.v), 1e300) FROM s WHERE s.f = q.f AND s.bin > hl AND s.bin < q.bin)) END AS left_, CASE WHEN hr IS NULL THEN least(0, v) ELSE least(v, (SELECT coalesce(min(s.v), 1e300) FROM s WHERE s.f = q.f AND s.bin < hr AND s.bin > q.bin)) END AS right_ FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY v DESC, bin) AS k FROM p WHERE v - greatest(left_, right_) >= 2),
g(f, k, held, bin, v) AS (SELECT f, k, [bin], bin, v FROM o WHERE k = 1 UNION ALL SELECT o.f, o.k, CASE WHEN len(list_filter(held, lambda b: abs(b - o.bin) < 3)) = 0 THEN list_append(held, o.bin) ELSE held END, CASE WHEN len(list_filter(held, lambda b: abs(b - o.bin) < 3)) = 0 THEN o.bin END, o.v FROM g JOIN o ON o.f = g.f AND o.k = g.k + 1)
SELECT f AS l_returnflag, bin, round(v, 6) AS smooth, row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS rank FROM g WHERE bin IS NOT NULL"""


@query(_PEAKS)
def strongest_peaks(spark, d):
    """Peaks with prominence and greedy suppression of weaker neighbours, per return flag."""
    sm = aggregate.smoothed_histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 2000.0)
    return ordered.peaks(sm, ["l_returnflag"], "bin", "smooth", 5.0, 3, 2.0).select("l_returnflag", "bin", F.round("smooth", 6).alias("smooth"), long("rank").alias("rank"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k FROM lineitem)
SELECT l_orderkey, count(*) AS n, max(k) AS last FROM r GROUP BY 1""")
def running_ranks(spark, d):
    """Ranks within a key, the base of every ordered operator."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("k", F.row_number().over(w) - 1).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("k").cast("long").alias("last"))


@query("""SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS near FROM lineitem GROUP BY 1""")
def approximate_counts(spark, d):
    """Distinct orders by a sketch, within five percent of the exact number."""
    # a distinct count beside a sketch would keep a sketch for every order; a sketch doesn't mind that they are distinct
    orders = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    a = orders.groupBy("l_returnflag").agg(F.count("l_orderkey").alias("exact"), F.approx_count_distinct("l_orderkey", 0.01).alias("about"))
    return a.select("l_returnflag", "exact", (F.abs(F.col("about") / F.col("exact") - 1) < 0.05).alias("near"))

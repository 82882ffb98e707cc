"""The ordered, aggregating, joining and raster operators on the relational test tables, each
with the SQL that states the same result. The tables have no point clouds, so adapters give
their numeric columns the part of times, stations, heights or cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rings, site, text, vec, walls
from ..operators import aggregate, align, cells, graph, join, ordered, select
from ..operators import knn as nearby

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    for f in df.schema:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def events(spark, d):
    """Events with seconds since the epoch."""
    return table(spark, d, "events").withColumn("t", F.unix_micros("ts") / 1e6)


EV = "(SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"

# -- windows, islands, intervals -----------------------------------------------------------


@query("""WITH c AS (SELECT event_id, value, user_id, count(*) OVER () AS n FROM events),
s AS (SELECT *, least(19, CAST(floor(event_id * 20 / n) AS BIGINT)) AS stretch FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY stretch ORDER BY value DESC, event_id) = 1 AS first FROM s)
SELECT event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (ORDER BY first DESC, value DESC, event_id) AS r FROM f) WHERE r <= 20""")
def spread_topk(spark, d):
    """Twenty events spread over the id range (a top-k report)."""
    ev = table(spark, d, "events").select("event_id", "value")
    n = ev.count()
    return select.spread_top(ev.withColumn("all", F.lit(0)), ["all"], "event_id", "value", 20, n).select("event_id", F.round("value", 6).alias("value"))


@query(f"""WITH e AS (SELECT user_id, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 21600 THEN 1 ELSE 0 END AS b FROM {EV}),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, round(min(t), 3) AS t0, round(max(t), 3) AS t1 FROM i GROUP BY 1, 2 HAVING count(*) >= 3""")
def gap_islands(spark, d):
    out = ordered.islands(events(spark, d), ["user_id"], "t", 21600.0, least=3, ties=["event_id"])
    return out.select("user_id", F.col("island").cast("long").alias("island"), "n", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query("""WITH o AS (SELECT o_custkey, epoch_us(o_orderdate) / 86400000000 AS a, epoch_us(o_orderdate) / 86400000000 + 30 AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
k AS (SELECT *, sum(CASE WHEN a > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT o_custkey, round(min(a), 4) AS t0, round(max(b), 4) AS t1, count(*) AS n FROM k GROUP BY o_custkey, k""")
def interval_union(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.unix_micros("o_orderdate") / 86400000000).alias("t0")).withColumn("t1", F.col("t0") + 30)
    return ordered.interval_union(o, ["o_custkey"], bridge=5.0).select("o_custkey", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"), "n")


@query("""WITH o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) / 86400000000 AS a, epoch_us(o_orderdate) / 86400000000 + 30 AS b FROM orders),
w AS (SELECT k, min(a) AS w0, max(b) AS w1 FROM o GROUP BY k),
m AS (SELECT o.k, a, b, max(b) OVER (PARTITION BY o.k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
SELECT k AS o_custkey, round(reach, 4) AS t0, round(a, 4) AS t1 FROM m WHERE a - reach > 60""")
def interval_difference(spark, d):
    """Stretches of a customer's history without an open order: the uncovered portions of a line."""
    o = table(spark, d, "orders").select("o_custkey", (F.unix_micros("o_orderdate") / 86400000000).alias("t0")).withColumn("t1", F.col("t0") + 30)
    whole = o.groupBy("o_custkey").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return ordered.interval_difference(whole, o, ["o_custkey"], 60.0).select("o_custkey", F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"))


@query("""WITH h AS (SELECT CAST(floor(l_extendedprice / 1000) AS BIGINT) AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(bin) FROM h), (SELECT max(bin) FROM h))) AS bin),
f AS (SELECT g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (bin))
SELECT bin, n, round((2 * n + coalesce(lag(n) OVER (ORDER BY bin), 0) + coalesce(lead(n) OVER (ORDER BY bin), 0)) / 4, 6) AS smooth FROM f""")
def histogram_smooth(spark, d):
    li = table(spark, d, "lineitem").select(F.lit(0).alias("all"), "l_extendedprice")
    return aggregate.smoothed_histogram(li, ["all"], "l_extendedprice", 1000.0).select("bin", "n", F.round("smooth", 6).alias("smooth"))


@query("""WITH h AS (SELECT CAST(floor(l_extendedprice / 500) AS BIGINT) AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(bin) FROM h), (SELECT max(bin) FROM h))) AS bin),
f AS (SELECT g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (bin)),
w AS (SELECT *, lag(n) OVER (ORDER BY bin) AS l, lead(n) OVER (ORDER BY bin) AS r FROM f)
SELECT bin, n FROM w WHERE n >= coalesce(l, -1e300) AND n > coalesce(r, -1e300) AND n >= 20""")
def local_peaks(spark, d):
    li = table(spark, d, "lineitem").select(F.lit(0).alias("all"), "l_extendedprice")
    dense = aggregate.dense(aggregate.histogram(li, ["all"], "l_extendedprice", 500.0), ["all"])
    return ordered.local_maxima(dense, ["all"], "bin", "n", 20.0).select("bin", "n")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, ln(1 - l_discount) AS x FROM lineitem),
p AS (SELECT l_orderkey, exp(sum(x) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)) AS p FROM (SELECT l_orderkey, l_linenumber, sum(x) AS x FROM r GROUP BY 1, 2))
SELECT l_orderkey, round(greatest(max(p), 1) / least(min(p), 1), 6) AS spread, count(*) AS links FROM p GROUP BY 1""")
def scale_chain(spark, d):
    """Spread of the running product of factors along each order."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.exp(F.sum(F.ln(1 - F.col("l_discount")))).alias("f"))
    return ordered.chain_spread(li, ["l_orderkey"], "l_linenumber", "f").select("l_orderkey", F.round("spread", 6).alias("spread"), "links")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)
SELECT o_custkey, c AS chunk, count(*) AS n, min(o_orderkey) AS first FROM (
  SELECT o_custkey, o_orderkey, unnest(generate_series(greatest(0, CAST(ceil((k - 5) / 4.0) AS BIGINT)), CAST(floor(k / 4.0) AS BIGINT))) AS c FROM r) GROUP BY 1, 2""")
def hopping_chunks(spark, d):
    """Hopping windows of six orders, two shared, like the chunks of a walk."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return ordered.hopping(o.withColumn("k", k), F.col("k"), 6, 2).groupBy("o_custkey", "chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT a.user_id, a.event_id, count(*) AS n, round(sum(abs(a.value - b.value)), 4) AS apart FROM r a JOIN r b ON a.user_id = b.user_id AND abs(a.k - b.k) <= 6 AND a.k <> b.k GROUP BY 1, 2""")
def neighbour_pairs(spark, d):
    """Views at most six places apart: an explode and an equi-join."""
    p = ordered.neighbours(table(spark, d, "events"), ["user_id"], "event_id", 6, ["event_id", "value"])
    return p.groupBy("user_id", F.col("event_id_i").alias("event_id")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("value_i") - F.col("value_j"))), 4).alias("apart"))


# -- joins -----------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT * FROM {EV} WHERE event_type = 'click'), b AS (SELECT * FROM {EV} WHERE event_type = 'view'),
p AS (SELECT a.event_id, b.event_id AS other, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t, b.event_id) AS r
      FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 3600)
SELECT a.event_id, p.other FROM a LEFT JOIN p ON a.event_id = p.event_id AND p.r = 1""")
def asof_nearest(spark, d):
    """Each click with the nearest view of the same user within an hour."""
    ev = events(spark, d).select("user_id", "event_id", "event_type", "t")
    left = ev.filter("event_type = 'click'").drop("event_type")
    right = ev.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("other"), F.col("t").alias("seen"))
    return join.nearest(left, right, ["user_id"], "t", "seen", 3600.0, ["other"], ["other"]).select("event_id", "other")


@query(f"""WITH a AS (SELECT user_id, t FROM {EV} WHERE event_type = 'click'), b AS (SELECT user_id, t FROM {EV} WHERE event_type = 'view'),
o AS (SELECT unnest([-600.0, 0.0, 600.0])::DOUBLE AS off),
p AS (SELECT off, a.user_id, a.t, min(abs(a.t + off - b.t)) AS gap FROM a, o, b WHERE a.user_id = b.user_id GROUP BY 1, 2, 3)
SELECT off AS clock_offset, count(*) FILTER (gap <= 1800) AS n, round(sum(gap) FILTER (gap <= 1800), 2) AS apart FROM p GROUP BY 1""")
def clock_offsets(spark, d):
    """Nearest matches under three clock offsets, scored."""
    ev = events(spark, d).select("user_id", "event_type", "t")
    left = ev.filter("event_type = 'click'").select("user_id", "t").distinct()
    right = ev.filter("event_type = 'view'").select("user_id", "t").distinct()
    m = join.offset_search(left, right, ["user_id"], "t", [-600.0, 0.0, 600.0], 1800.0, [])
    gap = F.abs(F.col("t") + F.col("clock_offset") - F.col("t_nearest"))
    return m.groupBy("clock_offset").agg(F.count(gap).alias("n"), F.round(F.sum(gap), 2).alias("apart"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(b.s_acctbal - a.s_acctbal, 4) AS apart FROM supplier a JOIN supplier b
ON a.s_nationkey = b.s_nationkey AND b.s_acctbal - a.s_acctbal BETWEEN 40 AND 450""")
def range_pairs(spark, d):
    """Pairs within a band of distances: faces of one wall."""
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"))
    r = s.select("s_nationkey", F.col("a").alias("b"), F.col("x").alias("y"))
    gap = F.col("y") - F.col("x")
    return join.range_join(s, r, ["s_nationkey"], F.col("x"), F.col("y"), 450.0, gap.between(40, 450)).select("a", "b", F.round(gap, 4).alias("apart"))


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 86400000000 AS x, o_totalprice AS q FROM orders)
SELECT o_orderkey FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(a.x - b.x) <= 3
  AND (b.q > a.q OR (b.q = a.q AND b.o_orderkey < a.o_orderkey)))""")
def duplicate_anti(spark, d):
    """Orders without a larger one of the same customer within three days."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.unix_micros("o_orderdate") / 86400000000).alias("x"), "o_totalprice")
    return join.anti_near(o, ["o_custkey"], "x", 3.0, "o_totalprice", "o_orderkey").select("o_orderkey")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey, epoch_us(o_orderdate) / 86400000000 AS t FROM orders),
i AS (SELECT c_custkey AS k, 9000 + c_custkey % 700 AS lo, 9000 + c_custkey % 700 + 45.5 AS hi FROM customer)
SELECT p.o_orderkey, p.k AS o_custkey FROM p JOIN i ON p.k = i.k AND p.t BETWEEN i.lo AND i.hi""")
def interval_lookup(spark, d):
    """Orders inside their customer's season: points in intervals."""
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.unix_micros("o_orderdate") / 86400000000).alias("t"))
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (9000 + F.col("c_custkey") % 700).cast("double").alias("lo")).withColumn("hi", F.col("lo") + 45.5)
    return join.interval_join(p, i, ["k"], F.col("t"), F.col("lo"), F.col("hi"), 30.0).select("o_orderkey", F.col("k").alias("o_custkey"))


@query("""WITH b AS (SELECT p_partkey AS id, p_size * 10.0 AS x0, p_retailprice AS y0, p_size * 10.0 + 4 AS x1, p_retailprice + 3 AS y1, p_brand FROM part)
SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.p_brand = b.p_brand AND a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def box_overlaps(spark, d):
    """Boxes that touch, through a grid of tiles: each pair once."""
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("a"), F.struct((F.col("p_size") * 10.0).alias("x0"), F.col("p_retailprice").alias("y0"), (F.col("p_size") * 10.0 + 4).alias("x1"), (F.col("p_retailprice") + 3).alias("y1")).alias("box"))
    q = p.select("p_brand", F.col("a").alias("b"), F.col("box").alias("other"))
    return join.box_join(p, q, ["p_brand"], F.col("box"), F.col("other"), 25.0, F.col("a") < F.col("b"), deal=4 * spark.sparkContext.defaultParallelism).select("a", "b")


@query("""WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
r AS (SELECT a.label, a.vec_id AS id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.vec_id) AS rank
      FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT id, other, rank FROM r WHERE rank <= 5""")
def knn(spark, d):
    """Five nearest in the plane of the first two dimensions, within a label."""
    v = table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return nearby.k_nearest(v, ["label"], "vec_id", ["x", "y"], 5).select("id", "other", F.col("rank").cast("long").alias("rank"))


RINGS = [("square", [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]), ("wedge", [(0, 0), (0.3, 0.02), (0.05, 0.3)]), ("ell", [(-0.3, -0.3), (0.2, -0.3), (0.2, -0.1), (-0.1, -0.1), (-0.1, 0.2), (-0.3, 0.2)])]


def _rings(spark):
    rows = [(n, [{"x": float(x), "y": float(y)} for x, y in r]) for n, r in RINGS]
    return spark.createDataFrame(rows, "name string, ring array<struct<x:double,y:double>>")


def _ring_sql() -> str:
    edges = [(n, *r[i], *r[(i + 1) % len(r)]) for n, r in RINGS for i in range(len(r))]
    return "(VALUES " + ", ".join(f"('{n}', {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for n, ax, ay, bx, by in edges) + ") e(name, ax, ay, bx, b_y)"


@query(f"""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, name FROM v, {_ring_sql()} WHERE (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def point_in_polygon(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), F.lit(0).alias("k"))
    return join.point_in_polygon(v, _rings(spark).withColumn("k", F.lit(0)), ["k"], "x", "y", "ring", 0.1).select("vec_id", "name")


# -- aggregates and rasters --------------------------------------------------------------------


@query("""SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS vx, CAST(floor(l_extendedprice / 10000) AS BIGINT) AS vy, CAST(floor(l_discount * 100 / 2) AS BIGINT) AS vz, count(DISTINCT l_orderkey) > 0 AS hit FROM lineitem GROUP BY 1, 2, 3""")
def voxel_dedup(spark, d):
    """One line a voxel of quantity, price and discount; which one is a hash's choice."""
    li = table(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("point_id"), (F.col("l_quantity") / 5).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_discount") * 100 / 2).alias("z"))
    v = select.voxel_thin(li, [], 1.0)
    return v.select(F.floor("x").cast("long").alias("vx"), F.floor("y").cast("long").alias("vy"), F.floor("z").cast("long").alias("vz"), F.lit(True).alias("hit"))


@query("""SELECT l_suppkey % 50 AS ix, l_partkey % 50 AS iy, count(DISTINCT month(l_shipdate)) AS bands FROM lineitem GROUP BY 1, 2""")
def coverage_cells(spark, d):
    """Distinct months in each cell of a grid: height bands in each cell of a plan."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("ix"), (F.col("l_partkey") % 50).alias("iy"), F.month("l_shipdate").alias("z"))
    return aggregate.band_coverage(li, ["ix", "iy"], "z", 1.0)


@query("""WITH a AS (SELECT DISTINCT user_id AS ix, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS iy FROM events WHERE event_type = 'click'),
b AS (SELECT DISTINCT user_id AS ix, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS iy FROM events WHERE event_type = 'view')
SELECT (SELECT count(*) FROM a JOIN b USING (ix, iy)) AS inter, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS total,
round((SELECT count(*) FROM a JOIN b USING (ix, iy)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS iou""")
def raster_iou(spark, d):
    """Common over covered cells of two event types by user and day."""
    c = table(spark, d, "events").select("event_type", F.col("user_id").alias("ix"), F.unix_date(F.to_date("ts")).cast("long").alias("iy"))
    out = cells.iou(c.filter("event_type = 'click'").distinct(), c.filter("event_type = 'view'").distinct(), [])
    return out.select("inter", "total", F.round("iou", 6).alias("iou"))


_CELLS = "(SELECT DISTINCT CAST(floor(l_quantity) AS BIGINT) AS ix, CAST(floor(l_extendedprice / 2000) AS BIGINT) AS iy FROM lineitem)"


def _cells(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.floor("l_quantity").cast("long").alias("ix"), F.floor(F.col("l_extendedprice") / 2000).cast("long").alias("iy")).distinct()


@query(f"""SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM {_CELLS} c, (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b""")
def dilate_cells(spark, d):
    return cells.dilate(_cells(spark, d), [], 1)


@query(f"""SELECT c.ix, c.iy FROM {_CELLS} c JOIN {_CELLS} o ON abs(c.ix - o.ix) <= 1 AND abs(c.iy - o.iy) <= 1 GROUP BY 1, 2 HAVING count(*) = 9""")
def erode_cells(spark, d):
    return cells.erode(_cells(spark, d), [], 1)


@query(f"""WITH b AS (SELECT DISTINCT ix // 4 AS bx, iy // 4 AS b_y FROM {_CELLS} c)
SELECT bx * 4 + i AS ix, b_y * 4 + j AS iy FROM b, (SELECT unnest(range(4)) AS i) p, (SELECT unnest(range(4)) AS j) q""")
def pool_cells(spark, d):
    """Blocks that hold any set cell: the seen share of a floor at a coarser reach."""
    return cells.pool(_cells(spark, d), [], 4)


@query(f"""SELECT ix, iy, side FROM (SELECT c.*, e.* FROM {_CELLS} c, (VALUES ('E', 1, 0), ('W', -1, 0), ('N', 0, 1), ('S', 0, -1)) e(side, dx, dy)) t
WHERE NOT EXISTS (SELECT 1 FROM {_CELLS} o WHERE o.ix = t.ix + t.dx AND o.iy = t.iy + t.dy)""")
def cell_outline(spark, d):
    return cells.boundary(_cells(spark, d), [])


@query("""WITH RECURSIVE c AS (SELECT DISTINCT l_orderkey % 500 AS ix, l_partkey % 500 AS iy FROM lineitem), n AS (SELECT ix, iy, ix * 100000 + iy AS id FROM c),
e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.iy = b.iy AND a.ix = b.ix + 1 UNION ALL SELECT a.id, b.id FROM n a JOIN n b ON a.ix = b.ix AND a.iy = b.iy + 1), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
l AS (SELECT a, min(b) AS label, count(*) AS size FROM r GROUP BY a)
SELECT size, count(*) / size AS parts FROM (SELECT a, size::BIGINT AS size FROM l) GROUP BY size""")
def cell_component_sizes(spark, d):
    """How many 4-connected pieces of each size a raster has."""
    c = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("ix"), (F.col("l_partkey") % 500).alias("iy")).distinct()
    comp = graph.cell_components(c.withColumn("k", F.lit(0)), ["k"])
    sizes = comp.groupBy("label").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").cast("double").alias("parts"))


@query("""WITH p AS (SELECT event_type, (epoch_us(ts) / 1e6 % 86400) / 86400 * 2 * pi() AS a FROM events)
SELECT event_type, round(((atan2(sum(sin(a)), sum(cos(a))) / (2 * pi()) * 24) % 24 + 24) % 24, 4) AS hour FROM p GROUP BY 1""")
def circular_mean_hour(spark, d):
    ev = events(spark, d).withColumn("a", F.pmod(F.col("t"), F.lit(86400.0)) / 86400 * 24)
    return ev.groupBy("event_type").agg(F.round(vec.circular_mean(F.col("a"), 24.0), 4).alias("hour"))


@query("""SELECT event_type, CASE WHEN count(*) FILTER (value >= 20) >= 5 THEN round(quantile_cont(value, 0.05) FILTER (value >= 20), 6) ELSE 2.05 END AS z1, count(*) FILTER (value >= 20) >= 5 AS measured FROM events GROUP BY 1""")
def measured_or_default(spark, d):
    """A lintel height where enough samples are high enough, else the default."""
    out = aggregate.floor_of_samples(table(spark, d, "events"), ["event_type"], "value", 20.0, 5, 2.05)
    return out.select("event_type", F.round("z1", 6).alias("z1"), "measured")


@query("""WITH x AS (SELECT l.quality, l.toxic, d.n_chars, l.doc_id FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT toxic, row_number() OVER (PARTITION BY toxic ORDER BY quality, doc_id) AS a, row_number() OVER (PARTITION BY toxic ORDER BY n_chars, doc_id) AS b FROM x)
SELECT toxic, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 3""")
def spearman(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = aggregate.spearman(x, ["toxic"], "quality", "n_chars", ["doc_id"])
    return out.filter("n >= 3").select("toxic", F.round("rho", 6).alias("rho"), "n")


@query("""SELECT label, round(covar_pop(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 8) AS c01, round(var_pop(embedding[1]::DOUBLE), 8) AS c00, round(var_pop(embedding[2]::DOUBLE), 8) AS c11 FROM embeddings GROUP BY 1""")
def pca_covariance(spark, d):
    e = table(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in (0, 1)])
    return e.groupBy("label").agg(F.round(F.covar_pop("e0", "e1"), 8).alias("c01"), F.round(F.var_pop("e0"), 8).alias("c00"), F.round(F.var_pop("e1"), 8).alias("c11"))


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def schedule_cube(spark, d):
    """Totals at every level, as an area schedule with its sums."""
    o = table(spark, d, "orders")
    name = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c))
    out = o.cube("o_orderstatus", "o_orderpriority").agg(name("o_orderstatus").alias("status"), name("o_orderpriority").alias("priority"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.select("status", "priority", "n", "total")


# -- selection, rules, graphs ------------------------------------------------------------------


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '\\.org/') THEN 'org' WHEN regexp_matches(url, '/(de|fr|es)/') THEN 'foreign' WHEN regexp_matches(url, '#') THEN 'anchor' ELSE NULL END AS rule FROM pages""")
def regex_rules(spark, d):
    """First matching rule, as a phone is identified by its model string."""
    rules = [(r"\.org/", F.lit("org")), ("/(de|fr|es)/", F.lit("foreign")), ("#", F.lit("anchor"))]
    return table(spark, d, "pages").select("page_id", select.first_rule(F.col("url"), rules).alias("rule"))


@query("""WITH r AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS position, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_nationkey, position, s_name AS label FROM r WHERE position <= 3 UNION ALL SELECT DISTINCT s_nationkey, 4, '+' || (n - 3) || ' more' FROM r WHERE n > 3""")
def overflow_rows(spark, d):
    """A table cut at three rows that says how many more there are (a report)."""
    out = select.with_overflow(table(spark, d, "supplier"), ["s_nationkey"], ["s_name"], 3, "s_name", "+%d more")
    return out.select("s_nationkey", F.col("position").cast("long").alias("position"), "label")


@query("""WITH RECURSIVE h AS (SELECT p_partkey AS id, p_brand || '/' || p_size AS k FROM part UNION ALL SELECT p_partkey, p_type || '/' || CAST(floor(p_retailprice / 20) AS BIGINT) FROM part),
e AS (SELECT DISTINCT a.id AS a, min(b.id) AS b FROM h a JOIN h b ON a.k = b.k GROUP BY a.id, a.k), u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(a, b) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT a AS node, min(b) AS label FROM r GROUP BY a""")
def components(spark, d):
    """Parts linked by brand and size or by type and price level, through a star a group."""
    p = table(spark, d, "part")
    key = lambda *c: F.concat_ws("/", *c)
    h = p.select(F.col("p_partkey").alias("a"), F.explode(F.array(key("p_brand", F.col("p_size").cast("string")), key("p_type", F.floor(F.col("p_retailprice") / 20).cast("string")))).alias("k"))
    first = h.groupBy("k").agg(F.min("a").alias("b"))
    e = h.join(first, "k").filter("a <> b").select(F.lit(0).alias("z"), "a", "b")
    return graph.components(e, ["z"]).select("node", "label")


@query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN CAST(CAST(floor(s_acctbal / 0.0254 / 12) AS BIGINT) + CASE WHEN round_even(s_acctbal / 0.0254 - floor(s_acctbal / 0.0254 / 12) * 12, 0) = 12 THEN 1 ELSE 0 END AS VARCHAR) || '''' || CAST(CAST(CASE WHEN round_even(s_acctbal / 0.0254 - floor(s_acctbal / 0.0254 / 12) * 12, 0) = 12 THEN 0 ELSE round_even(s_acctbal / 0.0254 - floor(s_acctbal / 0.0254 / 12) * 12, 0) END AS BIGINT) AS VARCHAR) || '"' END AS ft FROM supplier""")
def feet_inches(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, text.length_text(F.col("s_acctbal"), "ft")).alias("ft"))


@query("""WITH a AS (SELECT c_custkey, abs(c_acctbal) / 100 AS x FROM customer), b AS (SELECT c_custkey, CAST(trunc(x) AS INT) AS deg, (x - trunc(x)) * 60 AS mf FROM a),
c AS (SELECT c_custkey, deg, CAST(trunc(mf) AS INT) AS m, CAST(round_even((mf - trunc(mf)) * 60, 0) AS INT) AS s FROM b),
e AS (SELECT c_custkey, deg, CASE WHEN s = 60 THEN m + 1 ELSE m END AS m, CASE WHEN s = 60 THEN 0 ELSE s END AS s FROM c)
SELECT c_custkey, printf('%d°%02d''%02d"', CASE WHEN m = 60 THEN deg + 1 ELSE deg END, CASE WHEN m = 60 THEN 0 ELSE m END, s) AS dms FROM e""")
def dms_format(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.dms(F.abs("c_acctbal") / 100).alias("dms"))


@query("""SELECT p_partkey, round(TRY_CAST(regexp_replace(replace(lower(trim(v)), ',', '.'), '( meters| metres| m|m)$', '') AS DOUBLE), 6) AS metres FROM (
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size || ',5 m' WHEN 1 THEN p_size || ' Metres' WHEN 2 THEN p_size || 'm' ELSE p_brand END AS v FROM part)""")
def unit_parse(spark, d):
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    v = F.when(k == 0, F.concat(F.lit(" "), size, F.lit(",5 m"))).when(k == 1, F.concat(size, F.lit(" Metres"))).when(k == 2, F.concat(size, F.lit("m"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.round(text.quantity(v), 6).alias("metres"))


@query("""SELECT c_custkey, round(((degrees(atan2(c_acctbal, c_custkey - 700)) % 360) + 360) % 360, 6) AS bearing,
CASE WHEN c_custkey <= 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((c_custkey - 24) / 20.0) AS BIGINT)) END AS chunks FROM customer""")
def bearings(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(vec.bearing(F.col("c_acctbal"), (F.col("c_custkey") - 700).cast("double")), 6).alias("bearing"), text.chunk_count(F.col("c_custkey")).alias("chunks"))


@query("""WITH p AS (SELECT s_suppkey, (s_suppkey % 160 - 80)::DOUBLE AS lat, (s_suppkey * 7 % 360 - 180)::DOUBLE AS lon FROM supplier)
SELECT s_suppkey, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32
 WHEN lat BETWEEN 72 AND 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END
 ELSE CAST(floor((lon + 180) / 6) AS INT) + 1 END AS zone, substr('CDEFGHJKLMNPQRSTUVWXX', CAST(floor((lat + 80) / 8) AS INT) + 1, 1) AS band FROM p""")
def utm_zones(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 160 - 80).cast("double").alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("lon"))
    return s.select("s_suppkey", site.utm_zone(F.col("lat"), F.col("lon")).alias("zone"), site.utm_band(F.col("lat")).alias("band"))


@query("""WITH s AS (SELECT s_suppkey, 6378137.0 AS a, 0.0066943799901413165 AS e2, radians(s_suppkey % 60) AS phi, s_suppkey % 60 AS lat0, s_suppkey % 170 AS lon0 FROM supplier)
SELECT s_suppkey, round(radians(0.001) * a / sqrt(1 - e2 * sin(phi) ** 2) * cos(phi), 5) AS x, round(radians(0.002) * a * (1 - e2) / (1 - e2 * sin(phi) ** 2) ** 1.5, 5) AS y FROM s""")
def local_frame(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 60).cast("double").alias("lat0"), (F.col("s_suppkey") % 170).cast("double").alias("lon0"))
    p = site.to_local(F.col("lon0") + 0.001, F.col("lat0") + 0.002, F.col("lon0"), F.col("lat0"))
    return s.select("s_suppkey", F.round(p["x"], 5).alias("x"), F.round(p["y"], 5).alias("y"))


@query("""WITH q AS (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice / 100 AS h FROM part)
SELECT p_partkey, round(w * h - w / 2 * h / 2, 6) AS area, round(2 * (w + h), 6) AS perimeter FROM q""")
def ring_measures(spark, d):
    """Area and outline of an L cut from each part's rectangle."""
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    pt = lambda x, y: rings.point(x, y)
    zero = F.lit(0.0)
    ell = F.array(pt(zero, zero), pt(w, zero), pt(w, h / 2), pt(w / 2, h / 2), pt(w / 2, h), pt(zero, h))
    return table(spark, d, "part").select("p_partkey", ell.alias("r")).select("p_partkey", F.round(rings.area(F.col("r")), 6).alias("area"), F.round(rings.perimeter(F.col("r")), 6).alias("perimeter"))


@query("""WITH p AS (SELECT p_size, p_retailprice FROM part) SELECT CAST(p_size AS BIGINT) AS size, round(sum(greatest(0, least(p_retailprice, 1500) - greatest(p_retailprice - 200, 1200))), 4) AS common FROM p GROUP BY 1""")
def interval_overlap(spark, d):
    c = walls.overlap(F.col("p_retailprice") - 200, F.col("p_retailprice"), F.lit(1200.0), F.lit(1500.0))
    return table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("size")).agg(F.round(F.sum(c), 4).alias("common"))


@query("""SELECT s_suppkey, string_split(s_name, '#')[1] AS head, replace(replace(replace(replace(s_name || ' <a&b>"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS markup FROM supplier""")
def markup_escape(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.split("s_name", "#").getItem(0).alias("head"), text.escape_markup(F.concat("s_name", F.lit(' <a&b>"'))).alias("markup"))


@query("""SELECT doc_id, CAST(floor(n_chars / 1000) AS BIGINT) AS k FROM documents WHERE n_chars >= 1000 INTERSECT SELECT doc_id, CAST(floor(n_chars / 1000) AS BIGINT) FROM documents WHERE lang = 'en'
EXCEPT SELECT doc_id, CAST(floor(n_chars / 1000) AS BIGINT) FROM documents WHERE n_chars > 5000""")
def set_algebra(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.floor(F.col("n_chars") / 1000).cast("long").alias("k"))
    pick = lambda c: x.filter(c).select("doc_id", "k")
    return pick("n_chars >= 1000").intersect(pick("lang = 'en'")).subtract(pick("n_chars > 5000"))


# -- cameras, rings and pictures -----------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings),
n AS (SELECT vec_id, x / l AS x, y / l AS y, z / l AS z, w / l AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS l FROM q))
SELECT vec_id, round(1 - 2 * (y * y + z * z), 6) AS r00, round(2 * (x * y - z * w), 6) AS r01, round(2 * (x * z - y * w), 6) AS r20 FROM n""")
def quaternion_rotation(spark, d):
    x, y, z, w = (F.get("embedding", F.lit(i)).cast("double") for i in range(4))
    r = table(spark, d, "embeddings").select("vec_id", vec.quaternion_rotation(x, y, z, w).alias("r"))
    return r.select("vec_id", *[F.round(vec.cell(F.col("r"), i, j), 6).alias(f"r{i}{j}") for i, j in ((0, 0), (0, 1), (2, 0))])


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y, p_partkey % 7 AS z FROM part),
r AS (SELECT *, x * cos(radians(-35)) - y * sin(radians(-35)) AS sx, x * sin(radians(-35)) + y * cos(radians(-35)) AS yr FROM p)
SELECT p_partkey, round(sx, 6) AS sx, round(z * cos(radians(32)) + yr * sin(radians(32)), 6) AS sy, round(yr * cos(radians(32)) - z * sin(radians(32)), 6) AS depth FROM r""")
def isometric_view(spark, d):
    p = table(spark, d, "part").select("p_partkey", vec.isometric(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 7).cast("double")).alias("v"))
    return p.select("p_partkey", *[F.round(f"v.{c}", 6).alias(c) for c in ("sx", "sy", "depth")])


@query("""SELECT p_partkey, round(1024 * (20 + p_size) / (0.8 * sqrt(36 * 36 + 24 * 24)), 6) AS focal_px, round(sqrt(36 * 36 + 24 * 24) / (2 * tan(radians(60 + p_size) / 2)), 6) AS f_eq_mm FROM part""")
def focal_lengths(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(vec.focal_pixels(s + 20, 1024), 6).alias("focal_px"), F.round(vec.focal_from_view(s + 60), 6).alias("f_eq_mm"))


@query("""WITH p AS (SELECT p_partkey, greatest(518.0 / (600 + p_size), 392.0 / 480) AS s, p_size FROM part)
SELECT p_partkey, round(500 * s, 6) AS fx, round(320 * s - ((600 + p_size) * s - 518) / 2, 6) AS cx, round(240 * s - (480 * s - 392) / 2, 6) AS cy FROM p""")
def rescaled_intrinsics(spark, d):
    k = vec.matrix([[500, 0, 320], [0, 510, 240], [0, 0, 1]])
    p = table(spark, d, "part").select("p_partkey", vec.rescale_intrinsics(k, (F.col("p_size") + 600).cast("double"), 480, 518, 392).alias("k"))
    return p.select("p_partkey", F.round(vec.cell(F.col("k"), 0, 0), 6).alias("fx"), F.round(vec.cell(F.col("k"), 0, 2), 6).alias("cx"), F.round(vec.cell(F.col("k"), 1, 2), 6).alias("cy"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 - 1.0 AS y0, p_size % 3 * 1.0 AS x1 FROM part)
SELECT p_partkey, CASE WHEN greatest(CASE WHEN x1 = 0 THEN 0.0 ELSE least(0.5 / x1, 1.5 / x1) END, CASE WHEN y0 = 0 THEN NULL ELSE least((0.5 - y0) / -y0, (1.5 - y0) / -y0) END, 0.0) <= least(CASE WHEN x1 = 0 THEN NULL ELSE greatest(0.5 / x1, 1.5 / x1) END, CASE WHEN y0 = 0 THEN NULL ELSE greatest((0.5 - y0) / -y0, (1.5 - y0) / -y0) END, 1.0)
  AND x1 <> 0 AND y0 <> 0 THEN true ELSE false END AS hit FROM p""")
def sight_through_box(spark, d):
    """Sight lines from (0, y0) to (x1, 0) through the box from (0.5, 0.5) to (1.5, 1.5)."""
    y0, x1 = (F.col("p_size") % 4 - 1).cast("double"), (F.col("p_size") % 3).cast("double")
    zero, lo, hi = F.lit(0.0), F.lit(0.5), F.lit(1.5)
    return table(spark, d, "part").select("p_partkey", walls.segment_hits_box(zero, y0, x1, zero, lo, lo, hi, hi).alias("hit"))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice / 100 AS h FROM part)
SELECT p_partkey, round(w, 6) AS low_chord, round(w / 2, 6) AS high_chord FROM p""")
def room_chords(spark, d):
    """Width of each part's L below and above its step."""
    w, h, zero = F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.lit(0.0)
    pt = lambda x, y: rings.point(x, y)
    ell = F.array(pt(zero, zero), pt(w, zero), pt(w, h / 2), pt(w / 2, h / 2), pt(w / 2, h), pt(zero, h))
    p = table(spark, d, "part").select("p_partkey", ell.alias("r"), w.alias("w"), h.alias("h"))
    return p.select("p_partkey", F.round(rings.chord_through(F.col("r"), F.col("w") / 4, F.col("h") / 4), 6).alias("low_chord"), F.round(rings.chord_through(F.col("r"), F.col("w") / 4, F.col("h") * 0.75), 6).alias("high_chord"))


@query("""WITH s AS (SELECT l_orderkey, unnest([0.0, 60.0, greatest(0, l_quantity - 5), least(60, l_quantity + 5)])::DOUBLE AS t FROM lineitem)
SELECT l_orderkey, count(DISTINCT t) AS n, round(sum(DISTINCT t), 4) AS total FROM s GROUP BY 1""")
def wall_stations(spark, d):
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") - 5).alias("t0"), (F.col("l_quantity") + 5).alias("t1"))).alias("o"))
    st = ordered.stations(F.lit(60.0), F.col("o"))
    return held.select("l_orderkey", F.size(st).cast("long").alias("n"), F.round(F.aggregate(st, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""SELECT o_orderkey, round((8 * 556 + 2 * 333) * 9.5 / 1000, 6) AS width, 'A-' || lpad(CAST(o_orderkey % 99 + 1 AS VARCHAR), 2, '0') AS next,
list_element(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], CAST(round_even(o_orderkey % 360 / 45.0, 0) AS INT) % 8 + 1) AS wind FROM orders""")
def sheet_labels(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").cast("string")
    sheet = F.concat(F.lit("A-"), F.lpad((F.col("o_orderkey") % 99).cast("string"), 2, "0"))
    return o.select("o_orderkey", F.round(text.text_width(day, 9.5), 6).alias("width"), text.next_sheet(sheet).alias("next"), text.compass((F.col("o_orderkey") % 360).cast("double")).alias("wind"))


@query("""WITH l AS (SELECT l_orderkey % 50 AS k, CAST(l_quantity AS INT) AS level, count(*) AS n FROM lineitem GROUP BY 1, 2),
w AS (SELECT a.k, a.s, sum(l.n) AS n FROM (SELECT DISTINCT k, greatest(level - d, 0) AS s FROM l, (SELECT unnest(range(9)) AS d)) a JOIN l ON l.k = a.k AND l.level BETWEEN a.s AND a.s + 8 GROUP BY 1, 2),
t AS (SELECT k, sum(n) AS n FROM l GROUP BY 1)
SELECT w.k, round(max(w.n) / t.n, 6) AS flatness FROM w JOIN t ON w.k = t.k GROUP BY w.k, t.n""")
def picture_flatness(spark, d):
    """Largest share of nine neighbouring levels of each picture's histogram."""
    px = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), F.col("l_quantity").alias("grey"))
    return aggregate.flatness(px, ["k"]).select("k", F.round("flatness", 6).alias("flatness"))


@query("""WITH p AS (SELECT user_id, event_id // 40 AS w, (event_id % 10) / 10.0 > 0.6 AS flat, value AS s FROM events),
v AS (SELECT user_id, w, max(CASE WHEN flat THEN 0 ELSE s END) AS best, bool_and(flat) AS flat FROM p GROUP BY 1, 2),
c AS (SELECT user_id, count(*) FILTER (best >= 20) AS usable_frames, count(*) FILTER (flat) AS flat_windows, count(*) AS n FROM v GROUP BY 1),
m AS (SELECT user_id, coalesce(median(s) FILTER (NOT flat), 0) AS med, coalesce(quantile_cont(s, 0.1) FILTER (NOT flat), 0) AS p10 FROM p GROUP BY 1)
SELECT user_id, usable_frames, flat_windows, n - usable_frames - flat_windows AS blurry_windows, round(med, 6) AS sharpness_median, round(p10, 6) AS sharpness_p10 FROM c JOIN m USING (user_id)""")
def clip_profile(spark, d):
    """Usable, blurry and flat windows of each user's probes."""
    probes = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("sharpness"), ((F.col("event_id") % 10) / 10).alias("flatness"))
    out = aggregate.video_profile(probes, ["user_id"], "event_id", 40)
    return out.select("user_id", "usable_frames", "flat_windows", "blurry_windows", F.round("sharpness_median", 6).alias("sharpness_median"), F.round("sharpness_p10", 6).alias("sharpness_p10"))


@query("""SELECT p_partkey, coalesce(min(s) FILTER (p_size * 1000 / s <= 273), max(s))::DOUBLE AS scale FROM part, (SELECT unnest([20, 25, 50, 75, 100, 125, 150, 200, 250, 500]) AS s) GROUP BY 1""")
def print_scales(spark, d):
    """First standard scale at which each part's side fits the paper."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return select.first_fitting(p, [20, 25, 50, 75, 100, 125, 150, 200, 250, 500], F.col("p_size") * 1000 / F.col("scale") <= 273).select("p_partkey", "scale")


@query("""WITH r AS (SELECT s_suppkey, 0.5 AS cx, (s_suppkey % 20) * 0.3 + 0.05 AS cy, 1 + (s_suppkey % 13) * 0.37 AS x, (s_suppkey % 17) * 0.31 + 0.07 AS y FROM supplier),
l AS (SELECT *, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS len FROM r), k AS (SELECT *, CAST(ceil((len - 0.06) / 0.07) AS INT) + 1 AS n FROM l WHERE len > 0.16),
p AS (SELECT *, unnest(range(n)) AS i FROM k)
SELECT DISTINCT CAST(floor((cx + (x - cx) * (i / greatest(n - 1, 1) * ((len - 0.06) / len))) / 0.1) AS BIGINT) AS ix, CAST(floor((cy + (y - cy) * (i / greatest(n - 1, 1) * ((len - 0.06) / len))) / 0.1) AS BIGINT) AS iy FROM p""")
def sight_lines(spark, d):
    """Cells crossed by sight lines, each along its whole length."""
    k = F.col("s_suppkey")
    pts = table(spark, d, "supplier").select(F.lit("s").alias("scene_id"), k.alias("point_id"), F.lit(0.5).alias("cx"), ((k % 20) * 0.3 + 0.05).alias("cy"), ((k % 13) * 0.37 + 1).alias("x"), ((k % 17) * 0.31 + 0.07).alias("y"))
    g = spark.createDataFrame([("s", 0.0, 0.0, 0.1, 1000, 1000)], "scene_id string, x0 double, y0 double, cell double, nx long, ny long")
    return cells.rays(pts, g, ["scene_id"]).select("ix", "iy")


@query("""WITH d AS (SELECT l_returnflag, l_linestatus, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, round(30 / m, 6) AS factor FROM d""")
def calibration_factors(spark, d):
    """Factor that brings a group's median width to a known one."""
    li = table(spark, d, "lineitem")
    return aggregate.median_factor(li, ["l_returnflag", "l_linestatus"], "l_quantity", 30.0).select("l_returnflag", "l_linestatus", F.round("factor", 6).alias("factor"))


@query("""WITH c AS (SELECT l_suppkey % 30 AS ix, l_partkey % 30 AS iy, l_orderkey % 9 AS o FROM lineitem), z AS (SELECT o, count(*) AS n FROM c GROUP BY 1),
r AS (SELECT DISTINCT ix, iy, o FROM c)
SELECT ix, iy, o FROM (SELECT r.*, row_number() OVER (PARTITION BY ix, iy ORDER BY z.n, r.o) AS k FROM r JOIN z USING (o)) WHERE k = 1""")
def shared_floor(spark, d):
    """Cells claimed by several owners stay with the smallest of them."""
    c = table(spark, d, "lineitem").select((F.col("l_suppkey") % 30).alias("ix"), (F.col("l_partkey") % 30).alias("iy"), (F.col("l_orderkey") % 9).alias("o"))
    sized = c.distinct().join(c.groupBy("o").agg(F.count("*").alias("n")), "o")
    return cells.give_to_smaller(sized, [], "o", "n").select("ix", "iy", "o")


def _registered() -> dict:
    from . import demos_geometry, demos_plans, demos_shapes, demos_sql  # noqa: F401  (their queries register themselves)

    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _registered().items() if s}

"""Functions for SQL text against the column functions, table functions against brute force, sketches
of parts against those of the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave import sql
from planweave.functions import rings, text, vec
from planweave.operators import sketches
from planweave.operators.ordered import peak_indices


def test_scalars_are_the_column_functions(spark):
    sql.register(spark)
    sql.register(spark)
    numbers = [(0.0, 1.0, 2.5, -4.0), (-1.0, 1.0, 0.125, 9.995), (3.3, -2.0, 7.0, 1e3)]
    df = spark.createDataFrame([(*n, q) for n, q in zip(numbers, ("3,5 m", "12", None))], "a double, b double, c double, d double, q string")
    ring = F.array(rings.point(F.col("a"), F.col("b")), rings.point(F.col("a") + 4, F.col("b")), rings.point(F.col("a") + 4, F.col("b") + 3), rings.point(F.col("a") + 1, F.col("b") + 1))
    df = df.withColumn("ring", ring)
    same = {
        "pw_distance(a, b, c, d)": F.hypot(F.col("c") - F.col("a"), F.col("d") - F.col("b")), "pw_bearing(a, b)": vec.bearing(F.col("a"), F.col("b")), "pw_wrap(d, 6.5D)": vec.wrap(F.col("d"), 6.5),
        "pw_length_text(d)": text.length_text(F.col("d")), "pw_area_text(d)": text.area_text(F.col("d")), "pw_quantity(q)": text.quantity(F.col("q")),
        "pw_ring_area(ring)": rings.area(F.col("ring")), "pw_ring_perimeter(ring)": rings.perimeter(F.col("ring")), "pw_ring_contains(ring, a + 2, b + 1)": rings.contains(F.col("ring"), F.col("a") + 2, F.col("b") + 1),
    }
    got = df.select(*[F.expr(e).alias(f"s{i}") for i, e in enumerate(same)], *[c.alias(f"c{i}") for i, c in enumerate(same.values())]).collect()
    for r in got:
        for i, e in enumerate(same):
            assert r[f"s{i}"] == (pytest.approx(r[f"c{i}"]) if isinstance(r[f"c{i}"], float) else r[f"c{i}"]), e
    plan = df.selectExpr("pw_ring_area(ring)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_table_functions(spark):
    sql.register(spark)
    r = np.random.default_rng(6)
    series = {k: r.integers(0, 12, 40).astype(float) for k in "ab"}
    spark.createDataFrame([(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)], "k string, bin int, n double").createOrReplaceTempView("series_of_test")
    got = {(x.k, x.rank): (x.bin, x.n) for x in spark.sql("SELECT * FROM pw_peaks(TABLE(series_of_test) PARTITION BY k ORDER BY (bin), 4.0D, 2)").collect()}
    assert got == {(k, rank): (i, s[i]) for k, s in series.items() for rank, i in enumerate(peak_indices(s, 4.0, 2))}
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 5.0), ("a", None), ("b", 0.0)], "k string, t double").createOrReplaceTempView("series_of_test")
    runs = sorted(tuple(x) for x in spark.sql("SELECT * FROM pw_islands(TABLE(series_of_test) PARTITION BY k ORDER BY (t), 1.5D)").collect())
    assert runs == [("a", 1.0, 2.0, 2), ("a", 5.0, 5.0, 1), ("b", 0.0, 0.0, 1)]
    spark.catalog.dropTempView("series_of_test")
    with pytest.raises(Exception, match="pw_islands takes a table"):
        spark.sql("SELECT * FROM pw_islands(1, 1.5D)").collect()


def test_sketches_of_parts_and_of_the_whole(spark, tmp_path):
    r = np.random.default_rng(7)
    values = np.concatenate([r.normal(0, 1, 20_000), r.exponential(5, 20_000)])
    rows = spark.createDataFrame([("k", int(i % 30), float(v), int(i % 7000)) for i, v in enumerate(values)] + [("k", 1, None, None), ("none", 1, None, None)], "k string, day int, v double, who long")
    sketches.build(rows, ["k", "day"], "v", "who").write.parquet(f"{tmp_path}/days")
    merged = sketches.merge(spark.read.parquet(f"{tmp_path}/days"), ["k"])
    shares = [0.01, 0.5, 0.99]
    got = {x.k: x for x in merged.select("k", "rows", sketches.quantiles(shares).alias("q"), sketches.distinct().alias("d")).collect()}
    assert got["k"].rows == 40_001 and got["none"].rows == 1 and got["none"].q is None and got["none"].d == 0
    order = np.sort(values)
    for share, q in zip(shares, got["k"].q):
        assert abs(np.searchsorted(order, q) / len(order) - share) < 0.01
    assert abs(got["k"].d - 7000) < 0.03 * 7000
    whole = sketches.build(rows, ["k"], "v").filter("k = 'k'").select(sketches.quantiles(shares).alias("q")).first().q
    assert all(abs(np.searchsorted(order, a) - np.searchsorted(order, b)) < 0.02 * len(order) for a, b in zip(whole, got["k"].q))
    size = spark.read.parquet(f"{tmp_path}/days").select(F.max(F.octet_length("quantile_sketch"))).first()[0]
    assert size < 40_000

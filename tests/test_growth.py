"""Queries on tables larger than the test tables: no side sent whole through the driver by a guess of its
size, few rows that make many pairs dealt out, ties settled."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from planweave.functions import text
from planweave.operators import join, polygons, select
from planweave.plans import demos, schedules

DATA = Path("/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["plan_painted", "plan_wall_tags", "turned_room_iou", "plan_chains", "plan_model", "plan_sides", "plan_swings", "plan_wall_pieces", "plan_areas", "plan_area_schedule", "site_drawing"])
def test_tables_of_a_plan_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan_of(demos.queries()[name](spark, str(DATA)))


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["plan_labels", "plan_wall_pieces", "site_drawing"])
def test_rows_are_dealt_out_before_they_grow(spark, name):
    assert re.search(r"REPARTITION_BY_NUM", plan_of(demos.queries()[name](spark, str(DATA))))


def test_sketch_is_kept_by_flag_only(spark):
    lines = [s for s in plan_of(demos.queries()["approximate_counts"](spark, str(DATA))).split("== Physical Plan ==")[1].splitlines() if "approx_count_distinct" in s]
    assert lines and not any("l_orderkey" in s.split("functions=")[0] for s in lines)


def test_largest_of_equal_parts_is_the_first(spark):
    rows = spark.createDataFrame([(1, i, 5.0) for i in range(9, 0, -1)] + [(1, 20, 4.0), (2, 3, None), (2, 7, 2.0)], "k int, id int, size double").repartition(7)
    assert sorted(tuple(r) for r in select.largest(rows, ["k"], "size", 1.0, ["id"]).collect()) == [(1, 1, 5.0), (2, 7, 2.0)]


def test_dealt_joins_find_the_same_pairs(spark):
    rows = spark.range(300).select(F.col("id").alias("a"), (F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("x")).coalesce(1)
    other = rows.select("k", F.col("a").alias("b"), F.col("x").alias("y"))
    box = lambda c: F.struct(F.col(c).alias("x0"), F.col(c).alias("y0"), (F.col(c) + 4).alias("x1"), (F.col(c) + 4).alias("y1"))
    for pairs in (lambda n: join.range_join(rows, other, ["k"], F.col("x"), F.col("y"), 5.0, deal=n), lambda n: join.box_join(rows, other, ["k"], box("x"), box("y"), 3.0, deal=n)):
        as_set = lambda df: sorted((r.a, r.b) for r in df.select("a", "b").collect())
        assert as_set(pairs(None)) == as_set(pairs(16))
        assert pairs(16).select("a", "b").withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4


def test_sides_in_one_pass(spark):
    from test_plans import SQUARE, box, rooms_df, walls_df

    rooms = rooms_df(spark, (box(0, 0, 4, 3), True, 0.9), (box(0, 0, 3, 3), True, 0.9))
    got = {r.id: (r.plus, r.minus) for r in schedules.sides(walls_df(spark, *SQUARE), rooms).collect()}
    assert got == {i: (12.0, 0.0) for i in range(4)}
    none = rooms_df(spark, (box(50, 50, 51, 51), True, 0.9))
    assert {(r.plus, r.minus) for r in schedules.sides(walls_df(spark, *SQUARE), none).collect()} == {(0.0, 0.0)}


def test_once_is_one_text(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), (F.col("id") + y).cast("double").alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    shapes = spark.range(5).withColumn("ring", ring)
    got = polygons.edges(shapes, ["id"], "ring")
    assert got.count() == 10  # the level sides
    assert plan_of(select.once(shapes, n=F.size("ring")).filter("n > 2")).split("== Physical Plan ==")[1].count("Generate explode") == 1


def test_width_of_documents_is_that_of_labels(spark):
    texts = ["", "Ävila — 3 m², “x”", "".join(map(chr, range(1, 300))), "a\nb\t~", "😀é" * 500, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for bold in (False, True):
        assert all(r.a == r.b for r in df.select(text.text_width(F.col("t"), 8.5, bold).alias("a"), text.document_width(F.col("t"), 8.5, bold).alias("b")).collect())


def test_register_passes_a_text_once(spark):
    from jobs.common import defaults
    from jobs.document_register import measured

    docs = spark.createDataFrame([(1, "abc", "en", "s")], "doc_id long, text string, lang string, source string")
    assert plan_of(measured(docs, defaults("document_register"))).split("== Physical Plan ==")[1].count("translate(") <= 2

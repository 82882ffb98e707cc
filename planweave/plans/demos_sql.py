"""Queries in SQL text with the registered functions, and sketches that are merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from ..operators import sketches
from .demos import query, table


def _asked(spark, d, text: str):
    """The result of SQL text over the tables, read where the names in braces stand."""
    sql.register(spark)
    names = ("part", "supplier", "customer", "events", "lineitem")
    return spark.sql(text, **{n: table(spark, d, n) for n in names if f"{{{n}}}" in text})


@query("""SELECT p_partkey, printf('%.2f m', sqrt(p_size * p_size + 16)) AS diagonal, round(p_size * 4.0::DOUBLE, 6) AS area, round(2 * (p_size + 4.0::DOUBLE), 6) AS perimeter,
p_retailprice % 50 < p_size AS holds, CAST(floor(p_retailprice / 0.5) AS BIGINT) AS cell FROM part""")
def sql_rooms(spark, d):
    """Rooms measured in SQL text alone."""
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', w, 'y', 0D), named_struct('x', w, 'y', 4D), named_struct('x', 0D, 'y', 4D))"
    return _asked(spark, d, f"""
        SELECT p_partkey, pw_length_text(pw_distance(0D, 0D, w, 4D)) AS diagonal, round(pw_ring_area(ring), 6) AS area, round(pw_ring_perimeter(ring), 6) AS perimeter,
               pw_ring_contains(ring, price % 50, 2D) AS holds, pw_cell(price, 0D, 0.5D) AS cell
        FROM (SELECT *, {ring} AS ring FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_retailprice AS DOUBLE) AS price FROM {{part}}))""")


@query("""WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000000 AS s FROM events), b AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 7200 THEN 0 ELSE 1 END AS new FROM t),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, min(s)::DOUBLE AS t0, max(s)::DOUBLE AS t1, count(*) AS n FROM i GROUP BY user_id, k""")
def sql_islands(spark, d):
    """Runs of each user's seconds no more than two hours apart, by a table function in SQL text."""
    return _asked(spark, d, """
        SELECT user_id, t0, t1, n FROM pw_islands(TABLE(SELECT DISTINCT user_id, unix_seconds(ts) AS s FROM {events}) PARTITION BY user_id ORDER BY (s), 7200D)""")


@query("SELECT event_type, count(*) AS rows, true AS close, true AS same, true AS counted FROM events GROUP BY 1")
def merged_sketches(spark, d):
    """Quantiles and users of each kind of event, from sketches of its days: how many rows they stand for;
    whether no quantile is off by more than 2 % of the ranks, whether sketches of all rows at once tell
    the same within that, and whether the users are right to 4 %."""
    events = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value", "user_id")
    shares = [0.1, 0.25, 0.5, 0.75, 0.9]
    merged = sketches.merge(sketches.build(events, ["event_type", "day"], "value", "user_id"), ["event_type"])
    told = merged.select("event_type", "rows", sketches.quantiles(shares).alias("q"), sketches.distinct().alias("users"))
    whole = sketches.build(events, ["event_type"], "value").select("event_type", sketches.quantiles(shares).alias("whole"))
    both = events.join(F.broadcast(told.join(whole, "event_type")), "event_type")  # a row a kind of event
    below = lambda name, k: F.avg((F.col("value") <= F.get(name, F.lit(k))).cast("double"))
    under = lambda name, k: F.avg((F.col("value") < F.get(name, F.lit(k))).cast("double"))
    off = lambda name: F.forall(F.array(*[(below(name, k) >= s - 0.02) & (under(name, k) <= s + 0.02) for k, s in enumerate(shares)]), lambda x: x)
    right = F.abs(F.first("users") - F.count_distinct("user_id")) <= 0.04 * F.count_distinct("user_id") + 1
    return both.groupBy("event_type").agg(F.first("rows").alias("rows"), off("q").alias("close"), off("whole").alias("same"), right.alias("counted"))

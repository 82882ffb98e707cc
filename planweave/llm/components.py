"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, label)`` for every node that is not the
    smallest of its component; ``label`` is that smallest node.

    Each round is two map-side-combined minimums and two equi-joins, so a hub's
    edges are never collected in one task (AQE splits the hub's join partition).
    Rounds grow with the logarithm of the component diameter and go on until nothing
    changes; each ends in a shared table, so lineage stays one round deep, and the table
    before it goes. Self loops, repeated edges and
    edges with a null end are ignored; no edge gives no row.
    """
    e = materialize(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, materialize(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(last)
        after = _mark(e)
        if after == mark:
            break
        mark = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("label"))

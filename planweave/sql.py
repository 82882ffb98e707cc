"""The library's functions for SQL text.

``register(spark)`` defines them for the session: scalar functions are SQL functions, whose bodies
Catalyst puts in place of the call, so they cost what the written-out expression does; table functions
are Python UDTFs that get one partition of a table at a time and declare their own columns.

    SELECT wall_id, pw_length_text(pw_distance(ax, ay, bx, by)) FROM walls
    SELECT * FROM pw_peaks(TABLE(SELECT scene, bin, n FROM bins) PARTITION BY scene ORDER BY (bin), 5.0D, 2)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_EDGES = "zip_with(ring, concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1)), (a, b) -> {})"
#: name: (parameters, result, body)
SCALARS = {
    "pw_distance": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE", "DOUBLE", "hypot(bx - ax, by - ay)"),
    "pw_bearing": ("dx DOUBLE, dy DOUBLE", "DOUBLE", "pmod(degrees(atan2(dx, dy)), 360D)"),
    "pw_wrap": ("angle DOUBLE, period DOUBLE", "DOUBLE", "pmod(angle, period)"),
    "pw_length_text": ("v DOUBLE", "STRING", "format_string('%.2f m', bround(v, 2))"),
    "pw_area_text": ("v DOUBLE", "STRING", "format_string('%.2f m²', bround(v, 2))"),
    "pw_quantity": ("v STRING", "DOUBLE", "try_cast(regexp_replace(replace(lower(trim(v)), ',', '.'), '( meters| metres| m|m)$', '') AS DOUBLE)"),
    "pw_cell": ("v DOUBLE, origin DOUBLE, cell DOUBLE", "BIGINT", "floor((v - origin) / cell)"),
    "pw_utm_zone": ("lon DOUBLE", "INT", "CAST(least(60, floor((lon + 180) / 6) + 1) AS INT)"),
    "pw_ring_area": (f"ring {_RING}", "DOUBLE", "abs(aggregate(" + _EDGES.format("(a.x * b.y - b.x * a.y) / 2") + ", 0D, (s, v) -> s + v))"),
    "pw_ring_perimeter": (f"ring {_RING}", "DOUBLE", "aggregate(" + _EDGES.format("hypot(b.x - a.x, b.y - a.y)") + ", 0D, (s, v) -> s + v)"),
    "pw_ring_contains": (f"ring {_RING}, px DOUBLE, py DOUBLE", "BOOLEAN", "size(filter(" + _EDGES.format("(a.y > py) != (b.y > py) AND px < (b.x - a.x) * (py - a.y) / (b.y - a.y) + a.x") + ", v -> v)) % 2 = 1"),
}


class Peaks:
    """Peaks of the last column of each partition, in the order the table is given in; its other columns
    pass, and ``rank`` (0: the strongest) is added. A partition is a series of histogram bins."""

    @staticmethod
    def analyze(rows, least, apart):
        from pyspark.sql.types import IntegerType, StructType
        from pyspark.sql.udtf import AnalyzeResult

        if not rows.isTable or len(rows.dataType) < 2:
            raise ValueError("pw_peaks takes a table with an order and a value as its last columns")
        return AnalyzeResult(StructType([*rows.dataType.fields]).add("rank", IntegerType()))

    def __init__(self):
        self.rows, self.least, self.apart = [], 0.0, 1

    def eval(self, rows, least: float, apart: int):
        self.rows.append(tuple(rows))
        self.least, self.apart = least, apart

    def terminate(self):
        from planweave.operators.ordered import peak_indices

        values = [float(r[-1]) if r[-1] is not None else 0.0 for r in self.rows]
        for rank, i in enumerate(peak_indices(values, self.least, self.apart)):
            yield (*self.rows[i], rank)


class Islands:
    """Runs of a partition's rows whose last column, in the table's order, grows by at most ``gap``: the
    columns before it of the run's first row, then t0, t1 and n. Holds one run at a time."""

    @staticmethod
    def analyze(rows, gap):
        from pyspark.sql.types import DoubleType, LongType, StructType
        from pyspark.sql.udtf import AnalyzeResult

        if not rows.isTable or not len(rows.dataType):
            raise ValueError("pw_islands takes a table with the ordered number as its last column")
        schema = StructType(rows.dataType.fields[:-1]).add("t0", DoubleType()).add("t1", DoubleType()).add("n", LongType())
        return AnalyzeResult(schema)

    def __init__(self):
        self.head = None

    def eval(self, rows, gap: float):
        *head, t = tuple(rows)
        if t is None:
            return
        t = float(t)
        if self.head is not None and t - self.t1 <= gap:
            self.t1, self.n = t, self.n + 1
            return
        if self.head is not None:
            yield (*self.head, self.t0, self.t1, self.n)
        self.head, self.t0, self.t1, self.n = head, t, t, 1

    def terminate(self):
        if self.head is not None:
            yield (*self.head, self.t0, self.t1, self.n)


def register(spark: SparkSession) -> None:
    """Define the functions for the session; a second time changes nothing."""
    from pyspark.sql.functions import udtf

    for name, (takes, gives, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.udtf.register("pw_peaks", udtf(Peaks))
    spark.udtf.register("pw_islands", udtf(Islands))

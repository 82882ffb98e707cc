"""Walls and openings as column expressions. A wall has ends (ax, ay), (bx, by)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rings import point


@dataclass
class WallColumns:
    """Derived geometry of a wall row; ``prefix`` names its columns after a join."""

    prefix: str = ""

    def c(self, name: str) -> Column:
        return F.col(self.prefix + name)

    @property
    def length(self) -> Column:
        return F.hypot(self.c("bx") - self.c("ax"), self.c("by") - self.c("ay"))

    @property
    def dx(self) -> Column:
        return F.when(self.length > 0, (self.c("bx") - self.c("ax")) / self.length).otherwise(1.0)

    @property
    def dy(self) -> Column:
        return F.when(self.length > 0, (self.c("by") - self.c("ay")) / self.length).otherwise(0.0)

    @property
    def nx(self) -> Column:
        return -self.dy

    @property
    def ny(self) -> Column:
        return self.dx

    def at(self, t: Column, off: Column | float = 0.0) -> Column:
        """Point at station ``t``, ``off`` along the normal."""
        off = off if isinstance(off, Column) else F.lit(float(off))
        return point(self.c("ax") + self.dx * t + self.nx * off, self.c("ay") + self.dy * t + self.ny * off)

    def rectangle(self, t0: Column, t1: Column, half: Column) -> Column:
        """Ring of the stretch from ``t0`` to ``t1``, ``half`` to either side."""
        return F.array(self.at(t0, -half), self.at(t1, -half), self.at(t1, half), self.at(t0, half))

    @property
    def body(self) -> Column:
        return self.rectangle(F.lit(0.0), self.length, self.c("thickness") / 2)

    def station(self, x: Column, y: Column) -> Column:
        return (x - self.c("ax")) * self.dx + (y - self.c("ay")) * self.dy

    def offset(self, x: Column, y: Column) -> Column:
        return (x - self.c("ax")) * self.nx + (y - self.c("ay")) * self.ny


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length of two intervals."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def within_any(intervals: Column, t: Column, slack: Column | float = 0.0) -> Column:
    """Whether a station lies in one of ``array<struct<t0,t1>>``."""
    slack = slack if isinstance(slack, Column) else F.lit(float(slack))
    return F.exists(intervals, lambda i: (i["t0"] - slack <= t) & (t <= i["t1"] + slack))


def near_end(intervals: Column, t: Column, snap: float) -> Column:
    """``struct<k, side>`` of the first interval whose end a station lies just outside of, else null."""
    flag = lambda i: F.when((i["t0"] - snap <= t) & (t < i["t0"]), -1).when((i["t1"] < t) & (t <= i["t1"] + snap), 1)
    found = F.filter(F.transform(intervals, lambda i, k: F.struct(k.alias("k"), flag(i).alias("side"))), lambda e: e["side"].isNotNull())
    return F.get(found, F.lit(0))


def family_point(alpha: Column, s: Column, t: Column) -> Column:
    """Point of a line family: ``s`` along its normal, ``t`` along its direction."""
    return point(s * F.cos(alpha) - t * F.sin(alpha), s * F.sin(alpha) + t * F.cos(alpha))


def family_crossing(alpha_a: Column, s_a: Column, alpha_b: Column, s_b: Column) -> Column:
    """``struct<ta, tb>``: stations where two centrelines cross, null when nearly parallel."""
    den = F.sin(alpha_b - alpha_a)
    c = F.cos(alpha_b - alpha_a)
    return F.when(F.abs(den) >= 0.3, F.struct(((s_b - s_a * c) / den).alias("ta"), (-(s_a - s_b * c) / den).alias("tb")))


def segment_hits_box(x0: Column, y0: Column, x1: Column, y1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Whether a sight line passes a rectangle (slab test)."""
    def slab(p, d, lo, hi):
        inside = (p >= lo) & (p <= hi)
        a, b = (lo - p) / d, (hi - p) / d
        return F.when(d == 0, F.when(inside, F.lit(0.0))).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, F.lit(1.0))).otherwise(F.greatest(a, b))

    ax, bx = slab(x0, x1 - x0, bx0, bx1)
    ay, by = slab(y0, y1 - y0, by0, by1)
    return F.coalesce(F.greatest(F.lit(0.0), ax, ay) <= F.least(F.lit(1.0), bx, by), F.lit(False)) & ax.isNotNull() & ay.isNotNull()

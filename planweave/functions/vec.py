"""Angles, vectors, rotations and poses as column expressions.

A vector is ``array<double>``; a matrix is ``array<array<double>>`` in rows; a pose is a
4x4 matrix that takes the camera frame (x right, y down, z forward) to the world.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def col(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def at(v: Column, i: int) -> Column:
    return v.getItem(i)


def cell(m: Column, i: int, j: int) -> Column:
    return m.getItem(i).getItem(j)


# -- angles ------------------------------------------------------------------------------


def wrap(theta: Column, period: Value) -> Column:
    """Angle in [0, period), never negative."""
    return F.pmod(theta, col(period))


def circular_distance(a: Column, b: Value, period: float) -> Column:
    """Smallest difference of two angles of a period."""
    d = wrap(a - col(b), period)
    return F.least(d, F.lit(period) - d)


def circular_mean(theta: Column, period: float, weight: Column | None = None) -> Column:
    """Aggregate: mean direction of a period, two sums and an arctangent (map-side combined)."""
    k = 2 * math.pi / period
    w = F.lit(1.0) if weight is None else weight
    return wrap(F.atan2(F.sum(w * F.sin(theta * k)), F.sum(w * F.cos(theta * k))) / k, period)


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north of a vector (east, north)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


# -- vectors -----------------------------------------------------------------------------


def vector(*parts: Value) -> Column:
    return F.array(*[col(p) for p in parts])


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return reduce(lambda x, y: x + y, [at(a, i) * at(b, i) for i in range(n)])


def norm(v: Column, n: int = 3) -> Column:
    return F.sqrt(dot(v, v, n))


def norm_any(v: Column) -> Column:
    """Norm of a vector of any length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column, eps: float = 1e-12) -> Column:
    """Unit vector; a vector shorter than ``eps`` is divided by ``eps``."""
    length = F.greatest(norm_any(v), F.lit(eps))
    return F.transform(v, lambda x: x / length)


def cross(a: Column, b: Column) -> Column:
    return vector(*(at(a, (i + 1) % 3) * at(b, (i + 2) % 3) - at(a, (i + 2) % 3) * at(b, (i + 1) % 3) for i in range(3)))


# -- matrices ----------------------------------------------------------------------------


def matrix(rows) -> Column:
    return F.array(*[vector(*r) for r in rows])


def matmul(a: Column, b: Column, n: int = 3, m: int | None = None) -> Column:
    m = m or n
    return matrix([[reduce(lambda x, y: x + y, [cell(a, i, k) * cell(b, k, j) for k in range(n)]) for j in range(m)] for i in range(n)])


def rotate(r: Column, v: Column) -> Column:
    """Upper-left 3x3 part of ``r`` applied to ``v``."""
    return vector(*(dot(at(r, i), v) for i in range(3)))


def rotation_z(theta: Value) -> Column:
    c, s = F.cos(col(theta)), F.sin(col(theta))
    return matrix([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def quaternion_rotation(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Rotation of a quaternion (x, y, z, w) of any length."""
    n = F.greatest(F.sqrt(x * x + y * y + z * z + w * w), F.lit(1e-12))
    x, y, z, w = x / n, y / n, z / n, w / n
    return matrix(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
            [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
            [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
        ]
    )


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it occurs."""
    return F.transform(F.array(value), use).getItem(0)


def rotation_between(a: Column, b: Column) -> Column:
    """Rotation that turns ``a`` onto ``b`` (Rodrigues). Parallel vectors give the identity,
    opposite ones half a turn about an axis perpendicular to ``a``."""
    helper = lambda u: F.when(F.abs(at(u, 0)) < 0.9, vector(1, 0, 0)).otherwise(vector(0, 1, 0))
    ends = F.struct(normalize(a).alias("a"), normalize(b).alias("b"))
    parts = lambda e: F.struct(cross(e["a"], e["b"]).alias("v"), dot(e["a"], e["b"]).alias("c"), normalize(cross(e["a"], helper(e["a"]))).alias("u"))

    def turn(p):
        (x, y, z), c, u = (at(p["v"], i) for i in range(3)), p["c"], p["u"]
        k = 1 / (1 + c)
        general = matrix(
            [
                [1 - k * (y * y + z * z), k * x * y - z, k * x * z + y],
                [k * x * y + z, 1 - k * (x * x + z * z), k * y * z - x],
                [k * x * z - y, k * y * z + x, 1 - k * (x * x + y * y)],
            ]
        )
        same = matrix([[float(i == j) for j in range(3)] for i in range(3)])
        half = matrix([[2 * at(u, i) * at(u, j) - float(i == j) for j in range(3)] for i in range(3)])
        return F.when(norm(p["v"]) >= 1e-9, general).when(c > 0, same).otherwise(half)

    return bound(bound(ends, parts), turn)


def pose(r: Column, t: Column) -> Column:
    return matrix([*[[cell(r, i, 0), cell(r, i, 1), cell(r, i, 2), at(t, i)] for i in range(3)], [0, 0, 0, 1]])


def apply_pose(t: Column, v: Column) -> Column:
    """Rigid transform of a point."""
    return vector(*(dot(at(t, i), v) + cell(t, i, 3) for i in range(3)))


def compose(a: Column, b: Column) -> Column:
    """Pose ``a`` after pose ``b``."""
    return matmul(a, b, 4)


def apply_similarity(scale: Column, r: Column, t: Column, p: Column) -> Column:
    """A similarity on a camera pose: orientation R.Rp, centre s.R.c + t."""
    turned = rotate(r, vector(*(cell(p, i, 3) for i in range(3))))
    top = matmul(r, p)
    return pose(top, vector(*(scale * at(turned, i) + at(t, i) for i in range(3))))


# -- cameras -----------------------------------------------------------------------------


def camera_centre(t: Column) -> Column:
    return vector(*(cell(t, i, 3) for i in range(3)))


def camera_up(t: Column) -> Column:
    return vector(*(-cell(t, i, 1) for i in range(3)))


def camera_forward(t: Column) -> Column:
    return vector(*(cell(t, i, 2) for i in range(3)))


def pixel_ray(k: Column, u: Column, v: Column) -> Column:
    """Direction of a pixel with z = 1, no lens distortion."""
    return vector((u - cell(k, 0, 2)) / cell(k, 0, 0), (v - cell(k, 1, 2)) / cell(k, 1, 1), 1)


def project(k: Column, p: Column) -> Column:
    """Pixel of a point in the camera frame, null behind the camera."""
    z = at(p, 2)
    return F.when(z > 0, vector(cell(k, 0, 0) * at(p, 0) / z + cell(k, 0, 2), cell(k, 1, 1) * at(p, 1) / z + cell(k, 1, 2)))


def rescale_intrinsics(k: Column, w0: Value, h0: Value, w1: Value, h1: Value) -> Column:
    """Intrinsics after a resize that covers (w1, h1) and a centre crop."""
    w0, h0, w1, h1 = col(w0), col(h0), col(w1), col(h1)
    s = F.greatest(w1 / w0, h1 / h0)
    return matrix(
        [
            [cell(k, 0, 0) * s, cell(k, 0, 1) * s, cell(k, 0, 2) * s - (w0 * s - w1) / 2],
            [cell(k, 1, 0) * s, cell(k, 1, 1) * s, cell(k, 1, 2) * s - (h0 * s - h1) / 2],
            [cell(k, 2, 0), cell(k, 2, 1), cell(k, 2, 2)],
        ]
    )


def restore_intrinsics(k: Column, w0: Value, h0: Value, w1: Value, h1: Value) -> Column:
    """Inverse of ``rescale_intrinsics``: back to the pixels of the stored image."""
    w0, h0, w1, h1 = col(w0), col(h0), col(w1), col(h1)
    s = F.greatest(w1 / w0, h1 / h0)
    return matrix(
        [
            [cell(k, 0, 0) / s, cell(k, 0, 1) / s, (cell(k, 0, 2) + (w0 * s - w1) / 2) / s],
            [cell(k, 1, 0) / s, cell(k, 1, 1) / s, (cell(k, 1, 2) + (h0 * s - h1) / 2) / s],
            [cell(k, 2, 0), cell(k, 2, 1), cell(k, 2, 2)],
        ]
    )


FULL_DIAGONAL = math.hypot(36.0, 24.0)  # mm of the 35 mm frame


def focal_pixels(f_eq_mm: Column, width: Value) -> Column:
    """Focal length in pixels of a 4:3 frame's long side from the 35 mm equivalent."""
    return col(width) * f_eq_mm / F.lit(0.8 * FULL_DIAGONAL)


def focal_from_view(degrees: Column) -> Column:
    """35 mm equivalent focal length of a diagonal field of view."""
    return F.lit(FULL_DIAGONAL) / (2 * F.tan(F.radians(degrees) / 2))


def isometric(x: Column, y: Column, z: Column, azimuth: float = -35.0, elevation: float = 32.0) -> Column:
    """Screen x, screen y (up) and depth (far is large) of an axonometric view."""
    a, e = math.radians(azimuth), math.radians(elevation)
    across = x * math.cos(a) - y * math.sin(a)
    away = x * math.sin(a) + y * math.cos(a)
    return F.struct(across.alias("sx"), (z * math.cos(e) + away * math.sin(e)).alias("sy"), (away * math.cos(e) - z * math.sin(e)).alias("depth"))

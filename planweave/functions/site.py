"""Geodesy of small sites: a local metric frame and UTM, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the transverse Mercator series (fixed values).
A = 6378137.0
FLATTENING = 1.0 / 298.257223563
E2 = FLATTENING * (2.0 - FLATTENING)
K0 = 0.9996
EP2 = E2 / (1.0 - E2)
MERIDIAN = (
    1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256,
    3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024,
    15 * E2**2 / 256 + 45 * E2**3 / 1024,
    35 * E2**3 / 3072,
)
BANDS = "CDEFGHJKLMNPQRSTUVWXX"


def _radii(lat0: Column) -> tuple[Column, Column, Column]:
    s = F.sin(F.radians(lat0))
    w = 1 - E2 * s * s
    return F.lit(A) / F.sqrt(w), F.lit(A * (1 - E2)) / F.pow(w, F.lit(1.5)), F.cos(F.radians(lat0))


def to_local(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """Metres east and north of an origin on the ellipsoid."""
    n, m, c = _radii(lat0)
    return F.struct((F.radians(lon - lon0) * n * c).alias("x"), (F.radians(lat - lat0) * m).alias("y"))


def to_wgs84(x: Column, y: Column, lon0: Column, lat0: Column) -> Column:
    n, m, c = _radii(lat0)
    return F.struct((lon0 + F.degrees(x / (n * c))).alias("lon"), (lat0 + F.degrees(y / m)).alias("lat"))


def utm_zone(lat: Column, lon: Column) -> Column:
    plain = ((lon + 180) / 6).cast("int") + 1
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).when(lon < 42, 37).otherwise(plain)
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    return F.when(norway, 32).when((lat >= 72) & (lat <= 84) & (lon >= 0), svalbard).otherwise(plain).cast("int")


def utm_band(lat: Column) -> Column:
    """Latitude band letter; Z beyond 80 south and 84 north."""
    inside = (lat >= -80) & (lat <= 84)
    return F.when(inside, F.substring(F.lit(BANDS), ((lat + 80) / 8).cast("int") + 1, 1)).otherwise("Z")


def utm(lat: Column, lon: Column) -> Column:
    """easting, northing, zone, band, hemisphere, epsg."""
    zone = utm_zone(lat, lon)
    phi = F.radians(lat)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    t2 = t * t
    n = F.lit(A) / F.sqrt(1 - E2 * s * s)
    cc = EP2 * c * c
    a = c * F.radians(lon - ((zone - 1) * 6 - 177))
    a2 = a * a
    m = A * (MERIDIAN[0] * phi - MERIDIAN[1] * F.sin(2 * phi) + MERIDIAN[2] * F.sin(4 * phi) - MERIDIAN[3] * F.sin(6 * phi))
    east = K0 * n * a * (1 + a2 / 6 * ((1 - t2 + cc) + a2 / 20 * (5 - 18 * t2 + t2 * t2 + 72 * cc - 58 * EP2))) + 500000.0
    north = K0 * (m + n * t * a2 / 2 * (1 + a2 / 12 * ((5 - t2 + 9 * cc + 4 * cc * cc) + a2 / 30 * (61 - 58 * t2 + t2 * t2 + 600 * cc - 330 * EP2))))
    south = lat < 0
    return F.struct(
        east.alias("easting"),
        (north + F.when(south, 10_000_000.0).otherwise(0.0)).alias("northing"),
        zone.alias("zone"),
        utm_band(lat).alias("band"),
        F.when(south, "S").otherwise("N").alias("hemisphere"),
        (F.when(south, 32700).otherwise(32600) + zone).alias("epsg"),
    )


def search_box(lat: float, lon: float, radius: float) -> tuple[float, float, float, float]:
    """West, south, east, north of a square around a point; literals for partition pruning."""
    import math

    dlat = radius / 111_320.0
    dlon = radius / (111_320.0 * max(0.05, math.cos(math.radians(lat))))
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat

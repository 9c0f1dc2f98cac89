"""Distances and projections as column expressions; degrees, metres and level-20 tile units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
EQUATOR_M = 6378137.0
#: One unit is one tile of this level; y grows north.
UNIT_LEVEL = 20
UNITS = float(1 << UNIT_LEVEL)
#: Origin of relation coordinates, a tile (level, x, y) (fixed values).
ORIGIN = (8, 219, 155)
#: Default fence: least and greatest longitude, least and greatest latitude (fixed values).
BOX = (123.0, 133.0, 31.0, 39.0)


def col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def haversine_m(lon0, lat0, lon1, lat1) -> Column:
    """Great-circle metres between two points."""
    lon0, lat0, lon1, lat1 = (F.radians(col(c)) for c in (lon0, lat0, lon1, lat1))
    half = lambda d: F.sin(d / 2) * F.sin(d / 2)
    a = half(lat1 - lat0) + F.cos(lat0) * F.cos(lat1) * half(lon1 - lon0)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def metres(lon0: float, lat0: float, lon1: float, lat1: float) -> float:
    """``haversine_m`` of two places, for folds inside tasks."""
    a = math.sin(math.radians(lat1 - lat0) / 2) ** 2 + math.cos(math.radians(lat0)) * math.cos(math.radians(lat1)) * math.sin(math.radians(lon1 - lon0) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def mercator_x(lon) -> Column:
    return (col(lon) + 180.0) / 360.0 * UNITS


def mercator_y(lat) -> Column:
    return (F.log(F.tan(F.radians(col(lat)) / 2 + math.pi / 4)) / (2 * math.pi) + 0.5) * UNITS


def mercator_xy(lon, lat) -> Column:
    """struct<x, y> in units."""
    return F.struct(mercator_x(lon).alias("x"), mercator_y(lat).alias("y"))


def mercator_lon(x) -> Column:
    return col(x) / UNITS * 360.0 - 180.0


def mercator_lat(y) -> Column:
    return F.degrees(2 * F.atan(F.exp((col(y) / UNITS - 0.5) * (2 * math.pi))) - math.pi / 2)


def mercator_lonlat(x, y) -> Column:
    """struct<lon, lat>."""
    return F.struct(mercator_lon(x).alias("lon"), mercator_lat(y).alias("lat"))


def _origin() -> tuple[float, float]:
    level, x, y = ORIGIN
    return float(x << (UNIT_LEVEL - level)), float(y << (UNIT_LEVEL - level))


def to_relation(x, y) -> Column:
    return F.struct((col(x) - _origin()[0]).alias("x"), (col(y) - _origin()[1]).alias("y"))


def to_global(x, y) -> Column:
    return F.struct((col(x) + _origin()[0]).alias("x"), (col(y) + _origin()[1]).alias("y"))


def metres_per_unit(lat) -> Column:
    return 2 * math.pi * EQUATOR_M / UNITS * F.cos(F.radians(col(lat)))


def foot_share(px, py, ax, ay, bx, by) -> Column:
    """How far along a segment (0 to 1) the nearest place to a point is; 0 on a segment of no length."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    long = F.greatest(dx * dx + dy * dy, F.lit(1e-300))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / long))


def along(a, b, share) -> Column:
    return col(a) + col(share) * (col(b) - col(a))


def apart(px, py, x, y, lat) -> Column:
    """Metres between two near places in units; ``lat`` gives the local scale."""
    dx, dy = col(px) - col(x), col(py) - col(y)
    return F.sqrt(dx * dx + dy * dy) * metres_per_unit(lat)


def point_segment(px, py, ax, ay, bx, by, lat) -> Column:
    """struct<distance, x, y>: metres from a point to a segment, and the segment's nearest point.

    Coordinates are units; ``lat`` gives the local scale.  The foot is clamped to the segment.  Joins over many pairs
    take its three steps one by one, so that each is computed once.
    """
    share = foot_share(px, py, ax, ay, bx, by)
    x, y = along(ax, bx, share), along(ay, by, share)
    return F.struct(apart(px, py, x, y, lat).alias("distance"), x.alias("x"), y.alias("y"))


def polygon_area(points) -> Column:
    """Signed shoelace area of a contour array<struct<x, y>>; positive when it runs counter-clockwise."""
    p = col(points)
    turned = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    cross = F.zip_with(p, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(p) > 0, F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2).otherwise(0.0)


# Transverse Mercator on WGS84, by Krueger's series in the third flattening.
_A, _FLAT, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(_FLAT * (2 - _FLAT))
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def utm_zone(lon) -> Column:
    """The zone (1 to 60) of a longitude."""
    return (F.pmod(F.floor((col(lon) + 180.0) / 6.0), F.lit(60)) + 1).cast("int")


def _meridian(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def utm_forward(lat, lon, zone=None) -> Column:
    """struct<zone, easting, northing>; a zone that isn't 1 to 60 is taken from the longitude."""
    lat, lon = col(lat), col(lon)
    own = utm_zone(lon)
    zone = own if zone is None else F.when(col(zone).between(1, 60), col(zone).cast("int")).otherwise(own)
    s, d = F.sin(F.radians(lat)), F.radians(lon) - _meridian(zone)
    t = F.sinh(F.atanh(s) - _E * F.atanh(s * _E))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    y = _K0 * _RADIUS * north
    return F.struct(zone.alias("zone"), (500000.0 + _K0 * _RADIUS * east).alias("easting"), F.when(y < 0, y + 1e7).otherwise(y).alias("northing"))


def utm_inverse(x, y, zone, south) -> Column:
    """struct<lat, lon> in degrees."""
    xi = (col(y) - F.when(col(south), 1e7).otherwise(0.0)) / (_K0 * _RADIUS)
    eta = (col(x) - 500000.0) / (_K0 * _RADIUS)
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, k in enumerate(_DELTA, 1):
        lat = lat + k * F.sin(2 * j * chi)
    lon = _meridian(col(zone)) + F.atan2(F.sinh(b), F.cos(a))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))

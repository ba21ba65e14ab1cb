"""Coordinates, distances and geometry text as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
MERCATOR_RADIUS_M = 6_378_137.0
WKT_POINT = r"(?i)Point\((-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)\)"

# UTM zone 16 north on WGS 84: ellipsoid and projection constants.
_A, _F, _K0, _LON0, _EASTING = 6_378_137.0, 1 / 298.257223563, 0.9996, -87.0, 500_000.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def in_box(lat: Column, lon: Column, box) -> Column:
    """Point inside (south, west, north, east), edges included; null gives false."""
    south, west, north, east = box
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def boxes_overlap(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, box) -> Column:
    south, west, north, east = box
    return (max_lon >= west) & (min_lon <= east) & (max_lat >= south) & (min_lat <= north)


def wkt_point(col: Column) -> Column:
    """Struct (lon, lat) of a WKT point, null parts when the text is none."""
    return F.struct(
        F.regexp_extract(col, WKT_POINT, 1).try_cast("double").alias("lon"),
        F.regexp_extract(col, WKT_POINT, 2).try_cast("double").alias("lat"),
    )


def kml_coordinates(col: Column) -> Column:
    """Array of (lon, lat) of KML coordinate text; broken tokens are left out."""
    points = F.transform(
        F.split(F.trim(col), r"\s+"),
        lambda t: F.struct(
            F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("lon"),
            F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("lat"),
        ),
    )
    return F.filter(points, lambda p: p.lon.isNotNull() & p.lat.isNotNull())


def haversine_m(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column) -> Column:
    h = F.pow(F.sin(F.radians(b_lat - a_lat) / 2), 2) + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * F.pow(
        F.sin(F.radians(b_lon - a_lon) / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def line_length_m(coords: Column) -> Column:
    """Length of an array of [lon, lat] pairs."""
    steps = F.zip_with(
        F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 1, F.lit(0))),
        F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0))),
        lambda a, b: haversine_m(a[0], a[1], b[0], b[1]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def line_pieces(coords: Column) -> Column:
    """Consecutive point pairs of a polyline as structs (ax, ay, bx, by)."""
    n = F.greatest(F.size(coords) - 1, F.lit(0))
    return F.zip_with(
        F.slice(coords, F.lit(1), n),
        F.slice(coords, F.lit(2), n),
        lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")),
    )


def piece_distance(px, py, ax, ay, bx, by, kx, ky) -> Column:
    """Distance of a point to a two-point piece after scaling axes by ``kx`` and ``ky``."""
    dx, dy = (bx - ax) * kx, (by - ay) * ky
    qx, qy = (px - ax) * kx, (py - ay) * ky
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (qx * dx + qy * dy) / square))).otherwise(0.0)
    return F.hypot(qx - t * dx, qy - t * dy)


def foot_point(px, py, ax, ay, bx, by, kx, ky) -> Column:
    """Nearest point on a piece, in the units of the input."""
    dx, dy = (bx - ax) * kx, (by - ay) * ky
    square = dx * dx + dy * dy
    t = F.when(
        square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * kx * dx + (py - ay) * ky * dy) / square))
    ).otherwise(0.0)
    return F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y"))


def to_utm16(lon: Column, lat: Column) -> Column:
    """Struct (x, y) in metres, UTM zone 16 north, by the Krüger series."""
    phi, lam = F.radians(lat), F.radians(lon - _LON0)
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_EASTING + _K0 * _RECT * x).alias("x"), (_K0 * _RECT * y).alias("y"))


def from_utm16(x: Column, y: Column) -> Column:
    """Struct (lon, lat) of UTM zone 16 north metres."""
    xi, eta = y / (_K0 * _RECT), (x - _EASTING) / (_K0 * _RECT)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct(
        (_LON0 + F.degrees(F.atan2(F.sinh(v), F.cos(u)))).alias("lon"), F.degrees(phi).alias("lat")
    )


def web_mercator(lon: Column, lat: Column) -> Column:
    return F.struct(
        (MERCATOR_RADIUS_M * F.radians(lon)).alias("x"),
        (MERCATOR_RADIUS_M * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))).alias("y"),
    )

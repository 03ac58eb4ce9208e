"""Geodesy and headings as column expressions."""

from __future__ import annotations

from math import asinh, atan, atanh, radians, sin, sinh, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

HAVERSINE_RADIUS, EQUIRECTANGULAR_RADIUS = 6_367_000.0, 6_371_000.0
#: WGS84 and the SVY21 projection (EPSG:3414).
A, FLAT = 6378137.0, 1 / 298.257223563
LAT0, LON0, FALSE_E, FALSE_N, SCALE = radians(1 + 22 / 60), radians(103 + 50 / 60), 28001.642, 38744.572, 1.0
E2 = FLAT * (2 - FLAT)
N = FLAT / (2 - FLAT)


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return 2 * HAVERSINE_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def equirectangular(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    dx = F.radians(lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = F.radians(lat2 - lat1)
    return EQUIRECTANGULAR_RADIUS * F.sqrt(dx * dx + dy * dy)


def heading_vector(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> tuple[Column, Column]:
    """(east, north) between two places on a plane at their mean latitude."""
    return F.radians(lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2)), F.radians(lat2 - lat1)


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of two vectors; null if one is zero."""
    return F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))


def bearing_vector(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def normal_heading(degrees: Column) -> Column:
    return F.pmod(degrees + 360, F.lit(360.0))


def heading_in_range(degrees: Column) -> Column:
    return F.isnan(degrees) | degrees.between(-180, 360)


#: Radius of the rectifying sphere, and the series in the third flattening between conformal and rectifying latitude and back to the geographic one.
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
TO_PLANE = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
)
FROM_PLANE = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
)
TO_LATITUDE = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def _conformal(lat: Column) -> Column:
    """Tangent of the conformal latitude."""
    e = sqrt(E2)
    s = F.sinh(e * F.atanh(e * F.sin(lat)))
    return F.tan(lat) * F.sqrt(1 + s * s) - s / F.cos(lat)


def _rectified(lat: float) -> float:
    """Distance from the equator along the meridian."""
    e = sqrt(E2)
    chi = atan(sinh(asinh(tan(lat)) - e * atanh(e * sin(lat))))
    return RECTIFYING * (chi + sum(c * sin(2 * j * chi) for j, c in enumerate(TO_PLANE, 1)))


ORIGIN = _rectified(LAT0)


def to_svy21(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Transverse Mercator: (x, y) in metres.

    Krueger's series to the sixth order, in the meridian's distance and not in the longitude's difference from it,
    so places 60 degrees east of it come out as exactly as those near it.
    """
    dl, t = F.radians(lng) - LON0, _conformal(F.radians(lat))
    u, v = F.atan2(t, F.cos(dl)), F.asinh(F.sin(dl) / F.sqrt(t * t + F.cos(dl) ** 2))
    east = sum((c * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, c in enumerate(TO_PLANE, 1)), v)
    north = sum((c * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, c in enumerate(TO_PLANE, 1)), u)
    return FALSE_E + SCALE * RECTIFYING * east, FALSE_N + SCALE * (RECTIFYING * north - ORIGIN)


def from_svy21(x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse series: (lng, lat) in degrees."""
    v, u = (x - FALSE_E) / (SCALE * RECTIFYING), ((y - FALSE_N) / SCALE + ORIGIN) / RECTIFYING
    east = sum((-c * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, c in enumerate(FROM_PLANE, 1)), v)
    north = sum((-c * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, c in enumerate(FROM_PLANE, 1)), u)
    chi = F.asin(F.sin(north) / F.cosh(east))
    lat = sum((c * F.sin(2 * j * chi) for j, c in enumerate(TO_LATITUDE, 1)), chi)
    return F.degrees(LON0 + F.atan2(F.sinh(east), F.cos(north))), F.degrees(lat)


def on_sphere(lng: Column, lat: Column) -> tuple[Column, Column]:
    """The projection of a sphere in place of the ellipsoid: within half a percent of it, from plain formulas."""
    dl, p = F.radians(lng) - LON0, F.radians(lat)
    return FALSE_E + A * F.atanh(F.cos(p) * F.sin(dl)), FALSE_N + A * (F.atan2(F.tan(p), F.cos(dl)) - LAT0)


def svy21_vector(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> tuple[Column, Column]:
    """(east, north) between two places in metres of the projection."""
    (x1, y1), (x2, y2) = to_svy21(lng1, lat1), to_svy21(lng2, lat2)
    return x2 - x1, y2 - y1


def turn_cost(turn: Column, costs: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in costs.items() for v in kv])
    return F.coalesce(F.try_element_at(table, turn), F.lit(0))



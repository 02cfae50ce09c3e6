"""Great-circle and plane measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371008.8  # mean radius in metres
METRES_PER_DEGREE_LON, METRES_PER_DEGREE_LAT = 111320.0, 110540.0
MERCATOR_RADIUS = 6378137.0


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres between two points in degrees."""
    lon1, lat1, lon2, lat2 = map(_lit, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def arc_distance(lon, lat, lon0: float, lat0: float) -> Column:
    """Great-circle metres by the cosine law, the cosine held to [-1, 1]."""
    lon, lat = _lit(lon), _lit(lat)
    cosine = math.sin(math.radians(lat0)) * F.sin(F.radians(lat)) + math.cos(math.radians(lat0)) * F.cos(F.radians(lat)) * F.cos(F.radians(lon) - math.radians(lon0))
    return EARTH * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def path_length(points: Column) -> Column:
    """Metres along an array of (x, y) structs."""
    step = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: haversine(p["x"], p["y"], q["x"], q["y"]))
    return F.aggregate(step, F.lit(0.0), lambda a, d: a + d)


def ring_area(points: Column) -> Column:
    """Square metres on the sphere inside a closed ring of (x, y) structs."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    part = F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda p, q: F.radians(q["x"] - p["x"]) * (2 + F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"]))))
    return F.abs(F.aggregate(part, F.lit(0.0), lambda a, d: a + d)) * (EARTH * EARTH / 2)


def mercator(lon, lat) -> tuple[Column, Column]:
    lon, lat = _lit(lon), _lit(lat)
    return F.radians(lon) * MERCATOR_RADIUS, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * MERCATOR_RADIUS


def from_mercator(x, y) -> tuple[Column, Column]:
    x, y = _lit(x), _lit(y)
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - math.pi / 2)


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, for x >= 0 and by symmetry below."""
    # Fixed values of the formula.
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    t = 1 / (1 + p * F.abs(x))
    y = 1 - (((((a5 * t + a4) * t) + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def area_text(m2: Column) -> Column:
    """km² from a million, hectares from ten thousand, else m²."""
    return F.when(m2 >= 1e6, F.concat(F.format_string("%.2f", m2 / 1e6), F.lit(" km²"))).when(m2 >= 1e4, F.concat(F.format_string("%.2f", m2 / 1e4), F.lit(" ha"))).otherwise(F.concat(F.format_string("%.0f", m2), F.lit(" m²")))


def length_text(m: Column) -> Column:
    return F.when(m >= 1000, F.concat(F.format_string("%.2f", m / 1000), F.lit(" km"))).otherwise(F.concat(F.format_string("%.0f", m), F.lit(" m")))

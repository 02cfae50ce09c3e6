"""Projected coordinate systems as column expressions: transverse Mercator and Lambert's conic, forward and back.

Both are native expressions, so a layer in metres is turned to degrees inside whole-stage code.  Ellipsoids of WGS 84, GRS 80 and
CGCS 2000 differ by less than 0.1 mm here and share GRS 80's or WGS 84's numbers.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geodesy import from_mercator, mercator

#: Semi-major axis and flattening.
WGS84_AXIS, WGS84_FLATTENING = 6378137.0, 1 / 298.257223563
GRS80_FLATTENING = 1 / 298.257222101


@dataclass(frozen=True)
class TransverseMercator:
    """Krüger's series in the third flattening, to its fourth power: under a micrometre within ten degrees of the meridian."""

    meridian: float
    scale: float
    easting: float
    northing: float = 0.0
    flattening: float = WGS84_FLATTENING

    def _series(self) -> tuple[float, float, float, tuple, tuple, float]:
        f = self.flattening
        n, e = f / (2 - f), math.sqrt(f * (2 - f))
        a = WGS84_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # Fixed coefficients of the series.
        ahead = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )
        back = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )
        return n, e, a, ahead, back, self.scale * a

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        _, e, _, ahead, _, r = self._series()
        away, s = F.radians(lon - self.meridian), F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, c in enumerate(ahead, 1):
            x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return r * x + self.easting, r * y + self.northing

    def back(self, x: Column, y: Column) -> tuple[Column, Column]:
        _, e, _, _, back, r = self._series()
        xi, eta = (y - self.northing) / r, (x - self.easting) / r
        u, v = xi, eta
        for j, c in enumerate(back, 1):
            u = u - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            v = v - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        lon = self.meridian + F.degrees(F.atan2(F.sinh(v), F.cos(u)))
        return lon, F.degrees(_latitude(F.atanh(F.sin(u) / F.cosh(v)), e))


def _latitude(isometric: Column, e: float, rounds: int = 5) -> Column:
    """The latitude of an isometric latitude: each round gains over two digits."""
    s = F.tanh(isometric)
    for _ in range(rounds):
        s = F.tanh(isometric + e * F.atanh(e * s))
    return F.asin(s)


@dataclass(frozen=True)
class LambertConic:
    """Two standard parallels."""

    meridian: float
    origin: float
    parallels: tuple[float, float]
    easting: float
    northing: float
    flattening: float = GRS80_FLATTENING

    def _cone(self) -> tuple[float, float, float, float]:
        e = math.sqrt(self.flattening * (2 - self.flattening))

        def isometric(lat: float) -> float:
            s = math.sin(math.radians(lat))
            return math.atanh(s) - e * math.atanh(e * s)

        def width(lat: float) -> float:
            s = math.sin(math.radians(lat))
            return math.cos(math.radians(lat)) / math.sqrt(1 - e * e * s * s)

        p, q = self.parallels
        n = math.sin(math.radians(p)) if p == q else math.log(width(p) / width(q)) / (isometric(q) - isometric(p))
        f = WGS84_AXIS * width(p) * math.exp(n * isometric(p)) / n
        return e, n, f, f * math.exp(-n * isometric(self.origin))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, n, f, r0 = self._cone()
        s = F.sin(F.radians(lat))
        r, angle = f * F.exp(-n * (F.atanh(s) - e * F.atanh(e * s))), n * F.radians(lon - self.meridian)
        return self.easting + r * F.sin(angle), self.northing + r0 - r * F.cos(angle)

    def back(self, x: Column, y: Column) -> tuple[Column, Column]:
        e, n, f, r0 = self._cone()
        sign = math.copysign(1, n)
        dx, dy = (x - self.easting) * sign, (r0 - (y - self.northing)) * sign
        r = sign * F.sqrt(dx * dx + dy * dy)
        return self.meridian + F.degrees(F.atan2(dx, dy) / n), F.degrees(_latitude(F.log(f / r) / n, e))


class Degrees:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    back = forward


class WebMercator:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return mercator(lon, lat)

    def back(self, x: Column, y: Column) -> tuple[Column, Column]:
        return from_mercator(x, y)


def crs(name: str | int):
    """The system of an EPSG code, with or without the prefix: 4326, 4490, 3857, all UTM zones on WGS 84 (326zz, 327zz), the
    three-degree zones of CGCS 2000 (4513 to 4533 with the zone before the easting, 4534 to 4554 without), Lambert-93 (2154)."""
    found = re.fullmatch(r"(?i)\s*(?:EPSG:)?(\d{4,6})\s*", str(name))
    code = int(found[1]) if found else 0
    if code in (4326, 4490, 4979):
        return Degrees()
    if code in (3857, 900913):
        return WebMercator()
    zone = code % 100
    if code // 100 in (326, 327) and 1 <= zone <= 60:
        return TransverseMercator(6.0 * zone - 183, 0.9996, 500_000.0, 10_000_000.0 if code // 100 == 327 else 0.0)
    if 4513 <= code <= 4533:
        return TransverseMercator(3.0 * (code - 4513 + 25), 1.0, (code - 4513 + 25) * 1e6 + 500_000.0, flattening=GRS80_FLATTENING)
    if 4534 <= code <= 4554:
        return TransverseMercator(75.0 + 3 * (code - 4534), 1.0, 500_000.0, flattening=GRS80_FLATTENING)
    if code == 2154:
        return LambertConic(3.0, 46.5, (49.0, 44.0), 700_000.0, 6_600_000.0)
    raise ValueError(f"no coordinate system {name}")


def to_degrees(x: Column, y: Column, source: str | int) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates in a system."""
    return crs(source).back(x, y)


def transform(geom: Column, source: str | int, *, back: bool = True) -> Column:
    """A geometry struct with all vertices taken from a system to degrees (``back``), or from degrees to it."""
    system = crs(source)

    def moved(p: Column) -> Column:
        x, y = (system.back if back else system.forward)(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    part = lambda p: F.struct(p["part"].alias("part"), p["ring"].alias("ring"), F.transform(p["pts"], moved).alias("pts"))
    return F.when(geom.isNotNull(), F.struct(geom["kind"].alias("kind"), F.transform(geom["parts"], part).alias("parts")))

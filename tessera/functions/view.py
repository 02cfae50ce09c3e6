"""What a map needs to know of a layer: viewports, sample sizes, cameras, derived weights.  Pure arithmetic or expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import kind_of, number_of

# Zoom levels up to which a sample of so many points is shown; above the last, all.
TIERS = ((14, 50_000), (15, 200_000), (16, 600_000))
CULL_BELOW, CULL_ZOOM, PAD = 0.55, 15, 0.25
FIELD_OF_VIEW = 0.6435011087932844
Box = tuple[float, float, float, float]


def sample_size(zoom: float, total: int) -> int:
    return next((min(n, total) for top, n in TIERS if zoom <= top), total)


def next_sample_size(now: int, total: int) -> int | None:
    return None if now >= total else next((n for _, n in TIERS if now < n < total), total)


def padded(box: Box, share: float = PAD) -> Box:
    """The box grown on each side by a share of its width and height, within the globe; an empty one stays."""
    w, s, e, n = box
    dx, dy = (e - w) * share, (n - s) * share
    if dx <= 0 or dy <= 0:
        return box
    return max(-180.0, w - dx), max(-90.0, s - dy), min(180.0, e + dx), min(90.0, n + dy)


def box_area(box: Box) -> float:
    w, s, e, n = box
    return abs(e - w) * abs(n - s) * abs(math.cos(math.radians((s + n) / 2)))


def box_contains(outer: Box, inner: Box, margin: float = 0.0) -> bool:
    return all(a - margin <= b for a, b in zip(outer[:2], inner[:2], strict=True)) and all(a + margin >= b for a, b in zip(outer[2:], inner[2:], strict=True))


def culls(view: Box, layer: Box | None, zoom: float) -> bool:
    """Is it worth fetching only the rows in view?"""
    if layer is None:
        return zoom >= CULL_ZOOM
    return box_area(layer) > 0 and box_area(view) / box_area(layer) < CULL_BELOW


def viewport_rows(df: DataFrame, view: Box, zoom: float, *, key: str, lon: str = "lon", lat: str = "lat", seed: int = 42, thin: bool = True) -> DataFrame:
    """Coordinates of the rows in the padded view, thinned to the zoom's sample by seeded hash: a filter before a limit.

    Without ``thin`` all rows in the view.
    """
    w, s, e, n = padded(view)
    seen = df.where(F.col(lon).between(w, e) & F.col(lat).between(s, n)).select(key, lon, lat)
    size = sample_size(zoom, 1 << 62) if thin else 1 << 62
    return seen if size == 1 << 62 else seen.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(size)


@dataclass(frozen=True)
class Camera:
    """A pitched and turned view of the Web Mercator plane through a lens at a fixed angle."""

    width: float
    height: float
    zoom: float
    lon: float
    lat: float
    bearing: float = 0.0
    pitch: float = 0.0

    @property
    def distance(self) -> float:
        return 0.5 * self.height / math.tan(FIELD_OF_VIEW / 2)

    def _world(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        size = 512 * 2.0**self.zoom
        return (lon + 180) / 360 * size, (0.5 - F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) / (2 * math.pi)) * size

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Pixels from the top left; null for places behind the camera."""
        x, y = self._world(lon, lat)
        x0, y0 = self._world(F.lit(self.lon), F.lit(self.lat))
        turn, p, d = math.radians(-self.bearing), math.radians(self.pitch), self.distance
        across = (x - x0) * math.cos(turn) - (y - y0) * math.sin(turn)
        down = (x - x0) * math.sin(turn) + (y - y0) * math.cos(turn)
        depth = d - down * math.sin(p)
        seen = F.when(depth > 0, d / depth)
        return self.width / 2 + across * seen, self.height / 2 + down * math.cos(p) * seen

    def unproject(self, px: Column, py: Column) -> tuple[Column, Column]:
        """The place on the ground under a pixel; null above the horizon."""
        turn, p, d = math.radians(-self.bearing), math.radians(self.pitch), self.distance
        v = (py - self.height / 2) / d
        slope = math.cos(p) + v * math.sin(p)
        down = F.when(slope > 0, v * d / slope)
        across = (px - self.width / 2) * (d - down * math.sin(p)) / d
        size = 512 * 2.0**self.zoom
        x0, y0 = self._world(F.lit(self.lon), F.lit(self.lat))
        x, y = x0 + across * math.cos(turn) + down * math.sin(turn), y0 - across * math.sin(turn) + down * math.cos(turn)
        return x / size * 360 - 180, F.degrees(2 * F.atan(F.exp((0.5 - y / size) * 2 * math.pi)) - math.pi / 2)


def flow_value(df: DataFrame) -> Column:
    """The first finite number among the fields flow, value, volume and count."""
    found = [number_of(F.col(c), kind_of(df, c)) for c in ("flow", "value", "volume", "count") if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def max_flow(df: DataFrame) -> DataFrame:
    return df.agg(F.greatest(F.lit(0.0), F.coalesce(F.max(flow_value(df)), F.lit(0.0))).alias("max_flow"))


def max_weight(df: DataFrame, field: str = "density") -> DataFrame:
    """The largest density, 1 without any."""
    x = number_of(F.col(field), kind_of(df, field)) if field in df.columns else F.lit(None).cast("double")
    return df.agg(F.coalesce(F.max(x), F.lit(1.0)).alias("max_weight"))


def timestamps(df: DataFrame, points: Column) -> Column:
    """A time for each vertex: the first array field that has as many, else the vertices' numbers."""
    fields = [F.when(F.size(c) == F.size(points), F.col(c).cast("array<double>")) for c in ("timestamps", "time", "times") if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
    return F.coalesce(*fields, F.transform(points, lambda _, i: i.cast("double")))


def cluster_bubbles(df: DataFrame, zoom: int, *, radius: int = 50, max_zoom: int = 16, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Counts and mean places of points by square of ``radius`` pixels at a zoom, single points above ``max_zoom``."""
    size = 512 * 2.0 ** min(zoom, max_zoom) / radius
    x, y = (F.col(lon) + 180) / 360, 0.5 - F.ln(F.tan(math.pi / 4 + F.radians(F.least(F.lit(85.0), F.greatest(F.lit(-85.0), F.col(lat)))) / 2)) / (2 * math.pi)
    return df.groupBy(F.floor(x * size).cast("long").alias("tx"), F.floor(y * size).cast("long").alias("ty")).agg(F.count(F.lit(1)).alias("n"), F.avg(lon).alias("lon"), F.avg(lat).alias("lat"))


def merge_by_name(df: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """One Multi* geometry for the lines or polygons of a name, with the number of its ``segments``; equal ones count once."""
    rows = df.select(*keys, geom).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(geom)).alias("gs"))
    parts = F.flatten(F.transform("gs", lambda g, i: F.transform(g["parts"], lambda p: F.struct((i * 1_000 + p["part"]).cast("int").alias("part"), p["ring"].alias("ring"), p["pts"].alias("pts")))))
    kind = F.concat(F.lit("Multi"), F.regexp_replace(F.col("gs")[0]["kind"], "^Multi", ""))
    return rows.select(*keys, F.struct(kind.alias("kind"), parts.alias("parts")).alias(geom), F.size("gs").alias("segments"))


def resolve_alias(query: str, catalog: dict[str, list[str]]) -> str | None:
    """A catalog name by itself, by an alias, else by the longest alias that contains the query or is contained in it."""
    plain = lambda t: "".join(t.lower().split())
    q, best = plain(query), (0, None)
    if not q:
        return None
    for name, aliases in catalog.items():
        if q in (plain(name), *map(plain, aliases)):
            return name
        for a in map(plain, aliases):
            if a and (a in q or q in a) and min(len(a), len(q)) > best[0]:
                best = (min(len(a), len(q)), name)
    return best[1]

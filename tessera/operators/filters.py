"""Row filters: attribute predicates, boxes, radii, fences, and their conjunction."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.geodesy import arc_distance
from tessera.functions.shapes import GEOM, bounds, contains_point
from tessera.functions.values import kind_of, literal_number, missing, number_of, text_of


def equal_to(df: DataFrame, where: dict) -> DataFrame:
    """All of the fields equal their values; the value None asks for null."""
    tests = [F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in where.items()]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def predicate(df: DataFrame, field: str, op: str, value: str | None = None) -> Column:
    """One of twelve tests of a field, never null.

    Null and '' are missing, and missing values pass only ``is_null`` and, where a candidate stands for them, ``in``.  Two
    numbers are compared as numbers, anything else as text; order tests need two numbers.
    """
    c, kind = F.col(field), kind_of(df, field)
    absent, text, x, v = missing(c), text_of(c, kind), number_of(c, kind), literal_number(value)
    if op == "is_null":
        return absent
    if op == "not_null":
        return ~absent
    if op == "in":
        tests = []
        for one in (s.strip() for s in value.split(",")) if value else ():
            n = 0.0 if one == "" else literal_number(one)
            tests.append(F.coalesce(text == one, F.lit(False)))
            if n is not None:
                tests.append(F.coalesce(x == n, F.lit(False)))
                if n == 0:
                    tests.append(absent)
            if one == "null":
                tests.append(c.isNull())
        return reduce(Column.__or__, tests) if tests else F.lit(False)
    if op in ("eq", "neq"):
        same = F.when(x.isNotNull(), x == v).otherwise(text == value) if v is not None else text == (value or "")
        return ~absent & (same if op == "eq" else ~same)
    if op in ("gt", "gte", "lt", "lte"):
        if v is None:
            return F.lit(False)
        test = {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]
        return ~absent & F.coalesce(test, F.lit(False))
    if op in ("contains", "starts_with", "ends_with"):
        return ~absent & {"contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith}[op](value) if value is not None else F.lit(False)
    raise ValueError(f"unknown operator {op}")


def select_by_value(df: DataFrame, field: str, op: str, value: str | None = None) -> DataFrame:
    return df.where(predicate(df, field, op, value))


def in_box(west: float, south: float, east: float, north: float, lon: str = "lon", lat: str = "lat") -> Column:
    """Inside the box or on its edge."""
    if west > east or south > north:
        raise ValueError("a box needs west <= east and south <= north")
    return F.col(lon).between(west, east) & F.col(lat).between(south, north)


def overlaps_box(west: float, south: float, east: float, north: float) -> Column:
    """Bounds columns that share a point with the box."""
    return (F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south)


def within_distance(lon0: float, lat0: float, metres: float, lon: str = "lon", lat: str = "lat") -> Column:
    """At most so many metres away: a latitude band that a scan can prune, then the great circle."""
    band = metres / 110_000.0 + 1e-9
    return F.col(lat).between(lat0 - band, lat0 + band) & (arc_distance(F.col(lon), F.col(lat), lon0, lat0) <= metres)


def in_fence(fence: Column, *, boundary: bool, lon: str = "lon", lat: str = "lat") -> Column:
    b = bounds(fence)  # of a literal fence: literals, which most rows are compared with only
    near = F.col(lon).between(b["xmin"], b["xmax"]) & F.col(lat).between(b["ymin"], b["ymax"])
    return near & contains_point(fence, F.col(lon), F.col(lat), boundary=boundary)


def fence_of_layer(df: DataFrame, *, order: str, geom: str = "geom") -> Column:
    """The first polygon of a layer by ``order``, as a literal: one geometry comes to the driver."""
    first = df.where(F.col(f"{geom}.kind").isin("Polygon", "MultiPolygon")).orderBy(order).select(F.to_json(geom)).first()
    if first is None:
        raise ValueError("the layer has no polygon for a fence")
    return F.from_json(F.lit(first[0]), GEOM)


#: Rows up to which a result is shown in full, and beyond which it is not loaded at all.
SHOWN_ROWS, MOST_ROWS = 50_000, 200_000


@dataclass
class Filtered:
    """The rows of a filter, and its counts once an action over ``df`` has run: they come with that pass."""

    df: DataFrame
    seen: Observation
    limit: int | None = None

    def report(self, *, count_only: bool = False, whole: bool = False) -> dict:
        """sourceCount, resultCount, displayedCount and scope; with ``count_only`` this runs the one pass itself.

        Scope: full_table if nothing is shown, because only counts are asked for or the result is too large; filtered if
        all rows are shown; else sample_display.  ``whole``: the caller takes all rows, however many, so all count as shown.
        """
        if count_only:
            self.df.select(F.lit(1)).write.format("noop").mode("overwrite").save()
        n = self.seen.get
        source, result = n["sourceCount"], n["resultCount"]
        if whole and not count_only:
            shown, scope = result, "filtered"
        elif count_only or result > MOST_ROWS:
            shown, scope = 0, "full_table"
        else:
            shown = min(result, self.limit if self.limit is not None else result if result <= SHOWN_ROWS else SHOWN_ROWS)
            scope = "filtered" if shown == result else "sample_display"
        return {"sourceCount": source, "resultCount": result, "displayedCount": shown, "scope": scope}


def counted(df: DataFrame, test: Column, *, limit: int | None = None) -> Filtered:
    """The rows that pass, with the counts of all rows and of those as metrics of the same scan.  ``limit`` bounds display only."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is a positive number")
    seen = Observation()
    marked = df.withColumn("__hit", F.coalesce(test, F.lit(False)))
    observed = marked.observe(seen, F.count(F.lit(1)).alias("sourceCount"), F.count_if("__hit").alias("resultCount"))
    return Filtered(observed.where("__hit").drop("__hit"), seen, limit)


def row_at(df: DataFrame, lon0: float, lat0: float, *, order: str, lon: str = "lon", lat: str = "lat", tolerance: float = 1e-5) -> DataFrame:
    """The row at a place: one with exactly these coordinates, else the nearest by |dx| + |dy| of those less than ``tolerance``
    degrees away in each; ties go by ``order``.  No such row: an empty result."""
    dx, dy = F.abs(F.col(lon) - lon0), F.abs(F.col(lat) - lat0)
    near = df.where(F.col(lon).between(lon0 - tolerance, lon0 + tolerance) & F.col(lat).between(lat0 - tolerance, lat0 + tolerance))
    return near.where((dx < tolerance) & (dy < tolerance)).orderBy(dx + dy, order).limit(1)


def uniform_sample(df: DataFrame, n: int, *, seed: int | None = None) -> DataFrame:
    """``n`` rows, each subset as likely as any other: the least of independent random numbers, which an ordered limit keeps
    without a sort of all rows.  Without a seed another sample each time; fewer rows than ``n``: all of them."""
    if n < 0:
        raise ValueError("a sample has no negative size")
    return df.withColumn("__place", F.rand() if seed is None else F.rand(seed)).orderBy("__place").limit(n).drop("__place")


def filter_layer(df: DataFrame, *, where: dict | None = None, box: tuple | None = None, center: tuple | None = None, radius: float | None = None, fence: Column | None = None) -> DataFrame:
    """The rows that pass all given filters; the fence leaves its own boundary out."""
    df = equal_to(df, where or {})
    if box:
        df = df.where(in_box(*box))
    if center:
        df = df.where(within_distance(*center, radius))
    return df.where(in_fence(fence, boundary=False)) if fence is not None else df

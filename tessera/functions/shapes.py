"""Geometries as plain structs, so that boxes, measures, part lists and fences stay Catalyst expressions.

``geom``: struct<kind: string, parts: array<struct<part: int, ring: int, pts: array<struct<x, y>>>>>.  ``part`` numbers the
members of Multi* kinds, ``ring`` the rings of a polygon (0 is the shell).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
GEOM = f"struct<kind:string,parts:array<struct<part:int,ring:int,pts:{POINTS}>>>"


def points(*coords: tuple) -> Column:
    one = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    return F.array(*[F.struct(one(x).alias("x"), one(y).alias("y")) for x, y in coords]).cast(POINTS)


def geometry(kind: str, pts: Column) -> Column:
    """A geometry of one part from its points (of a polygon: its closed shell)."""
    return F.struct(F.lit(kind).alias("kind"), F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), pts.alias("pts"))).alias("parts")).cast(GEOM)


def point(x, y) -> Column:
    return geometry("Point", points((x, y)))


def box(west, south, east, north) -> Column:
    return geometry("Polygon", points((west, south), (east, south), (east, north), (west, north), (west, south)))


def vertices(geom: Column) -> Column:
    return F.flatten(F.transform(geom["parts"], lambda p: p["pts"]))


def bounds(geom: Column) -> dict[str, Column]:
    v = vertices(geom)
    return {"xmin": F.array_min(F.transform(v, lambda p: p["x"])), "ymin": F.array_min(F.transform(v, lambda p: p["y"])), "xmax": F.array_max(F.transform(v, lambda p: p["x"])), "ymax": F.array_max(F.transform(v, lambda p: p["y"]))}


def family(geom: Column) -> Column:
    """point, line or polygon; Multi* kinds belong to their single kind's family, collections to none."""
    k = F.regexp_replace(geom["kind"], "^Multi", "")
    return F.when(k == "Point", "point").when(k == "LineString", "line").when(k == "Polygon", "polygon")


#: What an edge under a point adds to its count of crossings; even, so that the crossings' parity stays.
ON_EDGE = 1 << 40


def _met(x: Column, y: Column, p: Column, q: Column) -> Column:
    """What an edge means to a point: ``ON_EDGE``, 1 where a ray to the right crosses it, else 0.

    One comparison with the line a x - b y = c tells left, right and on it, so that no point is neither.
    """
    a, b = q["y"] - p["y"], q["x"] - p["x"]
    at, c = a * x - b * y, a * p["x"] - b * p["y"]
    low, high = F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])
    level = y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])) & (x <= high)
    corner = ((x == p["x"]) & (y == p["y"])) | ((x == q["x"]) & (y == q["y"]))
    on = corner | ((at == c) & (x >= low))
    left = (x < low) | ((x < high) & F.when(a > 0, at < c).otherwise(at > c))
    return F.when(~level, F.lit(0).cast("long")).when(on, F.lit(ON_EDGE)).when(((p["y"] > y) != (q["y"] > y)) & left, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def _ring_met(x: Column, y: Column, pts: Column) -> Column:
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), lambda p, q: _met(x, y, p, q)), F.lit(0).cast("long"), lambda s, m: s + m)


def contains_point(geom: Column, x: Column, y: Column, *, boundary: bool) -> Column:
    """Is the point in the polygon (even-odd over all rings)?  Points on an edge count as ``boundary`` says."""
    end = (lambda n: (n >= ON_EDGE) | (n % 2 == 1)) if boundary else (lambda n: (n < ON_EDGE) & (n % 2 == 1))
    return F.aggregate(F.transform(geom["parts"], lambda p: _ring_met(x, y, p["pts"])), F.lit(0).cast("long"), lambda s, m: s + m, end)


def explode_parts(df, geom: str = "geom"):
    """Multi* geometries as one row per part, attributes copied, with ``part_no`` from 0."""
    rest = [c for c in df.columns if c != geom]
    ids = F.array_sort(F.array_distinct(F.transform(F.col(f"{geom}.parts"), lambda p: p["part"])))
    parts = df.select(*rest, geom, F.posexplode(ids).alias("part_no", "__part"))
    own = F.transform(F.filter(F.col(f"{geom}.parts"), lambda p: p["part"] == F.col("__part")), lambda p: F.struct(F.lit(0).alias("part"), p["ring"].alias("ring"), p["pts"].alias("pts")))
    return parts.select(*rest, "part_no", F.struct(F.regexp_replace(F.col(f"{geom}.kind"), "^Multi", "").alias("kind"), own.alias("parts")).cast(GEOM).alias(geom))


def wkt(geom: Column) -> Column:
    """Well-known text of single and Multi* kinds."""
    xy = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p["pts"], xy), ", "), F.lit(")"))
    kind = geom["kind"]
    rings = F.transform(geom["parts"], ring)
    single = F.when(kind.isin("Point", "LineString"), F.element_at(rings, 1)).when(kind == "MultiPoint", F.concat(F.lit("("), F.array_join(rings, ", "), F.lit(")")))
    ids = F.array_sort(F.array_distinct(F.transform(geom["parts"], lambda p: p["part"])))
    polygons = F.transform(ids, lambda i: F.concat(F.lit("("), F.array_join(F.transform(F.filter(geom["parts"], lambda p: p["part"] == i), ring), ", "), F.lit(")")))
    many = F.when(kind == "MultiLineString", F.concat(F.lit("("), F.array_join(rings, ", "), F.lit(")"))).when(kind == "Polygon", F.element_at(polygons, 1)).when(kind == "MultiPolygon", F.concat(F.lit("("), F.array_join(polygons, ", "), F.lit(")")))
    return F.concat(F.upper(kind), F.lit(" "), F.coalesce(single, many))


def geojson(geom: Column) -> Column:
    """GeoJSON geometry text of single and Multi* kinds."""
    xy = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    line = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p["pts"], xy), ","), F.lit("]"))
    kind, lines = geom["kind"], F.transform(geom["parts"], line)
    ids = F.array_sort(F.array_distinct(F.transform(geom["parts"], lambda p: p["part"])))
    polygons = F.transform(ids, lambda i: F.concat(F.lit("["), F.array_join(F.transform(F.filter(geom["parts"], lambda p: p["part"] == i), line), ","), F.lit("]")))
    wrap = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    body = F.when(kind == "Point", xy(geom["parts"][0]["pts"][0])).when(kind == "LineString", lines[0]).when(kind == "MultiPoint", wrap(F.transform(vertices(geom), xy))).when(kind == "MultiLineString", wrap(lines)).when(kind == "Polygon", polygons[0]).when(kind == "MultiPolygon", wrap(polygons))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))

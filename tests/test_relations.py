"""Relations between geometries of all kinds, against their definition on small cases and an exact count on a dense town."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels, shapes
from tessera.operators import joins


def geom(kind, *parts):
    """``parts``: lists of rings or lines, each a list of coordinates; closed here for polygons."""
    close = kind.endswith("Polygon")
    made = [{"part": i, "ring": k, "pts": [{"x": float(x), "y": float(y)} for x, y in (ring + ring[:1] if close else ring)]} for i, rings in enumerate(parts) for k, ring in enumerate(rings)]
    return {"kind": kind, "parts": made}


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


BIG, SMALL, APART = geom("Polygon", [square(0, 0, 10)]), geom("Polygon", [square(2, 2, 2)]), geom("Polygon", [square(20, 20, 2)])
RING = geom("Polygon", [square(0, 0, 10), square(2, 2, 6)])
FILL = geom("Polygon", [square(2, 2, 6)])
LINE, EDGE = geom("LineString", [[(1, 1), (9, 9)]]), geom("LineString", [[(0, 0), (10, 0)]])
TWO = geom("MultiPolygon", [square(20, 20, 2)], [square(4, 4, 1)])
DOT, RIM = geom("Point", [[(5, 5)]]), geom("Point", [[(0, 5)]])


@pytest.mark.parametrize(
    "a, b, meets, holds",
    [
        (BIG, SMALL, True, True), (SMALL, BIG, True, False), (BIG, APART, False, False), (BIG, BIG, True, True),
        (RING, SMALL, True, False), (RING, FILL, True, False), (RING, geom("Polygon", [square(4, 4, 1)]), False, False),
        (BIG, RING, True, True), (RING, BIG, True, False), (BIG, TWO, True, False), (TWO, APART, True, True), (APART, TWO, True, False),
        (BIG, geom("Polygon", [square(10, 0, 3)]), True, False), (BIG, geom("Polygon", [square(0, 0, 5)]), True, True), (BIG, geom("Polygon", [square(5, 5, 10)]), True, False),
        (BIG, LINE, True, True), (BIG, EDGE, True, False), (RING, LINE, True, False), (LINE, LINE, True, True), (EDGE, geom("LineString", [[(2, 0), (3, 0)]]), True, True), (EDGE, LINE, False, False),
        (BIG, DOT, True, True), (BIG, RIM, True, False), (RING, DOT, False, False), (LINE, DOT, True, True), (LINE, geom("Point", [[(1, 1)]]), True, False), (LINE, RIM, False, False),
        (DOT, DOT, True, True), (DOT, RIM, False, False), (geom("MultiPoint", [[(5, 5)]], [[(0, 5)]]), RIM, True, True), (BIG, geom("MultiPoint", [[(30, 5)]], [[(5, 5)]]), True, False), (DOT, BIG, True, False),
    ],
)
def test_relations(a, b, meets, holds):
    assert kernels.relate(a, b, "intersects") == kernels.relate(b, a, "intersects") == meets
    assert kernels.relate(a, b, "contains") == kernels.relate(b, a, "within") == holds


def test_nothing_is_related_to_null_or_empty():
    for g in (None, {"kind": "Polygon", "parts": []}, {"kind": "GeometryCollection", "parts": BIG["parts"]}):
        assert not any(kernels.relate(g, BIG, r) or kernels.relate(BIG, g, r) for r in joins.RELATIONS)


def test_dense_town(spark):
    """Many small parcels in one place under one large shape: each point meets its own parcels, no pair is lost."""
    n = 60
    cell = spark.range(n * n).select("id", (F.col("id") % n * 0.0078125).alias("x"), (F.floor(F.col("id") / n) * 0.0078125).alias("y"))
    parcels = cell.select("id", shapes.box(F.col("x"), F.col("y"), F.col("x") + 0.0078125, F.col("y") + 0.0078125).alias("geom"))
    town = spark.range(1).select(F.lit(-1).cast("long").alias("id"), shapes.box(-60.0, -60.0, 60.0, 60.0).alias("geom"))
    points = cell.select("id", (F.col("x") + 0.00390625).alias("lon"), (F.col("y") + 0.00390625).alias("lat"))
    out = joins.spatial_join_count(points, parcels.unionAll(town).withColumn("name", F.col("id").cast("string")), key="id", name="name", order="id")
    assert out.where("_joinCount = 2 and _joinName = '-1'").count() == n * n
    far = joins.candidates(joins.with_bounds(points.select("id", "lon", "lat")), joins.with_bounds(parcels, "geom"))
    assert far.count() == n * n


def test_rows_without_geometry_go(spark):
    rows = spark.createDataFrame([(1, BIG), (2, None)], f"id int, geom {shapes.GEOM}")
    assert [r.id for r in joins.spatial_join(rows, rows.withColumn("name", F.lit("a")), "within", key="id", other_key="id", name="name", order="id").collect()] == [1]
    assert joins.select_in_box(rows, "within", (0, 0, 10, 10)).count() == 1
    with pytest.raises(ValueError):
        joins.related(rows, rows, "touches")

"""Projections at published points, and back again."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import projections, shapes

#: Fixed values: (system, lon, lat, x, y) as published with the systems' definitions and in EPSG's guidance notes.
POINTS = [
    (32631, 3.0, 0.0, 500000.0, 0.0), (32731, 3.0, 0.0, 500000.0, 10000000.0),
    (32617, -79.387139, 43.642567, 630084.0, 4833439.0),  # a tower in Toronto, to the metre
    (2154, 3.0, 46.5, 700000.0, 6600000.0),
    (3857, 180.0, 0.0, 20037508.342789244, 0.0), (4326, 12.5, -7.25, 12.5, -7.25),
]


def at(spark, system, x, y, back):
    one = spark.range(1).select(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    p = projections.crs(system)
    return one.select(*[c.alias(n) for c, n in zip((p.back if back else p.forward)(F.col("x"), F.col("y")), "ab", strict=True)]).first()


@pytest.mark.parametrize("system, lon, lat, x, y", POINTS)
def test_published_points(spark, system, lon, lat, x, y):
    coarse = 1.0 if system == 32617 else 1e-6
    assert at(spark, system, lon, lat, False) == pytest.approx((x, y), abs=coarse)
    assert at(spark, system, x, y, True) == pytest.approx((lon, lat), abs=1e-5 if coarse == 1 else 1e-9)


def test_meridian_arc(spark):
    """The quarter meridian of the ellipsoid, 10001965.729 m, and a degree of latitude on the central meridian."""
    quarter = projections.TransverseMercator(0.0, 1.0, 0.0)
    got = spark.range(1).select(*[c.alias(n) for c, n in zip(quarter.forward(F.lit(0.0), F.lit(89.9999999)), "xy", strict=True)]).first()
    assert got.y == pytest.approx(10001965.729, abs=0.02)


@pytest.mark.parametrize("system, west, east, south, north", [(32633, 10.0, 20.0, -80.0, 84.0), (32760, 172.0, 182.0, -80.0, 0.0), (2154, -5.0, 10.0, 41.0, 51.5), (4546, 108.0, 114.0, 18.0, 50.0), (4520, 94.5, 97.5, 18.0, 50.0), (3857, -180.0, 180.0, -85.0, 85.0)])
def test_round_trips_of_whole_tables(spark, system, west, east, south, north):
    p = projections.crs(system)
    grid = spark.range(2500).select((west + (east - west) * (F.col("id") % 50) / 49).alias("lon"), (south + (north - south) * F.floor(F.col("id") / 50) / 49).alias("lat"))
    xy = grid.select("lon", "lat", *[c.alias(n) for c, n in zip(p.forward(F.col("lon"), F.col("lat")), "xy", strict=True)])
    back = xy.select("lon", "lat", *[c.alias(n) for c, n in zip(p.back(F.col("x"), F.col("y")), ("u", "v"), strict=True)])
    worst = back.agg(F.max(F.abs(F.col("u") - F.col("lon"))), F.max(F.abs(F.col("v") - F.col("lat"))), F.count("u")).first()
    assert worst[0] < 1e-7 and worst[1] < 1e-7 and worst[2] == 2500


def test_scale_along_the_meridians(spark):
    """A conformal map keeps angles: a small step east and a small step north have the same scale and are at right angles."""
    for system, lon, lat in ((32633, 17.0, 52.0), (2154, 6.0, 44.5)):
        p, d = projections.crs(system), 1e-5
        xy = [at(spark, system, lon + a * d, lat + b * d, False) for a, b in ((0, 0), (1, 0), (0, 1))]
        east, north = ((xy[k].a - xy[0].a, xy[k].b - xy[0].b) for k in (1, 2))
        dot = east[0] * north[0] + east[1] * north[1]
        assert abs(dot) < 1e-5 and p


def test_geometries_and_refusals(spark):
    df = spark.range(1).select(shapes.box(10.0, 50.0, 11.0, 51.0).alias("g"))
    moved = df.select(projections.transform(F.col("g"), 32632, back=False).alias("g"))
    back = moved.select(projections.transform(F.col("g"), "epsg:32632").alias("g")).first()["g"]
    want = df.first()["g"]
    assert all(a["x"] == pytest.approx(b["x"]) and a["y"] == pytest.approx(b["y"]) for a, b in zip(back["parts"][0]["pts"], want["parts"][0]["pts"], strict=True))
    assert df.select(projections.transform(F.lit(None).cast(shapes.GEOM), 3857).alias("g")).first()["g"] is None
    for bad in ("EPSG:99", "32661", "x", 4555):
        with pytest.raises(ValueError):
            projections.crs(bad)

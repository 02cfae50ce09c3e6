"""Options of the load dispatcher: fields, filter, limit, coordinate systems, layers."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import projections
from tessera.sources import readers


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,kind,px,py,shape\n" + "".join(f"{k},{'ab'[k % 2]},{k / 10},{k / 5},POINT ({k} {-k / 2})\n" for k in range(60)) + "60,a,x,1,POINT (bad\n61,a,,,\n")
    return str(path)


def ids(df):
    return [r["id"] for r in df.orderBy("__rid").collect()]


def test_fields_filter_and_limit(spark, csv):
    layer, shown = readers.read_csv_layer(spark, csv, lon_field="px", lat_field="py", filter={"kind": "a"}, limit=5)
    assert ids(layer) == list(range(0, 60, 2)) and ids(shown) == [0, 2, 4, 6, 8]
    assert ids(readers.load(spark, csv, lon_field="px", lat_field="py", limit=3)) == [0, 1, 2]
    layer, shown = readers.read_csv_layer(spark, csv, lon_field="px", lat_field="py", threshold=20, limit=30, seed=2)
    got = ids(shown)
    assert layer.count() == 60 and len(set(got)) == 30 and got != list(range(30))
    assert readers.read_csv_layer(spark, csv, geometry_column="shape")[1].count() == 60
    assert "geom" in readers.read_csv_layer(spark, csv)[0].columns


def test_metres_to_degrees(spark, tmp_path):
    utm = projections.crs(32633)
    grid = spark.range(30).select("id", (F.lit(13.0) + F.col("id") / 10).alias("lon"), (F.lit(40.0) + F.col("id") / 10).alias("lat"))
    metres = grid.select("id", *[c.alias(n) for c, n in zip(utm.forward(F.col("lon"), F.col("lat")), ("lng", "lat"), strict=True)])
    rows = metres.orderBy("id").collect()
    (tmp_path / "m.csv").write_text("id,lng,lat,wkt\n" + "".join(f"{r['id']},{r['lng']!r},{r['lat']!r},POINT ({r['lng']!r} {r['lat']!r})\n" for r in rows))
    for options in ({}, {"geometry_column": "wkt"}):
        got = readers.load(spark, str(tmp_path / "m.csv"), source_crs="EPSG:32633", **options).collect()
        assert len(got) == 30
        for r in got:
            x, y = (r["lon"], r["lat"]) if not options else (r["geom"]["parts"][0]["pts"][0][c] for c in "xy")
            assert (x, y) == pytest.approx((13 + r["id"] / 10, 40 + r["id"] / 10), abs=1e-9)


def test_refusals(spark, csv, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"Point","coordinates":[3,4]}')
    other = str(tmp_path / "a.geojson")
    for path, options, why in (
        (other, {"limit": 3}, "CSV only"), (other, {"filter": {"a": 1}}, "CSV only"), (other, {"layer": "x"}, "several layers"), (csv, {"layer": "x"}, "several layers"), (other, {"source_crs": 3857}, "vector files"),
        (csv, {"lon_field": "px"}, "both"), (csv, {"lon_field": "px", "lat_field": "no"}, "no field"), (csv, {"filter": {"no": 1}}, "no field"), (csv, {"limit": 0}, "positive"), (csv, {"lon_field": "px", "lat_field": "py", "source_crs": 1}, "coordinate system"), (csv, {"geometry_column": "no"}, "no field"),
    ):
        with pytest.raises(ValueError, match=why):
            readers.load(spark, path, **options)

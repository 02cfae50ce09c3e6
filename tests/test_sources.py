import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import shapes
from tessera.session import Session, admission, check_query, coordinate_columns
from tessera.sources import readers, writers


def layer(spark):
    rows = [(1, "a", 10.5, 20.25), (2, None, -3.5, 4.5)]
    return spark.createDataFrame(rows, "id int, a_rather_long_name string, lon double, lat double").withColumn("geom", shapes.box(F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1))


def test_csv_round_trip(spark, tmp_path):
    writers.write_csv(layer(spark), str(tmp_path / "out"), geom="geom")
    back = readers.with_geometry(readers.read_csv(spark, str(tmp_path / "out")), wkt="geom_wkt")
    assert {r["id"]: r["geom"] for r in back.collect()} == {r["id"]: r["geom"] for r in layer(spark).collect()}


def test_csv_coordinates(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lon_wgs84,lat_wgs84\n1,10,20\n2,x,20\n3,500,1\n4,,\n")
    (tmp_path / "b.csv").write_text("id,name,lon_wgs84,lat_wgs84\n5,n,1.5,2.5\n")
    df = readers.with_geometry(readers.read_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")))
    assert sorted((r["id"], r["lon"]) for r in df.collect()) == [(1, 10.0), (5, 1.5)]
    assert coordinate_columns(["LonX", "LatY"]) == ("LonX", "LatY") and coordinate_columns(["lng", "x"], ("lng", "lat")) is None


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1, "s": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"n": 2}, "geometry": None}]}
    (tmp_path / "a.geojson").write_text("﻿" + json.dumps(doc))
    rows = readers.load(spark, str(tmp_path / "a.geojson")).collect()
    assert len(rows) == 1 and rows[0]["n"] == 1 and rows[0]["s"] == "x" and rows[0]["geom"]["kind"] == "Point"
    text = json.loads(writers.feature_collection(layer(spark), geom="geom"))
    assert len(text["features"]) == 2 and text["features"][1]["properties"]["a_rather_long_name"] is None
    (tmp_path / "bare.geojson").write_text('{"type":"Point","coordinates":[3,4]}')
    assert readers.load(spark, str(tmp_path / "bare.geojson")).first()["geom"]["parts"][0]["pts"][0]["x"] == 3


def test_shapefile_round_trip(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(writers.shapefile(layer(spark)))
    back = {r["id"]: r for r in readers.load(spark, str(tmp_path / "a.zip")).collect()}
    assert back[1]["a_rather_l"] == "a" and back[2]["a_rather_l"] is None
    assert {k: r["geom"] for k, r in back.items()} == {r["id"]: r["geom"] for r in layer(spark).collect()}


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>A</name><Point><coordinates>1,2,0</coordinates></Point></Placemark><Placemark><name>B</name><description>d</description><LineString><coordinates>0,0 1,1</coordinates></LineString></Placemark></Document></kml>')
    rows = readers.load(spark, str(tmp_path / "a.kml")).collect()
    assert [(r["Name"], r["Description"], r["geom"]["kind"]) for r in rows] == [("A", None, "Point"), ("B", "d", "LineString")]


def test_session(spark):
    s = Session(spark)
    a, b = s.add(layer(spark), "first"), s.add(layer(spark).drop("geom"), "second")
    assert a.coords == ("lon", "lat") and a.describe()["rows"] == 2 and b.describe()["bounds"] == (-3.5, 4.5, 10.5, 20.25)
    s.move("second", 0)
    assert [x.name for x in s.list()] == ["second", "first"]
    assert s.sql("select count(*) as n from __layer__ where id > 1", "first").first()["n"] == 1
    for bad in ("select 1; select 2", "drop table x", "select '--'"):
        with pytest.raises(ValueError):
            check_query(bad)
    s.remove("first")
    assert s.clear() == 1 and not s.list()
    assert [admission(n) for n in (50_000, 100_000, 200_000, 200_001)] == ["plain", "ask", "cluster", "refuse"]


def test_stream_equals_batch(spark, sf, tmp_path):
    from tessera.streaming.windows import windowed_metrics

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").write_bytes(open(f"{sf}/events.parquet", "rb").read())
    stream = windowed_metrics(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["event_type"], width="6 hours", late="1 day")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windowed_metrics(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"], width="6 hours")
    assert sorted(spark.table("windows").collect()) == sorted(batch.collect())

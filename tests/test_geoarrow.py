"""Layers through GeoArrow and back."""

import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.functions.shapes import GEOM
from tessera.sources import geoarrow

R1, R2, R3 = [[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 0.5], [2, 1], [2, 0.5], [1, 0.5]], [[9, 9], [8, 9], [8, 8], [9, 9]]
VALUES = {
    "Point": [[1, 2], [3, 4]],
    "LineString": [[[0, 0], [1, 1]], R1],
    "Polygon": [[R1, R2], [R3]],
    "MultiPoint": [[[1, 2]], [[3, 4], [5, 6], [7, 8]]],
    "MultiLineString": [[R1, R2], [R3]],
    "MultiPolygon": [[[R1, R2], [R3]], [[R3]], [[R1], [R2]]],
}


def layer(spark, geoms):
    rows = [(k, json.dumps(g)) for k, g in enumerate(geoms)]
    return spark.createDataFrame(rows, "id long, g string").select("id", F.from_json("g", GEOM).alias("geom")).repartition(3)


def read(sink):
    return pa.ipc.open_stream(io.BytesIO(sink.getvalue())).read_all()


@pytest.mark.parametrize("kind", VALUES)
def test_every_kind_comes_back(spark, kind):
    df = layer(spark, [geoarrow._struct(kind, v) for v in VALUES[kind]])
    sink = io.BytesIO()
    assert geoarrow.write_stream(df, sink, geom="geom") == {"kind": f"geoarrow.{kind.lower()}", "kept": len(VALUES[kind]), "skipped": 0}
    t = read(sink)
    t.validate(full=True)
    assert t.schema.field("__geometry").metadata == {b"ARROW:extension:name": f"geoarrow.{kind.lower()}".encode()}
    assert dict(zip(t["id"].to_pylist(), t["__geometry"].to_pylist(), strict=True)) == {float(k): v for k, v in enumerate(VALUES[kind])}
    schema, rows, _ = geoarrow.record_batches(df, geom="geom")
    assert sorted(geoarrow.decoded(rows, schema).select("id", "geom").collect()) == sorted(df.select(F.col("id").cast("double"), "geom").collect())


def test_most_frequent_kind_stays(spark):
    geoms = [geoarrow._struct("Point", [k, k]) for k in range(2)] + [geoarrow._struct("Polygon", [R1])] * 3 + [None, {"kind": "Point", "parts": []}, {"kind": "GeometryCollection", "parts": []}]
    sink = io.BytesIO()
    assert geoarrow.write_stream(layer(spark, geoms), sink, geom="geom", attrs=[]) == {"kind": "geoarrow.polygon", "kept": 3, "skipped": 5}
    assert read(sink)["__geometry"].to_pylist() == [[R1]] * 3
    empty = io.BytesIO()
    assert geoarrow.write_stream(layer(spark, [None]), empty, geom="geom") == {"kind": None, "kept": 0, "skipped": 1}
    assert not empty.getvalue()


def test_points_of_columns(spark):
    rows = [("1.5", 2.0, 7, "a", [1]), (" ", 2.0, 1, "b", None), ("x", 2.0, 1, "b", None), (None, 2.0, 1, "b", None), ("181", 2.0, 1, "b", None), ("-180", -90.0, None, None, None), ("3", float("nan"), 1, "b", None), ("3", 90.5, 1, "b", None)]
    df = spark.createDataFrame(rows, "lon string, lat double, `n.o` int, name string, more array<int>")
    sink = io.BytesIO()
    assert geoarrow.write_stream(df, sink, coords=("lon", "lat")) == {"kind": "geoarrow.point", "kept": 2, "skipped": 6}
    t = read(sink)
    assert t.column_names == ["__geometry", "n.o", "name", "more"]
    got = sorted(t.to_pylist(), key=lambda r: r["name"])
    assert got[1] == {"__geometry": [1.5, 2.0], "n.o": 7.0, "name": "a", "more": "[1]"}
    assert got[0]["__geometry"] == [-180.0, -90.0] and got[0]["n.o"] != got[0]["n.o"] and got[0]["name"] == got[0]["more"] == ""
    none = io.BytesIO()
    assert geoarrow.write_stream(df.limit(0), none, coords=("lon", "lat"))["kept"] == 0
    assert read(none).num_rows == 0
    with pytest.raises(ValueError):
        geoarrow.record_batches(df.withColumn("__geometry", F.lit(1)), coords=("lon", "lat"))


def test_viewport(spark):
    df = spark.range(100).select(F.col("id").alias("__rid"), (F.col("id") - 50).cast("double").alias("lon"), F.lit(0.0).alias("lat"), F.lit("x").alias("name"))
    sink = io.BytesIO()
    assert geoarrow.viewport_stream(df, sink, (-10, -10, 10, 10), 12)["kept"] == 31
    assert read(sink).column_names == ["__geometry", "__rid"]

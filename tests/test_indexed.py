"""Shapefiles and GeoPackages by ranges of their records."""

import io
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import shapes
from tessera.sources import indexed, readers, writers


@pytest.fixture(scope="module")
def layer(spark):
    cell = spark.range(500).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), "id")).alias("name"), (F.col("id") % 20).cast("double").alias("lon"), (F.col("id") / 20).alias("lat"))
    return cell.withColumn("geom", shapes.box(F.col("lon"), F.col("lat"), F.col("lon") + 1 + F.col("id") / 1000, F.col("lat") + 1))


def test_shp_is_the_zip(spark, layer, tmp_path):
    data = writers.shapefile(layer)
    (tmp_path / "a.zip").write_bytes(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            (tmp_path / ("roads." + n.rsplit(".", 1)[1])).write_bytes(z.read(n))
    want = {r["id"]: r for r in readers.load(spark, str(tmp_path / "a.zip")).collect()}
    for rows in (7, 100, 50_000):
        df = readers.load(spark, str(tmp_path / "roads.shp"), rows=rows)
        assert {r["id"]: r for r in df.collect()} == want and df.rdd.getNumPartitions() == -(-500 // rows)
    few = readers.load(spark, f"file://{tmp_path}/roads.shp", columns=["name", "id"])
    assert few.columns == ["name", "id"] and {r["id"]: r["name"] for r in few.collect()} == {k: r["name"] for k, r in want.items()}
    with pytest.raises(Exception, match="no columns"):
        readers.load(spark, str(tmp_path / "roads.shp"), columns=["nothing"]).collect()
    with pytest.raises(Exception, match="has no .dbf"):
        (tmp_path / "roads.shp").rename(tmp_path / "other.shp")
        readers.load(spark, str(tmp_path / "other.shp")).collect()


def blob(x, y, order="<", envelope=False, empty=False):
    wkb = struct.pack(order + "BIdd", order == "<", 1, x, y)
    flags = (order == "<") | (envelope << 1) | (empty << 4)
    return b"GP\0" + bytes((flags,)) + struct.pack(order + "i", 4326) + (struct.pack(order + "4d", x, x, y, y) if envelope else b"") + wkb


@pytest.fixture
def package(tmp_path):
    path = str(tmp_path / "two #1.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_contents (table_name text, data_type text)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text, srs_id integer)")
        for t, g in (("towns", "shape"), ('odd "name"', "geom")):
            db.execute("insert into gpkg_contents values (?, 'features')", (t,))
            db.execute("insert into gpkg_geometry_columns values (?, ?, 4326)", (t, g))
        db.execute("create table towns (fid integer primary key, shape point, name text(20), size double, big boolean, n mediumint, raw blob)")
        db.execute('create table "odd ""name""" (fid integer primary key, geom point)')
        rows = [(k * 3 + 1, blob(k / 4, -k / 8, "<>"[k % 2], k % 3 == 0), f"t{k}" if k % 5 else None, k / 2, k % 2, k, b"\0\1") for k in range(1000)]
        db.executemany("insert into towns values (?, ?, ?, ?, ?, ?, ?)", [*rows, (5000, None, "no place", 1, 1, 1, None), (5001, blob(1, 1, empty=True), "empty", 1, 1, 1, None), (5002, b"junk", "junk", 1, 1, 1, None)])
        db.execute('insert into "odd ""name""" values (1, ?)', (blob(9, 9),))
    return path


def test_geopackage(spark, package):
    assert indexed.geopackage_layers(package) == [('odd "name"', "geom", 4326), ("towns", "shape", 4326)]
    for rows in (100, 50_000):
        df = readers.load(spark, package, layer="towns", rows=rows)
        assert df.dtypes[0] == ("fid", "bigint") and [k for _, k in df.dtypes[2:]] == ["string", "double", "boolean", "bigint", "binary"]
        got = {r["fid"]: r for r in df.collect()}
        assert len(got) == 1002 and df.rdd.getNumPartitions() == -(-5002 // rows)
        for k in range(1000):
            r, p = got[k * 3 + 1], got[k * 3 + 1]["shape"]["parts"][0]["pts"][0]
            assert (p["x"], p["y"], r["name"], r["size"], r["big"], r["n"], bytes(r["raw"])) == (k / 4, -k / 8, f"t{k}" if k % 5 else None, k / 2, bool(k % 2), k, b"\0\1")
        assert got[5001]["shape"] is None and got[5002]["shape"] is None
    assert readers.load(spark, package, layer='odd "name"', columns=["geom"]).first()["geom"]["kind"] == "Point"
    for bad in (None, "nothing"):
        with pytest.raises(Exception, match="name one layer"):
            readers.load(spark, package, layer=bad).collect()

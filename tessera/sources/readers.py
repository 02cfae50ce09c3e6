"""Readers of layers: CSV, Parquet, GeoJSON, shapefiles, KML, JDBC queries, and literals."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codecs, kernels
from tessera.functions.projections import to_degrees, transform
from tessera.functions.shapes import GEOM, geometry, points
from tessera.functions.values import NUMERAL
from tessera.operators import filters
from tessera.operators.aggregates import union_by_name
from tessera.session import check_query, coordinate_columns
from tessera.sources import split_json
from tessera.sources.formats import dbf_fields, dbf_records, geometry_type, shp_records
from tessera.sources.indexed import read_geopackage, read_shp

MAX_POINTS, MAX_VERTICES = 500, 1000


def read_csv(spark: SparkSession, *paths: str, text: bool = False) -> DataFrame:
    """CSV files with a header, typed by all of their rows (``text``: all strings), columns united by name."""
    return union_by_name(*[spark.read.csv(p, header=True, inferSchema=not text, enforceSchema=False, multiLine=True, escape='"') for p in paths])


def parse_geometry(c: Column, form: str) -> Column:
    """Text or binary as a geometry struct; ``form``: wkt (an SRID prefix is dropped), wkb (bytes or hex, also EWKB) or geojson."""

    @F.pandas_udf(GEOM)
    def parse(values: pd.Series) -> pd.DataFrame:
        read = {"wkt": lambda v: codecs.from_wkt(v)[0], "wkb": lambda v: codecs.from_wkb(v)[0], "geojson": codecs.from_geojson}[form]
        found = [read(v) for v in values]
        return pd.DataFrame({"kind": [g and g["kind"] for g in found], "parts": [g and g["parts"] for g in found]}, index=values.index)

    g = parse(c)
    return F.when(g["kind"].isNotNull(), g)


def with_geometry(df: DataFrame, *, coords: tuple[str, str] | None = None, wkt: str | None = None) -> DataFrame:
    """Rows with usable coordinates as ``lon`` and ``lat``, or with readable well-known text as ``geom``; coordinates win."""
    pair = None if wkt else coordinate_columns(df.columns, coords)
    if pair:
        lon, lat = (F.when(F.trim(F.col(c).cast("string")).rlike(NUMERAL), F.trim(F.col(c).cast("string")).try_cast("double")) for c in pair)
        return df.withColumn("lon", lon).withColumn("lat", lat).where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    wkt = wkt or sniff_wkt(df)
    if not wkt:
        raise ValueError(f"no coordinates among {df.columns}")
    return df.withColumn("geom", parse_geometry(F.col(wkt), "wkt")).where("geom is not null")


def sniff_wkt(df: DataFrame, rows: int = 50) -> str | None:
    """The first text column whose first values, blanks aside, are all well-known text."""
    looks = r"(?i)^\s*(SRID=\d+;)?\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*Z?\s*\("
    for name, kind in df.dtypes:
        if kind == "string":
            seen = df.where(F.trim(F.col(f"`{name}`")) != "").select(F.col(f"`{name}`").rlike(looks)).limit(rows).collect()
            if seen and all(r[0] for r in seen):
                return name
    return None


def read_geojson(spark: SparkSession, path: str, *, split: bool | None = None) -> DataFrame:
    """A FeatureCollection, Feature or geometry: the properties as columns beside ``geom``; features without one are dropped.

    ``split``: the collections are read by file splits (see ``split_json``), by default if a file is larger than a split; else
    each file is one value, whose features are then spread over tasks.  Both give the same rows; a file that is one Feature
    or geometry is only read whole.
    """
    if split is None:
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
        split = largest > int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
    if split:
        features = split_json.features(spark, path).where(F.get_json_object("f", "$.type") == "Feature").select("f")
    else:
        raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
        v = F.parse_json("v")
        kind = F.try_variant_get(v, "$.type", "string")
        bare = F.array(F.when(kind == "Feature", F.col("v")).otherwise(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col("v"), F.lit("}"))))
        many = F.from_json(F.get_json_object("v", "$.features"), "array<string>")
        features = raw.select(F.explode(F.when(kind == "FeatureCollection", many).otherwise(bare)).alias("f")).repartition(spark.sparkContext.defaultParallelism)
    rows = features.select(F.get_json_object("f", "$.properties").alias("p"), F.get_json_object("f", "$.geometry").alias("g"))
    rows = rows.select("p", parse_geometry(F.col("g"), "geojson").alias("geom")).where("geom is not null")
    schema = rows.agg(F.schema_of_json_agg("p").alias("s")).first()["s"] if hasattr(F, "schema_of_json_agg") else spark.read.json(rows.select(F.coalesce("p", F.lit("{}"))).rdd.map(lambda r: r[0])).schema
    return rows.select(F.from_json("p", schema).alias("p"), "geom").select("p.*", "geom")


def read_shapefile(spark: SparkSession, path: str, *, schema: str | None = None) -> DataFrame:
    """Zipped shapefiles (the first layer of each): attributes from the DBF, ``geom`` from the SHP.

    ``path`` may match many archives; each is parsed in a task of its own.  Without ``schema`` the fields of the first
    archive hold for all.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    if schema is None:
        fields = dbf_fields(_members(bytes(files.limit(1).collect()[0][0]))["dbf"])
        schema = ", ".join(f"`{n}` {'double' if t in 'NF' else 'boolean' if t == 'L' else 'string'}" for n, t, _, _ in fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"].to_pylist():
                files = _members(content)
                geoms, rows = shp_records(files["shp"]), dbf_records(files["dbf"])
                names = [n for n, *_ in dbf_fields(files["dbf"])]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                kept = [i for i, g in enumerate(geoms) if g]
                yield pa.RecordBatch.from_arrays([*(pa.array([c[i] for i in kept]) for c in cols), pa.array([geoms[i] for i in kept], geometry_type())], names=[*names, "geom"])

    return files.mapInArrow(parse, f"{schema}, geom {GEOM}" if schema else f"geom {GEOM}")


def _members(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shp = min(n for n in z.namelist() if n.lower().endswith(".shp"))
        return {n.rsplit(".", 1)[1].lower(): z.read(n) for n in z.namelist() if n.rsplit(".", 1)[0] == shp[:-4]}


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks as (Name, Description, geom); each file is parsed in a task of its own."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for text in b["value"].to_pylist() for r in kml_placemarks(text)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], geometry_type())], names=["Name", "Description", "geom"])

    return spark.read.text(path, wholetext=True).mapInArrow(parse, f"Name string, Description string, geom {GEOM}").where("geom is not null")


def kml_placemarks(text: str) -> list[tuple]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    places = lambda e: np.array([[float(x) for x in p.split(",")[:2]] for c in e.iter() if local(c) == "coordinates" for p in (c.text or "").split()])
    out = []
    for mark in (e for e in ET.fromstring(text).iter() if local(e) == "Placemark"):
        about, geom = {local(c): c.text for c in mark}, None
        for e in mark.iter():
            if local(e) == "Point":
                geom = kernels.geom_of("Point", [[places(e)]])
            elif local(e) == "LineString":
                geom = kernels.geom_of("LineString", [[places(e)]])
            elif local(e) == "Polygon":
                geom = kernels.geom_of("Polygon", [[places(r) for r in e.iter() if local(r) == "LinearRing"]])
            if geom:
                break
        out.append((about.get("name"), about.get("description"), geom))
    return out


def read_jdbc(spark: SparkSession, url: str, sql: str, *, geometry_name: str | None = None, **options: str) -> DataFrame:
    """A reading query pushed down to a database; its geometry column, as EWKB hex, becomes ``geom``."""
    df = spark.read.format("jdbc").options(url=url, query=check_query(sql), **options).load()
    return df.withColumn("geom", parse_geometry(F.col(geometry_name), "wkb")).drop(geometry_name) if geometry_name else df


def read_csv_layer(spark: SparkSession, *paths: str, lon_field: str | None = None, lat_field: str | None = None, geometry_column: str | None = None, source_crs: str | int | None = None, filter: dict | None = None, limit: int | None = None, threshold: int = 50_000, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(layer, shown): the rows of CSV files with a place, and those that are shown.

    Coordinates come from the named fields, else a named or recognised column of well-known text, else recognised coordinate
    fields; ``source_crs`` is where they are in, and the layer is in degrees.  ``filter`` (fields and values, all equal)
    defines the layer; ``limit`` only bounds what is shown: the first rows by ``__rid``, the order of the files, of a layer of
    up to ``threshold`` rows, a uniform sample of a larger one, by default all rows or ``threshold`` of them.
    """
    if limit is not None and (not isinstance(limit, int) or limit < 1):
        raise ValueError("a limit is a positive number")
    if (lon_field is None) != (lat_field is None):
        raise ValueError("name both coordinate fields or none")
    df = read_csv(spark, *paths).withColumn("__rid", F.monotonically_increasing_id())
    for c in (lon_field, lat_field, geometry_column, *(filter or ())):
        if c is not None and c not in df.columns:
            raise ValueError(f"no field {c}; there are {df.columns[:-1]}")
    coords = (lon_field, lat_field) if lon_field else None
    wkt = geometry_column or (None if coordinate_columns(df.columns, coords) else sniff_wkt(df))
    df = filters.equal_to(df, filter or {})
    if wkt:
        layer = with_geometry(df, wkt=wkt)
        layer = layer if source_crs is None else layer.withColumn("geom", transform(F.col("geom"), source_crs))
    elif source_crs is None:
        layer = with_geometry(df, coords=coords)
    else:
        pair = coordinate_columns(df.columns, coords)
        if not pair:
            raise ValueError(f"no coordinates among {df.columns[:-1]}")
        lon, lat = to_degrees(*(F.trim(F.col(c).cast("string")).try_cast("double") for c in pair), source_crs)
        layer = df.withColumns({"lon": lon, "lat": lat}).where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    n = layer.limit(threshold + 1).count()
    if n > threshold:
        return layer, filters.uniform_sample(layer, limit or threshold, seed=seed)
    return layer, layer if limit is None or limit >= n else layer.orderBy("__rid").limit(limit)


#: Which options a source takes besides its path.
CSV_OPTIONS = {"lon_field", "lat_field", "geometry_column", "filter", "limit"}
LAYERED = {"gpkg"}
PLACED = {"shp", "zip", "kml", "gpkg"}


def load(spark: SparkSession, path: str, *, layer: str | None = None, source_crs: str | int | None = None, **options) -> DataFrame:
    """By extension.  ``layer`` names one of a GeoPackage, ``source_crs`` where a CSV's or a vector file's coordinates are in;
    coordinate fields, filter and limit are for CSV only.  With such options a CSV gives the rows that are shown."""
    readers = {"csv": read_csv, "geojson": read_geojson, "json": read_geojson, "zip": read_shapefile, "shp": read_shp, "gpkg": read_geopackage, "kml": read_kml, "parquet": lambda s, p: s.read.parquet(p)}
    extension = path.rsplit(".", 1)[-1].lower()
    if extension not in readers:
        raise ValueError(f"no reader for .{extension}; there are {sorted(readers)}")
    if extension != "csv" and (only := CSV_OPTIONS & set(options)):
        raise ValueError(f"{sorted(only)} are for CSV only")
    if layer is not None and extension not in LAYERED:
        raise ValueError("only files of several layers take a layer")
    if source_crs is not None and extension != "csv" and extension not in PLACED:
        raise ValueError("only CSV and vector files take a source_crs")
    if extension == "csv":
        return read_csv_layer(spark, path, source_crs=source_crs, **options)[1] if source_crs is not None or options else read_csv(spark, path)
    df = readers[extension](spark, path, **options, **({"layer": layer} if layer is not None else {}))
    if source_crs is None:
        return df
    geom = next(f.name for f in df.schema.fields if f.dataType.simpleString() == GEOM)
    return df.withColumn(geom, transform(F.col(geom), source_crs))


def create(spark: SparkSession, kind: str, shapes_: list[list[tuple[float, float]]]) -> DataFrame:
    """Points, lines or polygons from literal coordinates, checked; rings are closed and turned counter-clockwise."""
    if len(shapes_) > MAX_POINTS or any(len(s) > MAX_VERTICES for s in shapes_):
        raise ValueError(f"at most {MAX_POINTS} geometries of {MAX_VERTICES} vertices")
    rows = []
    for n, shape in enumerate(shapes_):
        if any(not (-180 <= x <= 180 and -90 <= y <= 90) for x, y in shape):
            raise ValueError("longitude is within 180 and latitude within 90 degrees")
        if kind == "LineString" and len(set(map(tuple, shape))) < 2:
            raise ValueError("a line has two different vertices at least")
        if kind == "Polygon":
            ring = np.array([*shape, shape[0]] if tuple(shape[0]) != tuple(shape[-1]) else shape, float)
            if fault := kernels.ring_fault(ring):
                raise ValueError(f"polygon {n}: {fault}")
            shape = (ring if kernels.signed_area(ring) > 0 else ring[::-1]).tolist()
        rows.append((n, [tuple(map(float, p)) for p in shape]))
    df = spark.createDataFrame(rows, "id int, pts array<struct<x:double,y:double>>")
    return df.select("id", geometry(kind, F.col("pts")).alias("geom"))


__all__ = ["create", "load", "points", "read_csv", "read_csv_layer", "read_geojson", "read_geopackage", "read_jdbc", "read_kml", "read_shapefile", "read_shp", "with_geometry"]

"""Layers as GeoArrow record batches: nested offset buffers built from a batch's own buffers, streamed batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shapes import GEOM
from tessera.functions.values import kind_of, number_of
from tessera.functions.view import Box, viewport_rows

# Fixed values of the format: the geometry column, its vertices, and the extension name of each kind.
GEOMETRY, EXTENSION = "__geometry", b"ARROW:extension:name"
XY = pa.list_(pa.field("xy", pa.float64(), False), 2)
LEVELS = {"Point": (), "LineString": ("vertices",), "Polygon": ("rings", "vertices"), "MultiPoint": ("points",), "MultiLineString": ("linestrings", "vertices"), "MultiPolygon": ("polygons", "rings", "vertices")}


def arrow_type(kind: str) -> pa.DataType:
    out = XY
    for name in reversed(LEVELS[kind]):
        out = pa.list_(pa.field(name, out, False))
    return out


def arrow_schema(kind: str, attrs: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(GEOMETRY, arrow_type(kind), True, {EXTENSION: b"geoarrow." + kind.lower().encode()}), *(pa.field(n, t) for n, t in attrs.items())])


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())


def encoded(geoms: pa.StructArray, kind: str) -> pa.Array:
    """Geometry structs of one kind, none of them null or empty, as a GeoArrow array."""
    parts = geoms.field("parts")
    rings = parts.flatten()
    per_feature, points = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), rings.field("pts")
    per_ring, xy = points.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), points.flatten()
    out = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([xy.field("x").to_numpy(zero_copy_only=False), xy.field("y").to_numpy(zero_copy_only=False)], axis=1).ravel()), type=XY)
    feature = np.repeat(np.arange(len(per_feature)), per_feature)
    if kind == "MultiPolygon":
        part = rings.field("part").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (feature[1:] != feature[:-1])])) if len(part) else np.zeros(0, np.int64)
        lengths = [np.bincount(feature[first], minlength=len(per_feature)), np.diff(first, append=len(part)), per_ring]
    elif len(LEVELS[kind]) == 2:
        lengths = [per_feature, per_ring]
    else:  # one list of points a feature
        lengths = [np.bincount(feature, per_ring, len(per_feature)).astype(np.int64)] if kind != "Point" else []
        if kind == "Point":
            out = out.take(pa.array(np.concatenate([[0], np.cumsum(np.bincount(feature, per_ring, len(per_feature)))])[:-1].astype(np.int64)))
    kinds, inner = [], arrow_type(kind)
    for _ in lengths:
        kinds.append(inner)
        inner = inner.value_type
    for n, t in zip(reversed(lengths), reversed(kinds), strict=True):
        out = pa.ListArray.from_arrays(_offsets(n), out, type=t)
    return out


def dominant(df: DataFrame, geom: str = "geom") -> tuple[str | None, int, int]:
    """(most frequent kind, its rows, all other rows); ties go to the first name, None without a geometry."""
    rows = {r["kind"]: r["count"] for r in df.groupBy(F.when(F.size(F.flatten(F.transform(F.col(f"{geom}.parts"), lambda p: p["pts"]))) > 0, F.col(f"{geom}.kind")).alias("kind")).count().collect()}
    known = {k: n for k, n in rows.items() if k in LEVELS}
    kind = min(known, key=lambda k: (-known[k], k), default=None)
    return kind, known.get(kind, 0), sum(rows.values()) - known.get(kind, 0)


def _attributes(df: DataFrame, attrs: list[str], absent: float) -> tuple[list, dict[str, pa.DataType]]:
    cols, kinds = [], {}
    for k, name in enumerate(attrs):  # by place: Arrow maps take no names with dots
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            cols.append(F.coalesce(c.cast("double"), F.lit(absent)).alias(f"a{k}"))
            kinds[name] = pa.float64()
        else:
            cols.append(F.coalesce(F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string"), F.lit("")).alias(f"a{k}"))
            kinds[name] = pa.string()
    return cols, kinds


def record_batches(df: DataFrame, *, geom: str | None = None, coords: tuple[str, str] | None = None, attrs: list[str] | None = None) -> tuple[pa.Schema | None, DataFrame | None, int]:
    """(schema, rows (batch, kept, skipped), rows of other kinds): each batch a GeoArrow record batch in IPC form.

    With ``coords`` points of the two columns; rows without two finite numbers in range are skipped.  With ``geom`` the rows of
    the most frequent kind.  Attributes are doubles (absent: NaN beside coordinates, 0 beside geometries) or text (absent: '').
    Without any geometry there is no schema.
    """
    attrs = [c for c in df.columns if c != geom and c not in (coords or ())] if attrs is None else attrs
    if GEOMETRY in attrs:
        raise ValueError(f"{GEOMETRY} is the geometry's name")
    if geom:
        kind, _, others = dominant(df, geom)
        if kind is None:
            return None, None, others
        cols, kinds = _attributes(df, attrs, 0.0)
        rows = df.where((F.col(f"{geom}.kind") == kind) & (F.size(F.flatten(F.transform(F.col(f"{geom}.parts"), lambda p: p["pts"]))) > 0)).select(F.col(geom).cast(GEOM).alias(GEOMETRY), *cols)
    else:
        kind, others = "Point", 0
        cols, kinds = _attributes(df, attrs, float("nan"))
        x, y = (number_of(F.col(f"`{c}`"), kind_of(df, c)) for c in coords)
        rows = df.select(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")).alias(GEOMETRY), *cols)
    schema = arrow_schema(kind, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            here = t.column(0)
            if geom:
                keep, made = np.ones(len(t), bool), encoded(here, kind)
            else:
                xy = np.stack([np.asarray(here.field(k).to_numpy(zero_copy_only=False), float) for k in (0, 1)], axis=1)
                with np.errstate(invalid="ignore"):
                    keep = (np.abs(xy) <= (180, 90)).all(axis=1)
                made = pa.FixedSizeListArray.from_arrays(pa.array(xy[keep].ravel()), type=XY)
            rest = [c.filter(pa.array(keep)).cast(k) for c, k in zip(t.columns[1:], kinds.values(), strict=True)]
            data = pa.RecordBatch.from_arrays([made, *rest], schema=schema).serialize().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([data]), pa.array([int(keep.sum())]), pa.array([int((~keep).sum())])], names=["batch", "kept", "skipped"])

    return schema, rows.mapInArrow(run, "batch binary, kept long, skipped long"), others


def write_stream(df: DataFrame, sink: BinaryIO, **what) -> dict:
    """The layer as one Arrow IPC stream, partition by partition; the driver holds a batch at a time.  Returns the counts of
    rows kept and skipped; without any geometry nothing is written and ``kind`` is None."""
    schema, rows, skipped = record_batches(df, **what)
    if schema is None:
        return {"kind": None, "kept": 0, "skipped": skipped}
    kept = 0
    with pa.ipc.new_stream(sink, schema) as out:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            kept, skipped = kept + r["kept"], skipped + r["skipped"]
            if r["kept"]:
                out.write_batch(pa.ipc.read_record_batch(pa.py_buffer(bytes(r["batch"])), schema))
    return {"kind": schema.field(0).metadata[EXTENSION].decode(), "kept": kept, "skipped": skipped}


def viewport_stream(df: DataFrame, sink: BinaryIO, view: Box, zoom: float, *, key: str = "__rid", lon: str = "lon", lat: str = "lat") -> dict:
    """The points in view, thinned to the zoom's sample: only places and the row's key."""
    return write_stream(viewport_rows(df, view, zoom, key=key, lon=lon, lat=lat), sink, coords=(lon, lat), attrs=[key])


def _struct(kind: str, value) -> dict:
    """A geometry struct of a GeoArrow value."""
    polygons = {"Point": lambda v: [[[v]]], "LineString": lambda v: [[v]], "MultiPoint": lambda v: [[[p]] for p in v], "Polygon": lambda v: [v], "MultiLineString": lambda v: [[r] for r in v], "MultiPolygon": lambda v: v}[kind](value)
    return {"kind": kind, "parts": [{"part": i, "ring": k, "pts": [{"x": x, "y": y} for x, y in r]} for i, p in enumerate(polygons) for k, r in enumerate(p)]}


def decoded(rows: DataFrame, schema: pa.Schema) -> DataFrame:
    """(geom, attributes) of the batches of ``record_batches``."""
    kind = next(k for k in LEVELS if b"geoarrow." + k.lower().encode() == schema.field(0).metadata[EXTENSION])
    fields = ", ".join(f"`{f.name}` {'double' if f.type == pa.float64() else 'string'}" for f in list(schema)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pts = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        shape = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("pts", pts)])))])
        for t in batches:
            for data in t["batch"]:
                b = pa.ipc.read_record_batch(data.as_buffer(), schema)
                yield pa.RecordBatch.from_arrays([pa.array([_struct(kind, v) for v in b.column(0).to_pylist()], shape), *b.columns[1:]], names=["geom", *schema.names[1:]])

    return rows.select("batch").mapInArrow(run, f"geom {GEOM}" + (f", {fields}" if fields else ""))

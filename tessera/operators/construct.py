"""Operators that make geometries: native where expressions do, else kernels over Arrow batches or salted groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import kernels
from tessera.functions.geodesy import EARTH
from tessera.functions.shapes import GEOM, POINTS, bounds, box, geometry, vertices
from tessera.functions.values import missing
from tessera.operators.overlay import feature, overlay
from tessera.operators.partition import spread
from tessera.storage import written

METRES = {"meters": 1.0, "kilometers": 1000.0, "miles": 1609.344, "feet": 0.3048, "yards": 0.9144, "degrees": math.pi / 180 * EARTH}
MAX_GRID = 2_000_000


def map_geometries(df: DataFrame, kernel: Callable[[dict], dict | None], geom: str = "geom") -> DataFrame:
    """``df`` with each geometry replaced by the kernel's; other columns pass through as Arrow; null stays null."""
    place = df.columns.index(geom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([kernel(g) if g else None for g in b[geom].to_pylist()], b.schema.field(geom).type)
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(b.columns)], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def _rings(geoms: pa.Array) -> tuple[pa.StructArray, pa.ListArray, np.ndarray]:
    """The rings of a batch's geometries in turn, their lists of points, and all points."""
    rings = geoms.flatten()[1].flatten()
    pts = rings.flatten()[2]
    x, y = pts.flatten().flatten()
    return rings, pts, np.stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)], axis=1)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def _lists(sizes: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values).cast(kind)


def _points(xy: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], names=["x", "y"])


def circles(lon: np.ndarray, lat: np.ndarray, metres: float, steps: int = 64) -> np.ndarray:
    """Closed rings at a great-circle distance around points, counter-clockwise: (point, vertex, x and y)."""
    d, la = metres / EARTH, np.radians(lat)[:, None]
    turn = -2 * math.pi * (np.arange(steps + 1) % steps) / steps
    y = np.arcsin(np.sin(la) * math.cos(d) + np.cos(la) * math.sin(d) * np.cos(turn))
    x = np.radians(lon)[:, None] + np.arctan2(np.sin(turn) * math.sin(d) * np.cos(la), math.cos(d) - np.sin(la) * np.sin(y))
    return np.degrees(np.stack([x, y], axis=2))


def buffer_points(df: DataFrame, distance: float, unit: str = "kilometers", lon: str = "lon", lat: str = "lat", steps: int = 64) -> DataFrame:
    """``df`` with the circle around each point as ``geom``; a point without a longitude or latitude has null for its vertices."""
    if distance <= 0:
        raise ValueError("a buffer needs a distance above zero")
    rows = spread(df)
    rows = rows.select(*[c for c in rows.columns if c != "geom"], F.col(lon).cast("double").alias("__lon"), F.col(lat).cast("double").alias("__lat"))
    kept, metres = rows.columns[:-2], distance * METRES[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                n = len(b)
                x, y = circles(b["__lon"].to_numpy(zero_copy_only=False), b["__lat"].to_numpy(zero_copy_only=False), metres, steps).reshape(-1, 2).T
                none = {c: np.repeat(b[c].is_null().to_numpy(zero_copy_only=False), steps + 1) for c in ("__lon", "__lat")}
                x = pa.array(np.ascontiguousarray(x), mask=none["__lon"] | none["__lat"])
                y = pa.array(np.ascontiguousarray(y), mask=none["__lat"])
                pts = _lists(np.full(n, steps + 1), pa.StructArray.from_arrays([x, y], names=["x", "y"]), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
                zero = pa.array(np.zeros(n, np.int32))
                parts = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.StructArray.from_arrays([zero, zero, pts], names=["part", "ring", "pts"]))
                geom = pa.StructArray.from_arrays([pa.array(["Polygon"] * n, pa.string()), parts], names=["kind", "parts"])
                yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], geom], names=[*kept, "geom"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-2], T.StructField("geom", T._parse_datatype_string(GEOM))]))


def reach(df: DataFrame, geom: str = "geom", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``df`` with ``vertices``, ``nearest`` and ``farthest`` for each geometry: its number of vertices, and the least and the
    largest great-circle metres from the row's point to one; a vertex or point without coordinates has no distance."""
    rows = df.select(*[c for c in df.columns if c != geom], F.col(geom).alias("__geom"), F.col(lon).cast("double").alias("__lon"), F.col(lat).cast("double").alias("__lat"))
    kept = rows.columns[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, pts, xy = _rings(b["__geom"])
            sizes, rings = _sizes(pts), _sizes(b["__geom"].flatten()[1])
            n = np.add.reduceat(np.append(sizes, 0), np.minimum(np.cumsum(rings) - rings, len(sizes))) * (rings > 0) if len(b) else rings
            lon, lat = (np.radians(np.repeat(b[c].to_numpy(zero_copy_only=False).astype(float), n)) for c in ("__lon", "__lat"))
            x, y = np.radians(xy.astype(float)).T
            h = np.sin((y - lat) / 2) ** 2 + np.cos(lat) * np.cos(y) * np.sin((x - lon) / 2) ** 2
            away = 2 * EARTH * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
            first, some = (np.cumsum(n) - n)[n > 0], n > 0
            out = []
            for f in (np.fmin, np.fmax):
                v = np.full(len(n), np.nan)
                v[some] = f.reduceat(away, first) if some.any() else v[some]
                out.append(pa.array(v, mask=np.isnan(v)))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(n.astype(np.int32)), *out], names=[*kept, "vertices", "nearest", "farthest"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-3], T.StructField("vertices", T.IntegerType()), T.StructField("nearest", T.DoubleType()), T.StructField("farthest", T.DoubleType())]))


def buffer(df: DataFrame, distance: float, unit: str = "kilometers", geom: str = "geom") -> DataFrame:
    """Buffers of any geometries, one by one."""
    if distance <= 0:
        raise ValueError("a buffer needs a distance above zero")
    metres = distance * METRES[unit]
    return map_geometries(df, lambda g: kernels.buffer(g, metres), geom)


def centroids(df: DataFrame, geom: str = "geom") -> DataFrame:
    """The mean of the vertices; a ring's closing vertex counts once."""
    parts = F.col(f"{geom}.parts")
    open_ = F.when(F.col(f"{geom}.kind").endswith("Polygon"), F.flatten(F.transform(parts, lambda p: F.slice(p["pts"], 1, F.size(p["pts"]) - 1)))).otherwise(vertices(F.col(geom)))
    mean = lambda v, k: F.aggregate(v, F.lit(0.0), lambda a, p: a + p[k]) / F.size(v)
    return df.withColumn("__v", open_).withColumn("lon", mean(F.col("__v"), "x")).withColumn("lat", mean(F.col("__v"), "y")).drop("__v")


def bounding_box(df: DataFrame, geom: str | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One polygon around everything."""
    b = bounds(F.col(geom)) if geom else {"xmin": F.col(lon), "xmax": F.col(lon), "ymin": F.col(lat), "ymax": F.col(lat)}
    e = df.select(*[c.alias(k) for k, c in b.items()]).agg(F.min("xmin").alias("west"), F.min("ymin").alias("south"), F.max("xmax").alias("east"), F.max("ymax").alias("north"))
    return e.where("west is not null").withColumn("geom", box(F.col("west"), F.col("south"), F.col("east"), F.col("north")))


def convex_hull(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """One polygon; each task reduces its rows to the corners of their hull before the last few meet.  None: no row."""

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, 2))
        for b in batches:
            kept = np.concatenate([kept, b.to_numpy(float)])
            ring = kernels.convex_hull(kept)
            kept = np.unique(kept, axis=0) if ring is None else ring[:-1]
        yield pd.DataFrame({"x": kept[:, 0], "y": kept[:, 1]})

    def last(group: pd.DataFrame) -> pd.DataFrame:
        ring = kernels.convex_hull(group[["x", "y"]].to_numpy())
        return pd.DataFrame({"n": range(len(ring)), "x": ring[:, 0], "y": ring[:, 1]}) if ring is not None else pd.DataFrame({"n": [], "x": [], "y": []})

    few = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().mapInPandas(corners, "x double, y double").withColumn("hull", F.lit(0))
    ring = few.groupBy("hull").applyInPandas(last, "n int, x double, y double")
    pts = F.transform(F.array_sort(F.collect_list(F.struct("n", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return ring.withColumn("hull", F.lit(0)).groupBy("hull").agg(pts.alias("pts")).select(geometry("Polygon", F.col("pts").cast(POINTS)).alias("geom"))


def simplify(df: DataFrame, tolerance: float, geom: str = "geom") -> DataFrame:
    """Lines and rings without the vertices that are no farther than ``tolerance`` from what is left; other columns pass through.

    All lines of a batch are cut together, in its own buffers.
    """
    place = df.columns.index(geom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b[geom]
            kind, parts = old.flatten()
            rings, pts, xy = _rings(old)
            sizes, many = _sizes(pts), _sizes(parts)
            closed = np.repeat(pc.ends_with(kind, "Polygon").fill_null(False).to_numpy(zero_copy_only=False).astype(bool), many)
            keep = kernels.simplify_all(xy, sizes, closed, tolerance)
            kept = np.concatenate(([0], np.cumsum(keep)))
            stops = np.cumsum(sizes)
            part, ring, _ = rings.flatten()
            pts = _lists(kept[stops] - kept[stops - sizes], _points(xy[keep]), pts.type)
            rings = pa.StructArray.from_arrays([part, ring, pts], fields=list(rings.type))
            new = pa.StructArray.from_arrays([kind, _lists(many, rings, parts.type)], fields=list(old.type), mask=old.is_null())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(b.columns)], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def smooth(df: DataFrame, iterations: int = 1, geom: str = "geom") -> DataFrame:
    """Corner cutting, 1 to 5 times; points are unchanged."""
    times = max(1, min(5, iterations))

    def kernel(g: dict) -> dict:
        if not g["kind"].endswith("Point"):
            for p, r in zip(g["parts"], kernels.rings_of(g), strict=True):
                p["pts"] = [{"x": x, "y": y} for x, y in kernels.smooth(r, times, g["kind"].endswith("Polygon")).tolist()]
        return g

    return map_geometries(df, kernel, geom)


def _unite(geoms: list[dict | None]) -> dict | None:
    """The union of polygons, pairwise in rounds so that each meets few edges at a time."""
    regions = [kernels.rings_of(g) for g in geoms if g and g["kind"].endswith("Polygon")]
    while len(regions) > 1:
        regions = [[r for p in kernels.union(regions[i : i + 4]) for r in p] for i in range(0, len(regions), 4)]
    parts = kernels.union(regions) if regions else []
    return kernels.geom_of("Polygon", parts) if parts else None


def dissolve(df: DataFrame, by: str | None = None, *, geom: str = "geom", salts: int = 32) -> DataFrame:
    """One polygon for each value of ``by`` (missing ones under a key of their own), or one for all.

    A group is united in salted parts first, so that a large group's work is spread; the few results are united after.  A whole
    layer is an overlay of its own.
    """
    if not by:
        return feature(overlay(df, df.limit(0), "union", geom)).select(F.lit("all").alias("key"), "geom")
    key = F.when(~missing(F.col(by)), F.col(by).cast("string")).otherwise("<none>")

    def unite(group: pa.Table) -> pa.Table:
        g = _unite(group["geom"].to_pylist())
        return pa.table({"key": pa.array([group["key"][0].as_py()], pa.string()), "geom": pa.array([g], group["geom"].type)}).slice(0, 1 if g else 0)

    rows = df.select(key.alias("key"), F.col(geom).alias("geom")).where("geom is not null")
    parts = rows.groupBy("key", F.pmod(F.xxhash64("geom"), F.lit(salts)).alias("salt")).applyInArrow(lambda t: unite(t.select(["key", "geom"])), f"key string, geom {GEOM}")
    return parts.groupBy("key").applyInArrow(unite, f"key string, geom {GEOM}")


def intersect(a: DataFrame, b: DataFrame, geom: str = "geom") -> DataFrame:
    """What both layers cover: at most one feature, without attributes; ``clip`` is the same.

    ``overlay`` gives the same as one row a polygon, for results that do not fit into one value.
    """
    return feature(overlay(a, b, "intersection", geom)).withColumnRenamed("geom", geom)


clip = intersect


def difference(a: DataFrame, b: DataFrame, geom: str = "geom") -> DataFrame:
    """What the first layer covers and the second does not; an empty second layer takes nothing."""
    return feature(overlay(a, b, "difference", geom)).withColumnRenamed("geom", geom)


def union(a: DataFrame, b: DataFrame, geom: str = "geom") -> DataFrame:
    """What either layer covers: at most one feature."""
    return feature(overlay(a, b, "union", geom)).withColumnRenamed("geom", geom)


def regular_grid(spark, bbox: tuple[float, float, float, float], cell: float, unit: str = "kilometers") -> DataFrame:
    """Square cells (i, j, geom) that fit into a box, centred in it; too many are refused with a size that would do."""
    west, south, east, north = bbox
    step = cell * METRES[unit] / METRES["degrees"]
    columns, rows = math.floor(abs(east - west) / step), math.floor(abs(north - south) / step)
    if columns * rows > MAX_GRID:
        raise ValueError(f"{columns * rows} cells; at least {cell * math.sqrt(columns * rows / MAX_GRID):.6g} {unit} are needed")
    x0, y0 = min(west, east) + (abs(east - west) - columns * step) / 2, min(south, north) + (abs(north - south) - rows * step) / 2
    cells = spark.range(columns * rows).select((F.col("id") % max(1, columns)).cast("int").alias("i"), F.floor(F.col("id") / max(1, columns)).cast("int").alias("j"))
    return cells.withColumn("geom", box(x0 + F.col("i") * step, y0 + F.col("j") * step, x0 + (F.col("i") + 1) * step, y0 + (F.col("j") + 1) * step))


def _cells(frame: np.ndarray, size: float, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The cells of a square's points that the places around it settle: all of them if ``last``."""

    def run(mine: pa.Table, near: pa.Table) -> pa.Table:
        xy = np.stack([near["x"].to_numpy(), near["y"].to_numpy()], axis=1)
        ids, rings = [], []
        for k, x, y in zip(mine["key"].to_pylist(), mine["lon"].to_pylist(), mine["lat"].to_pylist(), strict=True):
            p = np.array([x, y])
            ring = kernels.voronoi_cell(p, xy, frame)
            if last or len(ring) and 2 * math.sqrt(((ring - p) ** 2).sum(axis=1).max()) <= size:
                ids.append(k)
                rings.append(ring.tolist())
        return pa.table({"key": pa.array(ids, mine.schema.field("key").type), "ring": pa.array(rings, pa.list_(pa.list_(pa.float64())))})

    return run


def voronoi(points: DataFrame, bbox: tuple[float, float, float, float] | None = None, *, key: str = "id") -> DataFrame:
    """(key, geom): the part of the box that is nearer to the point than to any other; equal places share a cell.

    A point's cell needs only the points within twice its farthest corner.  Points look at the squares around their own;
    those whose cell could still be cut from beyond go on with squares twice as wide.  Equal places are one; each round is
    written, so that its plan does not hold those before it, and looks only at squares that some cell still needs.
    """
    w, s, e, n = points.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    if points.limit(3).count() < 3:
        raise ValueError("at least three points are needed")
    w, s, e, n = bbox or (w - 0.1 * (e - w), s - 0.1 * (n - s), e + 0.1 * (e - w), n + 0.1 * (n - s))
    frame = np.array([(w, s), (e, s), (e, n), (w, n), (w, s)])
    places = written(points.select(F.col("lon").cast("double"), F.col("lat").cast("double")).distinct().withColumn("key", F.monotonically_increasing_id()))
    size = max(math.sqrt((e - w) * (n - s) * 4 / max(1, places.count())), 1e-9)
    todo, done = places, None
    while True:
        last = size >= max(e - w, n - s)
        spot = {"gx": F.floor(F.col("lon") / size).cast("long"), "gy": F.floor(F.col("lat") / size).cast("long")}

        mine = todo.withColumns(spot)
        near = places.select(F.col("lon").alias("x"), F.col("lat").alias("y"), *[c.alias(k) for k, c in spot.items()])
        for c in ("gx", "gy"):
            near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        near = near.join(mine.select("gx", "gy").distinct().hint("merge"), ["gx", "gy"], "left_semi").select("x", "y", F.col("gx").alias("hx"), F.col("gy").alias("hy"))
        ready = written(mine.groupBy("gx", "gy").cogroup(near.groupBy("hx", "hy")).applyInArrow(_cells(frame, size, last), "key long, ring array<array<double>>"))
        done = ready if done is None else done.unionAll(ready)
        todo = written(todo.join(ready.select("key").hint("merge"), "key", "left_anti"))
        if last or todo.isEmpty():
            break
        size *= 2
    pts = F.transform("ring", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).cast(POINTS)
    cells = places.join(done.where(F.size("ring") > 0).hint("merge"), "key").select("lon", "lat", geometry("Polygon", pts).alias("geom"))
    return points.select(key, "lon", "lat").join(cells.hint("merge"), ["lon", "lat"]).select(key, "geom")

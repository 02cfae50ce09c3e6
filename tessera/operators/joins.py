"""Attribute joins, spatial joins through density-adaptive leaves, nearest neighbours through cells of the sphere."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.geodesy import EARTH, haversine
from tessera.functions.pairs import relate_pairs
from tessera.functions.shapes import bounds, contains_point
from tessera.functions.values import kind_of, missing, text_of
from tessera.operators.edits import with_row_ids
from tessera.operators.partition import MADE_ROWS, overlapping
from tessera.storage import written

RELATIONS = ("intersects", "contains", "within")
#: Ids of one place in a row; ids on a side of a block of pairs; pairs compared in a task, about.
PLACE_IDS, BLOCK_IDS, TASK_PAIRS = 128, 16_384, 1 << 28


def attribute_join(target: DataFrame, other: DataFrame, field: str, other_field: str | None = None, *, order: str) -> DataFrame:
    """Inner join on the key as text: missing keys match nothing, the first match by ``order`` counts, the target's columns win."""
    other_field = other_field or field
    key = text_of(F.col(other_field), kind_of(other, other_field))
    new = [c for c in other.columns if c not in target.columns]
    first = other.where(~missing(F.col(other_field))).select(key.alias("__key"), order, *[c for c in new if c != order]).withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy(order))).where("__n = 1")
    left = target.where(~missing(F.col(field))).withColumn("__key", text_of(F.col(field), kind_of(target, field)))
    return left.join(first.select("__key", *new), "__key").drop("__key")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r structs) of rows whose bounds (xmin, ymin, xmax, ymax) overlap; see ``partition.overlapping``.

    Both sides are written with a number; only numbers and bounds look for each other, and rows are fetched for pairs.
    """
    sides = [written(d.withColumn("k", F.monotonically_increasing_id())) for d in (left.withColumnRenamed("k", "__k"), right.withColumnRenamed("k", "__k"))]
    rows = [s.select(F.col("k").alias(n), F.struct(*[F.col("__k" if c == "k" else c).alias(c) for c in d.columns]).alias(v)) for s, d, n, v in zip(sides, (left, right), "ij", "lr", strict=True)]
    return overlapping(*sides).join(rows[0], "i").join(rows[1], "j").select("l", "r")


def with_bounds(df: DataFrame, geom: str | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    if geom:
        return df.withColumns(bounds(F.col(geom)))
    return df.withColumns({"xmin": F.col(lon), "xmax": F.col(lon), "ymin": F.col(lat), "ymax": F.col(lat)})


def _holders(points: DataFrame, polygons: DataFrame, key: str, *more: str) -> DataFrame:
    """Pairs (l, r) of points (key, lon, lat) and the polygons (geom, more) that hold them, edges included."""
    held = written(polygons.select(F.monotonically_increasing_id().alias("j"), "geom", *more))
    spots = with_bounds(points.select(F.struct(key, "lon", "lat").alias("k"), "lon", "lat"))
    pairs = overlapping(spots, held.select(F.col("j").alias("k"), *[c.alias(n) for n, c in bounds(F.col("geom")).items()]))
    pairs = pairs.join(held.select("j", F.struct("geom", *more).alias("r")), "j").select(F.col("i").alias("l"), "r")
    return pairs.where(contains_point(F.col("r.geom"), F.col("l.lon"), F.col("l.lat"), boundary=True))


def _counted(target: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``found``: (key, name, order) of each match."""
    per = found.groupBy(key).agg(F.count(F.lit(1)).alias("_joinCount"), F.min_by("__name", F.when(F.col("__name").isNotNull(), F.col("__order"))).alias("_joinName"))
    return target.join(per, key, "left").withColumn("_joinCount", F.coalesce("_joinCount", F.lit(0)))


def spatial_join_count(points: DataFrame, polygons: DataFrame, *, key: str, name: str, order: str) -> DataFrame:
    """Every point with ``_joinCount``, the polygons that hold it (edges count), and ``_joinName``, the first name by ``order``.

    ``key`` is unique among the points.
    """
    hits = _holders(points, polygons, key, *dict.fromkeys((name, order)))
    return _counted(points, hits.select(F.col(f"l.{key}").alias(key), F.col(f"r.{name}").alias("__name"), F.col(f"r.{order}").alias("__order")), key)


def select_by_location(points: DataFrame, polygons: DataFrame, *, key: str) -> DataFrame:
    """The points that some polygon holds (edges count)."""
    hits = _holders(points, polygons, key).select(F.col(f"l.{key}").alias(key)).distinct()
    return points.join(hits, key, "left_semi")


def related(left: DataFrame, right: DataFrame, relation: str, *, key: str = "id", other_key: str = "id", geom: str = "geom") -> DataFrame:
    """Keys (i, j) of geometries of any kinds where the left one intersects, contains or is within the right one.

    Touching intersects; containing needs interiors that meet, so that a point on an edge is not contained.  Null
    geometries are related to none.  Bounds decide first; the exact test runs where they met, over many pairs at once.
    """
    if relation not in RELATIONS:
        raise ValueError(f"a relation is one of {', '.join(RELATIONS)}")
    a = with_bounds(left.select(F.col(key).alias("k"), F.col(geom).alias("g")), "g")
    b = with_bounds(right.select(F.col(other_key).alias("k"), F.col(geom).alias("g")), "g")

    def pairs(p: pa.Table, q: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        hit = relate_pairs(p["g"], q["g"], i, j, relation)
        return pa.table({"i": p["k"].take(pa.array(i[hit])), "j": q["k"].take(pa.array(j[hit]))})

    return overlapping(a, b, leaf_rows=MADE_ROWS, make=pairs, made=f"i {dict(a.dtypes)['k']}, j {dict(b.dtypes)['k']}")


def _shapes_joined(target: DataFrame, other: DataFrame, relation: str, *, name: Column, order: Column, geom: str) -> DataFrame:
    """(g, n, name) of each different geometry of ``target`` that is related to some row of ``other``: how many rows, and the
    name of the first by ``order`` that has one.

    Equal geometries of a side are one, with their number, so copies are not compared again.  Those of ``other`` are numbered
    by their first name's order, so that a task gives one row a geometry: a sum and the least number, not its pairs.
    """
    if relation not in RELATIONS:
        raise ValueError(f"a relation is one of {', '.join(RELATIONS)}")
    mine = written(target.where(F.col(geom).isNotNull()).select(F.col(geom).alias("g")).distinct().withColumn("k", F.monotonically_increasing_id()))
    first = F.when(name.isNotNull(), order)
    theirs = other.where(F.col(geom).isNotNull()).select(F.col(geom).alias("g"), name.alias("name"), first.alias("order"))
    theirs = theirs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "order").alias("name"), F.min("order").alias("order"))
    theirs = written(with_row_ids(theirs, ["order"], "k"))
    weighed = with_bounds(theirs.select("k", "g", "n", F.when(F.col("name").isNotNull(), F.col("k")).alias("best")), "g")

    def summed(p: pa.Table, q: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        hit = relate_pairs(p["g"], q["g"], i, j, relation)
        i, j, none = i[hit], j[hit], np.iinfo(np.int64).max
        n, best = np.zeros(len(p), np.int64), np.full(len(p), none)
        np.add.at(n, i, np.asarray(q["n"])[j])
        np.minimum.at(best, i, np.asarray(q["best"].fill_null(none))[j])
        some = np.flatnonzero(n)
        return pa.table({"i": p["k"].take(pa.array(some)), "n": n[some], "best": pa.array(best[some], mask=best[some] == none)})

    found = overlapping(with_bounds(mine, "g"), weighed, leaf_rows=MADE_ROWS, make=summed, made="i long, n long, best long")
    found = found.groupBy(F.col("i").alias("k")).agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    names = theirs.select(F.col("k").alias("best"), "name").hint("merge")
    return mine.join(found.hint("merge"), "k").join(names, "best", "left").select("g", "n", "name")


def spatial_join(target: DataFrame, other: DataFrame, relation: str, *, key: str, other_key: str, name: str, order: str, geom: str = "geom") -> DataFrame:
    """``target`` with ``_joinCount`` and ``_joinName`` of the related rows of ``other``; rows without a geometry go.

    ``key`` and ``other_key`` are unique.
    """
    found = _shapes_joined(target, other, relation, name=F.col(name), order=F.col(order), geom=geom)
    found = found.select(F.col("g").alias(geom), F.col("n").alias("_joinCount"), F.col("name").alias("_joinName"))
    return target.where(F.col(geom).isNotNull()).join(found.hint("merge"), geom, "left").select(*target.columns, F.coalesce("_joinCount", F.lit(0)).cast("long").alias("_joinCount"), "_joinName")


def select_related(target: DataFrame, other: DataFrame, relation: str, *, key: str, other_key: str, geom: str = "geom") -> DataFrame:
    """The rows of ``target`` that are related to some row of ``other``."""
    found = _shapes_joined(target, other, relation, name=F.lit(None).cast("string"), order=F.lit(0), geom=geom)
    return target.join(found.select(F.col("g").alias(geom)).hint("merge"), geom, "left_semi")


def select_by_geometry(df: DataFrame, relation: str, shape: dict, *, geom: str = "geom") -> DataFrame:
    """The rows whose geometry, of any family, intersects, contains or is within one given geometry (a dict of the struct's
    form); bounds decide first, on Spark's side, then the exact test."""
    if relation not in RELATIONS:
        raise ValueError(f"a relation is one of {', '.join(RELATIONS)}")
    xy = [(p["x"], p["y"]) for part in shape["parts"] for p in part["pts"]]
    if not xy:
        return df.limit(0)
    (west, south), (east, north) = (tuple(f(c) for c in zip(*xy, strict=True)) for f in (min, max))
    b = bounds(F.col(geom))
    near = df.where((b["xmin"] <= east) & (b["xmax"] >= west) & (b["ymin"] <= north) & (b["ymax"] >= south))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.functions.kernels import relate

        for t in batches:
            yield t.filter(pa.array([relate(g, shape, relation) for g in t[geom].to_pylist()], pa.bool_()))

    return near.mapInArrow(run, df.schema)


def select_in_box(df: DataFrame, relation: str, box: tuple[float, float, float, float], *, geom: str = "geom") -> DataFrame:
    """``select_by_geometry`` with a box."""
    west, south, east, north = box
    if west > east or south > north:
        raise ValueError("a box needs west <= east and south <= north")
    frame = {"kind": "Polygon", "parts": [{"part": 0, "ring": 0, "pts": [{"x": x, "y": y} for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))]}]}
    return select_by_geometry(df, relation, frame, geom=geom)


def select_in_fence(df: DataFrame, layer: DataFrame, *, order: str, geom: str = "geom") -> DataFrame:
    """The rows whose geometry shares a point with the first polygon of a layer, edges included."""
    first = layer.where(F.col(f"{geom}.kind").isin("Polygon", "MultiPolygon")).orderBy(order).select(geom).first()
    if first is None:
        raise ValueError("the layer has no polygon for a fence")
    return select_by_geometry(df, "intersects", first[0].asDict(recursive=True), geom=geom)


def _unit() -> dict[str, Column]:
    """The place (lon, lat) on the unit sphere."""
    lon, lat = F.radians("lon"), F.radians("lat")
    return {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}


def _on_sphere(df: DataFrame, side: float, spread: bool) -> DataFrame:
    """Cells of a cube grid of the given side over the unit sphere; ``spread``: also the 26 around a point's own."""
    for c, x in _unit().items():
        cell = F.floor(x / side).cast("long")
        df = df.withColumn("c" + c, F.explode(F.sequence(cell - 1, cell + 1)) if spread else cell)
    return df


def within(left: DataFrame, right: DataFrame, metres: float, *, spread_right: bool = False) -> DataFrame:
    """Pairs (i, j, d) of points (id, lon, lat) at most ``metres`` apart, by an equi-join on cells; none is missed at poles or the date line.

    The join is told to sort and merge: Spark knows the size of the files only, not that one side (the left, or the right if
    ``spread_right``) is 27 times as many rows, and would send it to all tasks through the driver.
    """
    chord = 2 * math.sin(min(metres / EARTH, math.pi) / 2)
    side = min(2.0, chord + 1e-9)
    a = _on_sphere(left.select(F.col("id").alias("i"), F.col("lon"), F.col("lat")), side, not spread_right).withColumnsRenamed({"lon": "lon_i", "lat": "lat_i"})
    b = _on_sphere(right.select(F.col("id").alias("j"), F.col("lon"), F.col("lat")), side, spread_right).withColumnsRenamed({"lon": "lon_j", "lat": "lat_j"})
    pairs = a.join(b.hint("merge"), ["cx", "cy", "cz"]).withColumn("d", haversine(F.col("lon_i"), F.col("lat_i"), F.col("lon_j"), F.col("lat_j")))
    return pairs.where(F.col("d") <= metres).select("i", "j", "d", "lon_i", "lat_i", "lon_j", "lat_j")


def pairs_within(points: DataFrame, metres: float) -> DataFrame:
    """Pairs (i, j) of points (id, lon, lat) of one layer more than 0 and at most ``metres`` apart, both ways.

    Pairs can be as many as the square of the points, so one must cost little: a point meets places, each once with its ids
    in arrays, and ids are paired last; the chord decides, and great-circle metres only where rounding might.  Cells that
    meet are found first, then places go to those only.  A cell that many ids meet is a grid of blocks, a task each at most,
    so that neither a task's places nor its pairs follow the density.
    """
    chord = 2 * math.sin(min(max(metres, 0.0) / EARTH, math.pi) / 2)
    side = min(2.0, chord + 1e-9)
    part = F.floor((F.row_number().over(W.partitionBy("lon", "lat").orderBy("id")) - 1) / PLACE_IDS).alias("part")
    # Places that are neither null nor NaN nor infinite.
    known = points.select("id", "lon", "lat").where("id is not null and lon - lon = 0 and lat - lat = 0").select("id", "lon", "lat", part)
    places = written(_on_sphere(known.groupBy("lon", "lat", "part").agg(F.collect_list("id").alias("ids")).withColumns(_unit()), side, False))

    cell, home = ["cx", "cy", "cz"], {"cx": "hx", "cy": "hy", "cz": "hz"}
    cells = places.groupBy(cell).agg(F.sum(F.size("ids")).alias("a"))
    around = cells.withColumnsRenamed(home).withColumnRenamed("a", "n")
    for c, h in home.items():
        around = around.withColumn(c, F.explode(F.sequence(F.col(h) - 1, F.col(h) + 1)))
    meet = written(around.join(cells.hint("merge"), cell).withColumn("b", F.sum("n").over(W.partitionBy(cell))).drop("n"))  # a ids of a cell meet b

    own = F.xxhash64("lon", "lat", "part")
    lines = {n: F.ceil(F.col(n) / BLOCK_IDS) for n in "ab"}
    each = {n: F.explode(F.sequence(F.lit(0).cast("long"), lines[n] - 1)) for n in "ab"}
    a = places.join(meet.where("hx = cx and hy = cy and hz = cz").select(*cell, "a", "b").hint("merge"), cell).withColumns({"u": F.pmod(own, lines["a"]), "v": each["b"]})
    b = places.withColumnsRenamed(home).join(meet.hint("merge"), [*home.values()]).withColumns({"v": F.pmod(own, lines["b"]), "u": each["a"]})
    spark, key = points.sparkSession, [*cell, "u", "v"]
    compared = meet.where("hx = cx and hy = cy and hz = cz").agg(F.sum(F.col("a") * F.col("b").cast("double"))).first()[0] or 0.0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, min(10_000, int(compared / TASK_PAIRS)))

    def side_of(d: DataFrame, ids: Column, name: str) -> DataFrame:
        return d.repartition(parts, *key).select(*key, ids, *[F.col(c).alias(f"{c}_{name}") for c in ("lon", "lat", "x", "y", "z")])

    met = side_of(a, F.explode("ids").alias("i"), "i").join(side_of(b, F.col("ids"), "j").hint("merge"), key)
    dx, dy, dz = (F.col(f"{c}_i") - F.col(f"{c}_j") for c in "xyz")
    apart, d = dx * dx + dy * dy + dz * dz, haversine(F.col("lon_i"), F.col("lat_i"), F.col("lon_j"), F.col("lat_j"))
    square, rounding = chord * chord, 1e-10
    sure = (apart > rounding) & (apart < square - rounding)
    elsewhere = (F.col("lon_i") != F.col("lon_j")) | (F.col("lat_i") != F.col("lat_j"))
    near = (apart <= square + rounding) & (sure | (elsewhere & (d > 0) & (d <= metres)))
    return met.where(near).select("i", F.explode("ids").alias("j")).where("i <> j")


def nearest(left: DataFrame, right: DataFrame, k: int, *, skip: Column | None = None, spare: int | None = None) -> DataFrame:
    """The ``k`` points of ``right`` nearest to each of ``left`` (both id, lon, lat): (i, j, d, rank); ties go to the smaller j.

    A first radius is set from the density; points with fewer than k others within it go on with twice the radius, until
    the radius spans the sphere.  A pair within the radius cannot be beaten by one beyond it, so each answer is exact.
    ``skip`` drops pairs before they count.  ``spare`` says that of the points of one place it drops all or at most so many:
    then only the k + spare smallest ids of a place can count, and the others are left out before the join.  Each round is
    written, so that plans do not hold those before them.
    """
    right = right.select("id", "lon", "lat")
    if spare is not None:
        right = right.withColumn("__n", F.row_number().over(W.partitionBy("lon", "lat").orderBy("id"))).where(F.col("__n") <= k + spare).drop("__n")
    right = written(right)
    n = right.count()
    metres = min(math.pi * EARTH, 2 * EARTH * math.sqrt(2.0 * (k + 1) / max(1, n)))
    todo, done = written(left.select("id", "lon", "lat")), None
    while True:
        last = metres >= math.pi * EARTH
        pairs = within(todo, right, metres, spread_right=n < todo.count())
        pairs = pairs if skip is None else pairs.where(~skip)
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k).select("i", "j", "d", "rank")
        if not last:
            # Only points with k answers are settled at this radius.
            ranked = ranked.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("i"))).where(F.col("n") == k).drop("n")
        ranked = written(ranked)
        done = ranked if done is None else done.unionAll(ranked)
        if last:
            return done
        todo = written(todo.join(ranked.where("rank = 1").select(F.col("i").alias("id")).hint("merge"), "id", "left_anti"))
        if todo.isEmpty():
            return done
        metres *= 2


def od_matrix(origins: DataFrame, destinations: DataFrame, *, top: int = 100, max_pairs: int = 2000, flow: str | None = None) -> DataFrame:
    """Lines from each origin to its nearest destinations: (i, j, d, flow); identical places are skipped.

    At most ``max_pairs`` pairs, filled in order of the origin's id and the distance; an ordered limit keeps them without a
    global sort.  ``flow`` is the origin's field, else the distance, rounded to 2 places.
    """
    same = (F.col("lon_i") == F.col("lon_j")) & (F.col("lat_i") == F.col("lat_j"))
    pairs = nearest(origins, destinations, top, skip=same, spare=0)
    if flow:
        pairs = pairs.join(origins.select(F.col("id").alias("i"), F.col(flow).cast("double").alias("f")).hint("merge"), "i")
    return pairs.withColumn("flow", F.round(F.col("f") if flow else F.col("d"), 2)).orderBy("i", "rank").limit(max_pairs).select("i", "j", "rank", "d", "flow")

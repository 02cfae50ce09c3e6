"""Aggregations of layers: by attribute, grid cell and hexagon, and summaries of fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions.geodesy import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON
from tessera.functions.values import kind_of, missing, number_of, text_of
from tessera.operators.partition import spread

SQRT3 = math.sqrt(3)
MAX_HEX_CELLS, TARGET_DIVISIONS, MIN_HEX_METRES = 12_000, 40, 30.0


def feature_summary(df: DataFrame, field: str) -> DataFrame:
    """count, sum, avg, min, max and distinct of the present values; only finite numbers enter sums, blanks count as 0."""
    c, kind = F.col(field), kind_of(df, field)
    x = number_of(c, kind, blank=0.0)
    return df.where(~missing(c)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.countDistinct(text_of(c, kind)).alias("kinds"))


def first_values(df: DataFrame, field: str, order: str, limit: int = 20) -> DataFrame:
    """The first distinct values as text, in source order."""
    c = F.col(field)
    return df.where(~missing(c)).groupBy(text_of(c, kind_of(df, field)).alias("value")).agg(F.min(order).alias("first_at")).orderBy("first_at").limit(limit)


def layer_stats(df: DataFrame, field: str) -> DataFrame:
    numeric = kind_of(df, field) == "number"
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(field).alias("kinds"), F.min(field).alias("least"), F.max(field).alias("most"), (F.avg(field) if numeric else F.lit(None).cast("double")).alias("mean"))


def top_values(df: DataFrame, field: str, k: int = 10) -> DataFrame:
    """The commonest values, null among them; ties go to the smaller value, null first."""
    return df.groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)


def group_metrics(df: DataFrame, by: list[str], *, distinct: list[str] = (), total: list[str] = (), mean: list[str] = (), limit: int = 2000) -> DataFrame:
    """count, distinct_f, sum_f, avg_f for each group, the largest groups first, with the number of all groups."""
    metrics = [F.count(F.lit(1)).alias("count"), *[F.countDistinct(f).alias(f"distinct_{f}") for f in distinct], *[F.sum(f).alias(f"sum_{f}") for f in total], *[F.avg(f).alias(f"avg_{f}") for f in mean]]
    groups = df.groupBy(*by).agg(*metrics)
    return groups.crossJoin(F.broadcast(groups.agg(F.count(F.lit(1)).alias("total_groups")))).orderBy(F.desc("count"), *by).limit(limit)


def bounds_of(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))


def grid_aggregate(df: DataFrame, *, cell: float = 1000.0, lat0: float | None = None, limit: int = 2000, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Counts in cells of ``cell`` metres, densest first: i from the west edge, j from ``lat0`` (by default the middle latitude)."""
    if cell <= 0:
        raise ValueError("a cell needs a size above zero")
    west, south, _, north = bounds_of(df, lon, lat).first()
    if west is None:
        west = south = north = 0.0
    middle = (south + north) / 2 if lat0 is None else lat0
    d_lon, d_lat = cell / (METRES_PER_DEGREE_LON * math.cos(math.radians(middle))), cell / METRES_PER_DEGREE_LAT
    cells = df.groupBy(F.floor((F.col(lon) - west) / d_lon).cast("long").alias("i"), F.floor((F.col(lat) - middle) / d_lat).cast("long").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.desc("n"), "i", "j").limit(limit)


def hex_size(width: float, height: float) -> float:
    """The hexagon spacing in metres for an extent: a fortieth of its short side, more if that makes too many cells."""
    cell = min(width, height) / TARGET_DIVISIONS
    if cell <= 0 or width * height * 1.1547 / cell**2 > MAX_HEX_CELLS:
        cell = math.sqrt(width * height * 1.1547 / MAX_HEX_CELLS)
    return max(MIN_HEX_METRES, cell)


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def hexbin(df: DataFrame, *, cell: float | None = None, density: str | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pointy-top hexagons over the extent and one ring around it, empty ones too: (q, r, count, density)."""
    west, south, east, north = bounds_of(df, lon, lat).first()
    if west is None:
        return df.sparkSession.createDataFrame([], "q long, r long, count long, density double")
    d_lon, d_lat = 1 / (METRES_PER_DEGREE_LON * math.cos(math.radians((south + north) / 2))), 1 / METRES_PER_DEGREE_LAT
    cell = cell or hex_size((east - west) / d_lon, (north - south) / d_lat)
    for attempt in range(2):
        size = cell / SQRT3
        x, y = (F.col(lon) - west) / d_lon, (F.col(lat) - south) / d_lat
        axial = df.select(((SQRT3 / 3 * x - y / 3) / size).alias("qf"), (2 / 3 * y / size).alias("rf"), (F.col(density).cast("double") if density else F.lit(None).cast("double")).alias("d"))
        near = axial.select("*", _half_up(F.col("qf")).alias("a"), _half_up(F.col("rf")).alias("b"), _half_up(-F.col("qf") - F.col("rf")).alias("c"))
        dq, dr, ds = F.abs(F.col("a") - F.col("qf")), F.abs(F.col("b") - F.col("rf")), F.abs(F.col("c") + F.col("qf") + F.col("rf"))
        q_worst = (dq > dr) & (dq > ds)
        binned = near.select(F.when(q_worst, -F.col("b") - F.col("c")).otherwise(F.col("a")).cast("long").alias("q"), F.when(~q_worst & (dr > ds), -F.col("a") - F.col("c")).otherwise(F.col("b")).cast("long").alias("r"), "d")
        q0, q1, r0, r1 = binned.agg(F.min("q"), F.max("q"), F.min("r"), F.max("r")).first()
        n = (q1 - q0 + 3) * (r1 - r0 + 3)
        if n <= MAX_HEX_CELLS or attempt:
            break
        cell = max(MIN_HEX_METRES, cell * math.sqrt(n / MAX_HEX_CELLS))
    full = binned.groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"))
    cells = df.sparkSession.range(q0 - 1, q1 + 2).select(F.col("id").alias("q"), F.explode(F.sequence(F.lit(r0 - 1), F.lit(r1 + 1))).alias("r"))
    count = F.coalesce("n", F.lit(0)).cast("long")
    return cells.join(full, ["q", "r"], "left").select("q", "r", count.alias("count"), (F.round(F.coalesce("d", F.lit(0.0)), 4) if density else count.cast("double")).alias("density"))


def inspect_fields(df: DataFrame, *, id_like: str = r"(?i)(^|_)(id|key|code|fid|oid|gid)$|key$|id$", kinds: bool = True) -> DataFrame:
    """One row per column: valid and missing counts, range, mean, population deviation, distinct values, and why it is unfit.

    One aggregate over all columns, and, unless ``kinds`` is false, one over the different values of each column, in tasks of
    few rows each; ``reason`` is the first that holds of: named like an id, not numeric, fewer than three values, constant, more
    than half missing; null for a fit field.
    """
    df = spread(df)
    parts, values = [], []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), kind_of(df, f.name)
        x = number_of(c, kind) if not isinstance(f.dataType, T.BooleanType) else F.lit(None).cast("double")
        values.append(F.struct(F.lit(f.name).alias("field"), x.alias("x")))
        parts.append(F.struct(F.lit(f.name).alias("field"), F.count(x).alias("valid"), (F.count(F.lit(1)) - F.count(x)).alias("missing"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.lit(kind).alias("kind")).alias(f"c{len(parts)}"))
    rows = df.agg(*parts).select(F.explode(F.array(*[f"c{i}" for i in range(len(parts))])).alias("x")).select("x.*")
    if kinds:
        different = df.select(F.explode(F.array(*values)).alias("v")).select("v.field", "v.x").where("x is not null").distinct()
        count = different.groupBy("field").agg(F.count(F.lit(1)).alias("kinds"))
        rows = rows.join(count.hint("shuffle_hash"), "field", "left").select("field", "valid", "missing", "least", "most", "mean", "deviation", F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds"), "kind")
    reason = F.when(F.col("field").rlike(id_like), "id").when(F.col("kind") != "number", "text").when(F.col("valid") < 3, "few").when(F.col("least") == F.col("most"), "constant").when(F.col("missing") > F.col("valid"), "missing")
    return rows.withColumn("reason", reason)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns; a column that is text in one frame is text."""
    text = {f.name for df in frames for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    frames = [df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if c in text and kind != "string"}) for df in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stratified_sample(df: DataFrame, stratum: str, limit: int, *, seed: int = 42, key: str = "id") -> DataFrame:
    """An equal share of ``limit`` rows from each stratum, by seeded hash of the key."""
    groups = df.select(stratum).distinct().count()
    return df.withColumn("__n", F.row_number().over(W.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key))).where(F.col("__n") <= limit // max(1, groups)).drop("__n")


def systematic_sample(df: DataFrame, limit: int, row: str = "__rid") -> DataFrame:
    """Every so many-th row by its number, so that about ``limit`` remain."""
    n = df.count()
    return df.where(F.col(row) % max(1, -(-n // limit)) == 0)

"""Spatial and distribution statistics over DataFrames: weights are edge lists, ranks are windows, sums are aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.geodesy import EARTH, METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON, erf, haversine, normal_cdf
from tessera.functions.values import kind_of, missing, number_of, text_of
from tessera.operators.aggregates import bounds_of
from tessera.operators.edits import with_row_ids
from tessera.operators.joins import nearest

MAX_GRID_CELLS = 40_000


def great_circle(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def _numbers(df: DataFrame, field: str) -> Column:
    return number_of(F.col(field), kind_of(df, field))


def gini(df: DataFrame, field: str, *, missing_as: str | None = None, key: str = "id") -> DataFrame:
    """(gini, n, skipped), 4 places; missing values must be decided: ``drop`` or ``zero``.

    Ranks come from a range-partitioned sort, not from one window over all rows.
    """
    rows = df.select(F.col(key).alias("__key"), _numbers(df, field).alias("x"))
    lacking = rows.where("x is null").count()
    if lacking and missing_as not in ("drop", "zero"):
        raise ValueError(f"{field} lacks {lacking} values: say whether to drop them or count them as zero")
    rows = rows.fillna(0.0, ["x"]) if missing_as == "zero" else rows.where("x is not null")
    n, least, total = rows.agg(F.count(F.lit(1)), F.min("x"), F.sum("x")).first()
    if n < 3:
        raise ValueError("at least three values are needed")
    if least < 0 or not total > 0:
        raise ValueError("the values must not be negative and not all zero")
    ranked = with_row_ids(rows, ["x", "__key"], "rank", 1)
    g = 2 * F.sum(F.col("rank") * F.col("x")) / (n * F.sum("x")) - (n + 1) / n
    return ranked.agg(F.round(g, 4).alias("gini"), F.count(F.lit(1)).alias("n")).withColumn("skipped", F.lit(lacking if missing_as == "drop" else 0).cast("long"))


def shannon(df: DataFrame, field: str, *, mode: str = "auto", missing_as: str | None = None) -> DataFrame:
    """(h, h_max, evenness, categories, n, mode): the entropy of the shares of categories, or of equal values by their sum.

    ``auto`` takes values if over nine tenths of the present ones are numbers and over 12 of them differ.  Missing
    categories must be decided: ``drop`` or ``category``.
    """
    kind, c = kind_of(df, field), F.col(field)
    x, t = _numbers(df, field), text_of(c, kind)
    present, numeric, kinds, blanks = df.agg(F.count(F.when(~missing(c), 1)), F.count(x), F.countDistinct(x), F.count(F.when(missing(c), 1))).first()
    if mode == "auto":
        # Text that is no number counts as blank here, so the first test asks for any number at all.
        mode = "value" if numeric and kinds > 12 and numeric > 0.9 * (present if kind == "number" else numeric) else "category"
    if mode == "value":
        groups = df.where(x.isNotNull()).groupBy(t.alias("k")).agg(F.sum(x).alias("s"), F.count(F.lit(1)).alias("n"))
        least = df.agg(F.min(x)).first()[0]
        if numeric < 3 or least < 0:
            raise ValueError("three values are needed, none of them negative")
    else:
        if blanks and missing_as not in ("drop", "category"):
            raise ValueError(f"{field} lacks {blanks} values: say whether to drop them or make them a category")
        rows = df if missing_as == "category" else df.where(~missing(c))
        groups = rows.groupBy(F.when(missing(c), F.lit(None)).otherwise(t).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = groups.agg(F.sum("s").alias("all"))
    shares = groups.crossJoin(F.broadcast(whole)).where("s > 0").withColumn("p", F.col("s") / F.col("all"))
    out = shares.agg(F.sum(-F.col("p") * F.ln("p")).alias("h"), F.count(F.lit(1)).alias("categories"), F.sum("n").alias("n"))
    return out.select(F.round("h", 4).alias("h"), F.round(F.ln("categories"), 4).alias("h_max"), F.round(F.when(F.col("categories") > 1, F.col("h") / F.ln("categories")).otherwise(0.0), 4).alias("evenness"), "categories", "n", F.lit(mode).alias("mode"))


def kernel_density(points: DataFrame, *, radius: float = 5000.0, cell: float = 500.0) -> DataFrame:
    """Quartic kernel sums at the centres of a grid over the extent: (c, r, lon, lat, density), 4 places, empty cells 0.

    A point is sent to the cells whose centres its radius can reach, so the work follows the points' reach and not
    points times cells; sums of cells are combined before they are shuffled.
    """
    if radius <= 0 or cell <= 0:
        raise ValueError("radius and cell are above zero")
    west, south, east, north = bounds_of(points).first()
    d_lon, d_lat = cell / (METRES_PER_DEGREE_LON * math.cos(math.radians((south + north) / 2))), cell / METRES_PER_DEGREE_LAT
    cols, rows = max(1, math.ceil((east - west) / d_lon)), max(1, math.ceil((north - south) / d_lat))
    if cols * rows > MAX_GRID_CELLS:
        raise ValueError(f"{cols} x {rows} cells are more than {MAX_GRID_CELLS}: choose a larger cell")
    reach_lat = math.degrees(radius / EARTH) * 1.001
    top = F.least(F.lit(89.999), F.abs("lat") + reach_lat)
    # The widest longitude that a circle around the point spans; near the poles every column.
    ratio = F.sin(F.lit(radius / EARTH)) / F.cos(F.radians(F.abs(F.col("lat"))))
    reach_lon = F.when((ratio >= 1) | (top >= 89.9), 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))) * 1.001)
    # A centre beyond a pole is a place on the other side of it, which the point may reach over the pole: mirrored rows.
    row = lambda lat: (lat - south) / d_lat - 0.5
    low, high = max(0, math.ceil(row(-90.0))), min(rows - 1, math.floor(row(90.0)))
    stripe = lambda m, lo, hi, over: F.struct(F.greatest(F.lit(lo), F.ceil(row(m - reach_lat))).cast("int").alias("lo"), F.least(F.lit(hi), F.floor(row(m + reach_lat))).cast("int").alias("hi"), F.lit(over).alias("over"))
    stripes = [stripe(F.col("lat"), low, high, False), stripe(180 - F.col("lat"), high + 1, rows - 1, True), stripe(-180 - F.col("lat"), 0, low - 1, True)]
    # Around the date line the reach goes on at the other edge.
    spans = F.array(*[F.struct(F.greatest(F.lit(0), F.floor((F.col("lon") + w - reach_lon - west) / d_lon - 0.5)).cast("int").alias("lo"), F.least(F.lit(cols - 1), F.ceil((F.col("lon") + w + reach_lon - west) / d_lon)).cast("int").alias("hi")) for w in (-360, 0, 360)])
    spans = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.when(s["lo"] <= s["hi"], F.sequence(s["lo"], s["hi"])).otherwise(F.array().cast("array<int>")))))
    every = F.sequence(F.lit(0), F.lit(cols - 1))
    near = points.select("lon", "lat", spans.alias("cs"), F.explode(F.array(*stripes)).alias("s")).where("s.lo <= s.hi")
    near = near.select("lon", "lat", F.explode(F.sequence("s.lo", "s.hi")).alias("r"), F.when(F.col("s.over"), every).otherwise(F.col("cs")).alias("cs")).select("lon", "lat", "r", F.explode("cs").alias("c"))
    lon, lat = west + (F.col("c") + 0.5) * d_lon, south + (F.col("r") + 0.5) * d_lat
    u = haversine(lon, lat, F.col("lon"), F.col("lat")) / radius
    sums = near.withColumn("u", u).where("u < 1").groupBy("c", "r").agg(F.sum(3 / math.pi * F.pow(1 - F.col("u") * F.col("u"), 2)).alias("s"))
    grid = points.sparkSession.range(cols * rows).select((F.col("id") % cols).cast("int").alias("c"), F.floor(F.col("id") / cols).cast("int").alias("r"))
    return grid.join(sums, ["c", "r"], "left").select("c", "r", lon.alias("lon"), lat.alias("lat"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("density"))


def average_nearest_neighbor(points: DataFrame) -> DataFrame:
    """(observed, expected, ratio, n, area): the mean distance to the nearest other point against that of a random pattern
    in the extent's great-circle width times height."""
    west, south, east, north = bounds_of(points).first()
    area = great_circle(west, (south + north) / 2, east, (south + north) / 2) * great_circle((west + east) / 2, south, (west + east) / 2, north)
    found = nearest(points, points, 1, skip=F.col("i") == F.col("j"), spare=1)
    expected = 0.5 * F.sqrt(area / F.count(F.lit(1)))
    return found.agg(F.avg("d").alias("observed"), expected.alias("expected"), (F.avg("d") / expected).alias("ratio"), F.count(F.lit(1)).alias("n"), F.lit(area).alias("area"))


def _standardised(df: DataFrame, field: str, key: str) -> tuple[DataFrame, int, float, float]:
    rows = df.select(F.col(key).alias("id"), _numbers(df, field).alias("x"))
    n, lacking, mean = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("x").isNull(), 1)), F.avg("x")).first()
    if lacking:
        raise ValueError(f"{field} lacks {lacking} values: every feature needs one")
    s2 = rows.agg(F.sum(F.pow(F.col("x") - mean, 2))).first()[0]
    if not s2:
        raise ValueError(f"{field} is constant")
    return rows.withColumn("z", F.col("x") - mean), n, mean, s2


def _lags(rows: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """Sums of the neighbours' values and the number of neighbours, for rows with neighbours.

    Told to merge, as file sizes would have Spark broadcast a layer of millions of rows.
    """
    return edges.join(rows.select(F.col("id").alias("j"), F.col(value).alias("v")).hint("merge"), "j").groupBy("i").agg(F.sum("v").alias("lag"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("i", "id")


def moran_i(df: DataFrame, field: str, edges: DataFrame, *, key: str = "id", textbook: bool = False) -> DataFrame:
    """(i, expected, variance, z, p, n, pairs) of global Moran's I over symmetric binary ``edges``.

    The variance takes S1 as S0 unless ``textbook`` asks for 2 S0, its value for such weights.  The p value is that of
    the normal distribution, both sides; ``permutation.moran_p`` has the other.
    """
    rows, n, _, s2 = _standardised(df, field, key)
    lagged = rows.join(_lags(rows, edges, "z").hint("merge"), "id")
    s0, cross, s22 = (F.sum("degree").cast("double"), F.sum(F.col("z") * F.col("lag")), F.sum(F.pow(2.0 * F.col("degree"), 2)))
    sums = lagged.agg(s0.alias("s0"), cross.alias("cross"), s22.alias("s22"))
    e = -1 / (n - 1)
    i = n / F.col("s0") * F.col("cross") / s2
    s1 = F.col("s0") * (2 if textbook else 1)
    variance = (n * n * s1 - n * F.col("s22") + 3 * F.col("s0") * F.col("s0")) / ((n * n - 1) * F.col("s0") * F.col("s0")) - e * e
    out = sums.select(i.alias("i"), F.lit(e).alias("expected"), variance.alias("variance"), (F.col("s0") / 2).cast("long").alias("pairs"))
    z = F.when(F.col("variance") > 0, (F.col("i") - F.col("expected")) / F.sqrt("variance")).otherwise(0.0)
    return out.withColumn("z", z).withColumn("p", 1 - erf(F.abs("z") / math.sqrt(2))).withColumn("n", F.lit(n).cast("long"))


def benjamini_hochberg(df: DataFrame, p: str, *, key: str, alias: str = "q") -> DataFrame:
    """``df`` with the false-discovery-rate value of each p: the least of p n / rank over this and all larger ranks.

    The running minimum goes over ranges of ranks: within each by a window, and from the ranges above by the least of each.
    """
    ranked = with_row_ids(df, [p, key], "__rank", 1)
    n = ranked.count()
    ranked = ranked.withColumn("__v", F.col(p) * n / F.col("__rank")).withColumn("__range", F.floor((F.col("__rank") - 1) / 100_000))
    above = ranked.groupBy("__range").agg(F.min("__v").alias("__least"))
    above = above.select("__range", F.min("__least").over(W.orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)).alias("__above"))
    within = F.min("__v").over(W.partitionBy("__range").orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("__own", within).join(F.broadcast(above), "__range").withColumn(alias, F.least(F.lit(1.0), "__own", F.coalesce("__above", F.lit(1.0)))).drop("__rank", "__v", "__range", "__own", "__above")


def getis_ord(df: DataFrame, field: str, edges: DataFrame, *, key: str = "id", alpha: float = 0.05) -> DataFrame:
    """(id, gi_z, gi_p, gi_q, gi_class): Gi* with each feature its own neighbour, 4 places, hot or cold where q < alpha."""
    rows, n, mean, s2 = _standardised(df, field, key)
    if n < 4:
        raise ValueError("at least four features are needed")
    s = math.sqrt(s2 / n)
    lagged = rows.join(_lags(rows, edges, "x").hint("merge"), "id", "left")
    w = F.coalesce("degree", F.lit(0)) + 1
    wx = F.coalesce("lag", F.lit(0.0)) + F.col("x")
    spread = s * F.sqrt(F.greatest(F.lit(0.0), (n * w - w * w) / (n - 1)))
    z = F.when(spread > 0, (wx - mean * w) / spread).otherwise(0.0)
    scored = lagged.select("id", z.alias("z")).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))
    out = benjamini_hochberg(scored, "p", key="id")
    label = F.when(F.col("q") < alpha, F.when(F.col("z") > 0, "hot").otherwise("cold")).otherwise("ns")
    return out.select("id", F.round("z", 4).alias("gi_z"), F.round("p", 4).alias("gi_p"), F.round("q", 4).alias("gi_q"), label.alias("gi_class"))


def local_moran(df: DataFrame, field: str, edges: DataFrame, *, key: str = "id") -> DataFrame:
    """(id, x, z, lag, degree, lisa_i): the parts of local Moran's I that need no permutation."""
    rows, n, _, s2 = _standardised(df, field, key)
    out = rows.join(_lags(rows, edges, "z").hint("merge"), "id", "left").fillna(0, ["lag", "degree"])
    return out.withColumn("lisa_i", F.col("z") / (s2 / n) * F.col("lag"))


def kernel_parameters(span: float, width: float, height: float) -> tuple[float, float]:
    """A radius and a cell size in metres for an extent: the cell grows until the grid has at most the allowed cells."""
    radius = min(20_000.0, max(50.0, span / 15))
    cell = min(5_000.0, max(20.0, radius / 5))
    while math.ceil(width / cell) * math.ceil(height / cell) > MAX_GRID_CELLS:
        cell *= 1.02
    return radius, cell

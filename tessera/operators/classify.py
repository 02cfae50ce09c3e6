"""Thematic classes: breaks, class numbers, categories and colours."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import kind_of, missing, number_of, text_of
from tessera.operators.edits import with_row_ids

MAX_CATEGORIES, ASK_CATEGORIES, JENKS_SAMPLE = 500, 50, 2000


def _present(df: DataFrame, field: str) -> DataFrame:
    return df.select(number_of(F.col(field), kind_of(df, field)).alias("x")).where("x is not null")


def clamp(k: int) -> int:
    return max(2, min(12, k))


def equal_breaks(df: DataFrame, field: str, k: int = 5) -> DataFrame:
    """(class, upto): upper edges at equal steps."""
    k = clamp(k)
    edges = _present(df, field).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return edges.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("class")).where("a is not null").select("class", (F.col("a") + (F.col("b") - F.col("a")) / k * F.col("class")).alias("upto"))


def quantile_breaks(df: DataFrame, field: str, k: int = 5) -> DataFrame:
    """(class, upto): the values at the ranks ceil(i n / k), equal ones once."""
    k = clamp(k)
    rows = _present(df, field)
    n = rows.count()
    ranks = sorted({math.ceil(i * n / k) for i in range(1, k + 1)}) if n else []
    picked = with_row_ids(rows, ["x"], "rank", 1).where(F.col("rank").isin(ranks)).select("x").distinct()
    return picked.groupBy().agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.posexplode("xs").alias("class", "upto")).select((F.col("class") + 1).alias("class"), "upto")


def jenks_breaks(df: DataFrame, field: str, k: int = 5) -> list[float]:
    """Upper edges of Fisher's natural breaks, exact on at most 2000 values at equal distances in rank."""
    k = clamp(k)
    rows = _present(df, field)
    n = rows.count()
    if not n:
        return []
    step = max(1.0, n / JENKS_SAMPLE)
    ranked = with_row_ids(rows, ["x"], "rank")
    picked = ranked.where(F.floor(F.col("rank") / step) != F.floor((F.col("rank") - 1) / step))
    return natural_breaks(np.sort(np.array([r[0] for r in picked.select("x").limit(JENKS_SAMPLE + 1).collect()])), k)


def natural_breaks(x: np.ndarray, k: int) -> list[float]:
    """Upper edges of the ``k`` classes of sorted values with the least sum of squared deviations, by dynamic programming."""
    n, k = len(x), min(k, len(np.unique(x)))
    s1, s2 = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))
    cost = s2[1:] - s1[1:] ** 2 / np.arange(1, n + 1)
    back = np.zeros((k, n), np.int64)
    for c in range(1, k):
        best = np.full(n, np.inf)
        for j in range(c, n):
            i = np.arange(c, j + 1)
            total = cost[i - 1] + s2[j + 1] - s2[i] - (s1[j + 1] - s1[i]) ** 2 / (j + 1 - i)
            at = int(total.argmin())
            best[j], back[c, j] = total[at], i[at]
        cost = best
    out, j = [], n - 1
    for c in range(k - 1, -1, -1):
        out.append(float(x[j]))
        j = int(back[c, j]) - 1
    return out[::-1]


def class_of(x: Column, breaks: list[float]) -> Column:
    """The first class from 1 whose upper edge is not below x; above all, the last; missing values have none."""
    if any(a >= b for a, b in zip(breaks, breaks[1:], strict=False)):
        raise ValueError("breaks ascend")
    out = F.lit(len(breaks))
    for i in range(len(breaks) - 1, -1, -1):
        out = F.when(x <= breaks[i], i + 1).otherwise(out)
    return F.when(x.isNotNull(), out)


def class_counts(df: DataFrame, field: str, breaks: list[float]) -> DataFrame:
    x = number_of(F.col(field), kind_of(df, field))
    return df.groupBy(class_of(x, breaks).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def categories(df: DataFrame, field: str, *, confirmed: bool = False) -> DataFrame:
    """(category, n) with the commonest first, missing as null; many categories must be confirmed, too many are refused."""
    c = F.col(field)
    out = df.groupBy(F.when(~missing(c), text_of(c, kind_of(df, field))).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    n = out.limit(MAX_CATEGORIES + 1).count()
    if n > MAX_CATEGORIES or n > ASK_CATEGORIES and not confirmed:
        raise ValueError(f"{field} has {'over ' if n > MAX_CATEGORIES else ''}{min(n, MAX_CATEGORIES)} categories")
    return out.orderBy(F.desc("n"), "category")


def spread_colour(i: int) -> str:
    """The i-th of any number of distinct colours: hues a golden angle apart."""
    return f"hsl({round(i * 137.508 % 360)}, 65%, 50%)"


def ramp(low: tuple[int, int, int], high: tuple[int, int, int], k: int) -> list[str]:
    """``k`` colours from one to another."""
    return ["#" + "".join(f"{round(a + (b - a) * i / max(1, k - 1)):02x}" for a, b in zip(low, high, strict=True)) for i in range(k)]

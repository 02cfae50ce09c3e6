"""Pairs of overlapping bounds against brute force, and how rows are spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, partition


def boxes(rng, n, spread, size):
    p = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(spread, 0.01, (n - n // 2, 2))])
    return np.concatenate([p, p + rng.random((n, 2)) * size], axis=1)


def plain(a, b):
    hit = (a[:, None, 0] <= b[None, :, 2]) & (a[:, None, 2] >= b[None, :, 0]) & (a[:, None, 1] <= b[None, :, 3]) & (a[:, None, 3] >= b[None, :, 1])
    return sorted(map(tuple, np.argwhere(hit).tolist()))


def frame(spark, m):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "k long, xmin double, ymin double, xmax double, ymax double")


@pytest.mark.parametrize("case", ["clustered", "touching", "equal", "nested"])
def test_pairs_are_those_of_brute_force(spark, case):
    rng = np.random.default_rng(4)
    if case == "clustered":
        a, b = boxes(rng, 500, 5, 0), boxes(rng, 300, 5, 0.05)
    elif case == "touching":
        g = np.stack(np.meshgrid(np.arange(15), np.arange(15)), -1).reshape(-1, 2).astype(float)
        a = b = np.concatenate([g, g + 1], axis=1)
    elif case == "equal":
        a, b = np.tile([[1.0, 1.0, 1.0, 1.0]], (200, 1)), np.tile([[0.0, 0.0, 2.0, 2.0]], (150, 1))
    else:
        s = np.linspace(0.1, 50, 120)[:, None]
        a, b = np.concatenate([-s, -s, s, s], axis=1), boxes(rng, 200, 20, 0.5)
    want = plain(a, b)
    assert sorted(zip(*(x.tolist() for x in partition.local_pairs(a, b, dense=50)), strict=True)) == want
    for leaf_rows, sample, small in ((40, 100, 0), (16_384, 1000, 0), (10, 30, 0), (10, 10, 1000)):
        got = partition.overlapping(frame(spark, a), frame(spark, b), leaf_rows=leaf_rows, sample=sample, small=small)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want, (leaf_rows, sample, small)


def test_no_rows_and_null_bounds(spark):
    one, none = frame(spark, np.array([[0.0, 0, 1, 1]])), frame(spark, np.zeros((0, 4)))
    gap = one.withColumn("xmax", F.lit(None).cast("double"))
    for small in (0, 10):
        for a, b in ((one, none), (none, one), (none, none), (one, gap), (gap, one)):
            assert partition.overlapping(a, b, small=small).collect() == []
        assert partition.overlapping(one, one.unionAll(one), small=small).count() == 2


def test_a_dense_town_is_dealt_evenly():
    """Half of all points lie in a ten-thousandth of the extent: no leaf has over four times the median's rows."""
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.random((200_000, 2)) * 100, 50 + rng.normal(0, 0.01, (200_000, 2))])
    parcels = points[rng.choice(len(points), 40_000)]
    rows = np.concatenate([np.concatenate([points, points], axis=1), np.concatenate([parcels, parcels + 0.002], axis=1)])
    table = partition.SplitTable(rows[rng.choice(len(rows), 20_000), :2], len(rows), 4096)
    _, leaf = table.deal(rows)
    n = np.bincount(leaf, minlength=len(table.lower))
    assert len(n) > 100 and n.max() <= 4 * np.median(n) and n.sum() < 1.1 * len(rows)


def test_equal_points_under_equal_boxes_share_out_their_tasks(spark):
    points = spark.range(3000).select(F.col("id").alias("k"), *[F.lit(1.0).alias(c) for c in partition.BOUNDS])
    got = partition.overlapping(points, points.where("k < 300"), leaf_rows=100, sample=50, small=0)
    per = got.withColumn("task", F.spark_partition_id()).groupBy("i").count()
    assert got.count() == 900_000 and per.where("count = 300").count() == 3000


def test_points_meet_their_own_parcels_only(spark):
    """The pairs that are looked at are those whose bounds overlap, whatever the level of detail of the parcels."""
    n = 40
    cell = spark.range(n * n).select("id", (F.col("id") % n * 0.01).alias("x"), (F.floor(F.col("id") / n) * 0.01).alias("y"))
    spots = cell.select(F.col("id").alias("k"), *[(F.col(c[0]) + 0.005).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    parcels = cell.select(F.col("id").alias("k"), F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 0.0099).alias("xmax"), (F.col("y") + 0.0099).alias("ymax"))
    assert joins.candidates(spots, parcels).where("l.k = r.k").count() == joins.candidates(spots, parcels).count() == n * n

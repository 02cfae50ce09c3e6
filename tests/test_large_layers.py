"""Layers that a file gives to one task: they are spread, and shapes are made and simplified batch by batch."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import construct, partition
from tessera.plans.queries import QUERIES


def one_file(spark, path, rows):
    spark.range(rows).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.when(F.col("id") % 7 > 0, (F.col("id") % 999) / 4).alias("c_acctbal"), F.lit("A").alias("c_mktsegment")).coalesce(1).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_one_row_group_is_many_tasks(spark, tmp_path):
    """the work on each shape is not left to the task that reads the file."""
    sf = one_file(spark, tmp_path, 80_000)
    for name in ("simplify", "buffer_points", "smooth"):
        out = QUERIES[name](spark, sf)
        assert out.rdd.getNumPartitions() >= 3 and out.count() == 80_000, name
    dealt = partition.spread(spark.range(10_000).withColumn("x", F.lit(1)).coalesce(1), 1000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 10 and max(sizes) < 1300


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12)), max_size=6))
def test_lines_simplified_together_equal_each_alone(lines):
    closed = np.array([c for c, _ in lines], bool)
    arrays = [np.array(p + p[:1] if c and p else p, float).reshape(-1, 2) for c, p in lines]
    keep = kernels.simplify_all(np.concatenate([np.zeros((0, 2)), *arrays]), np.array([len(a) for a in arrays], np.int64), closed, 0.9)
    at = 0
    for c, a in zip(closed, arrays, strict=True):
        want = a if not len(a) else kernels.simplify_ring(a, 0.9) if c else kernels.simplify(a, 0.9)
        got = a[keep[at : at + len(a)]]
        at += len(a)
        assert got.tolist() == want.tolist()


def test_kinds_and_nulls_pass(spark):
    square = [(0.0, 0.0), (2.0, -0.01), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    shape = lambda kind, *rings: {"kind": kind, "parts": [{"part": p, "ring": r, "pts": [{"x": x, "y": y} for x, y in pts]} for p, r, pts in rings]}
    rows = [(1, None), (2, shape("Polygon", (0, 0, square), (0, 1, square))), (3, shape("LineString", (0, 0, square[:3]))), (4, shape("MultiPoint", (0, 0, square[:1]), (1, 0, square[1:2]))), (5, shape("Polygon"))]
    df = spark.createDataFrame(rows, f"id int, geom {construct.GEOM}").coalesce(1)
    got = {r["id"]: r["geom"] for r in construct.simplify(df, 0.1).collect()}
    assert got[1] is None and got[5]["parts"] == []
    assert [len(p["pts"]) for p in got[2]["parts"]] == [5, 5] and [(p["part"], p["ring"]) for p in got[2]["parts"]] == [(0, 0), (0, 1)]
    assert [(p["x"], p["y"]) for p in got[3]["parts"][0]["pts"]] == [(0, 0), (4, 0)] and len(got[4]["parts"]) == 2
    away = {r["id"]: (r["vertices"], r["nearest"]) for r in construct.reach(df.withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)})).collect()}
    assert away[1] == (0, None) and away[5] == (0, None) and away[2] == (12, 0.0) and away[4] == (2, 0.0)
    circles = construct.buffer_points(spark.createDataFrame([(1, None, 2.0), (2, 3.0, 90.0)], "id int, lon double, lat double"), 1.0).collect()
    assert [len(r["geom"]["parts"][0]["pts"]) for r in circles] == [65, 65] and circles[0]["geom"]["parts"][0]["pts"][0]["x"] is None


def test_inspected_fields_leave_no_task_all_values(spark, tmp_path):
    """no aggregate of one task holds the different values of all rows; the figures are those of one aggregate."""
    from tessera.operators.aggregates import inspect_fields

    one_file(spark, tmp_path, 80_000)
    df = spark.read.parquet(f"{tmp_path}/customer.parquet").withColumns({"b": F.lit(True), "t": F.when(F.col("c_custkey") % 3 == 0, " 7 ").otherwise("x"), "z": F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(-0.0)})
    out = inspect_fields(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "REPARTITION_BY_NUM" in plan
    got = {r["field"]: r for r in out.collect()}
    for c in ("c_custkey", "c_nationkey", "c_acctbal", "z"):
        want = df.agg(F.count(c), F.count(F.lit(1)) - F.count(c), F.min(c), F.max(c), F.avg(c), F.stddev_pop(c), F.countDistinct(c)).first()
        assert all(abs(a - b) < 1e-6 for a, b in zip(got[c][1:8], want, strict=True)), c
    assert (got["t"].valid, got["t"].kinds, got["b"].valid, got["b"].kinds, got["c_name"].kinds, got["z"].reason) == (26_667, 1, 0, 0, 0, "constant")
    assert [r["reason"] for r in inspect_fields(df.limit(0)).collect()][0] == "id"

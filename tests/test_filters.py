"""The twelve attribute tests over awkward values, against a plain Python reading of their rules."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import shapes
from tessera.operators import filters

NUMERAL = re.compile(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
TEXTS = [None, "", "0", "00", "012", " 12 ", "12", "null", "1e5", "Infinity", "NaN", "12%", "_x", "12d", "abc", "ABC", "a,b", "-3.5", "天河"]
VALUES = [None, "", "0", "12", "012", "1e5", "100000", "abc", "%", "_", "12%", "null", "天", "0,12", "a", "-3.5", "Infinity"]
OPS = ["eq", "neq", "gt", "gte", "lt", "lte", "contains", "starts_with", "ends_with", "in", "is_null", "not_null"]


def number(v):
    return float(v) if v is not None and NUMERAL.match(v) else None


def expected(text, op, value):
    absent = text is None or text == ""
    if op == "is_null":
        return absent
    if op == "not_null":
        return not absent
    x = number(text)
    if op == "in":
        found = False
        for one in (s.strip() for s in value.split(",")) if value else ():
            n = 0.0 if one == "" else number(one)
            found |= text == one or (one == "null" and text is None) or (n is not None and (x == n or n == 0 and absent))
        return found
    if absent:
        return False
    v = number(value) if value else None
    if x is not None and v is not None and op in ("eq", "neq", "gt", "gte", "lt", "lte"):
        return {"eq": x == v, "neq": x != v, "gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]
    if op in ("eq", "neq"):
        return (text == (value or "")) == (op == "eq")
    if op in ("contains", "starts_with", "ends_with") and value is not None:
        return {"contains": value in text, "starts_with": text.startswith(value), "ends_with": text.endswith(value)}[op]
    return False


@pytest.mark.parametrize("op", OPS)
def test_predicate_matrix(spark, op):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string")
    tests = [filters.predicate(df, "s", op, v).alias(f"t{k}") for k, v in enumerate(VALUES)]
    for r in df.select("i", "s", *tests).collect():
        for k, v in enumerate(VALUES):
            assert r[f"t{k}"] is expected(r["s"], op, v), (r["s"], op, v)


def test_numeric_columns_render_whole_numbers_without_fraction(spark):
    df = spark.createDataFrame([(12.0,), (0.5,), (None,), (1e7,)], "n double")
    assert df.where(filters.predicate(df, "n", "contains", "0")).count() == 2  # 0.5 and 10000000
    assert df.where(filters.predicate(df, "n", "ends_with", "2")).count() == 1
    assert df.where(filters.predicate(df, "n", "in", "12, 0")).count() == 2  # 0 stands for missing


def test_points_of_interest(spark):
    """200 points on a diagonal: the fence holds 118, the box 100."""
    df = spark.range(1, 201).select("id", (113 + (F.col("id") % 100) / 100).alias("lon"), (23 + (F.col("id") % 100) / 100).alias("lat"))
    fence = shapes.box(113.205, 23.205, 113.795, 23.795)
    assert df.where(filters.in_fence(fence, boundary=True)).count() == 118
    assert df.where(filters.in_box(113.5, 23.5, 114, 24)).count() == 100


def test_fence_boundary(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (11.0, 5.0)], "lon double, lat double")
    fence = shapes.box(0, 0, 10, 10)
    assert df.where(filters.in_fence(fence, boundary=True)).count() == 3
    assert df.where(filters.in_fence(fence, boundary=False)).count() == 1


def test_counts_come_with_the_pass(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id")).alias("v"))
    hit = filters.counted(df, F.col("v") < 300, limit=100)
    assert hit.df.columns == ["id", "v"] and hit.df.count() == 270
    assert hit.report() == {"sourceCount": 1000, "resultCount": 270, "displayedCount": 100, "scope": "sample_display"}
    plan = hit.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
    assert filters.counted(df, F.col("v") < 300).report(count_only=True) == {"sourceCount": 1000, "resultCount": 270, "displayedCount": 0, "scope": "full_table"}
    many = filters.counted(spark.range(300_000), F.col("id") >= 0)
    many.df.count()
    assert many.report() == {"sourceCount": 300_000, "resultCount": 300_000, "displayedCount": 0, "scope": "full_table"}
    some = filters.counted(spark.range(300_000), F.col("id") < 60_000)
    some.df.count()
    assert some.report()["displayedCount"] == filters.SHOWN_ROWS and some.report()["scope"] == "sample_display"


def test_row_at_a_place(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.000004, 20.0), (3, 10.0, 20.0), (4, None, 20.0), (5, 10.5, 20.0)], "id int, lon double, lat double")
    at = lambda x, y: [r.id for r in filters.row_at(df, x, y, order="id").collect()]
    assert at(10.0, 20.0) == [1] and at(10.000003, 20.0) == [2] and at(10.00002, 20.0) == [] and at(10.5, 20.000011) == [] and at(10.5, 20.000009) == [5]


def test_uniform_sample(spark):
    df = spark.range(400).repartition(7)
    assert filters.uniform_sample(df, 50, seed=1).count() == 50 and filters.uniform_sample(df, 1000).count() == 400 and filters.uniform_sample(df, 0).count() == 0
    times = df.limit(0)
    for seed in range(40):
        times = times.unionAll(filters.uniform_sample(df, 100, seed=seed))
    n = [r["count"] for r in times.groupBy((F.col("id") / 100).cast("int").alias("q")).count().collect()]
    assert len(n) == 4 and sum(n) == 4000 and all(850 < x < 1150 for x in n)

"""Row numbers are dense, unique and in order, whatever columns are kept and however many partitions there are."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.edits import with_row_ids


@pytest.mark.parametrize("partitions", [1, 4, 8, 211])
def test_row_ids_keep_all_columns(spark, sf, partitions):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = with_row_ids(orders.repartition(5), ["o_totalprice", "o_orderkey"], "rid", 7).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got["rid"]) == list(range(7, 7 + orders.count())) and set(orders.columns) <= set(got.columns)
    assert got.sort_values("rid")["o_orderkey"].tolist() == got.sort_values(["o_totalprice", "o_orderkey"])["o_orderkey"].tolist()


def test_row_ids_over_sums_that_are_not_exact(spark, sf):
    """Orders of rows that come from floating-point sums, as false-discovery ranks do."""
    sums = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("x"))
    got = [r["rid"] for r in with_row_ids(sums, ["x", "l_orderkey"], "rid").collect()]
    assert sorted(got) == list(range(len(got)))


def test_row_ids_of_nothing(spark):
    assert with_row_ids(spark.createDataFrame([], "x int"), ["x"]).count() == 0

"""Row numbers and field edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.storage import written

ROW = "__rid"


def with_row_ids(df: DataFrame, order: list[str], name: str = ROW, start: int = 0) -> DataFrame:
    """Dense numbers in the order of ``order`` without one task seeing all rows.

    Rows are range-partitioned and sorted once and written with their place in their partition, so that counts and rows
    speak of the same partitions.  A row's number is its place after the count of all partitions before its own; of the
    counts only one number per partition is handled together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = written(spread.select(*df.columns, F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__place")))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    numbered = placed.join(F.broadcast(before), "__part").withColumn("__number", (F.col("__before") + F.col("__place") + start).cast("long"))
    return numbered.select(*[c for c in df.columns if c != name], F.col("__number").alias(name))


def set_field(df: DataFrame, field: str, value, where: Column | None = None) -> DataFrame:
    """A constant in the rows that ``where`` lets through, in all without it; other rows keep theirs."""
    new = F.lit(value)
    if where is None:
        return df.withColumn(field, new)
    return df.withColumn(field, F.when(where, new).otherwise(F.col(field) if field in df.columns else F.lit(None)))


def add_field(df: DataFrame, field: str, kind: str = "string") -> DataFrame:
    """A null column, unless there is one of that name."""
    return df if field in df.columns else df.withColumn(field, F.lit(None).cast(kind))


def number_field(df: DataFrame, order: list[str], field: str = "seq", start: int = 0) -> DataFrame:
    return with_row_ids(df, order, field, start)

"""Grid and attribute aggregates over event streams: an extension of the batch operators by event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, by: list[str], *, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """count, and sum and mean of ``value``, per window and group; rows later than the watermark are dropped by a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    metrics = [F.count(F.lit(1)).alias("count")] + ([F.sum(value).alias("sum"), F.avg(value).alias("avg")] if value else [])
    out = rows.groupBy(F.window(time, width).alias("w"), *by).agg(*metrics)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *[c for c in out.columns if c not in ("w", *by)])


def windowed_grid(events: DataFrame, lon: Column, lat: Column, *, step: float, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and cell of ``step`` degrees; the cells need no extent, which a stream does not have."""
    cells = events.withColumn("i", F.floor(lon / step).cast("long")).withColumn("j", F.floor(lat / step).cast("long"))
    return windowed_metrics(cells, ["i", "j"], time=time, width=width, late=late)

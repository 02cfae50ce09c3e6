"""Points on slanting edges, reports of large results and whole views, where larger tables showed differences."""

from pyspark.sql import functions as F

from tessera.functions import shapes, view
from tessera.operators import filters
from tessera.plans.queries import DIAMOND


def test_points_on_slanting_edges(spark):
    """Hundredths of a degree all over the diamond's edges: in, on and out as its line equation says in doubles."""
    side = spark.range(6001).select(F.col("id").cast("double").alias("a"))
    up = ((F.lit(240_000) - 40 * F.col("a")) / 60).cast("long")
    spots = side.select(F.explode(F.array(F.lit(-1), F.lit(1))).alias("s"), "a", F.explode(F.array(up - 1, up, up + 1)).alias("b")).select("s", "a", "b", F.explode(F.array(F.lit(-1), F.lit(1))).alias("t"))
    spots = spots.select((F.col("s") * F.col("a") / 100).alias("x"), (F.col("t") * F.col("b") / 100).alias("y")).select(((F.col("x") + 180) - 180).alias("lon"), ((F.col("y") + 90) - 90).alias("lat"))
    fence, reach = shapes.geometry("Polygon", shapes.points(*DIAMOND)), F.abs("lon") * 40 + F.abs("lat") * 60
    for boundary, want in ((True, reach <= 2400), (False, reach < 2400)):
        assert spots.where(filters.in_fence(fence, boundary=boundary) != want).count() == 0
    assert spots.where(reach == 2400).count() > 1000


def test_whole_report_shows_all_rows(spark):
    hit = filters.counted(spark.range(300_000), F.col("id") >= 0)
    hit.df.count()
    assert hit.report(whole=True) == {"sourceCount": 300_000, "resultCount": 300_000, "displayedCount": 300_000, "scope": "filtered"}


def test_whole_view(spark):
    rows = spark.range(60_000).select("id", F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat"))
    assert view.viewport_rows(rows, (0, 0, 2, 2), 12, key="id", thin=False).count() == 60_000
    assert view.viewport_rows(rows, (0, 0, 2, 2), 12, key="id").count() == 50_000

"""Point joins: no side goes through the driver by the size of its file, and full places do not multiply the work."""

from pyspark.sql import functions as F

from tessera.operators import joins, weights


def test_no_side_is_broadcast_by_its_file_size(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.range(20_000).select("id", (F.col("id") % 360 - 180.0).alias("lon"), (F.col("id") % 170 - 85.0).alias("lat")).write.parquet(path)
    points = spark.read.parquet(path)
    for edges in (joins.within(points, points, 1000.0), weights.distance_weights(points, 1000.0)):
        assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_full_places(spark):
    """Forty points at each of a few places: the nearest are those with the smallest ids there, as in a plain loop."""
    spots = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.5), (179.5, 0.0)]
    rows = [(i, *spots[i * 7 % 4 if i < 120 else i % 3]) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    import math

    def away(p, q):
        h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for k, skip, spare, drop in ((3, F.col("i") == F.col("j"), 1, lambda p, q: p[0] == q[0]), (5, (F.col("lon_i") == F.col("lon_j")) & (F.col("lat_i") == F.col("lat_j")), 0, lambda p, q: p[1:] == q[1:])):
        got = {(r.i, r.rank): r.j for r in joins.nearest(df, df, k, skip=skip, spare=spare).collect()}
        for p in rows:
            want = sorted((round(away(p, q), 12), q[0]) for q in rows if not drop(p, q))[:k]
            assert [got[p[0], n + 1] for n in range(k)] == [j for _, j in want]


def _away(p, q):
    import math

    h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def test_copies_of_a_place_are_paired_after_the_join(spark):
    """The join compares points with places, not with each copy there: it puts out far fewer rows than there are pairs."""
    df = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(600)], "id long, lon double, lat double")
    edges = weights.distance_weights(df, 120_000.0)
    assert len(edges.collect()) == 4 * 200 * 200
    todo, rows = [edges._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "SortMergeJoin":
            rows.append(node.metrics().apply("numOutputRows").value())
        else:
            inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan"}.get(node.nodeName())
            todo += [getattr(node, inner)()] if inner else [node.children().apply(n) for n in range(node.children().size())]
    assert rows and max(rows) <= 4 * 200 * 200 / 50


def test_pairs_within_equal_a_plain_loop(spark, monkeypatch):
    """Copies over several rows, cells over several blocks, poles, the date line, opposite places, and equal ids."""
    import random

    monkeypatch.setattr(joins, "PLACE_IDS", 2)
    monkeypatch.setattr(joins, "BLOCK_IDS", 5)
    draw = random.Random(3)
    spots = [(0.0, 0.0), (-0.0, 0.0), (0.0, 1e-7), (180.0, 0.0), (-180.0, 0.0), (179.5, 0.2), (-179.6, 0.0), (12.0, 90.0), (70.0, 90.0), (70.0, 89.0), (-100.0, -89.5), (80.0, -89.0), (1.0, 1.0)]
    spots += [(draw.uniform(-3, 3), draw.uniform(-3, 3)) for _ in range(12)]
    rows = [(i if i < 90 else i - 5, *spots[i * 7 % len(spots)]) for i in range(100)]
    odd = [(200, None, 0.0), (201, 0.0, None), (202, float("nan"), 0.0), (203, 0.0, float("inf")), (None, 0.5, 0.5)]
    df = spark.createDataFrame(rows + odd, "id long, lon double, lat double")
    edge = _away((0, 0.0, 0.0), (0, 1.0, 1.0))
    for metres in (-1.0, 0.0, 0.5, edge, 250_000.0, 3e6, 30e6):
        want = sorted((p[0], q[0]) for p in rows for q in rows if p[0] != q[0] and 0 < _away(p, q) <= metres)
        assert sorted(map(tuple, weights.distance_weights(df, metres).collect())) == want, metres

import pytest
from pyspark.sql import functions as F

from tessera.functions import view


def test_tiers_and_boxes():
    assert [view.sample_size(z, 10**6) for z in (3, 14, 15, 16, 17)] == [50_000, 50_000, 200_000, 600_000, 10**6]
    assert view.sample_size(3, 10) == 10 and view.next_sample_size(50_000, 10**6) == 200_000 and view.next_sample_size(10, 10) is None
    assert view.padded((0, 0, 10, 20)) == (-2.5, -5, 12.5, 25) and view.padded((0, 0, 0, 5)) == (0, 0, 0, 5) and view.padded((-180, -90, 180, 90)) == (-180, -90, 180, 90)
    assert view.culls((0, 0, 1, 1), (0, 0, 10, 10), 3) and not view.culls((0, 0, 9, 9), (0, 0, 10, 10), 20) and view.culls((0, 0, 1, 1), None, 15)
    assert view.box_contains((0, 0, 10, 10), (-0.0004, 0, 10, 10), 0.0005) and not view.box_contains((0, 0, 10, 10), (-1, 0, 5, 5))


@pytest.mark.parametrize("camera", [view.Camera(800, 600, 10, 5.0, 50.0), view.Camera(800, 600, 12, -70.0, -33.0, 40, 50)])
def test_camera_round_trip(spark, camera):
    df = spark.createDataFrame([(100.0, 300.0), (400.0, 300.0), (700.0, 550.0)], "px double, py double")
    lon, lat = camera.unproject(F.col("px"), F.col("py"))
    px, py = camera.project(F.col("lon"), F.col("lat"))
    for r in df.withColumns({"lon": lon, "lat": lat}).withColumns({"qx": px, "qy": py}).collect():
        assert r["qx"] == pytest.approx(r["px"]) and r["qy"] == pytest.approx(r["py"])
        if (r["px"], r["py"]) == (400.0, 300.0):
            assert (r["lon"], r["lat"]) == (pytest.approx(camera.lon), pytest.approx(camera.lat))


def test_weights_times_and_aliases(spark):
    df = spark.createDataFrame([("x", 3.0, [1.0, 2.0]), ("7", 1.0, [1.0])], "flow string, value double, timestamps array<double>")
    assert [r[0] for r in df.select(view.flow_value(df)).collect()] == [3.0, 7.0] and view.max_flow(df).first()[0] == 7 and view.max_weight(df).first()[0] == 1
    pts = F.array(F.lit(1), F.lit(2))
    assert [r[0] for r in df.select(view.timestamps(df, pts)).collect()] == [[1.0, 2.0], [0.0, 1.0]]
    catalog = {"water": ["river", "lake"], "road": ["street", "high way"]}
    assert [view.resolve_alias(q, catalog) for q in ("Water", "highway", "rivers", "", "zzz")] == ["water", "road", "water", None, None]

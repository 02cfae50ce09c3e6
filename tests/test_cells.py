"""Voronoi cells of full places: one cell is made for each place, and plans do not grow round by round."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import construct


def test_equal_places_share_a_cell(spark):
    rng = np.random.default_rng(5)
    spots = [(float(x), float(y)) for x, y in rng.uniform(0, 10, (30, 2))]
    rows = [(i, *spots[i % 30]) for i in range(300)]
    out = construct.voronoi(spark.createDataFrame(rows, "id int, lon double, lat double"), (0, 0, 10, 10))
    assert out._jdf.queryExecution().analyzed().toString().count("\n") < 200
    cells = out.collect()
    per = {}
    for r in cells:
        per.setdefault(r["id"] % 30, set()).add(str(r["geom"]))
    assert len(cells) == 300 and all(len(v) == 1 for v in per.values())
    rings = [np.array([(p["x"], p["y"]) for p in r["geom"]["parts"][0]["pts"]]) for r in cells]
    assert abs(sum(abs(kernels.signed_area(r)) for r in rings) - 1000) < 1e-6
    assert "InMemoryTableScan" not in out.agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()

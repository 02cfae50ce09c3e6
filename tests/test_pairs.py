"""Relations of many pairs at once against one by one, and joins of equal shapes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels, shapes
from tessera.functions.pairs import relate_pairs
from tessera.operators import joins

KIND = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("pts", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])))])


def some(rng, n):
    """Rings of every kind on a coarse lattice, so that many touch: boxes, diamonds, stars, dented ones, holes, lines, points."""
    out = []
    for k in range(n):
        x, y, r = rng.integers(0, 8), rng.integers(0, 8), rng.integers(1, 5)
        box, dia = [(x, y), (x + r, y), (x + r, y + r), (x, y + r), (x, y)], [(x + r, y), (x, y + r), (x - r, y), (x, y - r), (x + r, y)]
        dent = [(x, y), (x + r, y), (x + r, y + r), (x + r / 2, y + r / 4), (x, y + r), (x, y)]
        ring = (box, dia, dia[::-1], dent, box)[k % 5]
        parts = [ring, [(x + r / 4, y + r / 4), (x + r / 2, y + r / 4), (x + r / 2, y + r / 2), (x + r / 4, y + r / 4)]] if k % 5 == 4 else [ring]
        g = kernels.geom_of("Polygon", [[np.array(p, float) for p in parts]])
        out.append({"kind": "LineString", "parts": g["parts"]} if k % 17 == 16 else None if k % 23 == 22 else g)
    return out


@pytest.mark.parametrize("relation", joins.RELATIONS)
def test_pairs_at_once_are_those_one_by_one(relation):
    a, b = some(np.random.default_rng(1), 60), some(np.random.default_rng(2), 60)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    got = relate_pairs(pa.chunked_array([pa.array(a, KIND)]), pa.chunked_array([pa.array(b[:20], KIND), pa.array(b[20:], KIND)]), i, j, relation)
    assert got.tolist() == [kernels.relate(a[p], b[q], relation) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
    assert 20 < got.sum() < 3000


def test_equal_shapes_are_compared_once(spark, monkeypatch):
    """Three hundred copies of two boxes under two hundred copies of a diamond: the tasks see two rows and one."""
    seen = []
    plain = joins.overlapping
    monkeypatch.setattr(joins, "overlapping", lambda a, b, **kw: seen.append((a.count(), b.count())) or plain(a, b, **kw))
    box = spark.range(300).select("id", shapes.box(F.col("id") % 2 * 50.0, F.lit(0.0), F.col("id") % 2 * 50.0 + 4, F.lit(4.0)).alias("geom"))
    dia = spark.range(200).select("id", F.when(F.col("id") > 3, F.concat(F.lit("d"), F.col("id").cast("string"))).alias("name"), shapes.geometry("Polygon", shapes.points((5, 2), (2, 5), (-1, 2), (2, -1), (5, 2))).alias("geom"))
    out = joins.spatial_join(box, dia, "intersects", key="id", other_key="id", name="name", order="id")
    got = {(r.id % 2, r._joinCount, r._joinName) for r in out.collect()}
    assert got == {(0, 200, "d4"), (1, 0, None)} and out.count() == 300
    assert joins.select_related(box, dia, "intersects", key="id", other_key="id").count() == 150
    assert seen and set(seen) == {(2, 1)}

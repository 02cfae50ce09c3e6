"""Overlays of layers: against the plain kernel, however the plane is cut."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import boundary, kernels
from tessera.functions.shapes import GEOM, box
from tessera.operators import construct
from tessera.operators.overlay import RULES, feature, overlay


def ring(*pts):
    return np.array([*pts, pts[0]], float)


def layer(spark, polygons, kind="Polygon"):
    rows = [(json.dumps(kernels.geom_of(kind, [[r for r in p]]) if p is not None else None),) for p in polygons]
    return spark.createDataFrame(rows, "g string").select(F.from_json("g", GEOM).alias("geom"))


def shapes_of(rng, n, span):
    """Boxes, diamonds and frames with a hole, on a coarse lattice (so that edges coincide) and off it."""
    out = []
    for k in range(n):
        x, y, h = (rng.random(3) * (span, span, 3) + (0, 0, 0.2)) if k % 4 == 3 else (rng.integers(0, span, 3) * (1, 1, 0) + (0, 0, rng.integers(1, 4)))
        square = ring((x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h))
        diamond = ring((x + h, y), (x, y + h), (x - h, y), (x, y - h))
        out.append(([square], [diamond], [square, (diamond - (x, y)) / 2 + (x, y)], [diamond])[k % 4])
    return out


def area(rows):
    return sum(kernels.signed_area(r) for row in rows for r in kernels.rings_of(row["geom"].asDict(recursive=True)))


def plain(a, b, rule):
    whole = [[r for p in kernels.union(side) for r in p] if side else [] for side in (a, b)]
    return kernels.overlay(whole, RULES[rule])


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("leaf_rows", [4, 1000])
def test_overlay_equals_plain_kernel(spark, rule, leaf_rows):
    rng = np.random.default_rng(3)
    a, b = shapes_of(rng, 40, 24), shapes_of(rng, 24, 24)
    rows = overlay(layer(spark, a), layer(spark, b), rule, leaf_rows=leaf_rows).collect()
    want = plain(a, b, rule)
    assert area(rows) == pytest.approx(sum(kernels.signed_area(r) for p in want for r in p), abs=1e-6)
    sizes = lambda polygons: sorted(round(abs(sum(kernels.signed_area(r) for r in p)), 5) for p in polygons)
    assert sizes(kernels.rings_of(r["geom"].asDict(recursive=True)) for r in rows) == sizes(want)
    # Places in and out agree, so each hole is in its own shell.
    spots = rng.random((400, 2)) * 30 - 3
    held = sum((kernels.inside(spots, kernels._edges(kernels.rings_of(r["geom"].asDict(recursive=True)))) for r in rows), np.zeros(400, int))
    assert (held == sum((kernels.inside(spots, kernels._edges(p)) for p in want), np.zeros(400, int))).all()
    assert held.max() == 1


def test_cuts_leave_no_vertices(spark):
    """A slanted ring over many cells comes back with its own corners only, and a hole across all of them stays one hole."""
    big, small = ring((0, 0), (31, 7), (23, 29), (-5, 17)), ring((4, 6), (20, 9), (18, 20), (3, 15))
    dust = [[ring((x, y), (x + 0.1, y), (x + 0.1, y + 0.1), (x, y + 0.1))] for x in range(5, 18, 2) for y in range(9, 15, 2)]
    got = overlay(layer(spark, [[big, small]]), layer(spark, dust), "union", leaf_rows=3).collect()
    sizes = sorted(len(kernels.rings_of(r["geom"].asDict(recursive=True))) for r in got)
    assert sizes == [1] * len(dust) + [2]
    frame = next(rings for r in got if len(rings := kernels.rings_of(r["geom"].asDict(recursive=True))) == 2)
    assert [len(r) for r in frame] == [5, 5]
    assert kernels.signed_area(frame[0]) > 0 > kernels.signed_area(frame[1])


def test_edges_of_layers(spark):
    one, none = layer(spark, [[ring((0, 0), (2, 0), (2, 2), (0, 2))], None]), layer(spark, []).where("geom is not null")
    line = layer(spark, [[np.array([(0.0, 0.0), (5.0, 5.0)])]], "LineString")
    assert area(overlay(one, none, "difference").collect()) == area(overlay(one.unionAll(one), line, "union").collect()) == 4
    assert construct.intersect(one, none).count() == construct.union(none, none).count() == construct.difference(one, one).count() == 0
    apart = construct.union(one, layer(spark, [[ring((5, 5), (6, 5), (6, 6), (5, 6))]])).collect()
    assert [r["geom"]["kind"] for r in apart] == ["MultiPolygon"] and [p["part"] for p in apart[0]["geom"]["parts"]] == [0, 1]
    assert feature(overlay(one, one, "intersection")).first()["geom"]["kind"] == "Polygon"
    with pytest.raises(ValueError):
        overlay(one, one, "xor")
    named = one.withColumnRenamed("geom", "shape")
    assert construct.clip(named, named, "shape").columns == ["shape"]


def test_covering_polygons_are_flags(spark):
    """One outline around thousands of boxes decides them all without meeting their edges."""
    grid = spark.range(3600).select(box((F.col("id") % 60).cast("double"), F.floor(F.col("id") / 60).cast("double"), F.col("id") % 60 + 0.5, F.floor(F.col("id") / 60) + 0.5).alias("geom"))
    around = spark.range(1).select(box(F.lit(-1.0), F.lit(-1.0), F.lit(61.0), F.lit(61.0)).alias("geom"))
    left = overlay(around, grid, "difference", leaf_rows=200).collect()
    assert len(left) == 1 and area(left) == pytest.approx(62 * 62 - 900)
    assert len(kernels.rings_of(left[0]["geom"].asDict(recursive=True))) == 3601
    assert overlay(grid, around, "intersection", leaf_rows=200).count() == 3600
    assert area(overlay(grid, around, "union", leaf_rows=200).collect()) == 62 * 62


@pytest.mark.parametrize("few", [4, 48])
def test_boundary_whatever_the_cells(few):
    rng = np.random.default_rng(9)
    sides = shapes_of(rng, 60, 20), shapes_of(rng, 40, 20)
    edges = [boundary.oriented(p) for p in sides[0] + sides[1]]
    owner, side = np.repeat(np.arange(100), [len(e) for e in edges]), np.array([0] * 60 + [1] * 40)
    for rule in RULES:
        p = boundary.boundary(np.concatenate(edges), owner, side, (-9.0, -9.0, 40.0, 40.0), RULES[rule], few=few)
        want = sum(kernels.signed_area(r) for q in plain(*sides, rule) for r in q)
        assert (p[:, 0] * p[:, 3] - p[:, 2] * p[:, 1]).sum() / 2 == pytest.approx(want, abs=1e-6)
        rings, open_ = boundary.joined(list(p.reshape(-1, 2, 2)), (-9.0, -9.0, 40.0, 40.0))
        assert not open_ and sum(map(kernels.signed_area, rings)) == pytest.approx(want, abs=1e-6)

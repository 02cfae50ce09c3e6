import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codecs, kernels, shapes
from tessera.operators import construct, joins
from tessera.operators.permutation import draws


def square(x, y, s):
    return [np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)]


def area(parts):
    return sum(kernels.signed_area(r) for p in parts for r in p)


def test_overlay_areas():
    a, b = square(0, 0, 10), square(5, 5, 10)
    assert area(kernels.intersection(a, b)) == pytest.approx(25)
    assert area(kernels.union([a, b])) == pytest.approx(175)
    assert area(kernels.difference(a, b)) == pytest.approx(75)
    hole = kernels.difference(square(0, 0, 10), square(3, 3, 2))
    assert len(hole) == 1 and len(hole[0]) == 2 and area(hole) == pytest.approx(96)
    assert len(kernels.union([square(0, 0, 1), square(5, 5, 1)])) == 2
    assert area(kernels.union([square(0, 0, 1), square(1, 0, 1)])) == pytest.approx(2)  # a shared edge vanishes


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5)), min_size=1, max_size=5))
def test_union_equals_cells(squares):
    cells = {(i, j) for x, y, s in squares for i in range(x, x + s) for j in range(y, y + s)}
    assert area(kernels.union([square(*q) for q in squares])) == pytest.approx(len(cells))


def test_hull_simplify_smooth():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(200, 2))
    ring = kernels.convex_hull(p)
    assert kernels.signed_area(ring) > 0 and kernels.inside(p[~np.isin(p, ring).all(axis=1)], kernels._edges([ring])).all()
    assert kernels.convex_hull(np.array([[0, 0], [1, 1], [2, 2]])) is None
    assert len(kernels.simplify(np.array([[0, 0], [1, 0.01], [2, 0]]), 0.1)) == 2
    triangle = np.array([[0, 0], [4, 0], [2, 4], [0, 0]], float)
    assert len(kernels.smooth(triangle, 1, True)) == 7
    line = np.array([[0, 0], [1, 1], [2, 0]], float)
    out = kernels.smooth(line, 2, False)
    assert (out[0] == line[0]).all() and (out[-1] == line[-1]).all()


@pytest.mark.parametrize("text", ["POINT (1 2)", "LINESTRING (0 0, 1 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((9 9, 10 9, 10 10, 9 9)))"])
def test_codec_round_trips(spark, text):
    g, srid = codecs.from_wkt("SRID=4326;" + text)
    assert srid == 4326 and codecs.to_wkt(g) == text
    assert codecs.from_wkb(codecs.to_wkb(g))[0] == g and codecs.from_wkb(codecs.to_wkb(g).hex())[0] == g
    assert codecs.from_geojson(codecs.to_geojson(g)) == g
    row = spark.createDataFrame([(g,)], f"geom {shapes.GEOM}").select(shapes.geojson(F.col("geom")).alias("j"), shapes.wkt(F.col("geom")).alias("w")).first()
    assert codecs.from_geojson(row["j"]) == g and codecs.from_wkt(row["w"])[0] == g


def test_bad_text_is_none():
    assert codecs.from_wkt("POINT (") == (None, None) and codecs.from_wkt(None) == (None, None)
    assert codecs.from_wkb(b"\x01") == (None, None) and codecs.from_geojson("{") is None


def test_literals_are_checked(spark):
    from tessera.sources.readers import create

    ring = create(spark, "Polygon", [[(0, 0), (0, 1), (1, 1)]]).first()["geom"]["parts"][0]["pts"]
    assert kernels.signed_area(np.array([(p["x"], p["y"]) for p in ring])) > 0
    for bad in ([(0, 0), (1, 1), (1, 0), (0, 1)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (200, 0), (1, 1)]):
        with pytest.raises(ValueError):
            create(spark, "Polygon", [bad])


def test_voronoi_tiles_the_box(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (60, 2)))]
    cells = construct.voronoi(spark.createDataFrame(pts, "id int, lon double, lat double"), (0, 0, 10, 10)).collect()
    rings = {r["id"]: np.array([(p["x"], p["y"]) for p in r["geom"]["parts"][0]["pts"]]) for r in cells}
    assert len(rings) == 60 and sum(abs(kernels.signed_area(r)) for r in rings.values()) == pytest.approx(100)
    for i, x, y in pts:
        assert kernels.inside(np.array([[x, y]]), kernels._edges([rings[i]]))[0]


def test_nearest_across_the_date_line_and_poles(spark):
    rows = [(1, 179.9, 0.0), (2, -179.9, 0.0), (3, 0.0, 89.9), (4, 180.0, 89.8), (5, 100.0, 10.0)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    got = {r["i"]: r["j"] for r in joins.nearest(df, df, 1, skip=F.col("i") == F.col("j")).collect()}
    assert got[1] == 2 and got[2] == 1 and got[3] == 4 and got[4] == 3


def test_draws_can_start_anywhere():
    a = 42
    plain = []
    for _ in range(50):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = a
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        plain.append((t ^ (t >> 14)) / 4294967296)
    assert draws(42, 0, 50).tolist() == plain and draws(42, 20, 30).tolist() == plain[20:]

"""Permutation tests against plain loops over the same shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import permutation


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 16, 97, 1000, 4097])
def test_a_bijection_for_every_key(spark, n):
    rows = spark.range(n * 5).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("key"))
    got = rows.select("key", "x", permutation.shuffled(F.col("x"), n, F.col("key"), F.lit(3)).alias("y")).collect()
    for k in range(5):
        assert sorted(r["y"] for r in got if r["key"] == k) == list(range(n))
    if n >= 97:
        maps = [tuple(r["y"] for r in sorted(got, key=lambda r: r["x"]) if r["key"] == k) for k in range(5)]
        assert len(set(maps)) == 5 and all(sum(i == y for i, y in enumerate(m)) < 12 for m in maps)


def test_places_are_uniform(spark):
    """Where 0 goes under 12,000 keys, in 20 places."""
    got = spark.range(12_000).select(permutation.shuffled(F.lit(0), 20, F.col("id")).alias("y")).groupBy("y").count().collect()
    assert len(got) == 20 and sum((r["count"] - 600) ** 2 / 600 for r in got) < 50


@pytest.fixture(scope="module")
def layer(spark):
    rng = np.random.default_rng(3)
    n = 60
    v = np.sin(np.arange(n) / 6) + rng.normal(0, 0.4, n)
    ids = rng.permutation(n * 3)[:n].tolist()
    edges = sorted({(i, j) for i in range(n) for j in (i - 1, i + 1, i + 7, i - 7) if 0 <= j < n})
    edges = [(i, j) for i, j in edges if 30 not in (i, j)]
    df = spark.createDataFrame(list(zip(ids, v.tolist(), strict=True)), "id long, v double")
    return df, spark.createDataFrame([(ids[i], ids[j]) for i, j in edges], "i long, j long"), ids, v, edges


def shuffles(spark, n, count, seed, *more):
    """The permutations, taken from the expression itself."""
    rows = spark.range(n * count).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).cast("int").alias("s"))
    got = rows.select("s", "x", permutation.shuffled(F.col("x"), n, *more, F.col("s"), F.lit(seed)).alias("y")).collect()
    out = np.zeros((count, n), int)
    for r in got:
        out[r["s"], r["x"]] = r["y"]
    return out


def test_moran_is_the_plain_loop(spark, layer):
    df, edges_df, ids, v, edges = layer
    got = permutation.moran_test(df, "v", edges_df, permutations=99, seed=5, source="bijection").first()
    order = np.argsort(ids)
    z = (v - v.mean())[order]
    place = {int(k): p for p, k in enumerate(order)}
    pairs = np.array([(place[i], place[j]) for i, j in edges])
    cross = lambda z: abs((z[pairs[:, 0]] * z[pairs[:, 1]]).sum())
    reached = sum(cross(z[p]) >= cross(z) * (1 - 1e-12) for p in shuffles(spark, len(v), 99, 5))
    assert got["p"] == (reached + 1) / 100
    near = permutation.moran_test(df, "v", edges_df, permutations=999).first()
    assert abs(near["p"] - permutation.moran_test(df, "v", edges_df, permutations=999, source="bijection").first()["p"]) < 0.03


def test_local_moran_is_the_plain_loop(spark, layer):
    df, edges_df, ids, v, edges = layer
    got = {r["id"]: r["lisa_p"] for r in permutation.local_moran_test(df, "v", edges_df, permutations=39, seed=5, source="bijection").collect()}
    order = np.argsort(ids)
    z = (v - v.mean())[order]
    near = {p: [] for p in range(len(v))}
    place = {int(k): p for p, k in enumerate(order)}
    for i, j in edges:
        near[place[i]].append(place[j])
    for p in range(0, len(v), 7):
        own, others = abs(z[p] * z[near[p]].sum()), np.delete(z, p)
        drawn = shuffles(spark, len(v) - 1, 39, 5, F.lit(p).cast("long"))
        reached = sum(abs(z[p] * others[s[: len(near[p])]].sum()) >= own * (1 - 1e-12) for s in drawn)
        assert got[int(np.array(ids)[order][p])] == round((reached + 1) / 40, 4)
    assert len(got) == 60 and got[ids[30]] == 1.0


def test_large_layers_are_not_refused(spark, monkeypatch):
    monkeypatch.setattr(permutation, "MAX_FEATURES", 300)
    n = 800
    df = spark.range(n).select("id", F.sin(F.col("id") / 50).alias("v"))
    edges = df.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j")).where(F.col("j") < n)
    edges = edges.unionAll(edges.select("j", "i"))
    assert permutation.moran_test(df, "v", edges, permutations=19).first()["p"] == 0.05
    classes = {r["lisa_class"]: r["count"] for r in permutation.local_moran_test(df, "v", edges, permutations=19, alpha=0.2).groupBy("lisa_class").count().collect()}
    assert min(classes["HH"], classes["LL"]) > n / 8
    with pytest.raises(ValueError, match="at most"):
        permutation.moran_test(df, "v", edges, source="sequence")

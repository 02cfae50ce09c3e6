"""Permutation tests of Moran's I.

Two sources of shuffles.  The sequence is a 32-bit counter-based generator whose shuffles follow one another, so a task needs all
values; it serves layers of up to ``MAX_FEATURES`` features and gives the results of a run one after another.  The bijection
is a keyed permutation of the row numbers, of which any value is known by itself: each (shuffle, row) gets its value by an
equi-join, sums are partial aggregates, and no task sees the layer.  It serves layers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geodesy import erf
from tessera.operators.edits import with_row_ids
from tessera.operators.statistics import _standardised, local_moran, moran_i
from tessera.storage import written

MAX_FEATURES = 20_000
STEP = 0x6D2B79F5  # fixed value of the generator (mulberry32)


def draws(seed: int, start: int, count: int) -> np.ndarray:
    """Numbers in [0, 1) number ``start`` to ``start + count - 1`` of the sequence; seed 0 counts as 1."""
    base = np.uint64((seed & 0xFFFFFFFF) or 1)
    low = np.uint64(0xFFFFFFFF)
    a = (base + (np.arange(start + 1, start + count + 1, dtype=np.uint64) & low) * np.uint64(STEP)) & low
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & low
    t = t ^ ((t + ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61)) & low)) & low)
    return ((t ^ (t >> np.uint64(14))) & low).astype(np.float64) / 4294967296.0


def shuffled(x: Column, n: int, *keys: Column, rounds: int = 4) -> Column:
    """Where a number below ``n`` goes under the permutation of 0 to n - 1 that ``keys`` (any columns) choose.

    A Feistel network over a rectangle of a by b cells, a b >= n: rounds add a hash of the one coordinate to the other, so each
    can be taken back, whatever the hash.  From a cell beyond n the walk goes on; as fewer than a are, it ends within a + 1
    steps, and for large n within a few.
    """
    a = max(1, math.isqrt(n - 1) + 1) if n > 0 else 1
    b = max(1, -(-n // a))

    def once(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), F.pmod(v, F.lit(b))
        for k in range(rounds):
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(2 * k), *keys), F.lit(a)), F.lit(a))
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(2 * k + 1), *keys), F.lit(b)), F.lit(b))
        return left * b + right

    first = once(x.cast("long"))
    if a * b == n:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(a + 1, 24))), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """(id, place, z), places from 0 in order of the ids."""
    return written(with_row_ids(rows.select("id", "z"), ["id"], "place").select("id", F.col("place").cast("long").alias("place"), "z"))


def _moran_by_bijection(rows: DataFrame, n: int, edges: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(p): shuffles that give a cross product of at least the layer's own, in absolute value, one added to both counts."""
    places = _numbered(rows)
    at = lambda end: places.select(F.col("id").alias(end), F.col("place").alias(f"{end}_place"))
    pairs = written(edges.join(at("i"), "i").join(at("j"), "j").select("i_place", "j_place"))
    # Shuffle -1 leaves every value where it is.
    each = pairs.withColumn("shuffle", F.explode(F.sequence(F.lit(-1), F.lit(permutations - 1))))
    for end in ("i", "j"):
        to = shuffled(F.col(f"{end}_place"), n, F.col("shuffle"), F.lit(seed))
        each = each.withColumn("place", F.when(F.col("shuffle") < 0, F.col(f"{end}_place")).otherwise(to))
        each = each.join(places.select("place", F.col("z").alias(f"z_{end}")), "place").drop("place")
    # To 12 digits, so that the order in which partial sums meet does not decide between equal products.
    cross = each.groupBy("shuffle").agg(F.abs(F.sum(F.col("z_i") * F.col("z_j"))).alias("c"))
    own = F.max(F.when(F.col("shuffle") < 0, F.col("c")))
    found = cross.agg(own.alias("own"), F.collect_list(F.when(F.col("shuffle") >= 0, F.col("c"))).alias("all"))
    reached = F.size(F.filter("all", lambda c: c >= F.col("own") * (1 - 1e-12)))
    return found.select(((reached + 1) / F.lit(permutations + 1.0)).alias("p"))


def _local_by_bijection(parts: DataFrame, n: int, edges: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``parts`` with p: each feature draws as many of the other values as it has neighbours, without one twice."""
    places = _numbered(parts)
    rows = parts.join(places.select("id", "place"), "id")
    draw = rows.select("place", "z", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("shuffle"), F.col("degree").cast("int").alias("degree"), "lag")
    draw = draw.where("degree > 0").select("place", "shuffle", F.explode(F.sequence(F.lit(0), F.col("degree") - 1)).alias("k"))
    other = shuffled(F.col("k"), n - 1, F.col("place"), F.col("shuffle"), F.lit(seed))
    draw = draw.withColumn("other", F.when(other >= F.col("place"), other + 1).otherwise(other))
    lags = draw.join(places.select(F.col("place").alias("other"), F.col("z").alias("v")), "other").groupBy("place", "shuffle").agg(F.sum("v").alias("drawn"))
    reached = lags.join(rows.select("place", "z", "lag"), "place").groupBy("place").agg(F.count_if(F.abs(F.col("z") * F.col("drawn")) >= F.abs(F.col("z") * F.col("lag")) * (1 - 1e-12)).alias("reached"))
    reached = rows.join(reached, "place", "left")
    # Without neighbours every shuffle gives the layer's own 0.
    p = (F.coalesce("reached", F.lit(permutations)) + 1) / F.lit(permutations + 1.0)
    return reached.select("id", "z", "lag", "lisa_i", p.alias("p"))


def _source(source: str | None, n: int) -> str:
    source = source or ("sequence" if n <= MAX_FEATURES else "bijection")
    if source not in ("sequence", "bijection"):
        raise ValueError("shuffles come from a sequence or a bijection")
    if source == "sequence" and n > MAX_FEATURES:
        raise ValueError(f"the sequence serves at most {MAX_FEATURES} features")
    return source


def local_moran_test(df: DataFrame, field: str, edges: DataFrame, *, key: str = "id", permutations: int = 999, seed: int = 42, alpha: float = 0.05, source: str | None = None) -> DataFrame:
    """(id, lisa_i, lisa_lag, lisa_p, lisa_class): conditional permutation p values, classes HH, LL, HL, LH or nonsig.

    Without permutations p is that of the normal distribution at |I|.  ``source``: where shuffles come from, sequence or
    bijection, by default the sequence as far as it serves.
    """
    parts = local_moran(df, field, edges, key=key)
    if permutations <= 0:
        tested = parts.withColumn("p", 1 - erf(F.abs("lisa_i") / 2**0.5))
    elif (n := parts.count()) and _source(source, n) == "bijection":
        tested = _local_by_bijection(parts, n, edges, permutations, seed)
    else:
        rows = parts.select("id", "z").orderBy("id").toArrow()
        ids, z = rows["id"].to_pylist(), rows["z"].to_numpy()
        place, n = {k: i for i, k in enumerate(ids)}, len(ids)
        m2 = float((z**2).mean())
        shared = df.sparkSession.sparkContext.broadcast((place, z))
        near = edges.groupBy(F.col("i").alias("id")).agg(F.collect_list("j").alias("near"))
        schema = f"id {parts.schema['id'].dataType.simpleString()}, z double, lag double, lisa_i double, p double"

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, z = shared.value
            for b in batches:
                p = []
                for k, own, near_ in zip(b["id"], b["lisa_i"], b["near"], strict=True):
                    i = place[k]
                    pool = np.delete(z, i)
                    spots = np.array([j - (j > i) for j in (place[x] for x in near_)] if near_ is not None else [], int)
                    least, n_draws = 0, n - 2
                    for r in range(permutations):
                        u = draws(seed, (i * permutations + r) * n_draws, n_draws)
                        to = np.floor(u * np.arange(n - 1, 1, -1)).astype(int).tolist()
                        for q, s in zip(range(n - 2, 0, -1), to, strict=True):
                            pool[q], pool[s] = pool[s], pool[q]
                        least += abs(z[i] / m2 * pool[spots].sum()) >= abs(own)
                    p.append((least + 1) / (permutations + 1))
                yield b.drop(columns="near").assign(p=p)[["id", "z", "lag", "lisa_i", "p"]]

        spread = parts.join(near, "id", "left").select("id", "z", "lag", "lisa_i", "near").repartition("id")
        tested = spread.mapInPandas(test, schema)
    high = F.col("z") > 0
    label = F.when((F.col("p") >= alpha) | (F.col("z") == 0) | (F.col("lag") == 0), "nonsig").when(high & (F.col("lag") > 0), "HH").when(high, "HL").when(F.col("lag") < 0, "LL").otherwise("LH")
    return tested.select("id", F.round("lisa_i", 6).alias("lisa_i"), F.round("lag", 6).alias("lisa_lag"), F.round("p", 4).alias("lisa_p"), label.alias("lisa_class"))


def moran_test(df: DataFrame, field: str, edges: DataFrame, *, key: str = "id", permutations: int = 999, seed: int = 42, source: str | None = None) -> DataFrame:
    """``moran_i`` with the p value of shuffles of all values; ``source`` as in ``local_moran_test``.

    Those of the sequence follow one another, each from the last, and are one task's work.
    """
    rows, n, _, _ = _standardised(df, field, key)
    if _source(source, n) == "bijection":
        p = _moran_by_bijection(rows, n, edges, permutations, seed)
        return moran_i(df, field, edges, key=key).drop("p").crossJoin(F.broadcast(p))
    edge_lists = edges.groupBy(F.col("i").alias("id")).agg(F.collect_list("j").alias("near"))
    whole = rows.join(edge_lists, "id", "left").select("id", "x", "near").withColumn("layer", F.lit(1))

    def test(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        place = {k: i for i, k in enumerate(group["id"])}
        pairs = np.array([(i, place[j]) for i, near in enumerate(group["near"]) if near is not None for j in near]).reshape(-1, 2)
        x = group["x"].to_numpy().copy()

        def cross(x: np.ndarray) -> float:
            z = x - x.mean()
            return abs(float((z[pairs[:, 0]] * z[pairs[:, 1]]).sum() / (z * z).sum()))

        own, least = cross(x), 0
        for r in range(permutations):
            to = np.floor(draws(seed, r * (n - 1), n - 1) * np.arange(n, 1, -1)).astype(int).tolist()
            for q, s in zip(range(n - 1, 0, -1), to, strict=True):
                x[q], x[s] = x[s], x[q]
            least += cross(x) >= own
        return pd.DataFrame({"p": [(least + 1) / (permutations + 1)]})

    p = whole.groupBy("layer").applyInPandas(test, "p double")
    return moran_i(df, field, edges, key=key).drop("p").crossJoin(F.broadcast(p))

"""Exact near-duplicate links between embeddings by dual traversal of cover trees.

Vectors are scaled to length one, so a cosine of at least t means a distance of at most sqrt(2 - 2t).  The top level of
the cover is a bounded set of centres to whose balls all vectors are dealt; pairs of balls that are too far apart for
their covering radii are left out, and each other pair is one task, which builds the lower levels of both balls' cover
trees (radii halve from level to level) and descends them together, pruning node pairs by the same bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import components, written

SLACK = 1e-7


class CoverTree:
    """Nodes are (centre, covering radius, children, points); a leaf has points and no children."""

    def __init__(self, x: np.ndarray, reach: float, leaf: int = 24):
        self.x, self.reach, self.leaf = x, reach, leaf
        self.root = self._node(np.arange(len(x)), 2.0)

    def _node(self, points: np.ndarray, radius: float) -> tuple:
        centre = points[0]
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.x[points] @ self.x[centre])))
        cover = float(d.max())
        while radius > cover and radius > SLACK:
            radius /= 2
        if len(points) <= self.leaf or cover <= self.reach / 4:
            return centre, cover, [], points
        children, rest = [], points
        while len(rest):  # the first centre is the node's own: levels are nested
            d = np.sqrt(np.maximum(0, 2 - 2 * (self.x[rest] @ self.x[rest[0]])))
            near = d <= radius
            near[0] = True
            own = rest[near]
            children.append((own[0], 0.0, [], own) if len(own) == 1 else self._node(own, radius / 2))
            rest = rest[~near]
        return centre, cover, children, points


def dual_links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows of x, rows of y, which of their pairs link); ``y`` None: x with itself, each pair in one block only."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    a = CoverTree(x, reach)
    b = a if y is None else CoverTree(y, reach)
    stack = [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        same = y is None and p is q
        if not p[2] and not q[2]:
            hit = a.x[p[3]] @ b.x[q[3]].T >= cosine
            if same:
                hit &= np.triu(np.ones(hit.shape, bool), 1)
            if hit.any():
                yield p[3], q[3], hit
            continue
        if same:
            left = right = p[2]
        else:
            left, right = (p[2], q[2]) if p[2] and q[2] else (p[2], [q]) if p[2] else ([p], q[2])
        ci, cj = (np.array([n[0] for n in s]) for s in (left, right))
        ri, rj = (np.array([n[1] for n in s]) for s in (left, right))
        for at in range(0, len(left), 512):
            d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[ci[at : at + 512]] @ b.x[cj].T)))
            near = d <= ri[at : at + 512, None] + rj[None, :] + reach + SLACK
            if same:
                near &= np.arange(len(right))[None, :] >= np.arange(at, at + len(near))[:, None]
            stack.extend((left[at + i], right[j]) for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True) if not (same and at + i == j and len(left[at + i][3]) == 1))


def _linked(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, ball: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the links, root) of each row: links between two balls, or within one if there is one only."""
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    first = np.flatnonzero(ball == ball[0])
    second = np.flatnonzero(ball != ball[0])
    for p, q, hit in dual_links(x[first], x[second] if len(second) else None, cosine):
        p, q = first[p], (second if len(second) else first)[q]
        links[p] += hit @ weight[q]
        links[q] += hit.T @ weight[p]
        i, j = np.nonzero(hit)
        i, j = p[i], q[j]
        while True:
            u, v = parent[i], parent[j]
            if (u == v).all():
                break
            np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
            while (parent != (parent := parent[parent])).any():
                pass
    return links, parent


def embedding_links(vectors: DataFrame, *, cosine: float = 0.98, ball: int = 2048, max_centres: int = 1024, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels and lengths are equal and their cosine is at least ``cosine``.  A null label or vector, a
    zero vector, or one with a null, infinite or NaN component links with nothing.  Equal vectors of a label are one class,
    compared once, under a number of its own; so rows that share an id, or have none, are vectors of their own with the
    links of their vector.  ``component_id`` is the smallest id among the component's rows, null if none has one, and a row
    without an id is not kept.  No rows: an empty result.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("v", lambda c: c != 0), F.lit(False)))
    classes = written(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m")).withColumn("cls", F.monotonically_increasing_id()))
    keys = [F.col("label"), F.size("v").alias("dim")]
    sizes = {(r["label"], r["dim"]): r["n"] for r in classes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(max_centres).collect()}
    total = sum(sizes.values())
    wanted = {k: max(1, min(-(-n // ball), max_centres * n // max(1, total))) for k, n in sizes.items()}
    # A bounded sample of centres, of all labels at once; labels beyond the bound have one ball each, around the origin.
    centres: dict[tuple, np.ndarray] = {}
    if any(n > 1 for n in wanted.values()):
        spark = vectors.sparkSession
        many = spark.createDataFrame([(*k, n) for k, n in wanted.items() if n > 1], f"label {classes.schema['label'].dataType.simpleString()}, dim int, wanted int")
        place = F.row_number().over(W.partitionBy("label", "dim").orderBy(F.xxhash64("v", F.lit(seed)), "v"))
        got = classes.withColumn("dim", F.size("v")).join(F.broadcast(many), ["label", "dim"]).withColumn("place", place).where("place <= wanted").orderBy("label", "dim", "place").select("label", "dim", "v").toArrow()
        for k, x in zip(zip(got["label"].to_pylist(), got["dim"].to_pylist(), strict=True), got["v"].to_pylist(), strict=True):
            centres.setdefault(k, []).append(x)
        centres = {k: (c := np.array(v)) / np.linalg.norm(c, axis=1, keepdims=True) for k, v in centres.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, v = b["label"].to_pylist(), b["v"].to_pylist()
            near, far, unit = np.zeros(len(v), np.int64), np.ones(len(v)), []
            for i, (k, x) in enumerate(zip(label, v, strict=True)):
                x = np.array(x)
                x /= np.abs(x).max()
                x /= np.linalg.norm(x)
                unit.append(x)
                c = shared.value.get((k, len(x)))
                if c is not None:
                    d = 2 - 2 * (c @ x)
                    near[i] = d.argmin()
                    far[i] = np.sqrt(max(0.0, d.min()))
            yield pa.RecordBatch.from_arrays([b["label"], b["cls"], b["m"], pa.array([len(x) for x in v], pa.int32()), pa.array(near), pa.array(far), pa.array([x.tobytes() for x in unit], pa.binary())], names=["label", "cls", "m", "dim", "centre", "far", "unit"])

    types = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    placed = written(classes.mapInArrow(dealt, f"label {types['label']}, cls long, m long, dim int, centre long, far double, unit binary"))
    balls = placed.groupBy("label", "dim", "centre").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    # A ball above the size is split evenly into parts around the same centre.
    balls = balls.withColumn("parts", F.ceil(F.col("n") / ball).cast("long"))
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    near = vectors.sparkSession.createDataFrame([(*k, i, x.tolist()) for k, c in centres.items() for i, x in enumerate(c)], f"label {types['label']}, dim int, centre long, at array<double>")
    shards = balls.join(F.broadcast(near), ["label", "dim", "centre"], "left").select("label", "dim", "centre", "radius", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).withColumn("shard", F.col("centre") * (1 << 24) + F.col("part"))
    left, right = (shards.select("label", "dim", F.col("shard").alias(s), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}"), F.col("at").alias(f"x{s}")) for s in "ij")

    squares = F.aggregate(F.zip_with("xi", "xj", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, x: a + x)
    apart = F.when(F.col("ci") == F.col("cj"), 0.0).otherwise(F.coalesce(F.sqrt(squares), F.lit(0.0)))
    pairs = left.join(right, ["label", "dim"]).where("i <= j").where(apart <= F.col("ri") + F.col("rj") + reach).select("label", "dim", "i", "j")
    each = pairs.withColumn("shard", F.explode(F.array_distinct(F.array("i", "j"))))
    placed = placed.join(balls.select("label", "dim", "centre", "parts"), ["label", "dim", "centre"]).withColumn("shard", F.col("centre") * (1 << 24) + F.pmod(F.xxhash64("cls", F.lit(seed + 1)), F.col("parts")))
    tasks = placed.join(each, ["label", "dim", "shard"]).select("label", "dim", "i", "j", "shard", "cls", "m", "unit")

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        if group["i"].iloc[0] != group["j"].iloc[0] and group["shard"].nunique() < 2:
            return pd.DataFrame({"cls": [], "links": [], "root": []})
        group = group.sort_values(["shard", "cls"])
        x = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
        cls = group["cls"].to_numpy()
        links, parent = _linked(cls, group["m"].to_numpy(), x, group["shard"].to_numpy(), cosine)
        hit = links > 0
        return pd.DataFrame({"cls": cls[hit], "links": links[hit], "root": cls[parent[hit]]})

    found = written(tasks.groupBy("label", "dim", "i", "j").applyInPandas(compared, "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    good = rows.where("ok").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Overlays of polygon layers of any size: boundaries leaf by leaf, rings stitched up the split tree, holes given to shells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import boundary, kernels
from tessera.functions.shapes import GEOM, POINTS, bounds
from tessera.operators.partition import SplitTable, overlapping
from tessera.storage import written

LEAF_ROWS, SAMPLE, LEVELS, SPREAD, TASKS = 512, 100_000, 3, 64, 4096
RULES = {"union": lambda m: m.any(axis=1), "intersection": lambda m: m.all(axis=1), "difference": lambda m: m[:, 0] & ~m[:, 1]}


class Cells:
    """The cells of a split table's nodes inside a frame, and each node's ancestors."""

    def __init__(self, table: SplitTable, frame: boundary.Cell):
        self.table, self.cell, self.parent, self.depth, self.leaf = table, {0: frame}, {0: 0}, {0: 0}, {}
        # Cuts on the grid of the edges, so that what two cells cut there is the same place.
        table.nodes = [(n[0], round(n[1], boundary.DIGITS), *n[2:]) if n[0] >= 0 else n for n in table.nodes]
        todo = [0]
        while todo:
            me = todo.pop()
            axis, *rest = table.nodes[me]
            if axis < 0:
                self.leaf[rest[0]] = me
                continue
            for side, child in enumerate(rest[1:]):
                cell = list(self.cell[me])
                cell[axis + 2 if side == 0 else axis] = rest[0]
                self.cell[child], self.parent[child], self.depth[child] = tuple(cell), me, self.depth[me] + 1
                todo.append(child)

    def above(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.parent[node]
        return node


def _lines(node: int, rings: list[np.ndarray], open_: list[np.ndarray]) -> pa.Table:
    both = rings + open_
    return pa.table({"node": pa.array([node] * len(both), pa.int64()), "closed": pa.array([True] * len(rings) + [False] * len(open_), pa.bool_()), "xy": pa.array([r.ravel() for r in both], pa.list_(pa.float64()))})


def _dealt(polygons: DataFrame, shared) -> DataFrame:
    """(node, side, edges) for each leaf that a polygon reaches: the edges that decide there, none if it covers the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for t in batches:
            out = []
            for side, geom in zip(t["side"].to_pylist(), t["geom"].to_pylist(), strict=True):
                edges = boundary.oriented(kernels.rings_of(geom))
                if not len(edges):
                    continue
                box = np.array([[edges[:, 0].min(), edges[:, [1, 3]].min(), edges[:, 2].max(), edges[:, [1, 3]].max()]])
                # A cell's padding reaches over its border.
                for leaf in np.unique(cells.table.deal(box + np.array([-1, -1, 1, 1]) * 2 * boundary.PAD)[1]).tolist():
                    node = cells.leaf[leaf]
                    near, here = boundary.in_reach(edges, cells.cell[node])
                    if here.any():
                        out.append((node, side, edges[near].ravel()))
                    elif boundary.covers(edges[near], cells.cell[node]):
                        out.append((node, side, np.zeros(0)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.float64()))], names=["node", "side", "edges"])

    dealt = polygons.mapInArrow(run, "node long, side int, edges array<double>")
    # One row says that a layer covers a leaf.
    whole = F.size("edges") == 0
    return dealt.where(~whole).unionAll(dealt.where(whole).distinct())


def _boundaries(dealt: DataFrame, shared, rule) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        node = t["node"][0].as_py()
        cell = shared.value.cell[node]
        side = t["side"].to_numpy()
        edges = [np.asarray(e, float).reshape(-1, 4) for e in t["edges"].to_numpy()]
        covered = tuple(bool(((side == k) & np.array([not len(e) for e in edges])).any()) for k in (0, 1))
        owner = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        pieces = boundary.boundary(np.concatenate(edges), owner, side, cell, rule, covered)
        return _lines(node, *boundary.joined(list(pieces.reshape(-1, 2, 2)), cell))

    # Leaves are few bytes and much work: a number of partitions of their own, which are not coalesced by size.
    return dealt.repartition(min(len(shared.value.leaf), TASKS), "node").groupBy("node").applyInArrow(run, "node long, closed boolean, xy array<double>")


def _stitched(lines: DataFrame, cells: Cells, shared) -> DataFrame:
    """The closed rings (xy): open lines meet in their ancestors' cells, ``LEVELS`` of the tree at a time."""

    def run(t: pa.Table) -> pa.Table:
        node = t["node"][0].as_py()
        return _lines(node, *boundary.joined([np.asarray(x, float).reshape(-1, 2) for x in t["xy"].to_numpy()], shared.value.cell[node]))

    closed, depth = lines.where("closed").select("xy"), max(cells.depth.values())
    while depth > 0:
        depth = max(0, depth - LEVELS)

        def raised(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for t in batches:
                up = [shared.value.above(n, depth) for n in t["node"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), t["xy"]], names=["node", "xy"])

        open_ = lines.where("not closed").select("node", "xy").mapInArrow(raised, "node long, xy array<double>")
        lines = written(open_.groupBy("node").applyInArrow(run, "node long, closed boolean, xy array<double>"))
        closed = closed.unionAll(lines.where("closed").select("xy"))
    return closed


def _rings(closed: DataFrame) -> DataFrame:
    """(id, area, xy, bounds, x, y): rings with their signed area and a place on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rings = [boundary.corners(np.asarray(x, float).reshape(-1, 2)) for x in t["xy"].to_numpy(zero_copy_only=False)]
            box = np.array([[*r.min(axis=0), *r.max(axis=0)] for r in rings]).reshape(-1, 4)
            spot = np.array([(r[0] + r[1]) / 2 for r in rings]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.ravel() for r in rings], pa.list_(pa.float64())), pa.array([kernels.signed_area(r) for r in rings], pa.float64()), *(pa.array(c) for c in box.T), *(pa.array(c) for c in spot.T)],
                names=["xy", "area", "xmin", "ymin", "xmax", "ymax", "x", "y"],
            )

    made = closed.mapInArrow(run, "xy array<double>, area double, xmin double, ymin double, xmax double, ymax double, x double, y double")
    return written(made.withColumn("id", F.monotonically_increasing_id()))


def _owners(rings: DataFrame) -> DataFrame:
    """(hole, shell): of the shells around a hole the smallest; a shell's holes are looked at in up to ``SPREAD`` tasks."""
    box = ["xmin", "ymin", "xmax", "ymax"]
    shells, holes = rings.where("area > 0"), rings.where("area < 0")
    pairs = overlapping(holes.select(F.col("id").alias("k"), *box), shells.select(F.col("id").alias("k"), *box))
    asked = pairs.join(holes.select(F.col("id").alias("i"), "x", "y"), "i").groupBy("j", F.pmod(F.xxhash64("i"), F.lit(SPREAD)).alias("salt")).agg(F.collect_list(F.struct("i", "x", "y")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            found = []
            for shell, size, xy, asked in zip(t["j"].to_pylist(), t["area"].to_pylist(), t["xy"].to_numpy(zero_copy_only=False), t["asked"].to_pylist(), strict=True):
                ring = np.asarray(xy, float).reshape(-1, 2)
                spots = np.array([(a["x"], a["y"]) for a in asked])
                held = kernels.inside(spots, kernels._edges([ring]))
                found += [(a["i"], shell, size) for a, h in zip(asked, held, strict=True) if h]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["hole", "shell", "size"])

    tried = asked.join(shells.select(F.col("id").alias("j"), "area", "xy"), "j").mapInArrow(run, "hole long, shell long, size double")
    return tried.groupBy("hole").agg(F.min(F.struct("size", "shell"))["shell"].alias("shell"))


def _points(xy: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(xy) - 2, F.lit(2)), lambda i: F.struct(F.get(xy, i).alias("x"), F.get(xy, i + 1).alias("y"))).cast(POINTS)


def overlay(a: DataFrame, b: DataFrame, rule: str, geom: str = "geom", *, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(geom): the polygons of ``rule`` (union, intersection, difference) of what all of ``a`` and all of ``b`` cover.

    Other families, null and empty geometries cover nothing; repeated polygons count once; empty layers are allowed.  A k-d
    table from a bounded sample cuts the plane to leaves of about ``leaf_rows`` polygons; a task takes a leaf, where polygons
    that cover it whole are one flag.  Lines that go on beyond a leaf are joined in ever larger cells, each of which holds only
    what crosses its own border or did cross its children's.  A place under very many *different* outlines stays one leaf.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    sides = [d.select(F.lit(k).alias("side"), F.col(geom).alias("geom")).where(F.col("geom.kind").endswith("Polygon") & (F.size("geom.parts") > 0)).distinct() for k, d in enumerate((a, b))]
    both = written(sides[0].unionAll(sides[1]))
    box = both.select(*[c.alias(k) for k, c in bounds(F.col("geom")).items()])
    n, w, s, e, t = box.agg(F.count("xmin"), F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    if not n:
        return both.select("geom").limit(0)
    centre = box.select(((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"), F.rand(11).alias("h"))
    got = centre.orderBy("h").limit(sample).select("x", "y").toArrow()
    table = SplitTable(np.stack([got["x"].to_numpy(), got["y"].to_numpy()], axis=1), n, leaf_rows)
    cells = Cells(table, (w - 1.0, s - 1.0, e + 1.0, t + 1.0))
    shared = both.sparkSession.sparkContext.broadcast(cells)
    lines = written(_boundaries(_dealt(both, shared), shared, RULES[rule]))
    rings = _rings(_stitched(lines, cells, shared))
    shells, holes = rings.where("area > 0"), rings.where("area < 0")
    if holes.isEmpty():
        held = shells.select("xy", F.array().cast("array<array<double>>").alias("holes"))
    else:
        owned = holes.join(_owners(rings), F.col("id") == F.col("hole")).groupBy("shell").agg(F.array_sort(F.collect_list("xy")).alias("holes"))
        held = shells.join(owned, F.col("id") == F.col("shell"), "left").select("xy", F.coalesce("holes", F.array().cast("array<array<double>>")).alias("holes"))
    parts = F.transform(F.concat(F.array("xy"), "holes"), lambda r, k: F.struct(F.lit(0).alias("part"), k.alias("ring"), _points(r).alias("pts")))
    return held.select(F.struct(F.lit("Polygon").alias("kind"), parts.alias("parts")).cast(GEOM).alias("geom"))


def feature(polygons: DataFrame, geom: str = "geom") -> DataFrame:
    """All polygons as one feature, a MultiPolygon if there are several; none: no row.  The result is one value, so it must fit
    into a row."""
    rows = polygons.groupBy().agg(F.array_sort(F.collect_list(f"{geom}.parts")).alias("g")).where(F.size("g") > 0)
    parts = F.flatten(F.transform("g", lambda g, i: F.transform(g, lambda p: F.struct(i.cast("int").alias("part"), p["ring"].alias("ring"), p["pts"].alias("pts")))))
    return rows.select(F.struct(F.when(F.size("g") > 1, "MultiPolygon").otherwise("Polygon").alias("kind"), parts.alias("parts")).cast(GEOM).alias(geom))

"""Pairs of overlapping bounds through partitions that follow the density of both layers.

A k-d split table, made from a bounded sample of both layers, cuts the plane to leaves of about equal rows.  Bounds are dealt to
the leaves that they touch, a leaf is one task, and a task splits its leaf again and again until few rows are left to compare.
A leaf that stays too full, because the sample was too coarse or because its bounds lie over each other, is laid out as a grid of
tasks, so that no task holds more than a few times the rows of a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import written

BOUNDS = ("xmin", "ymin", "xmax", "ymax")
LEAF_ROWS, SAMPLE, SMALL = 16_384, 100_000, 20_000
TASK_ROWS = 32_768
#: Rows of a leaf whose task does more with its pairs than to name them.
MADE_ROWS = 2048


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, for steps that do much with each row.

    Tasks that read files follow their row groups: a compact table of millions of rows may be one task.  Rows are dealt by
    their place, so equal ones do not meet.
    """
    tasks = -(-df.count() // rows)
    return df if tasks < 2 else df.withColumn("__place", F.xxhash64(F.monotonically_increasing_id())).repartition(tasks, "__place").drop("__place")


class SplitTable:
    """Cuts of the plane by a k-d tree over sampled centres: inner nodes (axis, cut, below, above), leaves (-1, leaf)."""

    def __init__(self, centres: np.ndarray, rows: int, leaf_rows: int):
        most = max(1, int(leaf_rows * len(centres) / max(1, rows)))
        self.nodes: list[tuple] = []
        self.lower: list[tuple[float, float]] = []  # of each leaf: the least x and y of a pair's corner there
        self._split(centres, most, (-np.inf, -np.inf))

    def _split(self, p: np.ndarray, most: int, lower: tuple[float, float]) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(p) > most:
            for axis in np.argsort(p.min(axis=0) - p.max(axis=0)).tolist():
                cut = float(np.median(p[:, axis]))
                below = p[:, axis] < cut
                if not below.any():  # over half of the centres agree: cut behind them
                    above = p[:, axis][p[:, axis] > cut]
                    if not len(above):
                        continue
                    cut = float(above.min())
                    below = p[:, axis] < cut
                raised = (cut, lower[1]) if axis == 0 else (lower[0], cut)
                self.nodes[me] = (axis, cut, self._split(p[below], most, lower), self._split(p[~below], most, raised))
                return me
        self.nodes[me] = (-1, len(self.lower))
        self.lower.append(lower)
        return me

    def deal(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that a row of bounds (n, 4) touches."""
        rows, leaves, todo = [], [], [(0, np.arange(len(b)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            axis, *rest = self.nodes[node]
            if axis < 0:
                rows.append(at)
                leaves.append(np.full(len(at), rest[0], np.int64))
            else:
                cut, below, above = rest
                todo += [(below, at[b[at, axis] < cut]), (above, at[b[at, axis + 2] >= cut])]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *leaves])


def local_pairs(a: np.ndarray, b: np.ndarray, lower: tuple[float, float] = (-np.inf, -np.inf), dense: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of a, of b) whose bounds share a point, each pair once; ``lower``: only pairs whose lower left corner of the
    intersection is not below it."""
    found, todo = [], [(np.arange(len(a)), np.arange(len(b)), lower)]
    while todo:
        i, j, low = todo.pop()
        size = len(i) * len(j)
        if not size:
            continue
        if size > dense:
            p, best = (a[i], b[j]), None
            spread = [max(s[:, k + 2].max() for s in p) - min(s[:, k].min() for s in p) for k in (0, 1)]
            for axis in np.argsort(spread)[::-1].tolist():
                side = p[0] if len(i) >= len(j) else p[1]
                cut = float(np.median((side[:, axis] + side[:, axis + 2]) / 2))
                halves = [(i[p[0][:, axis] < cut], j[p[1][:, axis] < cut]), (i[p[0][:, axis + 2] >= cut], j[p[1][:, axis + 2] >= cut])]
                work = sum(len(x) * len(y) for x, y in halves)
                if work <= 0.8 * size:
                    best = halves, (max(low[0], cut), low[1]) if axis == 0 else (low[0], max(low[1], cut))
                    break
            if best:
                todo += [(*best[0][0], low), (*best[0][1], best[1])]
                continue
        step = max(1, (1 << 22) // len(j))
        for at in range(0, len(i), step):
            p, q = a[i[at : at + step], None], b[None, j]
            hit = (p[..., 0] <= q[..., 2]) & (p[..., 2] >= q[..., 0]) & (p[..., 1] <= q[..., 3]) & (p[..., 3] >= q[..., 1])
            if low[0] > -np.inf:
                hit &= np.maximum(p[..., 0], q[..., 0]) >= low[0]
            if low[1] > -np.inf:
                hit &= np.maximum(p[..., 1], q[..., 1]) >= low[1]
            x, y = np.nonzero(hit)
            found.append((i[at + x], j[y]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))


def _matrix(t) -> np.ndarray:
    return np.stack([np.asarray(t[c]) for c in BOUNDS], axis=1)


def split_table(sides: tuple[DataFrame, DataFrame], leaf_rows: int, sample: int) -> SplitTable:
    """From the ``sample`` rows of both sides, at most, with the smallest hashes."""
    both = sides[0].select(*BOUNDS).unionAll(sides[1].select(*BOUNDS))
    centre = both.select(((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"), F.rand(11).alias("h"))
    got = centre.orderBy("h").limit(sample).select("x", "y").toArrow()
    return SplitTable(np.stack([got["x"].to_numpy(), got["y"].to_numpy()], axis=1), both.count(), leaf_rows)


def _beside(one: DataFrame, few: pa.Table, few_is_left: bool, schema: str) -> DataFrame:
    """Pairs with a side that is known to be small: it goes to every task."""
    shared = one.sparkSession.sparkContext.broadcast((few["k"].combine_chunks(), _matrix(few)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bounds = shared.value
        for t in batches:
            mine, other = local_pairs(_matrix(t), bounds)
            own, theirs = t["k"].take(pa.array(mine)), keys.take(pa.array(other))
            yield pa.RecordBatch.from_arrays([theirs, own] if few_is_left else [own, theirs], names=["i", "j"])

    return one.mapInArrow(run, schema)


def overlapping(left: DataFrame, right: DataFrame, *, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, small: int = SMALL, make: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table] | None = None, made: str = "") -> DataFrame:
    """Keys (i, j) of the rows of ``left`` and ``right`` (k, xmin, ymin, xmax, ymax) whose bounds share a point, each pair once.

    Rows with a null bound meet nothing; equal rows meet each.  A side of at most ``small`` rows goes to all tasks of the
    other; else both are dealt to leaves.  What the driver holds is bounded by ``small``, or by ``sample`` and the leaves.

    ``make``, with its schema ``made``, replaces the pairs of a task by what it makes of them: it is given the task's rows of
    both sides, whose other columns go along, and the numbers of the rows that meet.  Sides are then always dealt to leaves.
    """
    known = " and ".join(f"{c} is not null" for c in BOUNDS)
    more = [[c for c in d.columns if make and c not in ("k", *BOUNDS)] for d in (left, right)]
    left, right = (d.select("k", *[F.col(c).cast("double") for c in BOUNDS], *m).where(known) for d, m in zip((left, right), more, strict=True))
    kinds = [d.schema["k"].dataType.simpleString() for d in (left, right)]
    schema = f"i {kinds[0]}, j {kinds[1]}"
    for few, other, is_left in () if make else ((right, left, False), (left, right, True)):
        head = few.limit(small + 1).toArrow()
        if len(head) <= small:
            return _beside(other, head, is_left, schema)
    left, right = written(left), written(right)
    table = split_table((left, right), leaf_rows, sample)
    shared = left.sparkSession.sparkContext.broadcast(table)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            leaves, n = np.unique(shared.value.deal(_matrix(t))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(n)], names=["leaf", "n"])

    counts = [{r["leaf"]: r["n"] for r in d.mapInArrow(touched, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()} for d in (left, right)]
    leaves = range(len(table.lower))
    most = 2 * leaf_rows
    grid = np.array([[max(1, -(-c.get(x, 0) // most)) for c in counts] for x in leaves], np.int64)
    grid[[min(c.get(x, 0) for c in counts) == 0 for x in leaves]] = 0  # nothing to meet there
    grids = left.sparkSession.sparkContext.broadcast(grid)

    def dealt(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                rows, leaf = shared.value.deal(_matrix(t))
                cells = grids.value[leaf]
                # Its own line of the grid, by its place in the batch, and all cells of that line.
                line, copies = rows % np.maximum(1, cells[:, side]), np.where(cells[:, 0] > 0, cells[:, 1 - side], 0)
                rows, leaf, line = (np.repeat(x, copies) for x in (rows, leaf, line))
                other = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
                a, b = (line, other) if side == 0 else (other, line)
                task = leaf * (1 << 32) + (a << 16) + b
                out = t.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(task), *out.columns], names=["task", *t.schema.names])

        return run

    def compared(p: pa.Table, q: pa.Table) -> pa.Table:
        i = j = np.zeros(0, np.int64)
        if len(p) and len(q):
            i, j = local_pairs(_matrix(p), _matrix(q), shared.value.lower[p["task"][0].as_py() >> 32])
        if make:
            return make(p, q, i, j)
        return pa.table({"i": p["k"].take(pa.array(i)), "j": q["k"].take(pa.array(j))})

    tasks = [d.mapInArrow(dealt(n), T.StructType([T.StructField("task", T.LongType()), *d.schema.fields])) for n, d in enumerate((left, right))]
    if make:  # small rows with much work: as many partitions as said, not as few as their bytes need
        spark = left.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        tasks = [t.repartition(parts, "task") for t in tasks]
    return tasks[0].groupBy("task").cogroup(tasks[1].groupBy("task")).applyInArrow(compared, made if make else schema)


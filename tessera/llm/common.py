"""What the operators of this subpackage share: word rules, seeded hashing, components; and the core's written tables."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import inspect
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import dropped, shared_folder, written

__all__ = ["WORD", "components", "dropped", "fold", "shared_folder", "table", "tidy", "workers_can_import", "written"]

#: A word is a run of anything but the ASCII blanks; ``bytes.split()`` cuts UTF-8 text by the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def workers_can_import(spark: SparkSession, batch: str = "4m") -> None:
    """Let Python workers import this library in a local session whose driver was started elsewhere, and get texts in Arrow
    batches of bounded bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


@functools.lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL | None:
    """The C library, looked up once a worker: that starts processes."""
    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


_kept = [0]


def _keep_free(size: int) -> None:
    """Let the C library keep up to ``size`` free bytes of its heap, or its usual 128 K, so that it need not get pages from
    the system again, which come zeroed one by one."""
    if size != _kept[0] and (mallopt := getattr(_c_library(), "mallopt", None)):
        mallopt(-1, max(size, 1 << 17))  # M_TRIM_THRESHOLD
        mallopt(-3, min(max(size, 1 << 17), 1 << 25))  # M_MMAP_THRESHOLD
        _kept[0] = size


def give_back() -> None:
    """Hand memory that is free to the system.  Python workers live on between tasks and stages, and what the C library and
    Arrow keep for later adds up over the workers of an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_c_library(), "malloc_trim", None):
        trim(0)


def tidy(function: Callable, kept: int = 0) -> Callable:
    """A function of one or two groups that gives memory back after each.

    ``kept``: free bytes that a worker may keep for its next group, where groups are so many and small that getting memory
    takes a good part of their time.
    """

    def after(*groups):
        _keep_free(kept)
        out = function(*groups)
        if not kept:
            give_back()
        return out

    return (lambda a: after(a)) if len(inspect.signature(function).parameters) == 1 else (lambda a, b: after(a, b))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_can_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as remainder 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def components(edges: DataFrame, rounds: int = 60, hub: int = 1 << 20) -> DataFrame:
    """Connected components of an undirected graph: (node, component), the component named by its smallest node.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; nodes without an edge are absent from the
    result.  Rounds of large-star and small-star contraction, each an aggregate and an equi-join.  The edges of a node
    that has more than ``hub`` of them do not meet in one task: they get its row by broadcast, and there are at most as
    many such nodes as edges by half of ``hub``.  The edges are written to the shared folder after each round, and the
    loop ends when a round leaves them as they were.  No edges: an empty result.
    """

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        hubs = least.where(F.col("n") > hub).select("a", F.col("m").alias("of_hub"))
        rows = rows.select("a", "b").join(F.broadcast(hubs), "a", "left")
        others = rows.where("of_hub is null").select("a", "b").join(least.where(F.col("n") <= hub).select("a", "m"), "a")
        return others.unionAll(rows.where("of_hub is not null").select("a", "b", F.col("of_hub").alias("m")))

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = digest(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        was, seen, now = seen, digest(after), after
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

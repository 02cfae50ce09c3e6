"""Near-duplicate groups by SimHash fingerprints and BK-trees.

Each text gets a 64-bit fingerprint.  Distinct fingerprints are dealt to shards, each shard builds a BK-tree (children
keyed by their Hamming distance to the parent) and a search follows only the edges that the triangle inequality leaves
within the radius.  Two fingerprints that differ in at most r bits agree on one of r + 1 blocks of bits, so a shard is the
set of fingerprints with one block in common: every link is found in some shard, a shard's tree meets only the queries
that can match it, and no tree has to be broadcast whole.  Shards above a size are dealt anew by blocks of their
remaining bits, up to a depth at which their size is bounded by the bits left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, give_back, written


def fingerprint(data: bytes, words: int = 3, seed: int = 42, slab: int = 1 << 16) -> int:
    """SimHash of UTF-8 text, unsigned: a bit is set if it is set in over half the hashes of the word shingles."""
    parts = data.lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), slab):
        h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[at : at + slab], stops[at : at + slab], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, words: int = 3, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) and the ``keep`` columns: the fingerprint of each row's whole text as a signed long; null text counts as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) if t else 0 for t in b["data"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(fp.view(np.int64))], names=[*names, "fp"])
        give_back()

    rows = docs.select(docs[doc_id].alias("doc_id"), *[docs[c] for c in keep or []], docs[text].cast("binary").alias("data"))
    names = rows.columns[:-1]
    return rows.mapInArrow(hashed, f"{rows.select(*names).schema.simpleString()[7:-1]}, fp long")


class BKTree:
    """A BK-tree over distinct fingerprints, its edges flattened into arrays sorted by parent and distance."""

    def __init__(self, values: np.ndarray):
        self.values = values = np.asarray(values, np.uint64)
        edges: list[dict[int, int]] = [{} for _ in values]
        plain = values.tolist()
        for i in range(1, len(plain)):
            at, x = 0, plain[i]
            while True:
                d = (x ^ plain[at]).bit_count()
                after = edges[at].get(d)
                if after is None:
                    edges[at][d] = i
                    break
                at = after
        self.first = np.concatenate(([0], np.cumsum([len(e) for e in edges]))).astype(np.int64)
        flat = [(d, c) for e in edges for d, c in sorted(e.items())]
        self.distance = np.array([d for d, _ in flat], np.int64)
        self.child = np.array([c for _, c in flat], np.int64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, value index) of all matches; all queries descend the tree together."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found_q, found_n = [], []
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            lo, n = self.first[node], self.first[node + 1] - self.first[node]
            edge = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            q, d = np.repeat(q, n), np.repeat(d, n)
            go = np.abs(self.distance[edge] - d) <= radius
            q, node = q[go], self.child[edge[go]]
        return np.concatenate(found_q), np.concatenate(found_n)


def joined_within(values: np.ndarray, radius: int, slab: int = 256) -> np.ndarray:
    """For each of the distinct values the index of the first value of its connected group under links within the radius."""
    parent = np.arange(len(values))
    tree = BKTree(values)
    for at in range(0, len(values), slab):
        q, n = tree.within(values[at : at + slab], radius)
        q = q + at
        while True:
            a, b = parent[q], parent[n]
            if (a == b).all():
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent != (parent := parent[parent])).any():
                pass
    return parent


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask``, in ``parts`` contiguous blocks, each as ``mask`` with that block added."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_links(fps: DataFrame, *, radius: int = 2, largest: int = 2000, depth: int = 3) -> DataFrame:
    """Edges (a, b) that connect exactly those of the distinct fingerprints ``fp`` that links within ``radius`` connect.

    A group of n linked fingerprints in a shard gives n - 1 edges, not its pairs.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of a partition arrive sorted; one that goes on in the next batch is carried over."""
        rest: list[np.ndarray] = []

        def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
            mask, key, fp = rows
            new = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
            out_a, out_b = [], []
            for lo, n in zip(new.tolist(), np.diff(np.append(new, len(fp))).tolist(), strict=True):
                if n > 1:
                    values = fp[lo : lo + n].view(np.uint64)
                    if n == 2:
                        if int(np.bitwise_count(values[0] ^ values[1])) > radius:
                            continue
                        top = np.array([0, 0])
                    else:
                        top = joined_within(values, radius)
                    moved = np.flatnonzero(top != np.arange(n))
                    out_a.append(fp[lo + moved])
                    out_b.append(fp[lo + top[moved]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = [batch[c].to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")]
            rows = [np.concatenate([r, x]) for r, x in zip(rest, rows, strict=True)] if rest else rows
            if len(rows[0]):
                last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                rest = [x[cut:] for x in rows]
                if cut:
                    yield edges([x[:cut] for x in rows])
        if rest and len(rest[0]):
            yield edges(rest)

    spark = fps.sparkSession
    steps = [(0, m) for m in _blocks(0, radius + 1)]
    level, ready = fps.select("fp", F.lit(0).cast("long").alias("mask")), None
    for k in range(depth):
        finer = spark.createDataFrame([(_signed(a), _signed(b)) for a, b in steps], "mask long, finer long")
        level = level.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")).distinct()
        large = None
        if k < depth - 1:
            large = written(level.groupBy("mask", "key").count().where(F.col("count") > largest).select("mask", "key"))
        if large is None or large.isEmpty():
            ready = level if ready is None else ready.unionAll(level)
            break
        few = level.join(large, ["mask", "key"], "left_anti").select("fp", "mask", "key")
        ready = few if ready is None else ready.unionAll(few)
        level = level.join(large, ["mask", "key"], "left_semi").select("fp", "mask")
        steps = [(m, x) for _, m in steps for x in _blocks(m, radius + 1)]
    return ready.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(trees, "a long, b long")


def near_duplicates(docs: DataFrame, *, radius: int = 2, words: int = 3, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row, and with ``keep`` those columns and ``component_fp``, which differs
    between components that share their smallest doc_id: the smallest doc_id reachable by links between fingerprints.

    Null and blank texts have fingerprint zero and link like any other; repeated rows each give a row; a null doc_id
    gives a row but never names a component; other columns are ignored.  An empty table: an empty result.
    """
    own = written(fingerprints(docs, words=words, doc_id=doc_id, text=text, keep=keep))
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(shard_links(fps.select("fp"), radius=radius))
    named = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    named = written(named.select("fp", "group", "least"))
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return own.join(named.join(smallest, "group").select("fp", "group", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *([*keep, F.col("group").alias("component_fp")] if keep else []))

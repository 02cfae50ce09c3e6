"""Best-fit packing of tokenised documents into sequences, certified by dual-feasible-function bounds.

Pieces are dealt evenly to partitions and packed there by best-fit decreasing.  Lower bounds from dual feasible functions
tell how few bins any packing of a partition needs; a partition that meets its bound is finished, and those with a gap
give the documents of their emptiest bins into an exchange, where they are dealt anew and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.tokens import Pieces


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual feasible functions.

    A dual feasible function maps every set of sizes that fits one bin to values that fit one bin, so the sum of the
    mapped sizes, over the capacity, bounds the bins from below.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # Sizes above capacity - e count as whole bins, sizes below e as nothing.
    below, volume = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * size)))
    e = np.arange(1, capacity // 2 + 1)
    whole = below[-1] - below[capacity - e + 1]
    middle = volume[capacity - e + 1] - volume[e]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    # Sizes rounded to multiples of 1/k: x for x (k+1)/C whole, else floor(x (k+1)/C)/k.
    for k in range(1, 41):
        up = size * (k + 1)
        value = np.where(up % capacity == 0, size * k, (up // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, its offset there, number of bins); the fullest open bin that still has room takes an item."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # a bit for each amount of room that some open bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > s:
            if not open_bins[room - s]:
                rooms |= 1 << (room - s)
            open_bins[room - s].append(b)
    return bins, offsets, n


def pieces(docs: DataFrame, *, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of ``capacity`` of which only the first may be shorter.

    (doc_id, piece, start, length, ids_crc32[, ids]); a null text is empty and gives the end id alone.
    """
    ending = int(end).to_bytes(4, "little")

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Pieces()
        for b in batches:
            rows: list[tuple] = []
            for i, t in enumerate(b["text"].to_pylist()):
                ids = memoryview(encoder.ids(t or "") + ending)
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    stop = at + (n - at - 1) % capacity + 1
                    part = ids[4 * at : 4 * stop]
                    rows.append((i, k, at, stop - at, zlib.crc32(part), bytes(part) if with_ids else None))
                    at, k = stop, k + 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            out = [b["doc_id"].take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[5], pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.select(docs[doc_id].alias("d")).schema["d"].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(tokenised, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _packer(capacity: int, step: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def packed(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["length"].to_numpy(np.int64)
        bins, offsets, n_bins = best_fit_decreasing(sizes, capacity)
        gap = n_bins - lower_bound(sizes, capacity)
        given = np.zeros(n_bins, bool)
        if gap and not last:
            given[np.argsort(np.bincount(bins, weights=sizes, minlength=n_bins), kind="stable")[: 4 * gap + 8]] = True
        part = int(group["__part"].iloc[0])
        return group.drop(columns="__part").assign(sequence_id=((step << 30) + part << 30) + bins, offset=offsets, certified=gap == 0, given=given[bins])

    return packed


def pack(items: DataFrame, *, capacity: int = 2048, per_partition: int = 20_000, rounds: int = 3) -> DataFrame:
    """``items`` (any columns, one of them ``length`` from 1 to ``capacity``) with ``sequence_id``, ``offset``, ``certified``.

    ``certified``: the row's partition uses as few bins as any packing of its documents could.  Equal rows are packed
    each; no rows: an empty result.
    """
    waiting, done = items, None
    for k in range(rounds):
        waiting = written(waiting)
        n = waiting.count()
        if k and not n:
            break
        parts, last = max(1, -(-n // per_partition)), k == rounds - 1
        fields = waiting.schema.simpleString()[7:-1]

        dealt = waiting.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
        out = written(dealt.groupBy("__part").applyInPandas(_packer(capacity, k, last), f"{fields}, sequence_id long, offset long, certified boolean, given boolean"))
        kept = out.where("not given").drop("given")
        done = kept if done is None else done.unionAll(kept)
        waiting = out.where("given").select(items.columns)
    return done


def pack_documents(docs: DataFrame, *, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified) of every piece; see ``pieces`` and ``pack``."""
    return pack(pieces(docs, capacity=capacity, doc_id=doc_id, text=text), capacity=capacity)

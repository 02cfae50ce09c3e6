"""Features of large GeoJSON collections, read by Spark's own file splits.

Spark's text reader cuts a file at closing braces and deals its splits to tasks, which start in the middle of a feature or of a
string.  A first pass gives each split's map from the three states that a scanner may be in (outside of strings, inside, after
a backslash) to the state at its end and the levels it opens; folded over a file's splits the maps tell every split its true
state.  A second pass finds the features: whole ones at once, and for those that straddle splits the pieces, put together by
a window over the splits of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OUTSIDE, INSIDE, ESCAPED = range(3)
FEATURE_DEPTH = 2  # levels open around a feature of a collection: its object and its array
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def scan(data: bytes, state: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(state at the end, places of braces and brackets outside of strings, +1 or -1 for each)."""
    b = np.frombuffer(data, np.uint8)
    slash = np.flatnonzero(b == 92)
    escaped = np.zeros(len(b) + 1, bool)
    escaped[0] = state == ESCAPED
    if len(slash):  # of each run of backslashes every other one escapes what follows it
        first = np.flatnonzero(np.diff(slash, prepend=-2) > 1)
        place = np.arange(len(slash)) - np.repeat(first, np.diff(first, append=len(slash)))
        shifted = (slash[first] == 0) & escaped[0]
        place = place + np.repeat(shifted, np.diff(first, append=len(slash)))
        escaped[slash[place % 2 == 0] + 1] = True
    quote = (b == 34) & ~escaped[:-1]
    inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    at = np.flatnonzero(((b | 0x20) == 0x7B) | ((b | 0x20) == 0x7D))  # {, [ and }, ]
    at = at[~inside[at]]
    end = (bool(inside[-1]) if len(b) else state != OUTSIDE) * 1
    if end and escaped[-1]:
        end = ESCAPED
    return end, at, np.where((b[at] | 0x20) == 0x7B, 1, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """(split, its bytes) in stretches: braces are given back to the fragments that they ended."""
    for t in batches:
        keys = list(zip(t["path"].to_pylist(), t["block"].to_pylist(), strict=True))
        values, a = t["value"].to_pylist(), 0
        for z in range(1, len(keys) + 1):
            if z == len(keys) or keys[z] != keys[a]:
                yield keys[a], "".join(f"{v}}}" for v in values[a:z]).encode()
                a = z


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, {}

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": now[0], "block": now[1], **{f"{n}{s}": int(v) for s in range(3) for n, v in zip(("end", "opened"), state[s], strict=True)}}], schema=pa.schema([("path", pa.string()), ("block", pa.int64()), *[(f"{n}{s}", pa.int64()) for s in range(3) for n in ("end", "opened")]]))

    for key, data in _chunks(batches):
        if key != now:
            if now:
                yield row()
            now, state = key, {s: (s, 0) for s in range(3)}
        seen: dict[int, tuple] = {}
        for s, (end, opened) in state.items():
            if end not in seen:
                after, _, steps = scan(data, end)
                seen[end] = after, int(steps.sum())
            state[s] = seen[end][0], opened + seen[end][1]
    if now:
        yield row()


def _folded(maps: pd.DataFrame) -> pd.DataFrame:
    state, depth, out = OUTSIDE, 0, []
    for r in maps.sort_values("block").to_dict("records"):
        out.append((r["path"], r["block"], state, depth))
        state, depth = r[f"end{state}"], depth + r[f"opened{state}"]
    return pd.DataFrame(out, columns=["path", "block", "state", "depth"])


def _pieces(starts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, depth, held, headless, place = None, OUTSIDE, 0, b"", False, 0
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["path", "block", "kind", "place", "text"])

        def close() -> None:
            if now and (held or headless):
                rows.append((*now, MIDDLE if headless else TAIL, place, held.decode()))

        for key, data in _chunks(batches):
            if key != now:
                close()
                now, (state, depth), held, place = key, starts[key], b"", 0
                headless = depth > FEATURE_DEPTH  # the split starts inside a feature
            open_ = bool(held) or headless
            state, at, steps = scan(data, state)
            levels = depth + np.cumsum(steps)
            depth = int(levels[-1]) if len(levels) else depth
            begins = at[(levels == FEATURE_DEPTH + 1) & (steps > 0) & (np.frombuffer(data, np.uint8)[at] == 123)]
            ends = at[(levels == FEATURE_DEPTH) & (steps < 0) & (np.frombuffer(data, np.uint8)[at] == 125)] + 1
            if open_ and len(ends) and (not len(begins) or ends[0] <= begins[0]):
                rows.append((*now, HEAD if headless else WHOLE, place, (held + data[: ends[0]]).decode()))
                held, headless, open_, ends, place = b"", False, False, ends[1:], place + 1
            elif open_:
                held += data
            for a, z in zip(begins, ends, strict=False):
                rows.append((*now, WHOLE, place, data[a:z].decode()))
                place += 1
            if not open_ and len(begins) > len(ends):
                held = data[begins[len(ends)] :]
            if len(rows) > 2000:
                yield out()
        close()
        yield out()

    return run


def features(spark: SparkSession, path: str) -> DataFrame:
    """(path, f): the text of every object in the arrays of the collections at ``path``, whatever the splits.

    Only splits' maps, a row each, and the places where splits begin come to the driver.
    """
    cut = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    maps = cut.mapInArrow(_maps, "path string, block long, " + ", ".join(f"{n}{s} long" for s in range(3) for n in ("end", "opened")))
    starts = {(r["path"], r["block"]): (r["state"], r["depth"]) for r in maps.groupBy("path").applyInPandas(_folded, "path string, block long, state int, depth long").collect()}
    pieces = cut.mapInArrow(_pieces(starts), "path string, block long, kind int, place long, text string")
    order = W.partitionBy("path").orderBy("block", "place")
    straddling = pieces.where(F.col("kind") != WHOLE).withColumn("feature", F.count(F.when(F.col("kind") == TAIL, 1)).over(order))
    joined = straddling.groupBy("path", "feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda p: p["text"]), "").alias("f"))
    return pieces.where(F.col("kind") == WHOLE).select("path", F.col("text").alias("f")).unionByName(joined.select("path", "f"))

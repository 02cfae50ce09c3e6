"""A quality classifier: histogram gradient-boosted trees over document statistics.

Training bins each statistic by its quantiles and grows depth-limited trees from gradient histograms, in numpy, on a
bounded sample of labelled rows.  The trees are complete binary trees flattened into three arrays, through which whole
batches of documents descend at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text_stats import char_classes, duplicate_lines, repeated_words

FEATURES = (
    "log_words", "log_bytes", "mean_word", "log_longest_word", "log_lines", "words_per_line", "dup_lines", "repeats", "distinct_words", "short_words",
    "lower", "upper", "digit", "blank", "symbol", "other", "wide", "stops_per_word", "commas_per_word", "byte_entropy", "symbol_words", "capital_words", "digit_words", "longest_line",
)


def features(data: bytes | None) -> np.ndarray:
    """Statistics of a whole text; a null or empty one gives finite values, mostly zeros."""
    data = data or b""
    words, classes = data.split(), char_classes(data)
    n, chars = max(1, len(words)), max(1, int(classes.sum()))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines, dup = duplicate_lines(data)
    p = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data))
    p = p[p > 0]
    first = np.fromiter([w[0] for w in words], np.uint8, len(words))
    last = np.fromiter([w[-1] for w in words], np.uint8, len(words))
    return np.array([
        np.log1p(len(words)), np.log1p(len(data)), sizes.mean(), np.log1p(sizes.max()), np.log1p(lines), len(words) / max(1, lines), dup / max(1, lines), repeated_words(words) / n, len(set(words)) / n, (sizes <= 3).sum() / n,
        *(classes / chars), (last == 46).sum() / n, (last == 44).sum() / n, -(p * np.log2(p)).sum() if len(p) else 0, np.isin(last, list(b"#*$%&|<>")).sum() / n, ((first >= 65) & (first <= 90)).sum() / n, ((first >= 48) & (first <= 57)).sum() / n, np.log1p(max(map(len, data.split(b"\n")))),
    ])


@dataclass(frozen=True)
class BoostedTrees:
    """``feature`` and ``threshold``: (trees, inner nodes), in heap order; ``leaf``: (trees, leaves); a row goes right if above."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        raw = self.start + self.leaf[trees, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> BoostedTrees:
    """Boost trees on the logistic loss; splits are chosen level by level from histograms of gradients over the bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, f = x.shape
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    raw = np.full(n, start)
    cells = binned + np.arange(f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            slot = ((at - base)[:, None] * (f * bins) + cells).ravel()
            gs, hs = (np.bincount(slot, weights=np.repeat(v, f), minlength=width * f * bins).reshape(width, f, bins).cumsum(axis=2) for v in (g, h))
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, cut = divmod(int(b), bins)
                if gain[k, j, cut] > 1e-6 and cut < len(edges[j]):
                    feature[t, base + k], threshold[t, base + k] = j, edges[j][cut]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf[t] = -rate * np.bincount(at - inner, weights=g, minlength=inner + 1) / (np.bincount(at - inner, weights=h, minlength=inner + 1) + l2)
        raw += leaf[t][at - inner]
    return BoostedTrees(feature, threshold, leaf, start)


def fit(docs: DataFrame, labels: DataFrame, *, target: str = "quality", sample: int = 20_000, seed: int = 11) -> BoostedTrees | None:
    """Train on at most ``sample`` labelled rows, those of the smallest seeded hash; null labels teach nothing.

    A bound on the sample bounds what is broadcast (its ids and labels) and what is collected (its statistics).  Labels of
    ids without a document are left out.  No labelled document: None.
    """
    chosen = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).cast("double").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "y").limit(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.string()), b["y"], pa.array([features(t).tolist() for t in b["data"].to_pylist()], pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("data")).join(F.broadcast(chosen), "doc_id")
    got = rows.mapInArrow(measured, "id string, y double, x array<double>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    if not len(got):
        return None
    return train(np.array(got["x"].to_pylist()), got["y"].to_numpy())


def score(docs: DataFrame, model: BoostedTrees | None, *, keep: list[Column], threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``keep`` columns with ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold`` on).

    Every row gets a score from its whole text, also a null or empty one; without a model it is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, docs[text].cast("binary").alias("__data"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b["__data"].to_pylist()]).reshape(-1, len(FEATURES))
            s = shared.value.scores(x) if shared.value else np.full(len(x), 0.5)
            rest = [c for c in b.schema.names if c != "__data"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    return rows.mapInArrow(scored, f"{rows.drop('__data').schema.simpleString()[7:-1]}, score double, predicted int")

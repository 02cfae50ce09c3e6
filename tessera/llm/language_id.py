"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows, each filter's largest response over a window is
kept, and a softmax layer turns these responses into language probabilities.  The network is trained in numpy on a bounded
sample of labelled documents; all windows of every text are scored, in batches, inside Spark's tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import give_back

LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class ByteConvNet:
    """Weights: ``embed`` (256, e); ``filters`` (widest * e, f), zero beyond a filter's width; ``out`` (f, languages)."""

    languages: tuple[str, ...]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    widest: int
    window: int

    def _responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = windows.shape
        e = self.embed.shape[1]
        x = self.embed[windows].reshape(n, length * e)
        places = length - self.widest + 1
        view = np.lib.stride_tricks.as_strided(x, (n, places, self.widest * e), (x.strides[0], e * x.itemsize, x.itemsize))
        columns = np.ascontiguousarray(view).reshape(n * places, self.widest * e)
        return columns, (columns @ self.filters).reshape(n, places, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities of windows, a uint8 matrix of ``window`` + ``widest`` - 1 columns."""
        _, r = self._responses(windows)
        z = np.maximum(r.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut(data: bytes, window: int, widest: int) -> np.ndarray:
    """All windows over a text: they start ``window`` bytes apart and overlap by ``widest`` - 1, so none of the text's
    byte runs is missed; the last is filled up with zeros."""
    n = max(1, -(-len(data) // window))
    flat = np.zeros(n * window + widest - 1, np.uint8)
    flat[: len(data)] = _LOWER[np.frombuffer(data, np.uint8)]
    return np.lib.stride_tricks.as_strided(flat, (n, window + widest - 1), (window, 1))


def train(texts: list[tuple[str, bytes]], *, widths=(2, 3, 4), per_width: int = 16, embed: int = 8, window: int = 128, epochs: int = 5, seed: int = 7, batch: int = 128, rate: float = 0.004) -> ByteConvNet:
    """Fit the network on (language, window bytes) pairs by Adam on the cross entropy, with equal weight per language."""
    languages = tuple(sorted({k for k, _ in texts}))
    rng = np.random.default_rng(seed)
    widest, f = max(widths), per_width * len(widths)
    mask = np.zeros((widest * embed, f), np.float32)
    for i, w in enumerate(widths):
        mask[: w * embed, i * per_width : (i + 1) * per_width] = 1
    p = {
        "embed": rng.normal(0, 0.5, (256, embed)).astype(np.float32), "filters": (rng.normal(0, 1, mask.shape) / np.sqrt(widest * embed)).astype(np.float32) * mask,
        "bias": np.zeros(f, np.float32), "out": (rng.normal(0, 1, (f, len(languages))) / np.sqrt(f)).astype(np.float32), "out_bias": np.zeros(len(languages), np.float32),
    }
    x = np.zeros((len(texts), window + widest - 1), np.uint8)
    for i, (_, t) in enumerate(texts):
        t = _LOWER[np.frombuffer(t[: x.shape[1]], np.uint8)]
        x[i, : len(t)] = t
    y = np.searchsorted(np.array(languages), np.array([k for k, _ in texts]))
    weight = (len(texts) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            i = order[at : at + batch]
            net = ByteConvNet(languages, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"], widest, window)
            columns, r = net._responses(x[i])
            best = r.argmax(axis=1)
            top = np.take_along_axis(r, best[:, None, :], 1)[:, 0] + p["bias"]
            h = np.maximum(top, 0)
            z = h @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(i)), y[i]] -= 1
            z *= weight[i, None] / len(i)
            g = {"out": h.T @ z, "out_bias": z.sum(0)}
            dh = (z @ p["out"].T) * (top > 0)
            g["bias"] = dh.sum(0)
            rows = (np.arange(len(i))[:, None] * r.shape[1] + best).ravel()
            picked = columns[rows].reshape(len(i), f, -1)
            g["filters"] = np.einsum("nf,nfk->kf", dh, picked) * mask
            back = (dh[:, :, None] * p["filters"].T[None]).reshape(len(i), f, widest, embed)
            at_byte = x[i][np.arange(len(i))[:, None, None], best[:, :, None] + np.arange(widest)]
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], at_byte.ravel(), back.reshape(-1, embed))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteConvNet(languages, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"], widest, window)


def fit(docs: DataFrame, *, per_language: int = 1500, sample: int = 60_000, windows_per_text: int = 4, window: int = 128, seed: int = 7) -> ByteConvNet | None:
    """Train on at most ``per_language`` different texts of each language, and ``sample`` in all, by seeded hash of the text.

    ``docs`` has ``text`` and ``lang``; rows without either teach nothing, and copies of a text teach once.  A language is
    learned however few different texts it has: each gives its texts of the smallest hashes.  With over ``sample``
    languages, those of the most rows are learned, one text each.  Of each sampled text up to ``windows_per_text`` windows
    at seeded places are used, some of them shortened, so what reaches the driver is bounded by the parameters.  No such
    rows: None.
    """
    rows = docs.where("text is not null and lang is not null").select("lang", F.xxhash64("text", F.lit(seed)).alias("h"), "text")
    learned = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    n = learned.count()
    if not n:
        return None
    each = max(1, min(per_language, sample // n))
    # Ranked by hash alone, and cut to so many in each task before they are shuffled; texts are fetched for those that remain.
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= each)
    chosen = F.broadcast(chosen.join(learned.select("lang"), "lang", "left_semi").select("lang", "h"))

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, lang, text in zip(b["h"].to_pylist(), b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = text.encode()
                rng = np.random.default_rng([seed, h % 2**32])
                for k in range(windows_per_text):
                    size = window if k % 2 == 0 else int(rng.integers(12, window))
                    at = int(rng.integers(0, max(1, len(data) - size + 1)))
                    out.append((h, lang, k, data[at : at + size]))
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "lang", "k", "piece"), x, strict=True)) for x in out], schema=pa.schema([("h", pa.int64()), ("lang", pa.string()), ("k", pa.int32()), ("piece", pa.binary())]))

    pieces = rows.join(chosen, ["lang", "h"]).select("h", "lang", "text").mapInArrow(excerpts, "h long, lang string, k int, piece binary")
    got = pieces.groupBy("lang", "h", "k").agg(F.min("piece").alias("piece")).toArrow().sort_by([("h", "ascending"), ("k", "ascending"), ("lang", "ascending")])
    return train(list(zip(got["lang"].to_pylist(), got["piece"].to_pylist(), strict=True)), window=window, seed=seed)


def predict(docs: DataFrame, net: ByteConvNet | None, *, keep: list[Column] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score`` of each whole text.

    Every window is scored; a text's probabilities are the geometric mean of its windows', weighted by their bytes.  A null
    text, one without a letter, or any text when there is no network: ``und`` with score 0.  Very long texts are scored
    in slices of bounded memory.  Columns of ``docs`` may have any names; ``text``, ``lang_pred`` and ``score`` are added
    after ``keep`` has been taken.
    """
    kept = docs.select(*(keep if keep is not None else [docs[c] for c in docs.columns]), docs[text].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = kept.drop("__text").schema.simpleString()[7:-1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            texts = b["__text"].to_pylist()
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            todo: list[tuple[int, np.ndarray, int]] = []
            total = np.zeros((len(texts), len(net.languages) if net else 1))

            def flush() -> None:
                if todo:
                    p = np.log(net.probabilities(np.concatenate([w for _, w, _ in todo])) + 1e-12)
                    at = 0
                    for i, w, n in todo:
                        size = np.full(len(w), float(net.window))
                        size[-1] = n - (len(w) - 1) * net.window
                        total[i] += size @ p[at : at + len(w)]
                        at += len(w)
                    todo.clear()

            waiting, sizes = 0, np.ones(len(texts))
            for i, t in enumerate(texts):
                if net and t and LETTER.search(t):
                    data = t.encode()
                    sizes[i], step = len(data), 128 * net.window
                    for at in range(0, len(data), step):
                        part = data[at : at + step + net.widest - 1]
                        n = min(step, len(data) - at)
                        windows = cut(part, net.window, net.widest)[: -(-n // net.window)]
                        todo.append((i, windows, n))
                        waiting += len(windows)
                        if waiting >= 160:
                            flush()
                            waiting = 0
                    pred[i] = ""
            flush()
            if net:
                p = total / sizes[:, None]
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i in np.flatnonzero(pred == ""):
                    k = int(p[i].argmax())
                    pred[i], score[i] = net.languages[k], float(p[i, k])
            rest = [c for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array(pred, pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"])
        give_back()

    return kept.mapInArrow(label, f"{schema}, lang_pred string, score double" if schema else "lang_pred string, score double")

"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common short words are held against the references of
all languages by the Jensen-Shannon divergence (base 2, so 0 to 1).  A document is kept if, for each of the two, some
language comes near enough.  Short documents have noisy histograms, so each test applies only from a number of words on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import written
from tessera.llm.text_stats import CLASSES, char_classes, duplicate_lines, repeated_words, short_words

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, short array<binary>, short_n array<long>"


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document, null text as empty: ``doc_id``, ``lang`` and the columns of ``STATS`` over the whole text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for data in b["data"].to_pylist():
                data = data or b""
                words, classes = data.split(), char_classes(data)
                short = short_words(words)
                row = (len(words), int(classes.sum() - classes[3]), int(classes[4]), duplicate_lines(data)[1], repeated_words(words), classes.tolist(), list(short), list(short.values()))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "lang", *(x.split()[0] for x in STATS.split(", "))])

    kind = docs.select(docs[doc_id].alias("d")).schema["d"].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[lang].cast("string").alias("lang"), docs[text].cast("binary").alias("data"))
    return rows.mapInArrow(counted, f"doc_id {kind}, lang string, {STATS}")


def base_failed(min_words: int = 50) -> F.Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(stats: DataFrame, *, common: int = 40) -> dict[str, tuple[np.ndarray, dict[bytes, float]]]:
    """For each language: shares of the character classes, and of the ``common`` commonest short words.

    All documents with a language that pass the base rules count.  Ties go to the smaller word.  What is collected are
    ``common`` words and one row of sums for each language there is.
    """
    good = stats.where("lang is not null").where(~base_failed())
    sums = good.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"), *[F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)])
    sums = {r["lang"]: r for r in sums.collect()}
    words = good.select("lang", F.explode(F.arrays_zip("short", "short_n")).alias("w")).groupBy("lang", F.col("w.short").alias("word")).agg(F.sum("w.short_n").alias("n"))
    top = words.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= common)
    out: dict = {k: (np.array([r[c] for c in CLASSES], float) / max(1, sum(r[c] for c in CLASSES)), {}) for k, r in sums.items()}
    for r in top.collect():
        out[r["lang"]][1][bytes(r["word"])] = r["n"] / sums[r["lang"]]["words"]
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The divergence of two distributions over the same cells, base 2."""
    m = (p + q) / 2
    return float(sum((x[i := x > 0] * np.log2(x[i] / m[i])).sum() for x in (p, q)) / 2)


def judged(stats: DataFrame, refs: dict, *, max_char: float, max_word: float, word_guard: int) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, and the least divergences (null where no test applied).

    No references (no labelled document passes the base rules): the base rules alone decide.
    """
    shared = stats.sparkSession.sparkContext.broadcast(refs)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [(chars, list(words), np.append(list(words.values()), max(0.0, 1 - sum(words.values())))) for chars, words in shared.value.values()]
        for b in batches:
            chars, wordy, kept = [], [], []
            for failed, n, classes, short, short_n in zip(*(b[c].to_pylist() for c in ("base_failed", "n_words", "classes", "short", "short_n")), strict=True):
                jc = jw = None
                if not failed and sides:
                    p = np.array(classes, float) / sum(classes)
                    jc = min(jensen_shannon(p, q) for q, _, _ in sides)
                    if n >= word_guard:
                        own = dict(zip(short, short_n, strict=True))
                        hists = [(np.array([own.get(w, 0) for w in names], float) / n, q) for _, names, q in sides]
                        jw = min(jensen_shannon(np.append(h, 1 - h.sum()), q) for h, q in hists)
                chars.append(jc)
                wordy.append(jw)
                kept.append(not failed and (jc is None or jc <= max_char) and (jw is None or jw <= max_word))
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(kept), pa.array(chars, pa.float64()), pa.array(wordy, pa.float64())], names=[*names, "kept", "char_divergence", "word_divergence"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_divergence double, word_divergence double"
    return stats.withColumn("base_failed", base_failed()).mapInArrow(verdicts, schema)


def divergence_rules(docs: DataFrame, *, max_char: float = 0.08, max_word: float = 0.115, word_guard: int = 100, common: int = 40) -> DataFrame:
    """The verdict on every document; see ``judged``.

    Null, empty and blank texts have no words and fail; repeated rows are judged each; a null language only leaves the
    row out of the references; other columns are ignored; no rows: an empty result.
    """
    stats = written(statistics(docs))
    return judged(stats, references(stats, common=common), max_char=max_char, max_word=max_word, word_guard=word_guard)

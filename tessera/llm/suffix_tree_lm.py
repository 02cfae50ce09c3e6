"""Language-model scores from a probabilistic suffix tree over bytes.

A text is the bytes of its words, lower-cased, each word followed by a blank, and one end symbol.  Counts of all
(depth + 1)-byte runs of the training texts give, by their suffixes, the counts of all shorter contexts.  A context of
variable length is a state of the tree if its suffix is one and its next-symbol distribution diverges enough from the
suffix's; next-symbol distributions are smoothed by handing the rest of their mass to that suffix's.  Scoring takes, at each
symbol, the longest state that is a suffix of what came before.

The tree is a table: runs, one level of context length after the other, each level joined with the one below.  Texts are
dealt to blocks; a block asks for its distinct runs and tokens, gets their probabilities and counts by one join, and sums
them up, so that neither a tree nor a vocabulary is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import AtomicType, VariantType

from tessera.llm.common import dropped, written

END = b"\n"  # no word has it, so it can stand for the end of a text and for what comes before its start
SLAB = 1 << 20
#: Contexts of up to this many bytes are states whatever their divergence.
SHORT = 2


def _slabs(texts: list[bytes | None], depth: int) -> Iterator[tuple[list[int], list[list[bytes]], np.ndarray, np.ndarray]]:
    """(texts' indices, their words, bytes with each text led by ``depth`` ends, where each text's symbols start and stop)."""
    index, words, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        w = (t or b"").lower().split()
        index.append(i)
        words.append(w)
        parts.append(b" ".join([*w, END]) if w else END)
        size += len(parts[-1]) + depth
        if size >= SLAB or i == len(texts) - 1:
            lengths = np.array([len(p) for p in parts])
            stops = np.cumsum(lengths + depth)
            yield index, words, np.frombuffer(END * depth + (END * depth).join(parts), np.uint8), np.stack([stops - lengths, stops])
            index, words, parts, size = [], [], [], 0


def _grams(data: np.ndarray, spans: np.ndarray, depth: int) -> np.ndarray:
    """For every symbol of the texts: it and the ``depth`` bytes before, as one number."""
    key = np.zeros(len(data) - depth, np.int64)
    for k in range(depth + 1):
        key <<= 8
        key |= data[k : len(data) - depth + k]
    symbol = np.ones(len(data), bool)
    for k in range(depth):
        symbol[spans[0] - 1 - k] = False
    return key[symbol[depth:]]


def _word_keys(words: list[list[bytes]]) -> np.ndarray:
    """A signed 64-bit hash of each word, and of ``END`` for each text's end token."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter([digest(w) for text in words for w in (*text, END)], np.uint64).view(np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of several tables of (keys, counts)."""
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count[order], first)


RUN, TOKEN = 0, 1


def _asked(depth: int):
    """The distinct runs and tokens of a block's texts, with their counts in those texts that teach."""

    def run(docs: pa.Table) -> pa.Table:
        found: tuple[list, list] = ([], [])
        teach, texts = docs["__teach"].to_pylist(), docs["__data"].to_pylist()
        for teaches in (True, False):
            for _, words, data, spans in _slabs([t for t, x in zip(texts, teach, strict=True) if x == teaches], depth):
                for parts, keys in zip(found, (_grams(data, spans, depth), _word_keys(words)), strict=True):
                    distinct, n = np.unique(keys, return_counts=True)
                    parts.append((distinct, n if teaches else np.zeros_like(n)))
                    if len(parts) == 8:
                        parts[:] = [_added(parts)]
        (runs, r), (tokens, t) = map(_added, found)
        kind = np.repeat(np.array([RUN, TOKEN], np.int8), [len(runs), len(tokens)])
        return pa.table({"block": pa.array(np.full(len(kind), docs["__block"][0].as_py(), np.int32)), "kind": kind, "key": np.concatenate([runs, tokens]), "n": np.concatenate([r, t])})

    return run


def suffix_tree(runs: DataFrame, *, depth: int = 5, gain: float = 6.0) -> DataFrame:
    """(key, p, state) of each run of ``runs`` (key, n): the last byte's probability after the longest state that is a suffix
    of the ``depth`` bytes before, and whether all these bytes are a state.

    ``n`` may be 0 for runs that are only asked for.  A context hands down mass for its number of different next symbols
    (Witten and Bell).  It is a state if it occurs, its suffix is a state, and its count times its divergence from the
    suffix, in nats, is at least ``gain``, or if it has at most ``SHORT`` bytes.  No test depends on the size of the corpus.
    Without any count every byte is equally likely.
    """
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def level(k: int) -> DataFrame:
        if k == depth:
            return runs.select("key", "n")
        return runs.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"))

    below = level(0).select("key", ((F.col("n") + 1) / F.lit(float(total + 256))).alias("p"), F.lit(True).alias("state"))
    for k in range(1, depth + 1):
        under = below.select(F.col("key").alias("suffix"), F.col("p").alias("q"), F.col("state").alias("above"))
        rows = level(k).withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * k) - 1)).join(under, "suffix")
        context = W.partitionBy("context")
        rows = rows.withColumn("context", F.shiftright("key", 8)).withColumn("all", F.sum("n").over(context)).withColumn("kinds", F.count(F.when(F.col("n") > 0, 1)).over(context))
        own = (F.col("n") + F.col("kinds") * F.col("q")) / (F.col("all") + F.col("kinds"))
        rows = rows.withColumn("own", F.when(F.col("all") > 0, own).otherwise(F.col("q")))
        test = F.lit(True) if k <= SHORT else F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("own") / F.col("q"))).otherwise(0.0)).over(context) >= gain
        rows = rows.withColumn("state", F.col("above") & (F.col("all") > 0) & test)
        below = rows.select("key", F.when(F.col("state"), F.col("own")).otherwise(F.col("q")).alias("p"), "state")
    return below


def _scored(depth: int, carried: list[str], train_tokens: int, unseen: float):
    """The texts of a block with their scores, from the block's (kind, key, value)."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kind, key, value = (answers[c].to_numpy() for c in ("kind", "key", "value"))
        tables = []
        for k in (RUN, TOKEN):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(key[own])]
            tables.append((key[own], value[own]))
        (runs, logp), (known, count) = tables
        n = len(docs)
        tokens, seen, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for index, words, data, spans in _slabs(docs["__data"].to_pylist(), depth):
            i = np.array(index)
            symbols = spans[1] - spans[0]
            grams, of = np.unique(_grams(data, spans, depth), return_inverse=True)
            score[i] = np.add.reduceat(logp[np.searchsorted(runs, grams)][of], np.cumsum(symbols) - symbols)
            size = np.array([len(w) + 1 for w in words])
            starts = np.cumsum(size) - size
            distinct, of = np.unique(_word_keys(words), return_inverse=True)
            c = count[np.searchsorted(known, distinct)]
            tokens[i] = size
            seen[i] = np.add.reduceat((c > 0).astype(np.int64)[of], starts)
            base[i] = np.add.reduceat((np.log10(c + 1) + unseen)[of], starts)
        new = {"n_tokens": tokens, "n_known": seen, "train_tokens": np.full(n, train_tokens), "base_score": base, "score": score}
        return pa.Table.from_arrays([*(docs[c] for c in carried), *map(pa.array, new.values())], names=[*carried, *new])

    return run


def learn_and_score(docs: DataFrame, teaches: Column | bool, *, keep: list[Column] | None = None, depth: int = 5, gain: float = 6.0, text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    ``score`` is the log10 probability that the suffix tree gives the text's bytes, from the rows of ``docs`` where
    ``teaches`` holds (null: it does not); the probabilities of all texts add up to one.  ``base_score`` is the text's log10
    probability under add-one frequencies of tokens.  Null and empty texts consist of the end token alone; equal rows are
    scored each; without a teaching row every byte is equally likely; no rows: an empty result.  Other columns are carried
    only as ``keep`` names them.  Tokens are told apart by 64-bit hashes.  ``depth`` is 6 at most, as runs are one number.
    """
    if not 1 <= depth <= 6:
        raise ValueError("contexts have one byte to six")
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    size = docs.select(F.sum(F.octet_length(docs[text]))).first()[0]
    blocks = max(16, -(-int(size or 0) // block_bytes))
    teaches = F.coalesce(teaches if isinstance(teaches, Column) else F.lit(teaches), F.lit(False))
    rows = docs.select(*(keep if keep is not None else [docs[c] for c in docs.columns]), docs[text].cast("binary").alias("__data"), teaches.alias("__teach"), F.pmod(F.xxhash64(*[docs[c] for c in plain]), F.lit(blocks)).cast("int").alias("__block"))
    carried = [c for c in rows.columns if c not in ("__data", "__teach", "__block")]
    asked = written(rows.select("__block", "__data", "__teach").groupBy("__block").applyInArrow(_asked(depth), "block int, kind byte, key long, n long"))
    counts = written(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    tokens = counts.where(F.col("kind") == TOKEN)
    train_tokens, vocabulary = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    tree = suffix_tree(counts.where(F.col("kind") == RUN).select("key", "n"), depth=depth, gain=gain)
    # A float has the digits that a text's score can tell; its double travels in fewer bytes.
    known = written(tree.select(F.lit(RUN).cast("byte").alias("kind"), "key", F.log10("p").cast("float").cast("double").alias("value")).unionAll(tokens.select("kind", "key", F.col("n").cast("double"))))
    answers = written(asked.select("block", "kind", "key").join(known, ["kind", "key"]).select(F.col("block").alias("__block"), "kind", "key", "value"))
    dropped(asked, counts, known)
    fields = rows.select(*carried).schema.simpleString()[7:-1]
    schema = f"{fields}{', ' if fields else ''}n_tokens long, n_known long, train_tokens long, base_score double, score double"
    unseen = -float(np.log10(train_tokens + vocabulary + 1))
    return rows.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(_scored(depth, carried, int(train_tokens), unseen), schema)

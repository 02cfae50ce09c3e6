"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, and how often a pair of ids does.

Python only tokenises.  Texts are cut before single spaces between words, where both tokenizers always end a token, and the
different runs of a unit of texts are encoded once; those which both tokenizers cut alike stand apart.  Everything after that
is Spark's higher-order functions over arrays: ``zip_with`` pairs the tokens of runs cut alike; of the others
``array_intersect`` of the two end arrays gives the common ends, ``transform`` over a ``sequence`` of them slices groups and
crosses their ids to links; ``aggregate`` sums up each text.  Counts of id pairs over the corpus come back by joins.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm.common import written

_CUT = re.compile(r"(?<=\S) (?=\S)")
SHIFT = 16  # ids of the second tokenizer fit in so many bits


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of several stretches, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class _Encoded:
    """Ids and ends of all runs encoded so far under one tokenizer, one after the other."""

    def __init__(self, names: list[bytes]):
        self.names, self.width = names, np.array([len(x) for x in names], np.int32)
        self.clear()

    def clear(self) -> None:
        self.ids, self.ends, self.first = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, encoded: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.int32, int(lengths.sum()))
        total = np.concatenate(([0], np.cumsum(self.width[ids], dtype=np.int64)))
        before = np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, (total[1:] - np.repeat(total[before], lengths)).astype(np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])

    def tokens(self, runs: np.ndarray) -> np.ndarray:
        return self.first[runs + 1] - self.first[runs]

    def of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each run, ids, ends)."""
        starts, lengths = self.first[runs], self.tokens(runs)
        at = _ragged(starts, lengths)
        return lengths, self.ids[at], self.ends[at]


class Tokenizers:
    """Ids and end offsets of runs under a byte-level BPE and a sentencepiece model; a run stands for a space and itself."""

    def __init__(self, ranks: str, pieces: str, remembered: int = 400_000):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [model.id_to_piece(i) for i in range(len(model))]
        self.a = _Encoded(sorted(known, key=known.get))
        self.b = _Encoded([bytes((int(p[3:5], 16),)) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        #: No piece has a space after another character, so no merge crosses the start of a word.
        self.separable = not any("▁" in p.lstrip("▁") for p in names)
        self.remembered, self.numbers, self.alike = remembered, {}, np.zeros(0, bool)

    def _add(self, runs: list[str]) -> None:
        """Number runs; those of which a tokenizer loses bytes get -1."""
        encoded = [[self.encode(" " + r) for r in runs], self.model.encode(runs, num_threads=1)]
        good, want = [True] * len(runs), b" " + b" ".join([r.encode() for r in runs])
        for ids, one in zip(encoded, (self.a, self.b), strict=True):
            name = one.names.__getitem__
            if b"".join(map(name, chain.from_iterable(ids))) != want:
                good = [g and b"".join(map(name, own)) == b" " + run.encode() for g, own, run in zip(good, ids, runs, strict=True)]
            one.add(ids)
        at = len(self.a.first) - 1 - len(runs)
        new = np.arange(at, at + len(runs))
        same = self.a.tokens(new) == self.b.tokens(new)
        (n, _, ends), (_, _, others) = self.a.of(new[same]), self.b.of(new[same])
        same[same] = np.bincount(np.repeat(np.arange(len(n)), n), ends != others, len(n)) == 0
        self.alike = np.concatenate([self.alike, same])
        self.numbers |= {r: at + k if g else -1 for k, (r, g) in enumerate(zip(runs, good, strict=True))}

    def cut(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of the runs of each text; none if the text has no tokens."""
        if len(self.numbers) > self.remembered:
            self.numbers.clear()
            self.a.clear()
            self.b.clear()
            self.alike = np.zeros(0, bool)
        cuts = [(_CUT.split(t) if self.separable else [t]) if t else [] for t in texts]
        if new := [r for r in set().union(*cuts) if r not in self.numbers]:
            self._add(new)
        out = [list(map(self.numbers.__getitem__, c)) for c in cuts]
        for k, found in enumerate(out):
            if -1 in found:  # only the whole text decides
                if texts[k] not in self.numbers:
                    self._add([texts[k]])
                n = self.numbers[texts[k]]
                out[k] = [n] if n >= 0 else []
        return out


@functools.lru_cache(maxsize=2)
def _tokenizers(ranks: str, pieces: str) -> Tokenizers:
    return Tokenizers(ranks, pieces)


def tokenised(docs: DataFrame, *, doc_id: str, text: str, unit: int, ranks: str, pieces: str) -> DataFrame:
    """(alike_a, alike_b, a, a_ends, b, b_ends, run_ends, docs): a row has texts of about ``unit`` characters.

    Of its different runs come first those whose tokens end alike under both, with the ids of each.  The others stand one
    after the other, with their ids and twice the byte offsets at which ids and runs end; ``docs`` has for each text its
    numbers of tokens and the run at each place (``places``).
    """
    kind = docs.select(docs[doc_id].alias("d")).schema["d"].dataType
    names = ["alike_a", "alike_b", "a", "a_ends", "b", "b_ends", "run_ends", "docs"]

    def lists(offsets: list[int] | np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), values)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        both = _tokenizers(public_tokenizers.path(ranks), public_tokenizers.path(pieces))
        for b in batches:
            texts = b["text"].to_pylist()
            sizes = np.cumsum([len(t or "") for t in texts]) // unit
            for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                cuts = both.cut([texts[i] for i in own])
                stops = np.cumsum([0, *map(len, cuts)])
                every = np.fromiter(chain.from_iterable(cuts), np.int64, stops[-1])
                runs, places = np.unique(every, return_inverse=True)
                alike = both.alike[runs]
                order = np.concatenate([np.flatnonzero(alike), np.flatnonzero(~alike)])
                runs, places = runs[order], np.argsort(order)[places]
                same, runs = np.split(runs, [alike.sum()])
                fields, run_ends = [], None
                for one in (both.a, both.b):
                    n, ids, _ = one.of(same)
                    fields.append(lists([0, len(same)], lists(np.append(0, np.cumsum(n)), pa.array(ids))))
                for one in (both.a, both.b):
                    n, ids, ends = one.of(runs)
                    run_ends = np.cumsum(ends[np.cumsum(n) - 1], dtype=np.int64)
                    ends = ends + np.repeat(np.append(0, run_ends)[:-1], n)
                    fields += [lists([0, len(ids)], pa.array(ids)), lists([0, len(ends)], pa.array(2 * ends))]
                fields.append(lists([0, len(run_ends)], pa.array(2 * run_ends)))
                tokens = [pa.array(np.diff(np.append(0, np.cumsum(one.tokens(every)))[stops])) for one in (both.a, both.b)]
                rows = pa.StructArray.from_arrays([b["doc_id"].slice(own[0], len(own)), *tokens, lists(stops, pa.array(places.astype(np.int32)))], names=["doc_id", "n_a", "n_b", "places"])
                yield pa.RecordBatch.from_arrays([*fields, lists([0, len(rows)], rows)], names=names)

    ids, ends = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.LongType(), False)  # without nulls, as then Spark sorts plain numbers
    types = [T.ArrayType(ids, False), T.ArrayType(ids, False), ids, ends, ids, ends, ends]
    one_doc = T.StructType([T.StructField("doc_id", kind), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("places", ids)])
    schema = T.StructType([T.StructField(n, t, False) for n, t in zip(names, [*types, T.ArrayType(one_doc, False)], strict=True)])
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(encode, schema)


def _marked(ends: str, some: str) -> Column:
    """The ascending ``ends``, which are even, with each of ``some`` of them once more, plus one, just behind."""
    return F.sort_array(F.concat(ends, F.transform(some, lambda e: e + 1)))


def _places(marked: str) -> Column:
    """0 and, from 1, where each marked end stands among the ends.

    ``marked`` must be a column, and is used twice, so that Spark sorts it by generated code in a step of its own.
    """
    at = F.transform(marked, lambda x, i: x.bitwiseAND(1).cast("int") * (i + 1))
    at = F.transform(F.filter(at, lambda y: y > 0), lambda y, k: y - 1 - k)
    return F.when(F.size(marked) > 0, F.concat(F.array(F.lit(0)), at)).otherwise(F.array(F.lit(0)))


def _between(values: str, places: str, k: Column) -> Column:
    """The values from place k to place k + 1."""
    return F.slice(values, F.get(places, k) + 1, F.get(places, k + 1) - F.get(places, k))


def grouped(units: DataFrame) -> DataFrame:
    """(texts, links, sizes, docs): of each run of a unit its groups as text, its links, and the number of its groups."""

    def pair(a: Column, b: Column) -> Column:
        return F.shiftleft(a.cast("long"), SHIFT) + b

    def alike_text(a: Column, b: Column) -> Column:
        names = [x.cast("array<string>") for x in (a, b)]
        return F.array_join(F.zip_with(*names, lambda x, y: F.concat(x, F.lit("|"), y)), ";")

    alike = [F.zip_with("alike_a", "alike_b", f).alias(n) for n, f in (("texts", alike_text), ("links", lambda a, b: F.zip_with(a, b, pair)))]
    alike = F.struct(*alike, F.transform("alike_a", F.size).alias("sizes")).alias("alike")
    units = units.withColumn("common", F.array_intersect("a_ends", "b_ends"))
    marked = [_marked(*x).alias(f"marked_{n}") for n, x in {"a": ("a_ends", "common"), "b": ("b_ends", "common"), "run": ("common", "run_ends")}.items()]
    units = units.select("a", "b", "docs", alike, *marked)
    units = units.select("a", "b", "docs", "alike", *[_places(f"marked_{n}").alias(f"at_{n}") for n in ("a", "b", "run")])
    units = units.select("*", *[F.col(x).cast("array<string>").alias(f"{x}_names") for x in "ab"])

    def one(k: Column) -> Column:
        return (F.get("at_a", k + 1) - F.get("at_a", k) == 1) & (F.get("at_b", k + 1) - F.get("at_b", k) == 1)

    def text(k: Column) -> Column:
        names = [F.when(F.get(f"at_{x}", k + 1) - F.get(f"at_{x}", k) == 1, F.get(f"{x}_names", F.get(f"at_{x}", k))).otherwise(F.array_join(_between(f"{x}_names", f"at_{x}", k), ",")) for x in "ab"]
        return F.concat(names[0], F.lit("|"), names[1])

    def links(k: Column) -> Column:
        crossed = F.flatten(F.transform(_between("a", "at_a", k), lambda a: F.transform(_between("b", "at_b", k), lambda b: pair(a, b))))
        return F.when(one(k), F.array(pair(F.get("a", F.get("at_a", k)), F.get("b", F.get("at_b", k))))).otherwise(crossed)

    last = F.size("at_a") - 2
    each = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    units = units.select("docs", "alike", "at_run", F.transform(each, text).alias("group_texts"), F.transform(each, links).alias("group_links"))
    last = F.size("at_run") - 2
    runs = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    of_run = lambda k: F.get("at_run", k + 1) - F.get("at_run", k)
    texts = lambda k: F.when(of_run(k) == 1, F.get("group_texts", F.get("at_run", k))).otherwise(F.array_join(_between("group_texts", "at_run", k), ";"))
    others = {"texts": F.transform(runs, texts), "links": F.transform(runs, lambda k: F.flatten(_between("group_links", "at_run", k))), "sizes": F.transform(runs, of_run)}
    return units.select(*[F.concat(f"alike.{n}", c).alias(n) for n, c in others.items()], "docs")


def align(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: int = 1 << 17, hot_pairs: int = 500_000, ranks: str = "byte_bpe_50k.tiktoken", pieces: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row's whole text.

    A encodes a space and the text, special strings as plain text; B encodes the text and adds the space.  Byte offsets at
    which both end a token cut the tokens to groups; every A token of a group is linked with every B token of it.  A pair of
    ids counts the rows that link it; ``n_best`` are the links whose count is the highest of their A id, ``count_sum`` sums
    the counts over the links.  Null and empty texts, and those of which a tokenizer loses bytes, have no tokens: zeros and
    ''.  Equal rows count each; null ids are kept; other columns are ignored; no rows: an empty result.

    Counts reach the texts by broadcast for the most frequent pairs, at most ``hot_pairs`` of them, and by an equi-join for
    all others, so that no frequent pair's rows meet in one task.
    """
    units = tokenised(docs, doc_id=doc_id, text=text, unit=unit, ranks=ranks, pieces=pieces)
    units = grouped(units)

    def of_doc(d: Column) -> Column:
        sizes = F.aggregate(d["places"], F.lit(0).cast("long"), lambda n, i: n + F.get("sizes", i))
        whole = F.when(F.size(d["places"]) > 0, F.sha2(F.array_join(F.transform(d["places"], lambda i: F.get("texts", i)), ";"), 256)).otherwise("")
        pairs = F.flatten(F.transform(d["places"], lambda i: F.get("links", i)))
        return F.struct(*[d[c].alias(c) for c in ("doc_id", "n_a", "n_b")], sizes.alias("n_groups"), whole.alias("groups_sha256"), pairs.alias("pairs"))

    each = units.select(F.explode(F.transform("docs", of_doc)).alias("d"))
    aligned = written(each.select(F.monotonically_increasing_id().alias("row"), "d.*", F.size("d.pairs").cast("long").alias("n_links")))

    counts = aligned.select(F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    best = F.col("n") == F.max("n").over(W.partitionBy(F.shiftright("pair", SHIFT)))
    counts = written(counts.withColumn("best", best.cast("long")))
    sizes = {r["power"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()}
    least = next(p for p in range(64) if sum(n for q, n in sizes.items() if q >= p) <= hot_pairs)
    pairs = aligned.select("row", F.explode("pairs").alias("pair"))
    hot = F.broadcast(counts.where(F.col("n") >= 1 << least))
    met = pairs.join(hot, "pair")
    if any(p < least for p in sizes):
        met = met.unionByName(pairs.join(hot.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") < 1 << least), "pair"))
    summed = met.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    whole = aligned.drop("pairs").join(summed, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

"""Phrase collocations: exact counts of the phrases that a sketch cannot rule out.

Texts are dealt to blocks.  Each block hashes its phrases to the slots of a counting sketch and sends, for each slice of the
sketch, the slots it fills, packed; a task per slice adds them up and answers each block with one bit a slot: may its phrases
reach the threshold?  A slot counts all phrases that fall into it, so its sum is an upper bound.  The block compiles its
candidates to automata whose patterns begin and end with a delimiter, counts all their matches, overlaps included, and sends
them packed, a row for each language and shard of phrases; a task per shard sums the counts before thresholds apply.  The sketch has more slices the larger the corpus, so it neither
fills up nor is it ever in one place, and an automaton is bounded by its block.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import dropped, tidy, written

SLICE_BITS = 20
GAP = "\n"  # between pieces and between texts; no word has it
_TABLE = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
_TABLE[9] = 32
_TABLE = bytes(_TABLE)


class Words:
    """The words of all texts of one language in a block, one after the other, with a gap after each piece."""

    def __init__(self, lang: str, texts: list[str]):
        whole = b"\n".join([t.encode().translate(_TABLE) for t in texts]).decode()
        self.lang, self.words = lang, [w for w in re.sub(r"\n+", " \n ", whole).split(" ") if w]
        number = {GAP: 0}
        self.ids = np.fromiter([number.setdefault(w, len(number)) for w in self.words], np.int64, len(self.words))
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.array([digest(w.encode(), seed) for w in number], np.uint64)

    def __len__(self) -> int:
        return int((self.ids > 0).sum())

    def keys(self, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from one word: (which places start a phrase of that length, the phrases' hashes at all places)."""
        h, inside = self.hashes[self.ids], self.ids > 0
        own, whole = h, inside
        out = [(whole, own)]
        for k in range(1, min(longest, len(h))):
            own = ((own[:-1] ^ (own[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) + h[k:]
            own ^= own >> np.uint64(32)
            whole = whole[:-1] & inside[k:]
            out.append((whole, own))
        return out


def _of_block(table: pa.Table) -> Iterator[Words]:
    langs, texts = table["lang"].to_pylist(), table["text"].to_pylist()
    by: dict[str, list[str]] = {}
    for lang, t in zip(langs, texts, strict=True):
        by.setdefault(lang, []).append(t)
    for lang in sorted(by):
        yield Words(lang, by[lang])


def _slots(words: list[Words], longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots that a block's phrases fill, ascending, and how many phrases are in each."""
    parts = [key[whole] for w in words for whole, key in w.keys(longest)]
    slot = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]) >> np.uint64(64 - bits))
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, np.int64)
    return slot[first], np.diff(first, append=len(slot))


def _slices(slots: np.ndarray) -> list[tuple[int, int, int]]:
    """(slice, start, stop) of each slice that has a slot."""
    of = (slots >> np.uint64(SLICE_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of)) + 1
    starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(of)]))
    return list(zip(of[starts].tolist(), starts.tolist(), stops.tolist(), strict=True)) if len(of) else []


def _sketched(longest: int, bits: int, ceiling: int):
    def run(table: pa.Table) -> pa.Table:
        slots, counts = _slots(list(_of_block(table)), longest, bits)
        low, packer = (slots & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32), zstandard.ZstdCompressor(level=1)
        rows = []
        for s, a, b in _slices(slots):
            steps = np.diff(low[a:b], prepend=np.uint32(0)).astype("<u4")
            rows.append((s, b - a, packer.compress(steps.tobytes() + np.minimum(counts[a:b], ceiling).astype("<u2").tobytes())))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        block = table["block"][0].as_py()
        return pa.table({"slice": pa.array(cols[0], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "n": pa.array(cols[1], pa.int32()), "packed": pa.array(cols[2], pa.binary())})

    return run


def _answered(least: int):
    def run(table: pa.Table) -> pa.Table:
        total, unpacker = np.zeros(1 << SLICE_BITS, np.int64), zstandard.ZstdDecompressor()

        def message(k: int) -> tuple[np.ndarray, np.ndarray]:
            n, data = table["n"][k].as_py(), unpacker.decompress(table["packed"][k].as_py())
            return np.cumsum(np.frombuffer(data, "<u4", n)), np.frombuffer(data, "<u2", n, 4 * n)

        for k in range(len(table)):
            at, counts = message(k)
            total[at] += counts
        may = total >= least
        bits = [np.packbits(may[message(k)[0]]).tobytes() for k in range(len(table))]
        return pa.table({"block": table["block"], "slice": table["slice"], "bits": pa.array(bits, pa.binary())})

    return run


def candidates(words: Words, may: np.ndarray, longest: int, bits: int) -> list[str]:
    """The different phrases of which each part may reach the threshold; ``may``: the slots that do, ascending."""

    def open_(key: np.ndarray) -> np.ndarray:
        slot = key >> np.uint64(64 - bits)
        at = np.minimum(np.searchsorted(may, slot), max(0, len(may) - 1))
        return may[at] == slot if len(may) else np.zeros(len(slot), bool)

    out: list[str] = []
    before = np.zeros(0, np.int64)  # of the phrases one word shorter: their numbers by place, -1 if ruled out
    for k, (whole, key) in enumerate(words.keys(longest)):
        if k:
            whole = whole & (before[:-1] >= 0) & (before[1:] >= 0)
        at = np.flatnonzero(whole)
        at = at[open_(key[at])]
        exact = before[at] << 32 | words.ids[at + k] if k else words.ids[at]
        _, first, of = np.unique(exact, return_index=True, return_inverse=True)
        before = np.full(len(key), -1, np.int64)
        before[at] = of
        out += [" ".join(words.words[p : p + k + 1]) for p in at[first].tolist()]
    return out


def matches(words: Words, phrases: list[str], batch: int = 400_000) -> np.ndarray:
    """How often each phrase comes, by automata of at most ``batch`` phrases over the delimited words."""
    text = f" {' '.join(words.words)} "
    found = []
    for a in range(0, len(phrases), batch):
        machine = ahocorasick.Automaton()
        for k, p in enumerate(phrases[a : a + batch]):
            machine.add_word(f" {p} ", k)
        machine.make_automaton()
        found.append(np.bincount(np.fromiter((k for _, k in machine.iter(text)), np.int32), minlength=min(batch, len(phrases) - a)))
    return np.concatenate([np.zeros(0, np.int64), *found])


def _packed(lang: str, phrases: list[str], f: np.ndarray, shards: int) -> pa.Table:
    """(lang, shard, phrases, f): a row has all phrases of a shard, which goes by the phrase's bytes."""
    shard = np.fromiter((zlib.crc32(p.encode()) % shards for p in phrases), np.int32, len(phrases))
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    offsets = pa.array(np.append(first, len(shard)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x.take(pa.array(order))) for x in (pa.array(phrases, pa.string()), pa.array(f.astype(np.int64)))]
    return pa.table([pa.array([lang] * len(first), pa.string()), pa.array(shard[first]), *lists], names=["lang", "shard", "phrases", "f"])


def _counted(longest: int, bits: int, shards: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        every = list(_of_block(table))
        slots, _ = _slots(every, longest, bits)
        bits_of = dict(zip(answers["slice"].to_pylist(), answers["bits"].to_pylist(), strict=True))
        may = [slots[a:b][np.unpackbits(np.frombuffer(bits_of[s], np.uint8), count=b - a).astype(bool)] for s, a, b in _slices(slots)]
        may = np.concatenate([np.zeros(0, np.uint64), *may])
        out = []
        for w in every:
            found = candidates(w, may, longest, bits)
            n = matches(w, found)
            out.append(_packed(w.lang, [*found, ""], np.append(n, len(w)), shards))
        return pa.concat_tables(out)

    return run


def _summed(least: int):
    def run(table: pa.Table) -> pa.Table:
        flat = pa.table([table[c].combine_chunks().flatten() for c in ("phrases", "f")], names=["phrase", "f"])
        flat = flat.group_by("phrase").aggregate([("f", "sum")])
        flat = flat.filter((pc.field("f_sum") >= least) | (pc.field("phrase") == ""))
        return pa.table([pa.repeat(table["lang"][0], len(flat)), flat["phrase"], flat["f_sum"]], names=["lang", "phrase", "f"])

    return run


def counts(docs: DataFrame, *, least: int = 30, longest: int = 4, block_bytes: int = 16 << 20, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, f) of every phrase of up to ``longest`` words with at least ``least`` occurrences; the phrase '' has the
    number of all words."""
    if not 1 <= least <= 65_535 or longest < 2:
        raise ValueError("the threshold is from 1 to 65535, and phrases have two words at least")
    rows = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text"))
    size = int(rows.select(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = max(1, -(-size // block_bytes))
    # About a slot a byte, in at most 2^15 slices, so that a block's messages grow no more numerous than its words.
    bits = SLICE_BITS + min(15, max(0, (size >> SLICE_BITS).bit_length()))
    blocked = written(rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), "lang", "text"))
    sent = blocked.groupBy("block").applyInArrow(tidy(_sketched(longest, bits, least)), "slice int, block int, n int, packed binary")
    answers = written(sent.groupBy("slice").applyInArrow(tidy(_answered(least)), "block int, slice int, bits binary"))
    # Twice as many shards as blocks, so that a shard has about half of what a block sends, however many blocks there are.
    found = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy(_counted(longest, bits, 2 * blocks)), "lang string, shard int, phrases array<string>, f array<long>")
    summed = written(found.groupBy("lang", "shard").applyInArrow(tidy(_summed(least)), "lang string, phrase string, f long"))
    dropped(blocked, answers)
    return summed


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, *, least: int = 30, top: int = 2000, longest: int = 4, covered: int = 80, scale: int = 2_000_000, block_bytes: int = 16 << 20, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``longest`` words.

    Texts are lower-cased (A-Z) and cut at ``[.,;:!?]`` and line breaks; phrases do not cross cuts.  A phrase with a >=
    ``least`` occurrences scores floor(``scale`` a / (l + r)) by the lowest-scoring cut into a first part with l and a rest
    with r occurrences, the smallest first part among equals; n is the language's number of words.  A phrase inside a
    longer one that has at least ``covered`` percent of its occurrences is left out.  Ranks go by score, occurrences and
    the phrase's bytes.  A null language is ``und``, null texts are empty, equal rows count each, other columns are ignored;
    no phrase: an empty result.
    """
    found = counts(docs, least=least, longest=longest, block_bytes=block_bytes, lang=lang, text=text)
    words = F.split("phrase", " ")
    phrases = found.where(F.col("phrase") != "").select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).where(F.size("words") > 1)
    n_words = F.size("words")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), n_words - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("left"), _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"(cast(a as decimal(28,0)) * {scale}) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The parts of two or more words of each longer phrase, with the most occurrences that such a phrase has.
    longer = phrases.where(n_words > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), n_words - 1)).alias("m"))
    longer = longer.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), n_words - F.col("m") + 1)).alias("at"))
    longer = longer.groupBy("lang", _part(F.col("words"), F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(28,0)") * 100 < F.col("a").cast("decimal(28,0)") * covered))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    n = found.where(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Token counts by compiled transducers, without making tokens.

A byte-level BPE tokenizer is compiled to two deterministic transducers.  The first runs over classes of code points and marks
where the tokenizer's pattern starts a piece; all its states are known, so a chunk of the input has a whole state map, and a
parallel prefix scan over the maps of all chunks gives each chunk's first state.  The second runs over the bytes of pieces:
each transition carries the number of tokens that the byte adds to (or, by a longer token, takes from) the piece's tokens.
Its states are made when a piece first needs them, as the full table would have millions, and the table is bounded.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of code points.  The letters of contractions have their own; END stands after each text.
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE, ONE, TWO_E, TWO_L, E, END = range(11)
#: States of the segmenter: START, inside a piece of a kind, a run of blanks whose last is a space (1: the only one, N: not) or
#: another blank, an apostrophe that starts a piece, the same with r or v (needs e) or l (needs l), a contraction that is complete.
START, LETTERS, NUMBERS, OTHERS, SPACE1, SPACEN, BLANK1, BLANKN, QUOTE, QUOTE_E, QUOTE_L, DONE = range(12)
HERE, BEFORE = 1, 2  # marks: a piece starts at this code point, at the one before


@functools.cache
def segmenter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and class, of the pattern of contractions, letters, numbers, others and blanks."""
    step, mark = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    letters = (LETTER, ONE, TWO_E, TWO_L, E)
    fresh = {NUMBER: NUMBERS, OTHER: OTHERS, SPACE: SPACE1, BLANK: BLANK1, APOSTROPHE: QUOTE, END: START} | dict.fromkeys(letters, LETTERS)
    joined = fresh | {APOSTROPHE: OTHERS}  # after a space that belongs to the piece
    stays = {LETTERS: letters, NUMBERS: (NUMBER,), OTHERS: (OTHER, APOSTROPHE)}
    for c in range(11):
        for s in range(12):
            step[s, c], mark[s, c] = fresh[c], HERE
            if c in stays.get(s, ()):
                step[s, c], mark[s, c] = s, 0
            elif s in (SPACE1, SPACEN, BLANK1, BLANKN) and c in (SPACE, BLANK):
                step[s, c], mark[s, c] = SPACEN if c == SPACE else BLANKN, 0
            elif s in (SPACE1, SPACEN) and c != END:
                step[s, c], mark[s, c] = joined[c], BEFORE if s == SPACEN else 0
            elif s == BLANKN and c != END:
                mark[s, c] = BEFORE | HERE
            elif s == QUOTE and c in (OTHER, APOSTROPHE):
                step[s, c], mark[s, c] = OTHERS, 0
            elif s == QUOTE and c in (ONE, TWO_E, TWO_L):
                step[s, c], mark[s, c] = {ONE: DONE, TWO_E: QUOTE_E, TWO_L: QUOTE_L}[c], 0
            elif (s, c) in ((QUOTE_E, E), (QUOTE_L, TWO_L)):
                step[s, c], mark[s, c] = DONE, 0
            elif s in (QUOTE_E, QUOTE_L):  # the apostrophe stood alone, and a letter began a piece
                mark[s, c] = BEFORE if c in letters else BEFORE | HERE
    return step, mark


def prefix_states(maps: np.ndarray, first: int) -> np.ndarray:
    """The state in which each chunk starts, from the state maps (chunks, states) of all: an inclusive scan of compositions in
    log2(chunks) rounds, each of which composes all chunks at once."""
    done, d = maps.copy(), 1
    while d < len(done):
        done[d:] = np.take_along_axis(done[d:], done[:-d].astype(np.intp), axis=1)  # first the earlier chunks' map, then the later's
        d *= 2
    return np.concatenate(([first], done[:-1, first])).astype(np.uint8) if len(done) else np.zeros(0, np.uint8)


def piece_starts(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Which elements of a string of classes start a piece; END elements always do."""
    step, mark = segmenter()
    n = -(-len(classes) // chunk)
    lanes = np.full(n * chunk, END, np.uint8)
    lanes[: len(classes)] = classes
    lanes = np.ascontiguousarray(lanes.reshape(n, chunk).T)
    flat, marks = step.ravel(), mark.ravel()
    maps = np.tile(np.arange(12, dtype=np.uint8), (n, 1))
    for c in lanes:
        maps = flat[maps.astype(np.int16) * 11 + c[:, None]]
    state = prefix_states(maps, START)
    out = np.zeros((chunk, n), np.uint8)
    for k, c in enumerate(lanes):
        at = state.astype(np.int16) * 11 + c
        out[k], state = marks[at], flat[at]
    out = out.T.ravel()[: len(classes)]
    starts = (out & HERE) > 0
    starts[:-1] |= (out[1:] & BEFORE) > 0
    return starts


class MergeTransducer:
    """Tokens of byte strings under byte-pair merges.

    The last token of a prefix's tokens is the one token t that ends there and whose predecessor, the last token before its
    start, stays apart from it when both are merged together.  So a state holds, for each start from which a token may yet
    reach beyond this place, the last token before it and how many tokens fewer there were.  Starts are as far back as the
    longest token at most, so that there are finitely many states, however long the input is.
    """

    def __init__(self, ranks: dict[bytes, int], merge, max_states: int = 1 << 18):
        self.ranks, self.merge, self.max_states = ranks, merge, max_states
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}
        self.apart: dict[tuple, bool] = {}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._clear([])

    def _clear(self, keys: list[tuple]) -> None:
        """Forget all states but the first one and those of ``keys``, and all transitions."""
        self.keys: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.limit = max(self.max_states, 2 * len(keys))
        for tail, starts in [(b"", ((0, None, 0),)), *keys]:
            self._state(tail, starts)
        self._slots(1 << 14)

    def _state(self, tail: bytes, starts: tuple) -> int:
        n = self.number.setdefault((tail, starts), len(self.keys))
        if n == len(self.keys):
            self.keys.append((tail, starts))
        return n

    def _slots(self, n: int) -> None:
        """An empty table of transitions: slots by a multiplicative hash of (state, byte), the next slot if one is taken."""
        self.edge, self.next, self.gain = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int8)
        self.shift, self.edges = np.uint64(65 - n.bit_length()), 0

    def _find(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether it holds the edge) of each edge; if not, the slot is free."""
        slot = ((edge.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.edge[slot]
        there = held == edge
        todo = np.flatnonzero(~there)
        while len(todo := todo[held[todo] >= 0]):
            slot[todo] = (slot[todo] + 1) % len(self.edge)
            held[todo] = self.edge[slot[todo]]
            there[todo] = held[todo] == edge[todo]
            todo = todo[~there[todo]]
        return slot, there

    def _put(self, edge: np.ndarray, target: np.ndarray, gain: np.ndarray) -> None:
        """Enter distinct edges that the table lacks; of those that meet in a slot one is entered at a time."""
        self.edges += len(edge)
        if 3 * self.edges > len(self.edge):
            old, kept = (self.edge, self.next, self.gain), self.edge >= 0
            self._slots(1 << int(4 * self.edges).bit_length())
            edge, target, gain = (np.concatenate([x[kept], y]) for x, y in zip(old, (edge, target, gain), strict=True))
            self.edges = len(edge)
        while len(edge):
            slot, _ = self._find(edge)
            slot, first = np.unique(slot, return_index=True)
            self.edge[slot], self.next[slot], self.gain[slot] = edge[first], target[first], gain[first]
            edge, target, gain = (np.delete(x, first) for x in (edge, target, gain))

    def _stays_apart(self, last: int | None, token: bytes) -> bool:
        known = self.apart.get((last, token))
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            before = b"" if last is None else self.bytes_of[last]
            ids = self.merge(before + token)
            known = self.apart[last, token] = ids == ([self.ranks[token]] if last is None else [last, self.ranks[token]])
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens more) of a state on a byte."""
        tail, starts = self.keys[state]
        tail += bytes((byte,))
        for length, last, fewer in starts:
            token = tail[len(tail) - length - 1 :]
            if token in self.ranks and self._stays_apart(last, token):
                gain = fewer + 1
                break
        kept = [(length + 1, last, fewer - gain) for length, last, fewer in starts if tail[len(tail) - length - 1 :] in self.open]
        return self._state(tail[len(tail) - kept[0][0] :] if kept else b"", (*kept, (0, self.ranks[token], 0))), gain

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and tokens more of many lanes.  Beyond the bound on states those that no lane is in are forgotten."""
        edge = state.astype(np.int64) << 8 | byte
        slot, there = self._find(edge)
        if not there.all():
            if len(self.keys) > self.limit:
                live, of = np.unique(state, return_inverse=True)
                keys = [self.keys[s] for s in live.tolist()]
                self._clear(keys)
                edge = np.array([self.number[k] for k in keys], np.int64)[of] << 8 | byte
                there[:] = False
            new = np.unique(edge[~there])
            self._put(new, *np.array([self._compile(e >> 8, e & 255) for e in new.tolist()], np.int64).T)
            slot, _ = self._find(edge)
        return self.next[slot], self.gain[slot]

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: int = 16) -> np.ndarray:
        """Tokens of each piece of ``data``.  Pieces are lanes that step together, long ones first; the last few step alone."""
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state, n = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        longer = np.searchsorted(-left, -np.arange(int(left[0]) + 1 if len(left) else 0), side="left")  # pieces of over k bytes
        k = 0
        while k < len(longer) and longer[k] > lanes:
            a = longer[k]
            state[:a], more = self._step(state[:a], data[at[:a] + k])
            n[:a] += more
            k += 1
        rest = [self.keys[s] for s in state[: longer[k] if k < len(longer) else 0].tolist()]
        for i, key in enumerate(rest):
            known: dict[tuple, tuple] = {}  # by (key, byte): the states of this piece alone, which has few
            for b in data[at[i] + k : at[i] + left[i]].tolist():
                found = known.get((key, b))
                if found is None:
                    if len(self.keys) > self.limit or len(known) > self.max_states:
                        self._clear([key])
                        known.clear()
                    target, gain = self._compile(self._state(*key), b)
                    found = known[key, b] = self.keys[target], gain
                key = found[0]
                n[i] += found[1]
        out = np.empty(len(at), np.int64)
        out[order] = n
        return out


class TokenCounter:
    """The number of ids that ``tokenizers`` gives a text for a byte-level BPE file, with its special tokens recognised in texts."""

    def __init__(self, path: str, max_states: int = 1 << 18):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        byte_of = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(letters)))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merge = tiktoken.Encoding("merges", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.merges = MergeTransducer(ranks, merge, max_states)
        self._cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110001, 255, np.uint8)
        self.classes[0x110000] = END
        for chars, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", ONE), ("rv", TWO_E), ("l", TWO_L), ("e", E)):
            self.classes[[ord(c) for c in chars]] = kind

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points, those not met before as the tokenizer's own pattern takes them."""
        found = self.classes[points]
        if (found == 255).any():
            for c in np.unique(points[found == 255]).tolist():
                alone = [len(self._cut(x + chr(c))) == 1 for x in "a1!"]
                self.classes[c] = (LETTER, NUMBER, OTHER)[alone.index(True)] if any(alone) else BLANK
            found = self.classes[points]
        return found

    def _count(self, texts: list[str]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        points = np.full(int(sizes.sum()) + len(texts), 0x110000, np.uint32)
        inside = np.ones(len(points), bool)
        inside[ends] = False
        whole = "".join(texts)
        points[inside] = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        width = inside * (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        offset = np.cumsum(width) - width
        first = np.flatnonzero(piece_starts(self._classes(points)))
        lengths = np.diff(offset[first], append=offset[-1])
        real = inside[first]
        n = np.zeros(len(first), np.int64)
        n[real] = self.merges.counts(np.frombuffer(whole.encode(), np.uint8), offset[first[real]], lengths[real])
        return np.diff(np.concatenate(([0], np.cumsum(n)))[np.searchsorted(first, ends, side="right")], prepend=0)

    def counts(self, texts: list[str | None], slab: int = 1 << 21) -> np.ndarray:
        """Token counts of whole texts, in slabs of about ``slab`` characters; longer texts are cut before spaces that start a piece."""
        out = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            np.add.at(out, np.array(owner, np.int64), self._count(parts))
            parts.clear()
            owner.clear()

        for i, text in enumerate(texts):
            several = self.special.split(text) if self.special and text else [text or ""]
            out[i] += len(several) - 1
            for part in several:
                at = 0
                while at < len(part):
                    cut = _SAFE.search(part, at + slab) if len(part) - at > slab else None
                    stop = cut.start() + 1 if cut else len(part)
                    parts.append(part[at:stop])
                    owner.append(i)
                    size += stop - at
                    at = stop
                    if size >= slab:
                        flush()
                        size = 0
        if parts:
            flush()
        return out


_SAFE = re.compile(r"\S(?= \S)")


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    """One a worker process, so that its table serves all tasks of the process."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, *, limit: int = 1024, vocabulary: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text; over_limit: it has more than ``limit`` tokens.

    ``vocabulary`` names a byte-level BPE file of ``public_tokenizers``.  Null and empty texts have no bytes and no tokens;
    equal rows are counted each, null ids are kept, other columns are ignored; no rows: an empty result.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = _counter(public_tokenizers.path(vocabulary))
        for b in batches:
            n = counter.counts(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

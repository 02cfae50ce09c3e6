"""Removal of passages that repeat across documents, by merging shard Burrows-Wheeler transforms.

Every string of ``length`` bytes contains one of the text's winnowed grams (an anchor) at a place that depends on the
string alone.  Anchors of one document only are left out first.  Around each other anchor lies a window that holds all
strings in which it is selected; written with one symbol for the anchor it is ``left # right``, and the strings are its
substrings of ``length - gram + 1`` symbols.  Windows are dealt to buckets by their anchor, so a bucket holds every
occurrence of every such string, and within a bucket to shards by a hash; equal windows are one string of their shard.  Each
shard's suffixes are sorted once, in a task of its own, and only the shard's Burrows-Wheeler transform is sent on.  The
transforms of a bucket are merged by iterative interleave refinement, which sorts no suffixes again; the refinement yields common
prefixes, these the intervals of equal strings, and each interval the smallest document that has the string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, tidy, written

_BYTE = np.random.default_rng(1729).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Symbols of a window: 0 nothing before, 1 its end (twice), bytes from 2 on, 255 the anchor.  UTF-8 has no byte above 0xF4.
ENDS, ANCHOR = b"\xfe\xfe", b"\xff"
_SYMBOL = np.minimum(np.arange(256) + 2, 254).astype(np.uint8)
_SYMBOL[0xFE], _SYMBOL[0xFF] = 1, 255
LARGEST = np.iinfo(np.int64).max
KEPT = 64 << 20  # free bytes a worker keeps from bucket to bucket


def gram_length(length: int) -> int:
    """About half of ``length``, such that a string has an even number of symbols."""
    return length // 2 + (length - length // 2 + 1) % 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each place, by doubling."""
    m, current, have, out, done = 0xD6E8FEB86659FD93, _BYTE[data], 1, None, 0
    while True:
        if k & have:
            if out is None:
                out, done = current, have
            else:
                n = min(len(out), len(current) - done)
                out = out[:n] * np.uint64(pow(m, have, 1 << 64)) + current[done : done + n]
                done += have
        if 2 * have > k:
            return _mixed(out)
        n = len(current) - have
        current = current[:n] * np.uint64(pow(m, have, 1 << 64)) + current[have : have + n]
        have *= 2


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def winnowed(data: np.ndarray, length: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are smallest in some string of ``length`` bytes; equal smallest ones all count.

    ``ends``: where the texts end of which ``data`` is made; no string crosses them.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = gram_length(length)
    h = gram_hashes(data, k)
    w = length - k + 1
    low = _sliding(h, w, np.minimum)
    if ends is not None:
        m = len(low)
        across = np.bincount(np.clip(ends - length + 1, 0, m), minlength=m + 1) - np.bincount(np.minimum(ends, m), minlength=m + 1)
        low[np.cumsum(across[:m]) > 0] = 0
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), w, np.maximum) == h)
    return at, h[at]


SLAB = 1 << 16


def _slabs(texts: list[bytes]) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(joined bytes, first text's number, where each text ends) of runs of texts."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLAB or i == len(texts) - 1:
            yield b"".join(texts[at : i + 1]), at, np.cumsum([len(x) for x in texts[at : i + 1]])
            at, size = i + 1, 0


_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(n: int) -> list[np.ndarray]:
    """The powers of an odd number and of its inverse, from 0 to n."""
    return [np.cumprod(np.where(np.arange(n + 1) > 0, np.uint64(x), np.uint64(1))) for x in (_ODD, pow(_ODD, -1, 1 << 64))]


def _spans(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (starts, stops) that gives 64-bit hashes of stretches of ``data``, wherever they stand."""
    powers, back = _powers(1 << len(data).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[: len(data)])))
    return lambda a, b: _mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))


def transform(windows: list[bytes]) -> np.ndarray:
    """The Burrows-Wheeler transform of windows ``left # right``: for all suffixes in order, the symbol before each.

    Each window ends with two end symbols; windows' ends are told apart and ordered as the windows are.  Suffixes are
    sorted by prefix doubling from five symbols on, those that are not yet told apart.
    """
    sizes = np.array([len(w) for w in windows]) + 2
    text = _SYMBOL[np.frombuffer(ENDS.join(windows) + ENDS, np.uint8)]
    stops = np.cumsum(sizes)
    n = len(text)
    last, here = np.repeat(stops - 1, sizes), np.arange(n)
    key, have = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.int64), 1
    key = key[:-1] << 8 | key[1:]
    key = key[:-2] << 16 | key[2:]
    key = key[:-4] << 8 | (key[4:] >> 24)
    have, bits = 5, n.bit_length()
    key = key[:n] & np.array([~((1 << 8 * max(0, 4 - k)) - 1) for k in range(5)])[np.minimum(last - here, 4)]
    key[stops - 1] = np.arange(len(windows))
    # The place is sorted along with the key; a rank is the place of the first suffix that is equal so far.
    order, rank, place = here.copy(), np.empty(n, np.int64), here
    while len(place):
        packed = np.sort(key << bits | here[: len(place)])
        order[place] = who = order[place[packed & ((1 << bits) - 1)]]
        packed >>= bits
        new = np.concatenate(([True], packed[1:] != packed[:-1], [True]))
        rank[who] = place[np.maximum.accumulate(np.where(new[:-1], here[: len(place)], 0))]
        # Only suffixes that are not told apart go on.
        tied = ~(new[:-1] & new[1:])
        place, who = place[tied], who[tied]
        key = rank[who] * n + rank[np.minimum(who + have, last[who])]
        have *= 2
    before = np.concatenate(([0], text[:-1])).astype(np.uint8)
    before[np.concatenate(([0], stops[:-1]))] = 0
    return before[order]


def last_to_first(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, jump) for each suffix in order: the two symbols before it as one number (0 if there are not two) and the place
    of the suffix that starts with them."""
    m = int((bwt == 0).sum())
    move = np.argsort(bwt, kind="stable")[m:]
    one = np.zeros(len(bwt), np.int32)
    one[move] = m + np.arange(len(move), dtype=np.int32)
    second = bwt[one]
    pair = np.where((bwt > 0) & (second > 0), second.astype(np.uint16) << 8 | bwt, 0).astype(np.uint16)
    return pair, one[one]


def places(bwt: np.ndarray, pair: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, symbols up to its first end) of each suffix in order, read off the transform by walking back from the ends."""
    m = int((bwt == 0).sum())
    window, left = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int16)
    for parity in (0, 1):
        at, who, far = parity * m + np.arange(m), np.arange(m, dtype=np.int32), parity - 1
        while len(at):
            window[at], left[at] = who, far
            on = pair[at] > 0
            at, who, far = jump[at[on]], who[on], far + 2
    return window, left


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(source, interval) of the merged strings of ``depth`` symbols: the shard each is from, and the number of its interval
    of equal strings.

    A shard is (pair, left, start) of its suffixes in order: the two symbols before each, the symbols up to its window's
    end, and its place in the window.  The interleave starts as one shard after another.  A round reads each shard's symbol
    pairs in the order of the interleave and deals the sources out by them, after which suffixes are in order by two more
    symbols; neighbours have a common prefix of so many if their pairs are equal and the suffixes before had one of two
    less.  Only suffixes on the way to a string take part: as many in each round as there are strings.
    """
    ways = [(left >= 0) & (start >= depth) for _, left, start in shards]
    source = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint32), [int(w.sum()) for w in ways])
    n = len(source)
    common, symbols, new = np.zeros(n, np.int32), np.empty(n, np.uint16), np.ones(n, bool)
    for r in range(0, depth, 2):
        pairs = [pair[(left >= r) & (start >= depth - r)] for pair, left, start in shards]
        if len(pairs) == 2:
            second = source.astype(bool)
            symbols[~second], symbols[second] = pairs
        else:
            symbols[np.argsort(source, kind="stable")] = np.concatenate(pairs)
        move = np.argsort(symbols, kind="stable")
        symbol, was, source = symbols[move], common[move], source[move]
        new[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        common = np.cumsum(new, dtype=np.int32)
    return source, common


def smallest_owners(transforms: list[np.ndarray], anchors: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For each window (all shards' in turn) and each of its starts the smallest owner of a window with that string.

    A string is ``depth`` symbols; windows of different ``anchors`` have no string in common.  Starts that a window lacks
    have the largest number.
    """
    shards, names, base = [], [], 0
    for bwt in transforms:
        pair, jump = last_to_first(bwt)
        window, left = places(bwt, pair, jump)
        long = np.zeros(int((bwt == 0).sum()), np.int16)
        long[window[bwt == 0]] = left[bwt == 0]
        start = long[window] - left
        shards.append((pair, left, start))
        whole = left >= depth
        names.append((window[whole] + base, start[whole]))
        base += len(long)
    source, interval = merge(shards, depth)
    out = np.full((len(owner), depth), LARGEST)
    n = len(source)
    if not n:
        return out
    window, start = np.empty(n, np.int32), np.empty(n, np.int16)
    for k, (who, at) in enumerate(names):
        here = source == k if len(names) > 1 else slice(None)
        window[here], start[here] = who, at
    _, named = np.unique(anchors, return_inverse=True)
    bits = n.bit_length()
    packed = np.sort((interval.astype(np.int64) * (int(named.max()) + 1) + named[window]) << bits | np.arange(n))
    order = packed & ((1 << bits) - 1)
    packed >>= bits
    edge = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    least = np.minimum.reduceat(owner[window[order]], edge)
    out[window[order], start[order]] = np.repeat(least, np.diff(np.append(edge, n)))
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers; null ids are the largest."""
    return column.to_numpy() if not column.null_count else np.array([LARGEST if x is None else x for x in column.to_pylist()], np.int64)


def _block_grams(length: int, slices: int) -> Callable:
    """A block's distinct grams, packed for each slice of all hashes: the hashes, then a number for each: 1, or if several
    texts of the block have the gram, its places in them."""

    def run(docs: pa.Table) -> pa.Table:
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for data, at, ends in _slabs([x or b"" for x in docs["data"].to_pylist()]):
            place, h = winnowed(np.frombuffer(data, np.uint8), length, ends)
            rows.append(at + np.searchsorted(ends, place, "right"))
            hashes.append(h)
        row, h = np.concatenate(rows), np.concatenate(hashes)
        order = np.argsort(h)
        h, row = h[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        c = np.diff(np.append(first, len(h)))
        if len(h):
            c[np.minimum.reduceat(row, first) == np.maximum.reduceat(row, first)] = 1
        h, c = h[first], c.astype(np.uint32)
        of = (h % np.uint64(slices)).astype(np.int32)
        order = np.argsort(of, kind="stable")
        h, c, of = h[order], c[order], of[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)])) if len(of) else np.zeros(1, np.int64)
        packed = [h[x:y].tobytes() + c[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.table({"slice": pa.array(of[cuts[:-1]]), "block": pa.array(np.full(len(packed), docs["block"][0].as_py(), np.int32)), "grams": pa.array(packed, pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of a slice's grams those with several places in all: for each block that has some, they and these places, packed."""
    packed = table["grams"].to_pylist()
    sizes = [len(x) // 12 for x in packed]
    h = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(packed, sizes, strict=True)])
    c = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(packed, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(h)
    first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    n = np.empty(len(h), np.int64)
    n[order] = np.repeat(np.add.reduceat(c[order], first), np.diff(np.append(first, len(h))))
    at = np.flatnonzero(n > 1)
    stops = np.searchsorted(at, np.cumsum(sizes))
    pairs = np.split(np.stack([h[at], n[at]], axis=1), stops[:-1])
    some = [k for k, x in enumerate(pairs) if len(x)]
    return pa.table({"block": table["block"].take(pa.array(some, pa.int64())), "grams": pa.array([pairs[k].tobytes() for k in some], pa.binary())})


def _windows(length: int, hot: int, shards: int) -> Callable:
    """The different windows around a block's repeated grams, each once with all its places in the block.

    A gram with over ``hot`` places may stand in any number of different surroundings, so each of its strings is a window of
    its own, whose anchor is the hash of the whole string.
    """
    k = gram_length(length)
    side = length - k

    def run(docs: pa.Table, again: pa.Table) -> pa.Table:
        found: list[tuple] = []
        slabs: list[bytes] = []
        got = np.frombuffer(b"".join(again["grams"].to_pylist()), np.int64).reshape(-1, 2)
        repeated, times = np.ascontiguousarray(got[:, 0]).view(np.uint64), got[:, 1]
        order = np.argsort(repeated)
        repeated, times = repeated[order], times[order]
        for data, at, ends in _slabs([x or b"" for x in docs["data"].to_pylist()] if len(again) else []):
            array = np.frombuffer(data, np.uint8)
            place, h = winnowed(array, length, ends)
            i = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
            there = repeated[i] == h
            place, h, n = place[there], h[there], times[i[there]]
            row = np.searchsorted(ends, place, "right")
            begin = np.concatenate(([0], ends[:-1]))[row]
            a, b = np.maximum(place - side, begin), np.minimum(place + length, ends[row])
            many = np.where(n > hot, b - a - length + 1, 1)
            if (n > hot).any():
                of = np.repeat(np.arange(len(place)), many)
                step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                place, h, n, row, begin = place[of], h[of], n[of], row[of], begin[of]
                a = a[of] + np.where(n > hot, step, 0)
                b = np.where(n > hot, a + length, b[of])
            key = _mixed(_spans(array)(a, b) ^ h * np.uint64(3)) + (place - a).astype(np.uint64)
            found.append((key, np.where(n > hot, _mixed(key), h), n, row + at, a - begin, a, place, b, np.full(len(a), len(slabs))))
            slabs.append(data)
        key, anchor, n, row, lo, a, p, b, slab = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 9
        block, m = docs["block"][0].as_py() if len(docs) else 0, len(key)
        order = np.argsort(key)
        new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if m else np.zeros(0, np.int64)
        # Windows in the order of the text, in which neighbours compress best.
        rank = np.empty(len(new), np.int64)
        rank[np.argsort(np.minimum.reduceat(order, new) if m else new)] = np.arange(len(new))
        group = np.empty(m, np.int64)
        group[order] = np.repeat(rank, np.diff(np.append(new, m)))
        order = np.argsort(group, kind="stable")
        stops = np.cumsum(np.bincount(group, minlength=len(new)))
        first = np.concatenate(([0], stops[:-1]))[: len(new)].astype(np.int64)
        row, some = row[order], order[first]
        owner = _ids(docs["doc_id"])[row]
        contexts = [slabs[i][x:y] + ANCHOR + slabs[i][y + k : z] for i, x, y, z in zip(slab[some].tolist(), a[some].tolist(), p[some].tolist(), b[some].tolist(), strict=True)]
        each = np.stack([owner, docs["key"].to_numpy()[row], lo[order].astype(np.int64)], axis=1)
        least, most = (f.reduceat(owner, first) if m else owner for f in (np.minimum, np.maximum))
        # Equal windows meet in one shard, unless there are too many.
        shard = np.where(n[some] > hot, block % (shards * -(-n[some] // hot)), (key[some] % np.uint64(shards)).astype(np.int64) if m else 0)
        places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.append(first, m) * 24).astype(np.int32)), pa.py_buffer(each)])
        return pa.table({
            "anchor": pa.array(anchor[some].astype(np.uint64).view(np.int64)), "context": pa.array(contexts, pa.binary()), "shard": pa.array(shard.astype(np.int32)), "least": pa.array(least, pa.int64()), "most": pa.array(most, pa.int64()),
            "block": pa.array(np.full(len(first), block, np.int32)), "places": places,
        })

    return run


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


TRANSFORMS = "bucket int, shard int, bwt binary, anchor binary, context binary, least binary, most binary"


def _shard_transform(table: pa.Table) -> pa.Table:
    """One shard of one bucket: its different windows' transform, with each window's names and smallest and largest owner."""
    anchor, contexts = table["anchor"].to_numpy(), table["context"].to_pylist()
    # As Spark's xxhash64 of the bytes.
    context = np.fromiter((xxhash.xxh64_intdigest(c, 42) for c in contexts), np.uint64, len(contexts)).view(np.int64)
    order = np.lexsort((context, anchor))
    new = np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1])))
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(table["least"].to_numpy()[order], first)
    most = np.maximum.reduceat(table["most"].to_numpy()[order], first)
    bwt = transform([contexts[i] for i in order[first].tolist()])
    row = {"bucket": table["bucket"][0], "shard": table["shard"][0], "bwt": _packed(bwt), "anchor": _packed(anchor[order[first]]), "context": _packed(context[order[first]]), "least": _packed(least), "most": _packed(most)}
    return pa.Table.from_arrays([pa.array([v.as_py() if isinstance(v, pa.Scalar) else v], t) for v, t in zip(row.values(), (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=list(row))


def _merged(depth: int) -> Callable:
    """From the transforms of a bucket's shards: for each window the runs of starts whose string an earlier document has."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        transforms = [_unpacked(x, np.uint8) for x in table["bwt"].to_pylist()]
        anchor, context, least, most = (np.concatenate([_unpacked(x, np.int64) for x in table[c].to_pylist()]) for c in ("anchor", "context", "least", "most"))
        first = smallest_owners(transforms, anchor, least, depth)
        # Of equal windows of several shards one speaks for all.
        order = np.lexsort((context, anchor))
        new = np.flatnonzero(np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1]))))
        last, speaks = np.maximum.reduceat(most[order], new), order[new]
        first = first[speaks]
        hit = first < last[:, None]
        edge = hit.copy()
        edge[:, 1:] &= ~hit[:, :-1] | (first[:, 1:] != first[:, :-1])
        w, at = np.nonzero(edge)
        stop = np.ones_like(hit)
        stop[:, :-1] = ~hit[:, 1:] | (first[:, 1:] != first[:, :-1])
        end = np.nonzero(hit & stop)[1]
        return pa.table({"anchor": anchor[speaks[w]], "context_key": context[speaks[w]], "at": at.astype(np.int64), "n": (end - at + 1).astype(np.int64), "first": first[w, at]})

    return run


def _lost(length: int) -> Callable:
    """What the texts lose, of (block, at, n, first, places); the overlapping spans of a text in a batch are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b["places"].to_pylist()
            of = np.repeat(np.arange(len(places)), np.fromiter(map(len, places), np.int64, len(places)) // 24)
            owner, key, lo = np.frombuffer(b"".join(places), np.int64).reshape(-1, 3).T
            lost = owner > b["first"].to_numpy()[of]
            of, key, lo = of[lost], key[lost], lo[lost]
            lo = lo + b["at"].to_numpy()[of]
            stop = lo + b["n"].to_numpy()[of] + (length - 1)
            order = np.lexsort((lo, key))
            of, key, lo, stop = of[order], key[order], lo[order], stop[order]
            # Spans of one text that overlap or touch become one; texts are set apart on one scale.
            apart = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))[: len(key)] * (int(stop.max(initial=0)) + 1)
            reached = np.maximum.accumulate(apart + stop)
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | ((apart + lo)[1:] > reached[:-1])))[: len(key)])
            stop = np.maximum.reduceat(stop, first) if len(first) else stop
            yield pa.RecordBatch.from_arrays([b["block"].take(pa.array(of[first])), pa.array(key[first]), pa.array(lo[first]), pa.array(stop - lo[first])], names=["block", "key", "lo", "size"])

    return run


def _cut(with_text: bool, length: int) -> Callable:
    """Each text of a block with what it loses and keeps."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        docs = docs.sort_by("key")
        texts, keys = [x or b"" for x in docs["data"].to_pylist()], docs["key"].to_numpy()
        key, lo, size = (spans[c].to_numpy() for c in ("key", "lo", "size"))
        order = np.argsort(key, kind="stable")
        key, lo, size = key[order], lo[order], size[order]
        starts, stops = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        out: list[list] = [[] for _ in range(5)]
        for t, a, b in zip(texts, starts.tolist(), stops.tolist(), strict=True):
            runs: list[tuple[int, int]] = []
            if b > a:
                step = np.bincount(lo[a:b], minlength=len(t) + 1) - np.bincount(lo[a:b] + size[a:b], minlength=len(t) + 1)
                runs = _runs(np.cumsum(step[:-1]) > 0)
            at, kept = 0, []
            for x, y in runs:
                kept.append(t[at:x])
                at = y
            left = b"".join([*kept, t[at:]])
            for column, v in zip(out, (len(t), len(t) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None), strict=True):
                column.append(v)
        cols = {"n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "n_spans": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3], pa.string())}
        kept = {c: docs[c] for c in docs.column_names if c not in ("block", "key", "data")}
        return pa.table(kept | cols | ({"kept_text": pa.array(out[4], pa.string())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, *, length: int = 50, keep: list[str] | None = None, with_text: bool = False, block_bytes: int = 14 << 20, slice_bytes: int = 32 << 20, bucket_windows: int = 9000, shards: int = 2, hot: int = 60_000) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with n_bytes, n_removed, n_spans, kept_sha256[, kept_text].

    A byte goes if a string of ``length`` bytes (3 at least) that covers it also starts in a document with a smaller doc_id;
    strings are judged on the input.  Null texts are empty; rows of one doc_id never take from each other; a null doc_id
    counts as the largest.  ``keep`` names more columns to carry.  ``kept_text`` drops bytes of characters that were cut
    apart.

    Texts are dealt to blocks of about ``block_bytes`` by hash.  A slice has the grams of about ``slice_bytes`` of text by
    their hash, at most one row a block, so no gram fills it however many texts have it.  A bucket has about ``bucket_windows`` windows of the blocks
    and at least ``shards`` shards; anchors with over ``hot`` places go string by string, with more shards the more there are, so that no task's rows grow with the number of texts that share a passage, nor with its different surroundings.
    Everything moves as rows whose number follows the input.
    """
    if length < 3:
        raise ValueError("strings of three bytes at least can be compared")
    depth = length - gram_length(length) + 1
    rows = docs.select("doc_id", *[c for c in keep or [] if c != "doc_id"], F.col("text").cast("binary").alias("data"), F.xxhash64("doc_id", "text").alias("key"))
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    blocks = max(16, -(-int(size or 0) // block_bytes))
    dealt = rows.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    slim = dealt.select("block", F.col("doc_id").cast("long").alias("doc_id"), "key", "data")
    slices = max(64, -(-int(size or 0) // slice_bytes))
    grams = slim.groupBy("block").applyInArrow(tidy(_block_grams(length, slices)), "slice int, block int, grams binary")
    again = written(grams.groupBy("slice").applyInArrow(tidy(_repeated), "block int, grams binary"))
    several = again.agg(F.coalesce(F.sum(F.octet_length("grams")), F.lit(0))).first()[0] // 16
    buckets = max(4, -(-int(several) // bucket_windows))
    found = slim.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(tidy(_windows(length, hot, shards)), "anchor long, context binary, shard int, least long, most long, block int, places binary")
    windows = written(found)
    dropped(again)
    parts = windows.select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int").alias("bucket"), "shard", "anchor", "context", "least", "most")
    transforms = written(parts.groupBy("bucket", "shard").applyInArrow(tidy(_shard_transform, KEPT), TRANSFORMS))
    repeats = written(transforms.groupBy("bucket").applyInArrow(tidy(_merged(depth), KEPT), "anchor long, context_key long, at long, n long, first long"))
    dropped(transforms)
    held = windows.select("anchor", F.xxhash64("context").alias("context_key"), "block", "places")
    hits = held.join(repeats, ["anchor", "context_key"]).select("block", "at", "n", "first", "places")
    spans = written(hits.mapInArrow(_lost(length), "block int, key long, lo long, size long"))
    dropped(windows, repeats)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("data", "key"))
    schema = f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(tidy(_cut(with_text, length)), schema)

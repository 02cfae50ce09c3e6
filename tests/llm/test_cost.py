"""What is done again and again is bounded."""

import ctypes.util
import resource
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute

from tessera.llm import common, suffix_dedup


def test_looking_for_the_c_library_starts_processes_once(monkeypatch):
    calls = []
    find = ctypes.util.find_library
    monkeypatch.setattr(ctypes.util, "find_library", lambda name: calls.append(name) or find(name))
    tidy = common.tidy(lambda x: x)
    assert [tidy(k) for k in range(20)] == list(range(20)) and len(calls) <= 1


def test_a_transform_sorts_only_what_is_not_told_apart(monkeypatch):
    """All suffixes once; of different words hardly any again.  The order is that of plain sorted suffixes."""
    rng = np.random.default_rng(2)
    windows = sorted({bytes(rng.integers(97, 123, 25).astype(np.uint8)) + suffix_dedup.ANCHOR + bytes(rng.integers(97, 123, 20).astype(np.uint8)) for _ in range(200)} | {b"ab" * 12 + suffix_dedup.ANCHOR + b"ab" * 10})
    sizes, sort = [], np.sort
    monkeypatch.setattr(suffix_dedup.np, "sort", lambda x, *a, **k: sizes.append(len(x)) or sort(x, *a, **k))
    got = suffix_dedup.transform(windows)
    n = sum(len(w) + 2 for w in windows)
    assert sizes[0] == n and sum(sizes[1:]) < n / 4
    # A suffix's end stands for its window's number, below every other symbol.
    text = [[*suffix_dedup._SYMBOL[np.frombuffer(w, np.uint8)].tolist(), 1] for w in windows]
    suffixes = sorted([([*(x + 1000 for x in t[i:]), k], t[i - 1] if i else 0) for k, t in enumerate(text) for i in range(len(t))] + [([k], 1) for k in range(len(text))])
    assert got.tolist() == [b for _, b in suffixes]


def test_blocks_send_a_row_a_slice_of_their_grams():
    """Not a row a gram; together the slices name every gram that comes in two texts, with all its places."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 3000).astype(np.uint8)) for _ in range(12)]
    texts = [t + texts[(k + 5) % 12][:700] for k, t in enumerate(texts)]
    blocks = [pa.table({"block": pa.array([b] * 4, pa.int32()), "data": pa.array(texts[b::3], pa.binary())}) for b in range(3)]
    sent = pa.concat_tables([suffix_dedup._block_grams(50, 8)(b) for b in blocks])
    assert len(sent) == 3 * 8
    got = pa.concat_tables([suffix_dedup._repeated(sent.filter(pa.compute.equal(sent["slice"], k))) for k in range(8)])
    found = {}
    for block, grams in zip(got["block"].to_pylist(), got["grams"].to_pylist(), strict=True):
        found.setdefault(block, []).extend(map(tuple, np.frombuffer(grams, np.int64).reshape(-1, 2).tolist()))
    own = [[suffix_dedup.winnowed(np.frombuffer(t, np.uint8), 50)[1].view(np.int64).tolist() for t in texts[b::3]] for b in range(3)]
    total = Counter(x for b in own for c in b for x in c)
    several = {x for x in total if sum(x in c for b in own for c in b) > 1}
    assert several and set(found) == {0, 1, 2}
    for b in range(3):
        assert dict(found[b]) == {x: total[x] for c in own[b] for x in c if x in several}


def test_small_groups_use_their_memory_again():
    work = common.tidy(lambda n: sum(int(np.ones(n, np.int64)[0]) for _ in range(3)), 32 << 20)
    work(1 << 20)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    assert [work(1 << 20) for _ in range(10)] == [3] * 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 5000  # 30 arrays of 2048 pages each
    common.tidy(len)([])

"""Counts over one text, as UTF-8 bytes, that the quality operators share."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Character classes: lower, upper, digit, blank, symbol, other ASCII, not ASCII (counted by lead bytes; 7: continuation).
CLASSES = ("lower", "upper", "digit", "blank", "symbol", "other", "wide")
SYMBOLS = b"#*$%&|<>"
CLASS_OF = np.full(256, 5, np.int64)
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58] = 0, 1, 2
CLASS_OF[[32, *range(9, 14)]] = 3
CLASS_OF[list(SYMBOLS)] = 4
CLASS_OF[128:] = 6
CLASS_OF[128:192] = 7


def char_classes(data: bytes) -> np.ndarray:
    """Code points of each class."""
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(CLASS_OF, weights=bytes_of, minlength=8)[:7].astype(np.int64)


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words in n-word windows that are found twice or more, the first included."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    row = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, len(words))
    key = row[: len(row) - n + 1]
    size = len(ids)
    for i in range(1, n):
        key = key * size + row[i : len(row) - n + 1 + i]
        if i < n - 1 and size * (int(key.max()) + 1) > 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(row), bool)
    for i in range(n):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def short_words(words: list[bytes], longest: int = 4) -> Counter:
    """Counts of words of at most ``longest`` letters (ASCII, A-Z lower-cased, or wide characters), by their text."""
    return Counter(w for w in (x.lower() for x in words if len(x) <= 4 * longest) if _short(w, longest))


def _short(w: bytes, longest: int) -> bool:
    if w.isalpha():
        return len(w) <= longest
    if w.isascii():
        return False
    return len(t := w.decode()) <= longest and all("a" <= c <= "z" or ord(c) > 127 for c in t)

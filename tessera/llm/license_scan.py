"""License scans by conditional compression.

Around every cue word stands a candidate block of words, wide enough for any template.  A block is compressed with the wording of
each template as a raw zstandard dictionary; the templates rank by how much smaller it gets than with a neutral dictionary of
the same size.  In that order they are confirmed by exact wording differences, and the first that agrees over a stretch with
the cue word is the notice there.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public license notices.  A license has one or more templates: short statements and the standard header or grant.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)

CUE = r"(?i)licen[cs]|permission|redistribut|free\s+software|creative\s+commons|CC\s+BY"
_CUE = re.compile(CUE)
#: With all words that have a digit: what a small difference in wording may not add or take.
TELLING = frozenset("lesser library affero noncommercial nc sharealike sa noderivatives noderivs nd no not non only without mit apache gnu mozilla creative commons cc by bsd".split())
_WORD = re.compile(r"[A-Za-z0-9.+-]*[A-Za-z0-9]")


#: Words of no license, for baseline dictionaries.
NEUTRAL = "the river ran past an old mill where seven children played until evening came and lamps were lit along each quiet lane of that small town while bakers slept before dawn "


@lru_cache(maxsize=8)
def _compressors(templates: tuple[tuple[str, str], ...], level: int) -> list[tuple]:
    """For each template a compressor with a neutral dictionary of its size, and one with its wording."""

    def one(data: bytes) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    words = [" ".join(wording(t)).encode() for _, t in templates]
    return [(one((NEUTRAL * (len(w) // len(NEUTRAL) + 1)).encode()[: len(w)]), one(w)) for w in words]


@lru_cache(maxsize=10_000)
def ranked(block: str, templates: tuple[tuple[str, str], ...], level: int) -> list[tuple[int, int, int]]:
    """(template, size with the neutral dictionary, size with the template) of a block of wording, the largest reduction first."""
    data = block.encode()
    sizes = [(k, len(plain.compress(data)), len(own.compress(data))) for k, (plain, own) in enumerate(_compressors(templates, level))]
    return sorted(sizes, key=lambda x: (x[2] - x[1], x[0]))


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def differences(template: list[str], block: list[str]) -> tuple[int, int, int, int]:
    """(words of the template that the block lacks, extra words between its first and last match, where these are)."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks()[:-1]
    if not match:
        return len(template), 0, 0, 0
    kept = sum(m.size for m in match)
    first, last = match[0].b, match[-1].b + match[-1].size
    return len(template) - kept, last - first - kept, first, last


@dataclass(frozen=True)
class Found:
    license: str
    template: int
    plain_size: int
    with_template: int
    missing_words: int
    extra_words: int


def _places(own: list[str], words: list[str], joined: str, starts: list[int], allowed: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, end, missing, extra) of the stretches of ``words`` that have a template's wording with ``allowed`` differences.

    Of ``allowed`` + 1 pieces of the template one is verbatim in any such stretch, so only the places of pieces are compared."""
    cuts = [round(i * len(own) / (allowed + 1)) for i in range(allowed + 2)]
    tried = set()
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = f" {' '.join(own[a:b])} "
        at = joined.find(piece)
        while at >= 0:
            first = bisect.bisect_left(starts, at) - a
            if first not in tried:
                tried.add(first)
                lo = max(0, first - allowed)
                missing, extra, x, y = differences(own, words[lo : max(0, first + len(own) + allowed)])
                if missing + extra <= allowed:
                    yield lo + x, lo + y, missing, extra
            at = joined.find(piece, at + 1)


def _telling(words: Iterable[str]) -> Counter:
    """The words that tell licenses and versions apart, which a difference may not touch."""
    return Counter(w for w in words if w in TELLING or any(c.isdigit() for c in w))


def notices(text: str, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, level: int = 6, max_differences: float = 0.05) -> list[tuple[int, int, Found]]:
    """(start, end, found) of every notice of a text, in order; notices do not overlap.

    Words are compared across line breaks and comment marks.  A notice has a cue word; at most ``max_differences`` of its
    template's words may be missing or extra, and none of those that tell licenses or versions apart.  Of the templates that
    agree around a cue the one that ranks first by compression counts, of overlapping notices the one with the largest
    reduction; templates that rank low are confirmed too, if those before them fail, so ranking loses no notice."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    joined, starts = f" {' '.join(words)} ", list(accumulate((len(w) + 1 for w in words), initial=0))
    owns = [wording(t) for _, t in templates]
    reach = max(len(o) + int(max_differences * len(o)) for o in owns)
    cues = dict.fromkeys(bisect.bisect_right(starts, m.end() - 2) - 1 for m in _CUE.finditer(joined))
    found: dict[tuple[int, int], tuple] = {}
    last = (0, 0)
    for cue in cues:
        if last[0] <= cue < last[1]:
            continue
        lo, near = max(0, cue - reach), words[max(0, cue - reach) : cue + reach + 1]
        block, at = f" {' '.join(near)} ", list(accumulate((len(w) + 1 for w in near), initial=0))
        for k, plain, small in ranked(block, templates, level):
            own = owns[k]
            places = [(missing + extra, first, end, missing, extra) for first, end, missing, extra in _places(own, near, block, at, int(max_differences * len(own))) if first <= cue - lo < end]
            places = [p for p in places if not p[0] or _telling(own) == _telling(near[p[1] : p[2]])]
            if places:
                _, first, end, missing, extra = min(places)
                last = lo + first, lo + end
                found[last] = small - plain, *last, Found(templates[k][0], k, plain, small, missing, extra)
                break
    out: list[tuple[int, int, Found]] = []
    for _, first, end, one in sorted(found.values(), key=lambda x: x[:3]):
        if all(end <= x or first >= y for x, y, _ in out):
            out.append((first, end, one))
    return [(spans[x][0], spans[y - 1][1], f) for x, y, f in sorted(out, key=lambda x: x[:2])]


def identify(block: str, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, level: int = 6, max_differences: float = 0.05) -> Found | None:
    """The license of a block: of its ``notices`` the one with the longest template; None if there is none."""
    return max((f for _, _, f in notices(block, templates=templates, level=level, max_differences=max_differences)), key=lambda f: len(wording(templates[f.template][1])), default=None)


def scan(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, max_differences: float = 0.05, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per notice of a text, as ``notices`` finds them.

    (doc_id, line, start, length, license, template, plain_size, with_template, missing_words, extra_words): the number
    from 0 of the line in which the notice starts, the notice's place and length in characters, and the compressed sizes
    of its block.  Every whole text with a cue word is looked at.  Null and empty texts give no rows, repeated rows give theirs
    each, other columns are ignored, and an empty table gives none.
    """
    names = ("line", "start", "length", "license", "template", "plain_size", "with_template", "missing_words", "extra_words")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t in enumerate(b["text"].to_pylist()):
                for x, y, f in notices(t, templates=templates, max_differences=max_differences):
                    rows.append((i, t.count("\n", 0, x), x, y - x, f.license, f.template, f.plain_size, f.with_template, f.missing_words, f.extra_words))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names=["doc_id", *names])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).where(F.col("text").rlike(CUE))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scanned, f"doc_id {kind}, line int, start long, length long, license string, template int, plain_size long, with_template long, missing_words long, extra_words long")

"""Token ids of texts under the 50k byte-level BPE vocabulary.

``tokenizers`` encodes about 1 MB/s a core.  Most of a text is words seen before, and a byte-level BPE cuts its input at
every blank that a non-blank follows, so texts are split there and the ids of pieces are kept; pieces not seen before are
encoded by ``tiktoken`` from the same vocabulary as ranks.  The ids are those of ``tokenizers`` (tests hold them against
it); a text with the vocabulary's special token goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re
from array import array

_UNSAFE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")
SPECIAL = "<|endoftext|>"


class Pieces:
    """An encoder with a memory of up to ``remembered`` pieces, which is emptied when full."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None, remembered: int = 400_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self._exact = Tokenizer.from_file(vocabulary)
        self._known: dict[str, bytes] = {}
        self._remembered = remembered

    def _piece(self, piece: str) -> bytes:
        if len(self._known) >= self._remembered:
            self._known.clear()
        self._known[piece] = ids = array("I", self._fast(" " + piece)).tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if SPECIAL in text:
            return array("I", self._exact.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ") if not _UNSAFE.search(text) else _CUT.split(text)
        known, piece = self._known.get, self._piece
        return array("I", self._fast(first)).tobytes() + b"".join([known(x) or piece(x) for x in rest])

"""Cutting a text where the byte-level pre-tokenizer certainly cuts.

``public_tokenizers.PATTERN`` starts a match at every space that is followed
by something other than white space, and no match runs across such a place.
So a text may be cut before each of these spaces, and equal pieces share one
tokenization.  A piece of letters alone is one match.
"""

from __future__ import annotations

import re

from lowrank.llm.common import by_value

by_value(__name__)

_UNSAFE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")


def pieces(text: str) -> tuple[list[str], list[str]]:
    """(pieces as they are, pieces that follow them, without their space)."""
    if _UNSAFE.search(text):
        return _CUT.split(text), []
    parts = text.split(" ")
    return parts[:1], parts[1:]


class Memo(dict):
    """piece -> bytes: ``solve(lead + piece)``, worked out when first met."""

    def __init__(self, solve, lead: str):
        super().__init__()
        self.solve, self.lead = solve, lead

    def __missing__(self, piece: str) -> bytes:
        got = self[piece] = self.solve(self.lead + piece)
        return got


class SegmentMemo:
    """Bytes of a text joined from those of its pieces; at most ``limit``
    pieces are remembered."""

    def __init__(self, solve, limit: int = 500_000):
        self.plain, self.spaced, self.limit = Memo(solve, ""), Memo(solve, " "), limit

    def __call__(self, text: str) -> bytes:
        if len(self.plain) + len(self.spaced) > self.limit:
            self.plain.clear()
            self.spaced.clear()
        head, tail = pieces(text)
        return b"".join(map(self.plain.__getitem__, head)) + b"".join(map(self.spaced.__getitem__, tail))

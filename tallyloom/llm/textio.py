"""Pieces of texts that can be tokenized apart, and memos of bounded size for them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

#: Unicode White_Space, written out: Python's own classes also hold U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Byte-level pre-tokens never cross these pieces: words with the space before them, and the rest of white-space runs.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts of more characters are handled this many pieces at a time.
LONG, PIECES = 1 << 20, 1 << 16


def blocks(pattern: re.Pattern, text: str) -> Iterator[list[str]]:
    """All matches in order, in lists of bounded length."""
    if len(text) < LONG:
        yield pattern.findall(text)
        return
    found = (m[0] for m in pattern.finditer(text))
    while some := list(islice(found, PIECES)):
        yield some


#: Longer keys are not remembered, so that entries bound the bytes of a memo.
LONGEST = 64


class Memo(dict):
    """What `make` gives for a key. Keeps two generations of `limit` entries, so common keys stay."""

    def __init__(self, make: Callable, limit: int = 150_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def room(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        self.room()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

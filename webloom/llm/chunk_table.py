"""Distinct-chunk tables: segment each distinct marked word once, join ids back by position.

Where no piece of a vocabulary reaches across a boundary, a text's ids are the ids of its
chunks in order.  A worker keeps the chunks it has met in a table (chunk to ids); per text
it only looks its chunks up and joins what it finds.  The table is emptied beyond a bound,
which costs time and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Chunks that one worker remembers, and characters of a chunk beyond which it isn't kept.
MOST_CHUNKS, LONGEST = 200_000, 64


class ChunkTable:
    """Segments of chunks; ``segment`` is called with the distinct chunks of a block that aren't known yet."""

    def __init__(self, segment: Callable[[list[str]], list], most: int = MOST_CHUNKS, emptied: Callable[[], None] = lambda: None):
        self.segment, self.most, self.emptied, self.known = segment, most, emptied, {}

    def lookup(self, texts: list[list[str]]) -> dict:
        """A table that has every chunk of these texts."""
        new = set().union(*texts).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                self.emptied()
                new = set().union(*texts)
            new = list(new)
            found = dict(zip(new, self.segment(new), strict=True))
            if max(map(len, new)) > LONGEST:  # long ones serve this block only
                self.known.update({c: x for c, x in found.items() if len(c) <= LONGEST})
                return self.known | found
            self.known.update(found)
        return self.known


#: A run of markers with the word after it, or a line break alone.
_MARKED = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")


def marked_chunks(text: str) -> list[str]:
    """Chunks of a text with its blanks as markers; joined they are that text (some may be empty)."""
    if "  " in text or "\0" in text or text[:1] == " " or "▁" in text:
        return _MARKED.findall(text.replace(" ", "▁"))
    return text.replace("\n", "\0\n\0").replace(" ", "\0▁").split("\0")


_ODD_SPACE = re.compile(r"\s |\s\Z| \s")


def blank_chunks(text: str) -> list[str] | None:
    """Chunks that begin with their single blank, or None where blanks are not single ones between words."""
    if _ODD_SPACE.search(text) or not text:
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def batches_of(column, size: int = 256) -> Iterator[list]:
    for at in range(0, len(column), size):
        yield column.slice(at, size).to_pylist()

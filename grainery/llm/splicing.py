"""Splicing of encodings of overlapping pieces of one text.

Byte pair encoding has this property: a sequence of tokens is the encoding of its
bytes if and only if every two neighbours in it are the encoding of their own
bytes. (Take the first merge that would cross a border between two neighbours: so far
all merges lay inside tokens, so the two tokens' region has gone through the same
merges as it would alone, and alone it crosses their border as well.)

Two encodings that overlap may therefore be spliced wherever both have a boundary
and the same token after it: all neighbours of the joint sequence are neighbours
in the one or in the other. A piece that starts at a boundary of the one
before it meets it at once, as a rule, also inside words without an end or runs
of one character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


class Piece:
    """The ids of a piece of a text, and where each token starts and ends (lo and hi: the piece's place)."""

    def __init__(self, lo: int, hi: int, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.lo, self.hi, self.ids, self.starts = lo, hi, ids, starts
        #: Whether the token before has ended where a token starts: tokens may share a character's bytes.
        self.clean = np.concatenate([[True], ends[:-1] <= starts[1:]]) if len(ids) else np.zeros(0, bool)

    def boundary(self, place: int) -> int:
        """The last token boundary up to a place, after the piece's start if there is one."""
        i = int(np.searchsorted(self.starts, place, "right")) - 1
        while i > 0 and not self.clean[i]:
            i -= 1
        return int(self.starts[i]) if i > 0 else place

    def index(self, place: int) -> int:
        """The token that starts at a place, or -1."""
        i = int(np.searchsorted(self.starts, place))
        return i if i < len(self.starts) and self.starts[i] == place and self.clean[i] else -1


def splice(left: Piece, right: Piece, edge: int, allowed: Callable[[int], bool]) -> tuple[int, int] | None:
    """Indices in left and right of a boundary in their overlap with the same token after it, if there is one."""
    lo, hi = right.lo + edge, left.hi - edge
    a, b = np.searchsorted(left.starts, [lo, hi])
    places = left.starts[a:b][left.clean[a:b]]
    for place in places.tolist():
        j = right.index(place)
        if j >= 0:
            i = left.index(place)
            if i >= 0 and left.ids[i] == right.ids[j] and allowed(place):
                return i, j
    return None


def joined(size: int, chunk: int, overlap: int, edge: int, encode: Callable[[list[tuple[int, int]]], list[Piece]], allowed: Callable[[int], bool] = lambda place: True, several: int = 1) -> Iterator[np.ndarray]:
    """The ids of a whole text of a size, bit by bit, from encodings of overlapping pieces.

    encode gives the pieces at some places or a little around them. Up to `several` are encoded at once, the first of them from a boundary
    of the piece before. Where no boundary is common, the left piece and the overlap are doubled, so a
    text that has none takes at most a few times its own encoding. What is proven is not encoded again.
    """
    left = encode([(0, min(size, chunk + overlap))])[0]
    first, wide, many, start = 0, overlap, 1, None  # start: the place and the token where the left piece takes over
    while left.hi < size:
        begin = left.boundary(left.hi - wide)
        step = max(chunk, wide)
        places = [begin + step * k for k in range(many)]
        for k, right in enumerate(encode([(a, min(size, a + step + wide)) for a in places if a == begin or a + overlap < size])):
            found = splice(left, right, edge, allowed)
            if found is not None and found[0] < first:
                found = None
            if found is None:
                break
            yield left.ids[first : found[0]]
            first, left = found[1], right
            start = (int(left.starts[first]), int(left.ids[first]))
            wide = overlap
            if left.hi >= size:
                break
        else:
            many = min(2 * many, several)
            continue
        if found is not None:
            continue
        many = 1
        if not k:  # not even a piece that starts at a boundary meets the left one
            wide = 2 * max(wide, overlap)
            left = encode([(left.lo, min(size, left.hi + max(left.hi - left.lo, wide)))])[0]
            if start is not None:  # the place where this piece took over must have stayed
                first = left.index(start[0])
                if first < 0 or left.ids[first] != start[1]:
                    raise Unstable
    yield left.ids[first:]


class Unstable(Exception):
    """A longer piece has another beginning: the text must be encoded whole."""

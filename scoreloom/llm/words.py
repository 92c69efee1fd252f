"""Hashes of all words of a text at once, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
STRETCH = 1 << 20  # bytes that share one table of powers
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, np.int8)
SPACE[[9, 10, 11, 12, 13, 32]] = 1


def powers(base: int, many: int) -> np.ndarray:
    out = np.full(many, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = powers(BASE, STRETCH), powers(pow(BASE, -1, 1 << 64), STRETCH)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in order: runs of anything but the six ASCII spaces, in lower case A-Z.

    A word is a polynomial of its bytes modulo 2^64, read from sums over the whole text: the sum up to its end less that up to its start, times the
    inverse power of its start.
    """
    body = np.frombuffer((text or "").encode(), np.uint8)
    edges = np.flatnonzero(np.diff(SPACE[body], prepend=1, append=1))
    starts, ends = edges[0::2], edges[1::2]
    low = LOWER[body]
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + STRETCH, "right")))
        span = int(ends[last - 1] - origin)
        up, down = (POWERS, INVERSES) if span <= STRETCH else (powers(BASE, span), powers(pow(BASE, -1, 1 << 64), span))
        sums = np.zeros(span + 1, np.uint64)
        np.cumsum((low[origin:origin + span] + np.uint64(1)) * up[:span], out=sums[1:])
        out[first:last] = (sums[ends[first:last] - origin] - sums[starts[first:last] - origin]) * down[starts[first:last] - origin]
        first = last
    return mixed(out)

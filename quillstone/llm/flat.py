"""Words of many texts at once, as flat numpy arrays.

Texts are lower-cased and laid end to end as code points; a word is a run of letters,
marks and digits. Nothing here takes a step per word in Python.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_B1 = np.uint64(0x100000001B3)


@functools.cache
def _table(first: str) -> np.ndarray:
    """Whether each code point's category starts with one of the letters of `first`."""
    return np.fromiter((unicodedata.category(chr(c))[0] in first for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _B1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    points: np.ndarray  #: code points of the lower-cased texts, one separator after each
    start: np.ndarray  #: place of each word's first code point
    end: np.ndarray
    doc: np.ndarray  #: which text each word is of
    bounds: np.ndarray  #: of each text's words: bounds[d]..bounds[d + 1]


def words_of(texts: list[str], first: str = "LMN") -> Words:
    flat = "\0".join([t.lower() for t in texts]) + "\0"
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _table(first)[points]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]  # the last code point is a separator
    # a lower-cased text may be longer than the text
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    bounds = np.r_[0, np.searchsorted(start, ends)]
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(points, start, end, doc, bounds)


def hashes(w: Words, at_once: int = 1 << 15) -> np.ndarray:
    """A 64-bit hash of each word, some words at a time."""
    out = np.zeros(len(w.start), np.uint64)
    for lo in range(0, len(out), at_once):
        start, n = w.start[lo : lo + at_once], (w.end - w.start)[lo : lo + at_once]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)  # place within the word
        powers = _powers(1 << max(10, int(n.max() - 1).bit_length()))
        value = (w.points[np.repeat(start, n) + at].astype(np.uint64) + _ODD) * powers[at]
        out[lo : lo + at_once] = mix(np.add.reduceat(value, np.cumsum(n) - n))
    return out


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of k words within a text."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * _B1 + h[j : len(h) - k + 1 + j]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = doc[: len(out)] == doc[k - 1 :]
    return mix(out[whole]), doc[: len(out)][whole]

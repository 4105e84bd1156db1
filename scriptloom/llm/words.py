"""Words of many texts at once, as arrays: hashes, places and letter case.

A word is a run of letters and digits; case is folded for the hash.  Texts are laid end to
end and handled with NumPy, so the cost of a word is some tens of nanoseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Characters of several texts laid end to end; longer texts are handled alone.
TOGETHER = 250_000
#: Longer texts are cut between words.
SPAN = 1_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: folded, letter or digit, upper case, digit."""
    folded = np.arange(0x110000, dtype=np.uint32)
    word, upper, digit = (np.zeros(0x110000, bool) for _ in range(3))
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            word[i], upper[i], digit[i] = True, c.isupper(), c.isdecimal()
            low = c.lower()
            if len(low) == 1:
                folded[i] = ord(low)
    return folded, word, upper, digit


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _MULTIPLIER, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Arrays with an entry for each word: which text, start and stop there, hash, and
    whether it has only digits, or starts with its only capital.  ``opens``: it is the first
    of a sentence or line.  ``joint``: one of ``.,:/-`` and nothing else is before it."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    number: np.ndarray
    title: np.ndarray
    opens: np.ndarray
    joint: np.ndarray


def _analyse(texts: list[str], offset: int = 0, opens: bool = True) -> Words:
    folded, word, upper, digit = _tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], word[points], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), *(none.astype(bool) for _ in range(4)))
    at = np.flatnonzero(inside[1:-1])
    first = np.concatenate([[0], np.cumsum(stop - start)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, stop - start)
    # As many as the longest word has characters, rounded up so that few sizes are met.
    powers = _powers(max(4096, 1 << int((stop - start).max()).bit_length()))
    own = points[at]
    with np.errstate(over="ignore"):
        hashes = mixed(np.add.reduceat((folded[own].astype(np.uint64) + np.uint64(1)) * powers[place], first))
    capitals = np.add.reduceat(upper[own].astype(np.int32), first)
    digits = np.add.reduceat(digit[own].astype(np.int32), first)
    # What is between a word and the one before it.
    ends = np.concatenate([[0], np.cumsum(np.isin(points, np.array([ord(c) for c in ".!?\n"], np.uint32)))])
    before = np.concatenate([[0], stop[:-1]])
    opening = ends[start] > ends[before]
    opening[0] |= opens
    joint = (start - before == 1) & np.isin(points[np.maximum(start - 1, 0)], np.array([ord(c) for c in ".,:/-"], np.uint32))
    joint[0] = False
    begins = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    text = np.searchsorted(begins, start, "right") - 1
    return Words(text, start - begins[text] + offset, stop - begins[text] + offset, hashes, digits == stop - start, (capitals == 1) & upper[points[start]] & (stop - start > 1), opening, joint)


def _cuts(text: str) -> Iterator[tuple[int, str]]:
    """Slices of a long text, cut at white space."""
    at = 0
    while at < len(text):
        stop = at + SPAN
        if stop < len(text):
            while stop < len(text) and not text[stop].isspace():
                stop += 1
        yield at, text[at:stop]
        at = stop


def words(texts: list[str]) -> Words:
    """The words of all texts, in order."""
    parts, group, first, size = [], [], 0, 0

    def flush() -> None:
        nonlocal group, size
        if group:
            own = _analyse(group)
            own.text += first
            parts.append(own)
        group, size = [], 0

    for i, x in enumerate(texts):
        if len(x) > SPAN:
            flush()
            for at, cut in _cuts(x):
                own = _analyse([cut], at, at == 0)
                own.text += i
                parts.append(own)
            first = i + 1
            continue
        if size + len(x) > TOGETHER:
            flush()
        if not group:
            first = i
        group.append(x)
        size += len(x) + 1
    flush()
    fields = ("text", "start", "stop", "hash", "number", "title", "opens", "joint")
    return Words(*(np.concatenate([getattr(p, f) for p in parts]) for f in fields)) if parts else _analyse([])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbours."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(_MULTIPLIER) + hashes[k : k + n]
    return mixed(out)

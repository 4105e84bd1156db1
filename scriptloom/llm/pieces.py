"""Cutting texts where the tokenizers' split pattern always cuts, and caches by piece.

A space or line feed between two non-space characters always starts a new match of the
split pattern, so texts can be cut there by plain string operations, some ten times as
fast as by the pattern, and whatever is computed for a piece holds wherever it occurs.
Texts with other white space are cut by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space where the quick cut would not be exact.
_UNSAFE = re.compile(r"\s\s|\A\s|\s\Z|\0")
#: The same in texts whose only white space is the space and the line feed.
_UNSAFE_PAIRS = ("  ", "\n\n", " \n", "\n ")


def _is_safe(text: str) -> bool:
    # Other white space and the null character aren't printable.
    if text.replace("\n", "").isprintable():
        return text[0] not in " \n" and text[-1] not in " \n" and not any(p in text for p in _UNSAFE_PAIRS)
    return not _UNSAFE.search(text)


def quick_pieces(text: str) -> list[str] | None:
    """The text's pieces, or None if it has to be cut by the pattern."""
    if not text:
        return []
    if not _is_safe(text):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


class PieceCache:
    """Values by piece (``known``), computed for many missing pieces at once.

    Where it would hold more than ``limit`` pieces, only the half that came first stays, as
    the most frequent pieces come early.  That changes no result.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 300_000):
        self.known: dict = {}
        self.compute, self.limit = compute, limit

    def fill(self, lists: Iterable[list[str]]) -> Callable:
        """Computes what is missing and returns the look-up of these pieces."""
        lists = list(lists)
        missing: set[str] = set()
        for pieces in lists:
            missing |= set(pieces).difference(self.known)
        if missing and len(self.known) + len(missing) > self.limit:
            self.known = dict(islice(self.known.items(), self.limit // 2))
            missing = set().union(*lists).difference(self.known)
        if missing:
            missing = list(missing)
            self.known.update(zip(missing, self.compute(missing), strict=True))
        return self.known.__getitem__


@dataclass
class Cut:
    """Texts as runs of distinct pieces: text i has ``pieces[j]`` for j in
    ``index[offsets[i]:offsets[i + 1]]``.  Where ``slow[i]``, it isn't cut (and has the one
    piece "", as have empty texts)."""

    pieces: list[str]
    index: np.ndarray
    offsets: np.ndarray
    slow: list[bool]

    def joined(self, values: list[bytes], kind: str) -> list[np.ndarray]:
        """For each text, its pieces' values (arrays of ``kind``, as bytes) end to end."""
        if len(self.offsets) < 2:
            return []
        width = np.dtype(kind).itemsize
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
        flat, starts = np.frombuffer(b"".join(values), kind), np.cumsum(sizes) - sizes
        own = sizes[self.index]
        ends = np.cumsum(own)
        out = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[self.index] - (ends - own), own)]
        return np.split(out, np.concatenate([[0], ends])[self.offsets[1:-1]])


def cut_texts(texts: list[str]) -> Cut:
    """``quick_pieces`` of many texts at once, by Arrow's string functions."""
    slow = [bool(x) and not _is_safe(x) for x in texts]
    whole = pa.array(["" if s else x for x, s in zip(texts, slow, strict=True)], pa.large_string())
    for c in " \n":
        whole = pc.replace_substring(whole, c, "\0" + c)
    lists = pc.split_pattern(whole, "\0")
    coded = lists.values.dictionary_encode()
    return Cut(coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy(), slow)

"""Alignment of two sequences of hashes: a longest common subsequence."""

from __future__ import annotations

from bisect import bisect_left


def matched(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order.

    Equal beginnings and ends are taken off, and what only one side has; of the rest each
    place of ``a`` is met with its places in ``b``, last first, and the longest ascending run of
    these is kept by its ends.  Cost: the pairs of equal places left, times a logarithm."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    where: dict[int, list[int]] = {}
    for j in range(lo, len(b) - end):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # the least j that a run of each length can end with
    links: list[tuple] = []  # that run: (i, j, the run before)
    for i in range(lo, len(a) - end):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [(i, i) for i in range(lo)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def changes(a: list[int], b: list[int], names_a: list, names_b: list) -> list[tuple[str, int | None, int | None]]:
    """(change, place in a, place in b) of all that isn't aligned.

    Of the blocks left over, one with a name (identifier) that the other side's left-overs have
    too is ``moved`` if it is equal and ``changed`` if not; without a name it is ``moved`` if it has an
    equal among them.  The others are ``removed`` and ``added``.  Repeated names and equals are
    taken in order."""
    both = matched(a, b)
    left = sorted(set(range(len(a))) - {i for i, _ in both})
    right = sorted(set(range(len(b))) - {j for _, j in both})
    key = lambda name, hash_: (0, name) if name is not None else (1, hash_)
    waiting: dict[tuple, list[int]] = {}
    for j in reversed(right):
        waiting.setdefault(key(names_b[j], b[j]), []).append(j)
    out, taken = [], set()
    for i in left:
        found = waiting.get(key(names_a[i], a[i]))
        if found:
            j = found.pop()
            taken.add(j)
            out.append(("moved" if a[i] == b[j] else "changed", i, j))
        else:
            out.append(("removed", i, None))
    return out + [("added", None, j) for j in right if j not in taken]

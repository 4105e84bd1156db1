"""Spans of a block's text woven into its content as emphases, and taken out again.

Spans may cross; emphases can't.  Content is cut into atoms: pauses, and texts at every place
where a span begins or ends.  Each atom has the emphases around it in one order (that of their
beginnings, then longer ones first, then what was there before, then as given); between two
atoms those stay open that both start with.  So a crossing span falls into pieces, which
``unwoven`` puts together again: pieces that touch and have the same ``rend`` are one.
"""

from __future__ import annotations


def _atoms(tokens: list[dict], cuts: list[int]) -> tuple[list[tuple], list[tuple]]:
    """(offset, end, token, numbers of the emphases around) in order, and the emphases' tokens.
    Texts are cut at the offsets."""
    atoms, found, around, at = [], [], [], 0
    for i, t in enumerate(tokens):
        del around[t["depth"] :]
        if t["kind"] == "hi":
            around.append(len(found))
            found.append(t)
            if i + 1 == len(tokens) or tokens[i + 1]["depth"] <= t["depth"]:
                atoms.append((at, at, None, tuple(around)))  # an emphasis around nothing
        elif t["kind"] == "pause":
            atoms.append((at, at, t, tuple(around)))
        else:
            end = at + len(t["text"])
            inner = [at, *(c for c in cuts if at < c < end), end]
            atoms += [(lo, hi, {**t, "text": t["text"][lo - at : hi - at]}, tuple(around)) for lo, hi in zip(inner, inner[1:], strict=False)]
            at = end
    return atoms, found


def woven(tokens: list[dict], spans: list[tuple[int, int, str]]) -> list[dict]:
    """The content with an emphasis for each (start, stop, rend) in offsets of its text.  A pause
    is inside where the span begins before it and ends behind it.  Spans that are empty or
    leave the text mark what of them is there; what is nothing is left out."""
    size = sum(len(t["text"]) for t in tokens if t["kind"] == "text")
    spans = [(max(a, 0), min(b, size), r) for a, b, r in spans]
    spans = [s for s in spans if s[0] < s[1]]
    atoms, found = _atoms(tokens, sorted({x for s in spans for x in s[:2]}))
    extent: dict[int, list[int]] = {}
    for k, (*_, around) in enumerate(atoms):
        for h in around:
            extent.setdefault(h, [k, k])[1] = k
    old, marks = len(found), [{"rend": h["rend"]} for h in found]
    covered: list[list[int]] = [list(a[3]) for a in atoms]
    for n, (a, b, rend) in enumerate(spans):
        inside = [k for k, (lo, hi, *_) in enumerate(atoms) if (a <= lo and hi <= b if lo < hi else a < lo < b)]
        marks.append({"rend": rend})
        extent[old + n] = [inside[0], inside[-1]]
        for k in inside:
            covered[k].append(old + n)
    order = {h: (lo, -hi, h) for h, (lo, hi) in extent.items()}
    out: list[dict] = []
    opened: list[int] = []
    empty = {"text": None, "rend": None, "dur": None, "type": None}
    for (_, _, token, _), around in zip(atoms, covered, strict=True):
        wanted = sorted(around, key=order.__getitem__)
        same = next((k for k, (x, y) in enumerate(zip(opened, wanted, strict=False)) if x != y), min(len(opened), len(wanted)))
        del opened[same:]
        for h in wanted[same:]:
            out.append({**empty, "depth": len(opened), "kind": "hi", "rend": marks[h]["rend"]})
            opened.append(h)
        if token is not None and (token["kind"] != "text" or token["text"]):
            out.append({**token, "depth": len(opened)})
    return out


def unwoven(tokens: list[dict]) -> tuple[list[dict], list[tuple[int, int, str | None]]]:
    """The content without emphases, texts that meet joined; and (start, stop, rend) of the
    emphases around text, in order.  Those around no text are gone."""
    atoms, found = _atoms(tokens, [])
    plain: list[dict] = []
    extent: dict[int, list[int]] = {}
    for lo, hi, token, around in atoms:
        for h in around:
            extent.setdefault(h, [lo, hi])[1] = hi
        if token is None:
            continue
        if token["kind"] == "text" and plain and plain[-1]["kind"] == "text":
            plain[-1] = {**plain[-1], "text": plain[-1]["text"] + token["text"]}
        else:
            plain.append({**token, "depth": 0})
    spans: list[list] = []
    reach: dict[str | None, int] = {}
    for h in sorted(extent, key=lambda h: (extent[h][0], -extent[h][1], h)):
        (lo, hi), rend = extent[h], found[h]["rend"]
        if lo == hi:
            continue
        last = reach.get(rend)
        if last is not None and spans[last][1] == lo:
            spans[last][1] = hi
        else:
            reach[rend] = len(spans)
            spans.append([lo, hi, rend])
    return plain, [tuple(s) for s in spans]

"""Benchmark passages in documents, also where their numbers, names and units were changed.

Texts become sequences of template tokens: numbers (digits or English number words), names
(capitalised words; neighbours are one) and units (after a number; abbreviations after
digits alone) become typed placeholders, other
words stay, in lower case.  A capitalised word that opens a sentence is read in two ways, in
items and documents: as a word and as a name (where it starts a new one).  Windows of ``WINDOW`` tokens are hashed; documents' windows that
some benchmark item has are joined with the items' windows by hash.  A document's windows
that lie on one diagonal of an item, that is, follow each other as they do there, are
consistent if every slot value of the item stands for one value of the document and the
other way round; if not, only the diagonal's windows without slots count.  A document leaks
an item if such windows cover at least half of the item's windows, or ``ENOUGH`` of them,
in the first reading, in both, or in all three with the exact one below.

Documents' windows are sifted by a Bloom filter of the items' hashes before they leave the
task; it has ``FILTER_BITS`` bits whatever the benchmark's size, and the join decides.  A
window without slots leaves once for each text, however often it stands there.  Windows
common to more than ``COMMON`` items make no pair of document and item by themselves: of
each item so few of them are set aside that a leak must have another window too, and they
are joined only where that one has made the pair, with the same result.  Groups are bounded
by an item's length.

An item of fewer than WINDOW tokens is one window of its own length.  An item of fewer than
``LEAST`` words can't be told from chance within a sentence: it is found where a sentence,
line, quotation or part after a colon is it, word by word, and one of one or two words where
a document has no other word.  Template windows with fewer than half of
their tokens literal are passed over.  Where an item's words are so, or make no template
window, windows of the words as they are (``EXACT``, no placeholder, nothing merged) are
matched instead, so verbatim copies are found whatever they're made of.

Null and empty texts have no windows, an empty table of either kind gives no leaks.  Very
long texts are read whole; their windows leave the task in batches.  Repeated rows give a
pair once; two texts that share an identifier, or have none, are matched
apart and give the better match.  Of levels with equal shares, the one with more windows
counts.  Other columns may have any names: pairs have none of them, ``without_leaks`` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, chunks, sifted, tidy, unused
from .words import Words, windows, words

WINDOW, LEAST = 8, 5
ENOUGH, SHARE = 6, 0.5
#: Items that share a window beyond which it is a common one.
COMMON = 64
#: Bits of the items' Bloom filter (8 MB, two bits a hash).
FILTER_BITS = 26
#: Rows of a batch that leaves a task.
ROWS = 50_000
NUMBER, NAME, UNIT = 1, 2, 3
#: Readings of a text: openers of sentences as words, as names, and all words as they are.
OPENERS_LITERAL, OPENERS_NAMES, EXACT = 0, 1, 2
# Units that make way for a placeholder after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs hz khz mhz w kw v a k c f percent dollar dollars euro euros pound pounds cent cents meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years foot feet inch inches degree degrees".split()


# English number words.
COUNTS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
COUNTS |= {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
#: What may stand beside an item of few words that stands for itself.
BOUNDS = frozenset(".!?:;\n\"“”„«»()[]")


@lru_cache
def _listed() -> dict[str, np.ndarray]:
    """Sorted hashes of the listed words."""
    lists = {
        "long": [u for u in UNITS if len(u) > 2],
        "short": [u for u in UNITS if len(u) < 3],
        "tens": [w for w, n in COUNTS.items() if n > 19],
        "ones": [w for w, n in COUNTS.items() if 0 < n < 10],
        "counts": list(COUNTS),
        "scales": list(SCALES),
    }
    return {k: np.sort(words([" ".join(v)]).hash) for k, v in lists.items()}


def _among(hashes: np.ndarray, name: str) -> np.ndarray:
    own = _listed()[name]
    return own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes


def _after(found: Words, here: np.ndarray) -> np.ndarray:
    """Which words follow one of these in their text."""
    return np.concatenate([[False], here[:-1] & (found.text[1:] == found.text[:-1])])[: len(here)]


@dataclass
class _Marks:
    """Which words are numbers and units, and which go on with the number before them."""

    number: np.ndarray
    unit: np.ndarray
    tied: np.ndarray


def _marks(found: Words) -> _Marks:
    scale, spelt = _among(found.hash, "scales"), _among(found.hash, "counts")
    # A multiplier alone ("million reasons") is a word.
    goes_on = scale & _after(found, found.number | spelt | scale)
    number = found.number | spelt | goes_on
    unit = _among(found.hash, "long") & _after(found, number) | _among(found.hash, "short") & _after(found, found.number)
    ones = _among(found.hash, "ones") & _after(found, _among(found.hash, "tens"))
    tied = goes_on | ones | spelt & _after(found, goes_on)
    return _Marks(number, unit, tied & ~found.opens)


def _kinds(found: Words, marks: _Marks, opener_names: bool) -> np.ndarray:
    """Kinds of words (0: literal)."""
    kind = np.zeros(len(found.hash), np.int8)
    kind[found.title if opener_names else found.title & ~found.opens] = NAME
    kind[marks.unit] = UNIT
    kind[marks.number] = NUMBER
    return kind


def _reading(found: Words, marks: _Marks, kind: np.ndarray, n: int, merge: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of ``n`` texts: token hashes, kinds, spans, and the word each starts with."""
    same = np.concatenate([[False], (kind[1:] == kind[:-1]) & (found.text[1:] == found.text[:-1])])[: len(kind)]
    # A number with separators or of several words, or a name of several, is one placeholder.
    goes = same & ((kind == NUMBER) & (found.joint | marks.tied) | (kind == NAME) & ~found.opens) & merge
    keep = np.flatnonzero(~goes)
    last = np.concatenate([keep[1:], [len(kind)]]) - 1 if len(keep) else keep
    hashes = np.where(kind > 0, kind.astype(np.uint64), found.hash)[keep] if merge else found.hash
    text, start, stop, kind = found.text[keep], found.start[keep], found.stop[last] if len(keep) else found.stop[keep], kind[keep]
    cuts = np.searchsorted(text, np.arange(n + 1)).tolist()
    begins = np.searchsorted(found.text, np.arange(n)).tolist()
    return [(hashes[a:b], kind[a:b], np.stack([start[a:b], stop[a:b]], 1), keep[a:b] - w) for a, b, w in zip(cuts[:-1], cuts[1:], begins, strict=True)]


def template(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, list]]:
    """For each text: token hashes, kinds (0: literal), and the (text, start, stop) of each."""
    found = words(texts)
    marks = _marks(found)
    return [own[:3] for own in _reading(found, marks, _kinds(found, marks, False), len(texts))]


def readings(texts: list[str], wanted: tuple[int, ...] = (OPENERS_LITERAL, OPENERS_NAMES, EXACT)) -> dict[int, list]:
    """What ``_reading`` gives for each reading."""
    found = words(texts)
    marks = _marks(found)
    names = _kinds(found, marks, True)
    out = {}
    for r in wanted:
        out[r] = _reading(found, marks, _kinds(found, marks, False) if r == OPENERS_LITERAL else names, len(texts), r != EXACT)
    return out


def template_windows(hashes: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that are literal enough."""
    fit = np.flatnonzero(_literal(kinds, size) * 2 >= size)
    found = windows(hashes, size)
    # Windows of different sizes never share a hash.
    return fit, found[fit] ^ np.uint64(size)


def exact_windows(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all windows of words as they are; apart from templates' hashes."""
    found = windows(hashes, size)
    return np.arange(len(found)), found ^ np.uint64(size + (1 << 63))


def _literal(kinds: np.ndarray, size: int) -> np.ndarray:
    """How many tokens of each window are literal."""
    sums = np.concatenate([[0], np.cumsum(kinds == 0)])
    return sums[size:] - sums[: max(0, len(sums) - size)]


def item_windows(own: dict[int, tuple]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """An item's windows: size, places and hashes by reading."""
    out = {}
    for r, (hashes, kinds, _, _) in sorted(own.items()):
        size = min(WINDOW, len(hashes))
        # Fewer words have to stand for themselves, as they are.
        if size < (1 if r == EXACT else LEAST):
            continue
        if r != EXACT:
            out[r] = (size, *template_windows(hashes, kinds, size))
            continue
        at, found = exact_windows(hashes, size)
        # Only where the readings by templates have nothing.
        if any(len(out[x][1]) == 0 for x in out) or len(out) < 2:
            fit = slice(None)
        else:
            fit = np.flatnonzero(_literal(kinds, size) * 2 < size)
        out[r] = (size, at[fit], found[fit])
    return out


def value(text: str) -> str:
    """A slot's value: number words as the number they stand for, other texts in lower case."""
    parts = text.lower().replace("-", " ").split()
    if not any(p in COUNTS or p in SCALES for p in parts) or not all(p in COUNTS or p in SCALES or p.isdecimal() for p in parts):
        return " ".join(text.split()).lower()
    total = part = 0
    for p in parts:
        if p not in SCALES:
            part += COUNTS[p] if p in COUNTS else int(p)
            continue
        part *= SCALES[p]
        if SCALES[p] > 100:
            total, part = total + part, 0
    return str(total + part)


def slots(text: str, kinds: np.ndarray, spans: np.ndarray, at: int, size: int) -> list[str]:
    """Values of a window's placeholders, with their kind."""
    return [f"{kinds[i]}:{value(text[spans[i][0] : spans[i][1]])}" for i in range(at, at + size) if kinds[i]]


def standing(text: str, spans: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which windows of fewer than LEAST words stand for themselves."""
    n = len(spans)
    if size < 3:
        return at == (0 if size == n else -1)
    clear = lambda a, b: any(c in BOUNDS for c in text[a:b])
    return np.array([(i == 0 or clear(spans[i - 1][1], spans[i][0])) and (i + size == n or clear(spans[i + size - 1][1], spans[i + size][0])) for i in at.tolist()], bool)


_WINDOWS = "id long, tag string, reading int, size int, at long, place long, hash long, slots array<string>, n array<long>"


def bloom(hashes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The Bloom filter of the column ``hash``: places and bits of its 64-bit words that have any
    (at most 2 ** (FILTER_BITS - 6))."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    place = F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftright("hash", 32).bitwiseAND(mask)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    return found.column("w").to_numpy().astype(np.int32), found.column("b").to_numpy().view(np.uint64)


def _bits(own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[own[0]] = own[1]
    return out


def _maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the filter may hold."""
    hit = np.arange(len(hashes))
    for shift in (0, 32):
        p = hashes[hit] >> np.uint64(shift) & np.uint64((1 << FILTER_BITS) - 1)
        hit = hit[bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1) > 0]
    return hit


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
    names = [x.split()[0] for x in _WINDOWS.split(", ")]
    while out := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def all_windows(df: DataFrame, key: str, text: str, sizes: tuple[tuple[int, int], ...] | None, wanted: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """A row for each window: id, tag (a digest of the text),
    reading, size, token and word where it starts, hash, slots, and ``n``.  ``sizes``: pairs
    of reading and size, and the windows are those that the filter ``wanted`` may hold, each
    one without slots once a text; None: those of an item, and ``n`` is at how many words windows of
    the first reading, the first two, and all start."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("tag"), F.coalesce(text, F.lit("")).alias("text"))
    kinds_of = (OPENERS_LITERAL, OPENERS_NAMES, EXACT) if sizes is None else tuple(sorted({r for r, _ in sizes}))

    def of_item(own: dict[int, tuple]) -> Iterator[tuple]:
        places, found = [set(), set(), set()], item_windows(own)
        for r, (_, at, _) in found.items():
            for level in range(r, EXACT + 1):
                places[level].update(own[r][3][at].tolist())
        n = [len(p) for p in places]
        for r, (size, at, hashes) in found.items():
            yield r, size, at, hashes, n

    def of_document(own: dict[int, tuple], body: str, bits: np.ndarray) -> Iterator[tuple]:
        for r, size in sizes:
            hashes, kinds, spans, _ = own[r]
            if size > len(hashes):
                continue
            at, found = exact_windows(hashes, size) if r == EXACT else template_windows(hashes, kinds, size)
            hit = _maybe(bits, found)
            at, found = at[hit], found[hit]
            if r == EXACT and size < LEAST:
                fit = standing(body, spans, at, size)
                at, found = at[fit], found[fit]
            plain = np.ones(len(at), bool) if r == EXACT else _literal(kinds, size)[at] == size
            if plain.any():
                once = np.sort(np.concatenate([np.flatnonzero(~plain), np.flatnonzero(plain)[np.unique(found[plain], return_index=True)[1]]]))
                at, found = at[once], found[once]
            yield r, size, at, found, None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sizes is None else _bits(wanted)

        def made(part: pa.RecordBatch, texts: list[str]) -> Iterator[tuple]:
            read = readings(texts, kinds_of)
            for k, (i, tag, body) in enumerate(zip(part.column("id").to_pylist(), part.column("tag").to_pylist(), texts, strict=True)):
                own = {r: read[r][k] for r in kinds_of}
                for r, size, at, found, n in of_item(own) if sizes is None else of_document(own, body, bits):
                    _, kinds, spans, word = own[r]
                    for a, h in zip(at.tolist(), found.view(np.int64).tolist(), strict=True):
                        yield i, tag, r, size, a, int(word[a]), h, [] if r == EXACT else slots(body, kinds, spans, a, size), n

        for batch in batches:
            for part, texts in chunks(batch, "text", 1_000_000):
                yield from _batches(made(part, texts))

    return rows.mapInArrow(run, _WINDOWS)


def _common(known: DataFrame, common: int) -> DataFrame:
    """Items' windows with ``common``: the window is at a word that is set aside.  A leak has at least
    ``least`` words where matched windows start; of an item fewer than that are set aside, those
    whose windows most items share."""
    shared = known.select("hash", "id", "tag").distinct().groupBy("hash").agg(F.count("*").alias("items"))
    places = known.join(shared, "hash").groupBy("id", "tag", "place").agg(F.max("items").alias("items"), F.max("n").alias("n"))
    half = F.array_min(F.transform(F.filter("n", lambda x: x > 0), lambda x: F.ceil(x * F.lit(SHARE))))
    least = F.least(half, F.lit(ENOUGH))
    order = F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.desc("items"), "place"))
    aside = places.withColumn("k", order).where((F.col("items") > common) & (F.col("k") < least))
    aside = aside.select(F.col("id").alias("own"), F.col("tag").alias("own_tag"), F.col("place").alias("own_place"))
    same = F.col("id").eqNullSafe(F.col("own")) & (F.col("tag") == F.col("own_tag")) & (F.col("place") == F.col("own_place"))
    return known.join(aside, same, "left").withColumn("common", F.col("own_place").isNotNull()).drop("own", "own_tag", "own_place")


def find_leaks(docs: DataFrame, items: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, tag, item_id, matched, windows, slots: documents that leak items."""
    work = Workspace(docs.sparkSession, "templates")
    raw = work.save(all_windows(items, "item_id", "text", None), "windows").dropDuplicates(["id", "tag", "reading", "size", "at"])
    known = work.save(_common(raw, common), "items")
    sizes = tuple(sorted((r.reading, r.size) for r in known.select("reading", "size").distinct().collect()))  # at most 3 * WINDOW of them
    # Either reading of a document may meet either of an item.
    templates = {n for r, n in sizes if r != EXACT}
    sizes = tuple(sorted({(r, n) for n in templates for r in (OPENERS_LITERAL, OPENERS_NAMES)} | {x for x in sizes if x[0] == EXACT}))
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, tag string, item_id long, matched long, windows long, slots long")
    mine = all_windows(docs, "doc_id", "text", sizes, bloom(known.select("hash"))).drop("n", "place").dropDuplicates(["id", "tag", "reading", "size", "at"])
    theirs = known.select("hash", "size", "common", F.col("id").alias("item_id"), F.col("tag").alias("item_tag"), F.col("reading").alias("item_reading"), F.col("at").alias("item_at"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), F.col("n").alias("windows"))
    doc = ["id", "tag", "item_id", "item_tag"]
    if known.where("common").isEmpty():
        pairs = mine.join(theirs, ["hash", "size"])
    else:
        mine = work.save(mine, "documents")
        own = mine.join(theirs.where("not common"), ["hash", "size"])
        may = own.select(*(F.col(c).alias(f"may_{c}") for c in doc)).distinct()
        rest = mine.join(theirs.where("common").select("hash", "size").distinct(), ["hash", "size"], "left_semi")
        rest = rest.join(may, F.col("id").eqNullSafe(F.col("may_id")) & (F.col("tag") == F.col("may_tag")))
        same = F.col("may_item_id").eqNullSafe(F.col("item_id")) & (F.col("may_item_tag") == F.col("item_tag"))
        rest = rest.join(theirs.where("common"), ["hash", "size"]).where(same)
        pairs = own.unionByName(rest.select(own.columns))
    pairs = pairs.withColumn("diagonal", F.col("at") - F.col("item_at"))
    values = F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("mine"))
    literal = F.collect_set(F.when(F.size("slots") == 0, F.col("item_place")))
    lines = pairs.groupBy(*doc, "reading", "item_reading", "diagonal").agg(literal.alias("literal"), F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_list(values))).alias("v"), F.max("windows").alias("windows"))
    distinct = lambda c: F.size(F.array_distinct(F.col("v")[c]))
    consistent = (distinct("theirs") == F.size("v")) & (distinct("mine") == F.size("v"))
    lines = lines.withColumn("places", F.when(consistent, F.col("places")).otherwise(F.col("literal"))).where(F.size("places") > 0)
    # A text may repeat an item on any number of diagonals: words are counted by aggregates alone.
    words_of = lines.select(*doc, "item_reading", "windows", F.size("v").cast("long").alias("slots"), F.explode("places").alias("place"))
    words_of = words_of.groupBy(*doc, "place").agg(F.min("item_reading").alias("level"), F.max("windows").alias("n"), F.max("slots").alias("slots"))
    # Matched words by level: the first reading, both by templates, all.
    upto = [F.count(F.when(F.col("level") <= k, F.lit(1))).alias(f"m{k}") for k in range(EXACT + 1)]
    each = words_of.groupBy(*doc).agg(*upto, F.max("n").alias("n"), F.max("slots").alias("slots"))
    levels = [F.struct((F.col(f"m{k}") / F.greatest(F.col("n")[k], F.lit(1))).alias("share"), F.col(f"m{k}").alias("matched"), F.col("n")[k].alias("windows")) for k in range(EXACT + 1)]
    level = F.greatest(*levels)
    enough = F.greatest(*(F.col(f"m{k}") for k in range(EXACT + 1))) >= ENOUGH
    leaks = each.withColumn("best", level).where((F.col("best.share") >= SHARE) | enough).select("*", "best.matched", "best.windows")
    return leaks.select(F.col("id").alias("doc_id"), "tag", "item_id", "matched", "windows", "slots")


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs of document and item, with the best match of each."""
    best = F.struct("matched", "windows", "slots")
    found = find_leaks(docs, items).groupBy("doc_id", "item_id").agg(F.max(best).alias("m"))
    return found.select("doc_id", "item_id", "m.matched", "m.windows", "m.slots")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    own, tag = unused(docs.columns, "__id", "__tag")
    hit = find_leaks(docs, items).select(F.col("doc_id").alias(own), F.col("tag").alias(tag)).distinct()
    hit = Workspace(docs.sparkSession, "leaks").save(hit, "documents")
    may, no = sifted(docs, hit.select(F.col(own).cast(docs.schema["doc_id"].dataType).alias("doc_id")), "doc_id")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.md5(F.coalesce("text", F.lit("")).cast("binary")) == F.col(tag))
    return may.join(hit, same, "left_anti").unionByName(no)

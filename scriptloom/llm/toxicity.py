"""Toxicity of texts written to be misread: a noisy channel, then a linear score.

Writers hide words by look-alike signs (1d10t), repetition (idiooot) and spacing (i d i o t).
First what isn't seen goes, full-width signs become plain ones, and so do look-alike letters of
other scripts in words that have Latin ones too (``folded``).
A word that may be so hidden is a lattice of characters: each sign may stand for letters, a
repeated letter may be one, and what is between single letters may be nothing or the end of
a word.  A run of single letters is one lattice; its words as drawn together, without the
model, are read beside the likeliest ones.  Viterbi decoding finds the likeliest path under a trigram model of characters, counted over all
documents, and the channel's costs.  Texts are then scored as restored, by logistic
regression over words and word beginnings.

Steps, all distributed:
1. ``count_trigrams``: per-task arrays over a fixed alphabet, summed by trigram.  What comes
   back is bounded by the alphabet (``len(ALPHABET) + 1`` cubed).
2. ``fit``: the model learns from at most ``SAMPLE`` labelled documents of each label, least
   hash of the identifier first, weighted back to the labels' shares among all labelled
   rows.  Features are all whose likelihood ratio reaches a level; the level is the one of
   ``LEVELS`` with the least loss in cross-validation over ``FOLDS`` folds of these training
   rows.  Labels, languages, sources and identifiers are no features.
3. ``score``: narrow, one pass; the model is some hundreds of kilobytes.

Every word is decoded that has a sign that may stand for a letter beside one, or a letter
twice in a row, and every run of three or more single letters with up to three separators
between two of them; what is read counts beside what is written.  A run of signs without a letter
is a number.  The lattice's alphabet is Latin (``ALPHABET``): words of other scripts are scored
as written.

Null and empty texts are scored by the bias alone; very long texts are scored whole.  Without
a toxic label to learn from, all scores are 0.  Of rows that share an identifier the one with
the least digest is learnt from; an identifier that is labelled both ways counts as toxic.
Repeated rows are scored alike; an empty table gives no rows; columns named like the results
are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, chunks, tidy
from .pieces import PieceCache

SAMPLE = 4000
#: Likelihood ratios (G²) that a feature may have to reach, and the least number of sampled
#: documents with it.
LEVELS, LEAST_DOCS = (12.0, 16.0, 24.0), 3
FOLDS = 4
PREFIXES = (4, 5, 6)

ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäáãåçèéêëìíîïñòóôöõùúûüßœæ"
_CODES = {c: i + 1 for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1
# What signs may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs (natural logarithms) of the channel's moves.
SUBSTITUTE, DROP_REPEAT, KEEP_REPEAT, WILDCARD, KEEP_SIGN = 1.0, 0.5, 2.0, 1.5, 12.0

_LETTER = r"[^\W\d_]"
_SIGN = "[" + re.escape("".join(LEET)) + "*]"
#: A word that may be hidden: a sign beside a letter, or a letter twice in a row.
_HIDDEN = re.compile(rf"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}|({_LETTER})\1", re.I)
#: One that isn't common spelling either: restored texts keep letters that stand twice in a row.
_ODD = re.compile(rf"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}|({_LETTER})\1\1", re.I)
_TOKEN = re.compile(rf"(?:{_LETTER}|{_SIGN})+", re.I)
_WORD = re.compile(rf"{_LETTER}+")
#: What may stand between spaced letters, alone or a few of them, mixed.
SEPARATORS = " .-_/,"
_BETWEEN = "[" + re.escape(SEPARATORS) + "]"
_QUICK_SPACED = re.compile(rf"{_BETWEEN}\S{_BETWEEN}{{1,3}}\S(?![^\W_])")
_SPACED = re.compile(rf"(?<![^\W_])(?:{_LETTER}|{_SIGN})(?:{_BETWEEN}{{1,3}}(?:{_LETTER}|{_SIGN})(?![^\W_])){{2,}}")

# Signs that aren't seen, and letters of other scripts that look like Latin ones.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
ALIKE = {"а": "a", "в": "b", "е": "e", "ё": "ë", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "ï", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "α": "a", "ε": "e", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "κ": "k", "ı": "i"}
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {ord(c): None for c in UNSEEN}
_FOLDED = re.compile(f"[{UNSEEN}\uff01-\uff5e{''.join(ALIKE)}]")
_MIXED = re.compile(rf"(?=[^\W\d_]*[a-z])(?=[^\W\d_]*[{''.join(ALIKE)}]){_LETTER}+")
_ALIKE = str.maketrans(ALIKE)


def folded(text: str) -> str:
    """A text in lower case without what isn't seen, full-width signs as plain ones, and in
    words that mix Latin letters with look-alikes of other scripts those as Latin ones."""
    text = text.lower()
    if text.isascii() or not _FOLDED.search(text):
        return text
    return _MIXED.sub(lambda m: m[0].translate(_ALIKE), text.translate(_WIDE).lower())



def _lookup() -> np.ndarray:
    table = np.zeros(0x180, np.uint8)
    for c, i in _CODES.items():
        table[ord(c)] = i
    return table


_TABLE = _lookup()


def trigram_array(texts: list[str]) -> np.ndarray:
    """Counts of the letters' trigrams (anything else is a boundary), SIZE cubed of them."""
    points = np.frombuffer("\n\n".join(texts).lower().encode("utf-32-le"), np.uint32)
    codes = np.zeros(len(points) + 3, np.int32)
    codes[2:-1] = _TABLE[np.minimum(points, 0x17F)] * (points < 0x180)
    return np.bincount(codes[:-2] * SIZE * SIZE + codes[1:-1] * SIZE + codes[2:], minlength=SIZE**3)


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for _, texts in chunks(batch, text):
                total += trigram_array(texts)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["trigram", "n"])

    counted = docs.select(text).mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE**3, np.int64)
    for r in counted.collect():  # at most SIZE**3 rows
        out[r.trigram] = r.n
    return out


class CharModel:
    """Costs of a character after two others: interpolated trigrams, bigrams and unigrams."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * SIZE)
        p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).astype(np.float32)
        self._firsts: dict = {}
        self._endings = [(self.cost[:, :, 0].astype(np.float64), np.zeros((SIZE, SIZE), np.int8))]

    def decode(self, token: str) -> str:
        """The likeliest reading of a token or a run of spaced letters (lower case)."""
        head = token.rstrip("*")
        stars = len(token) - len(head)
        if "*" in head or stars > 64:
            return self.decode_wild(token)
        first, moves = self.endings(stars)
        states = self._states(head)
        a, b = min(states, key=lambda s: states[s][0] + first[s])
        out, text = [], states[a, b][1]
        while text:
            text, x = text
            out.append(x)
        out.reverse()
        for move in moves:
            k = int(move[a, b])
            a, b = (a, b) if not k else (0, 0) if k < 0 else (b, k)
            out += [ALPHABET[k - 1]] if k > 0 else [" "] * -k
        return " ".join("".join(out).split())

    def endings(self, stars: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Least costs of a token's end, so many stars, by the state before it; and by star the
        move from each state: a letter, a sign (-1) or nothing, as it repeats the last one (0)."""
        own = self.cost.astype(np.float64)[:, :, 1:] + WILDCARD if stars >= len(self._endings) else None

        def best(rest: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            letters = own + rest[None, :, 1:]
            k = letters.argmin(2)
            read, same = np.take_along_axis(letters, k[:, :, None], 2)[:, :, 0], np.where(repeat, rest + DROP_REPEAT, np.inf)
            value, move = np.minimum(same, read), np.where(read < same, k + 1, 0)
            sign = KEEP_SIGN * ~repeat + rest[0, 0]
            return np.minimum(value, sign), np.where(sign < value, -1, move).astype(np.int8)

        # A letter after the end of a word repeats nothing, and a first star nothing before it.
        repeats, none = np.ones((SIZE, SIZE), bool), np.zeros((SIZE, SIZE), bool)
        repeats[1:, 0] = False
        for n in range(len(self._endings), stars + 1):
            self._endings.append(best(self._endings[n - 1][0], repeats))
            self._firsts[n] = best(self._endings[n - 1][0], none)
        if not stars:
            return self._endings[0][0], []
        value, move = self._firsts[stars]
        return value, [move, *(self._endings[n][1] for n in range(stars - 1, 0, -1))]

    def _states(self, token: str) -> dict:
        """Least cost and reading of a token by the state after it."""
        cost = self.cost
        # State: the last two letters' codes.  Value: cost, reading as a chain of its letters.
        states: dict = {(0, 0): (0.0, None)}
        last, run = "", 0
        for i, c in enumerate(token):
            new: dict = {}

            def to(a, b, value, text, new=new):
                if (a, b) not in new or value < new[a, b][0]:
                    new[a, b] = (value, text)

            if c in SEPARATORS:
                for (a, b), (value, text) in states.items():
                    to(a, b, value, text)
                    if b:
                        to(b, 0, value + float(cost[a, b, 0]), (text, " "))
                states = new
                continue
            own = _CODES.get(c)
            run = run + 1 if i and token[i - 1] == c else 1
            if own and run > 3:
                continue  # From the third on, a repeated letter adds the same to all states.
            readings = [(c, 0.0)] if own else [(x, SUBSTITUTE) for x in LEET.get(c, "")]
            for (a, b), (value, text) in states.items():
                # A letter after the end of a word repeats nothing.
                repeat = c == last and not (a and not b)
                if repeat:
                    to(a, b, value + DROP_REPEAT, text)
                for x, extra in readings:
                    k = _CODES[x]
                    to(b, k, value + extra + (KEEP_REPEAT if repeat else 0) + float(cost[a, b, k]), (text, x))
                if not own:
                    to(0, 0, value + KEEP_SIGN * (not repeat), (text, " "))
            states, last = new, c
        return states

    def decode_wild(self, token: str) -> str:
        """The same over arrays of all states, for tokens with stars elsewhere than at their end."""
        cost = self.cost.astype(np.float64)
        value = np.full((SIZE, SIZE), np.inf)
        value[0, 0] = 0.0
        # States right after the end of a word: a letter, then a boundary.
        fresh = np.zeros((SIZE, SIZE), bool)
        fresh[1:, 0] = True
        here, every = np.arange(SIZE * SIZE, dtype=np.int16).reshape(SIZE, SIZE), np.arange(SIZE)
        back: list[tuple[np.ndarray, np.ndarray]] = []
        last, still = "", 0
        for i, c in enumerate(token):
            if not (i and token[i - 1] == c):
                still = 0
            if still > 64:
                continue  # Costs and moves stay as they are for the rest of this run.
            repeat = c == last and ~fresh
            new, origin, said = np.full((SIZE, SIZE), np.inf), here.copy(), np.zeros((SIZE, SIZE), np.int8)

            def to(a, b, v, source, what, new=new, origin=origin, said=said):
                better = v < new[a, b]
                new[a, b], origin[a, b], said[a, b] = np.where(better, v, new[a, b]), np.where(better, source, origin[a, b]), np.where(better, what, said[a, b])

            def emit(k, v):
                total = v + cost[:, :, k]
                best = total.argmin(0)
                to(every, k, total[best, every], best * SIZE + every, k)

            if c in SEPARATORS:
                new[:] = value
                emit(0, np.where(every[None] > 0, value, np.inf))
                value = new
                back.append((origin, said))
                continue
            if c == last:
                new[:] = np.where(repeat, value + DROP_REPEAT, np.inf)
            own = _CODES.get(c)
            if c == "*":
                total = value[:, :, None] + cost
                best = total.argmin(0)
                v = np.take_along_axis(total, best[None], 0)[0] + WILDCARD
                source = best * SIZE + every[:, None]
                better = v < new
                better[:, 0] = False
                new[better], origin[better], said[better] = v[better], source[better], np.broadcast_to(every, (SIZE, SIZE))[better]
            for x, extra in [(c, 0.0)] if own else [(x, SUBSTITUTE) for x in LEET.get(c, "")]:
                emit(_CODES[x], value + extra + KEEP_REPEAT * np.asarray(repeat, float))
            if not own:
                kept = value + KEEP_SIGN * ~np.broadcast_to(np.asarray(repeat, bool), (SIZE, SIZE))
                at = int(kept.argmin())
                if kept.flat[at] < new[0, 0]:
                    new[0, 0], origin[0, 0], said[0, 0] = kept.flat[at], at, -1
            still = still + 1 if np.array_equal(new, value) else 0
            value, last = new, c
            back.append((origin, said))
        state = int((value + cost[:, :, 0]).argmin())
        out = []
        for origin, said in reversed(back):
            k, before = int(said.flat[state]), int(origin.flat[state])
            if k or before != state:
                out.append(ALPHABET[k - 1] if k > 0 else " ")
            state = before
        return " ".join("".join(reversed(out)).split())


class Restorer:
    """Words of texts as they were meant."""

    def __init__(self, counts: np.ndarray):
        self.model = CharModel(counts)
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[token] = self.model.decode(token)
        return got

    def words(self, piece: str) -> list[str]:
        """Words of a piece, in lower case; both as read and, if that may differ, as written."""
        if len(piece) > 4 and piece[1] in SEPARATORS and _SPACED.fullmatch(piece):
            return self.spaced(piece)
        plain = _WORD.findall(piece)
        if not _HIDDEN.search(piece):
            return plain
        return [w for t in _TOKEN.findall(piece) for w in self.read(t)] + plain

    def read(self, token: str) -> list[str]:
        """Likeliest words of a token or run; exclamation marks and stars at its ends may be no letters."""
        return [w for t in dict.fromkeys((token, token.rstrip("!*" + SEPARATORS).lstrip("*"))) for w in self.token(t).split()]

    def spaced(self, run: str) -> list[str]:
        """Words of a run of spaced letters: as read, and as drawn together."""
        if not _WORD.search(run):
            return []
        return self.read(run) + self.words(re.sub(_BETWEEN, "", run))

    def restore(self, text: str) -> str:
        """The text in lower case with hidden words as they read."""

        def plain(part: str) -> str:
            return _TOKEN.sub(lambda m: meant(m[0]) if _ODD.search(m[0]) else m[0], part)

        def meant(token: str) -> str:
            """As written if only marks that aren't letters would go."""
            own = self.token(token)
            return token if own.split() == _WORD.findall(token) else own

        return "".join(self.token(x) if spaced and _WORD.search(x) else x if spaced else plain(x) for x, spaced in self._parts(folded(text or "")))

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text in lower case cut into runs of spaced letters (True) and what is between."""
        at = 0
        if _QUICK_SPACED.search(text):
            for m in _SPACED.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield text[at:], False

    def pieces(self, text: str) -> list[str]:
        return [p for x, spaced in self._parts(folded(text)) for p in ([x] if spaced else x.split())]


def features(word: str) -> list[str]:
    """A word, and its beginnings where it is longer."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def sample_labels(labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """At most ``size`` training labels of each kind, and what each then counts for.  Rows
    whose crc32 of the identifier is a multiple of five are held out."""
    train = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for k in (0, 1):
        own = train.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        chosen = own if chosen is None else chosen.unionByName(own)
    return chosen, {k: n / min(n, size) for k, n in totals.items()}


def _g2(a: Column, b: Column, n1: float, n0: float) -> Column:
    """Likelihood ratio of a feature that ``a`` of ``n1`` toxic and ``b`` of ``n0`` other documents have."""
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    total = n0 + n1
    return 2 * sum(part(o, row * column / total) for o, row, column in ((a, a + b, n1), (b, a + b, n0), (n1 - a, total - a - b, n1), (n0 - b, total - a - b, n0)))


def fit(docs: DataFrame, labels: DataFrame, counts: np.ndarray, size: int = SAMPLE, text: str = "text") -> dict[str, float]:
    """Weights by feature; "" is the bias.  No weights if there is nothing to learn.

    What comes to the driver is bounded by the sample: features that ``LEAST_DOCS`` of its
    documents have and that reach the least level in some fold, and who has which."""
    chosen, weight = sample_labels(labels, size)
    if 1 not in weight:
        return {}
    # Bounded by 2 * size rows, so they are broadcast; equal identifiers give one document.
    rows = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by(text, F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts)
        for batch in batches:
            for own, texts in chunks(batch, "text"):
                found = [sorted({f for p in set(restorer.pieces(x)) for w in restorer.words(p) for f in features(w)}) for x in texts]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "found"])

    work = Workspace(docs.sparkSession, "toxicity")
    found = work.save(rows.mapInArrow(run, "doc_id long, toxic int, found array<string>").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")), "found")
    documents = sorted((r.doc_id, r.toxic, r.fold) for r in found.select("doc_id", "toxic", "fold").collect())
    at = {d: i for i, (d, _, _) in enumerate(documents)}
    y, fold = (np.array([d[k] for d in documents], float) for k in (1, 2))
    weights = np.array([weight[t] for t in y.astype(int)])

    one = F.lit(1).cast("long")
    here = lambda k, t: F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), one).otherwise(0)).alias(f"f{k}t{t}")
    seen = found.select("toxic", "fold", F.explode("found").alias("feature")).groupBy("feature").agg(*(here(k, t) for k in range(FOLDS) for t in (1, 0)))
    n = {(k, t): float(((fold == k) & (y == t)).sum()) for k in range(FOLDS) for t in (1, 0)}
    # Ratios without each fold, and over all (the last one); only features that reach a level come to the driver.
    rests = [[j for j in range(FOLDS) if j != k] for k in range(FOLDS)] + [list(range(FOLDS))]
    had = lambda ks, t: sum(F.col(f"f{k}t{t}") for k in ks).cast("double")
    ratio = F.array(*(_g2(had(ks, 1), had(ks, 0), *(sum(n[k, t] for k in ks) for t in (1, 0))) for ks in rests))
    able = seen.where(had(range(FOLDS), 1) + had(range(FOLDS), 0) >= LEAST_DOCS).select("feature", ratio.alias("ratio")).where(F.array_max("ratio") >= LEVELS[0])
    able = sorted((r.feature, r.ratio) for r in able.collect())
    names, ratios = [f for f, _ in able], np.array([x for _, x in able], float).reshape(-1, FOLDS + 1).T
    strong = docs.sparkSession.createDataFrame([(f, j) for j, f in enumerate(names)], "feature string, column int")
    has = found.select("doc_id", F.explode("found").alias("feature")).join(F.broadcast(strong), "feature").groupBy("doc_id").agg(F.collect_list("column").alias("columns")).collect()
    work.drop()
    row = np.repeat(np.array([at[r.doc_id] for r in has], np.int64), [len(r.columns) for r in has])
    x = Incidence(row, np.array([c for r in has for c in r.columns], np.int64), len(documents), len(names))

    def loss(level: float) -> float:
        total = 0.0
        for k in range(FOLDS):
            rest, own = fold != k, ratios[k] >= level
            w = logistic(x.part(rest, own), y[rest], weights[rest], steps=8)
            z = x.part(~rest, own) @ w
            total += float((weights[~rest] * np.logaddexp(0, np.where(y[~rest] > 0, -z, z))).sum())
        return total

    level = min(LEVELS, key=loss)
    own = ratios[-1] >= level
    w = logistic(x.part(np.ones(len(y), bool), own), y, weights)
    return {**{names[j]: float(v) for j, v in zip(np.flatnonzero(own).tolist(), w[:-1], strict=True)}, "": float(w[-1])}


class Incidence:
    """A matrix of zeros and ones as the places of its ones; the last column, all ones, is the bias."""

    def __init__(self, row: np.ndarray, column: np.ndarray, height: int, width: int):
        order = np.lexsort((column, row))
        self.row, self.column, self.height, self.width = row[order], column[order], height, width
        self.shape = (height, width + 1)

    def part(self, rows: np.ndarray, columns: np.ndarray) -> Incidence:
        """Some rows and columns, given as masks."""
        keep = rows[self.row] & columns[self.column]
        place = lambda m: np.cumsum(m) - 1
        return Incidence(place(rows)[self.row[keep]], place(columns)[self.column[keep]], int(rows.sum()), int(columns.sum()))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.height) + w[-1]

    def back(self, u: np.ndarray) -> np.ndarray:
        """The transpose times ``u``."""
        return np.append(np.bincount(self.column, u[self.row], self.width), u.sum())


def logistic(x: np.ndarray | Incidence, y: np.ndarray, weight: np.ndarray, penalty: float = 0.05, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method, its steps by conjugate gradients, so any
    number of features will do; the last column is the bias."""
    back = x.back if isinstance(x, Incidence) else lambda u: x.T @ u
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = back(weight * (p - y)) + ridge * w
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        move, rest = np.zeros_like(w), gradient.copy()
        turn, size = rest.copy(), float(rest @ rest)
        for _ in range(60):
            if size <= 1e-12 * float(gradient @ gradient) or size < 1e-18:
                break
            bent = back(curve * (x @ turn)) + ridge * turn
            step = size / float(turn @ bent)
            move += step * turn
            rest -= step * bent
            size, before = float(rest @ rest), size
            turn = rest + size / before * turn
        w -= move * min(1, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, counts: np.ndarray, weights: dict[str, float], text: str = "text") -> DataFrame:
    """Adds ``score``, the probability that a text is toxic."""
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    names = [f for f in weights if f]
    bias = weights.get("", -math.inf)
    at, value = {f: i for i, f in enumerate(names)}, [weights[f] for f in names]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts)

        def known(pieces: list[str]) -> list[tuple[int, ...]]:
            return [tuple({at[f] for w in restorer.words(p) for f in features(w) if f in at}) for p in pieces]

        cache = PieceCache(known, 500_000)
        for batch in batches:
            for own, texts in chunks(batch, text):
                cut = [restorer.pieces(x) for x in texts]
                get, out = cache.fill(cut), []
                for pieces in cut:
                    # In order of the features, so that equal texts sum alike.
                    z = bias + sum(value[i] for i in sorted(set().union(*map(get, pieces))))
                    out.append(0.0 if z == -math.inf else 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.float64())], names=[*own.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, dict[str, float]]:
    """Character counts over ``docs`` and the weights learnt from ``labels``."""
    counts = count_trigrams(docs)
    return counts, fit(docs, labels, counts, size)


def toxic_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction for every document."""
    counts, weights = train(documents, labels)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(documents.select("doc_id", "text"), counts, weights).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import circulant as C

from .conftest import ODD
from .test_jaccard import near_copies

SPACE = " \t\n\x0b\x0c\r"


def runs(text, n=C.N):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in SPACE else c for c in text or "")
    w = [x for x in own.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts):
    """(set size, component) of each text."""
    sets, root = [runs(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_coordinates_are_one_permutation_shifted_around_the_circle():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 1 << 63, 1500).astype(np.uint64))
    images = [(int(g >> np.uint64(32)) * 0x9E3779B1 + 0x7F4A7C15) % 2**32 for g in grams]
    want = [min(int(C._second(np.array([(x + k) % 2**32], np.uint32))[0]) for x in images) for k in range(7)]
    assert C.circulant_signature(grams, 7).tolist() == want
    assert len(np.unique(C._second(np.arange(100_000, dtype=np.uint32)))) == 100_000


def test_signatures_estimate_the_index():
    from scriptloom.llm.words import mixed

    a, b = mixed(np.arange(900)), mixed(np.arange(100, 1000))
    same = C.circulant_signature(a, 2000) == C.circulant_signature(b, 2000)
    assert abs(same.mean() - 0.8) < 0.04


@pytest.mark.parametrize("block,size", [(256, 4_000_000), (3, 4_000_000), (256, 3000)])
def test_components_equal_brute_force(docs_of, monkeypatch, block, size):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "BLOCK_BYTES", size)
    texts = near_copies(5, 6, 6)
    out = C.near_duplicates(docs_of(texts))
    assert result(out) == dict(enumerate(brute(texts)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_pairs_just_at_and_under_the_threshold(docs_of):
    w = [f"w{i}" for i in range(43)]  # 40 runs of four; a changed last word changes one of them
    at, under = w[:39] + ["x"] + w[40:], w[:38] + ["y"] + w[39:41] + ["z"] + w[42:]
    texts = [" ".join(x) for x in (w, at, under)]
    sets = [runs(t) for t in texts]
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 80 * len(sets[0] | sets[2])
    assert result(C.near_duplicates(docs_of(texts))) == dict(enumerate(brute(texts)))


def test_a_dense_component_of_large_sets_and_a_chain(docs_of, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(30):  # mutual near copies
        own = list(base)
        own[int(rng.integers(400))] = "q" + str(rng.integers(9))
        texts.append(" ".join(own))
    for i in range(25):  # each like the next, the ends unlike
        texts.append(" ".join(f"c{k}" for k in range(8 * i, 8 * i + 120)))
    want = brute(texts)
    assert want[29][1] == 0 and want[54][1] == 30
    assert result(C.near_duplicates(docs_of(texts))) == dict(enumerate(want))


def test_odd_rows(odd, none):
    clash = odd.withColumns({c: F.lit("x") for c in ("key", "bands", "size", "grams", "class", "group", "__bits", "n_shingles")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in C.near_duplicates(clash).collect()), key=str)
    assert len(got) == odd.count()
    first = ODD.index("plain words here")
    assert got.count((first, 1, first, True)) == 2 and (first + 1, 1, first, False) in got
    assert all((i, 0, i, True) in got for i, t in enumerate(ODD) if not runs(t))
    assert (None, 1, None, False) in got
    out = C.near_duplicates(none)
    assert out.collect() == [] and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_rows_without_identifier_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " end"), (4, text + " other"), (7, "else")]
    got = C.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == [(4, 4, True), (7, 7, True), (None, 4, False), (None, 4, False)]


def test_case_and_white_space_are_those_of_ascii(docs_of):
    got = result(C.near_duplicates(docs_of(["A\x0bB\x0cc\rd", "a b C D", "É b c d", "é b c d", "a\xa0b c d"])))
    assert [got[i][1] for i in range(5)] == [0, 0, 2, 3, 4]


def test_long_texts_have_the_words_of_their_parts(monkeypatch):
    text = "  Ab c12 É!\n" * 50 + "x" * 300 + " end"
    want = C.word_hashes(text)
    monkeypatch.setattr(C, "SPAN", 40)
    assert (C.word_hashes(text) == want).all() and len(want) == 152


def test_near_copies_over_a_megabyte(docs_of):
    text = " ".join(f"w{i}" for i in range(250_000))
    assert result(C.near_duplicates(docs_of([text, text + " end", "w1 w2 w3 w4"]))) == {0: (249_997, 0), 1: (249_998, 0), 2: (1, 2)}

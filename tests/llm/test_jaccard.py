import itertools

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from scriptloom.llm import graph
from scriptloom.llm import jaccard as J
from scriptloom.llm.common import Workspace

from .conftest import ODD


def grams(text, n=J.N):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else {"|" + text} if text else set()


def brute(texts):
    """(class, links) of each text."""
    sets = [grams(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and both * 5 >= len(sets[i] | sets[j]) * 4:
            links[i] += 1
            links[j] += 1
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [(r, n) for r, n in zip(root, links, strict=True)]


def near_copies(seed, groups=12, size=8):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for g in range(groups):
        base = list(rng.choice(vocabulary, int(rng.integers(20, 150))))
        for k in range(size):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(own) if k % 3 else " ".join(own).upper() + ".")
    texts += ["a b c", "A, b c!", "one two three four five", "one two three four five six", "", None, "...", "x y", "...", "!?", "...", " "]
    return texts


def test_plan_of_bands():
    bands, rows = J.plan_bands()
    assert bands * rows <= J.HASHES and 1 - (1 - 0.8**rows) ** bands >= J.RECALL
    assert 1 - (1 - 0.8 ** (rows + 1)) ** (J.HASHES // (rows + 1)) < J.RECALL
    with pytest.raises(ValueError):
        J.plan_bands(0.01, 0.999999, 4)


@pytest.mark.parametrize("block", [512, 3])
def test_links_and_classes_equal_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = near_copies(1)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.link_documents(docs_of(texts)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.link_documents(odd.withColumn("key", F.lit("clash"))).collect()), key=str)
    assert len(got) == odd.count()
    same = [i for i, t in enumerate(ODD) if t == "plain words here"]
    assert [g for g in got if g[0] == same[0]] == [(same[0], same[0], 2)] * 2
    assert all((i, i, 0) in got for i, t in enumerate(ODD) if not grams(t))
    assert (None, None, 0) in got
    assert J.link_documents(none).collect() == [] and J.one_of_each(none).collect() == []


def test_null_ids_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " end"), (4, text + " other end"), (7, "else")]
    got = J.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == [(4, 4, 2), (7, 7, 0), (None, 4, 2), (None, 4, 2)]


def test_one_of_each(spark, docs_of, odd):
    texts = near_copies(2, 5, 5)
    kept = sorted(r.doc_id for r in J.one_of_each(docs_of(texts)).collect())
    assert kept == sorted({c for c, _ in brute(texts)})
    out = J.one_of_each(odd)
    assert out.columns == odd.columns
    assert [r.text for r in out.collect()].count("plain words here") == 1
    wordless = [t for t in ODD if not grams(t)]
    assert len([1 for r in out.collect() if not grams(r.text)]) == len(wordless)


def test_intersections_by_matrix_equal_those_by_search(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, int(n)).astype(np.uint64)) for n in rng.integers(1, 6000, 20)]
    mask = np.ones((20, 20), bool)
    one = J.intersections(sets, sets, mask)
    monkeypatch.setattr(J, "DENSE", 10)
    assert (J.intersections(sets, sets, mask) == one).all()
    assert (one == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_signatures_estimate_the_index():
    a, b = (np.unique(x) for x in (J.windows(J.mixed(np.arange(900)), 1), J.windows(J.mixed(np.arange(100, 1000)), 1)))
    n = 2000
    assert abs((J.signature(a, n) == J.signature(b, n)).mean() - 0.8) < 0.04


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 540)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "cc"), "t").collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_words_of_long_texts_are_those_of_short_ones(monkeypatch):
    from scriptloom.llm import words as W

    texts = ["Ab, c12 É! " * 50, "", "one", "x" * 300 + " y"]
    want = W.words(texts)
    monkeypatch.setattr(W, "SPAN", 40)
    got = W.words(texts)
    assert all((getattr(got, f) == getattr(want, f)).all() for f in ("text", "start", "stop", "hash", "number", "title"))


def test_long_words_are_told_apart():
    from scriptloom.llm.words import words

    a, b, c = (words([x]).hash.tolist() for x in ("x" * 4096 + "y" * 4096, "y" * 4096 + "x" * 4096, "X" * 4096 + "y" * 4096))
    assert a != b and a == c


def test_a_chain_halves_with_each_pair_of_rounds(spark, monkeypatch):
    work = Workspace(spark, "chain")
    rounds = []
    monkeypatch.setattr(work, "save", lambda df, name, save=work.save: rounds.append(name) or save(df, name))
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"), work, "t").collect()}
    assert got == dict.fromkeys(range(301), 0)
    assert sum("map" in n for n in rounds) <= 24


@pytest.mark.parametrize("bits", [26, 8])
def test_sifting_loses_no_wanted_row(spark, monkeypatch, bits):
    from scriptloom.llm import common

    monkeypatch.setattr(common, "SIFT_BITS", bits)
    rows = spark.range(5000).union(spark.sql("SELECT cast(null AS bigint)")).withColumn("x", F.lit("x"))
    may, no = common.sifted(rows, spark.createDataFrame([(7,), (900,), (None,), (10**6,)], "id int"), "id")
    assert may.columns == no.columns == rows.columns
    a, b = {r.id for r in may.collect()}, {r.id for r in no.collect()}
    assert {7, 900, None} <= a and not a & b and a | b == {*range(5000), None}
    assert len(a) < (10 if bits == 26 else 400)


def test_copies_that_may_not_exist_are_not_shuffled(spark, docs_of):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)] + ["same words in both of these two texts here"] * 2
    plan = J.one_of_each(docs_of(texts))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_extra_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", "k1"), (1, "a b c d e f", "k1"), (2, "A b c d e f!", "k2"), (3, "", "k3"), (3, "", "k3"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("root", F.lit(5))
    out = J.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 3, 4]

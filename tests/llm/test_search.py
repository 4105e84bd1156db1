import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import search as S

from .conftest import ODD


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(docs, items, k=S.TOP):
    """(item, rank, document, score), documents and items as (id, text)."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=200):
    rng = np.random.default_rng(seed)
    words = [f"w{int(i)}" for i in range(80)] + ["Ünï", "ß1", "naïve", "漢字", "X-ray", "l'eau"]
    p = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, int(rng.integers(0, 60)), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize("segment,terms_,scored", [(S.SEGMENT, S.QUERY_TERMS, S.SCORED), (300, 12, 1), (1, 1, 40)])
def test_ranks_equal_brute_force(spark, docs_of, monkeypatch, segment, terms_, scored):
    for name, value in (("SEGMENT", segment), ("QUERY_TERMS", terms_), ("SCORED", scored)):
        monkeypatch.setattr(S, name, value)
    texts = corpus(1)
    items = [(7, "w1 w2 W3 w3"), (8, "漢字 naïve, ünï Ünï"), (9, "w0 nowhere"), (10, "w70 w71 w72 X ray eau"), (11, "?!"), (12, None)]
    docs = docs_of(texts).repartition(5)
    got = ranked(S.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(list(enumerate(texts)), items) and {g[0] for g in got} == {7, 8, 9, 10}


def test_fewer_places_and_ties(spark, docs_of):
    texts = ["same words"] * 9 + ["other words"] * 3 + ["alone"]
    items = [(1, "same"), (2, "words"), (3, "alone same other")]
    docs = docs_of(texts).repartition(4)
    got = ranked(S.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string"), k=4))
    assert got == brute(list(enumerate(texts)), items, 4) and [g[2] for g in got if g[0] == 1] == [0, 1, 2, 3]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "plain words 12345"), (1, "plain words 12345"), (None, "word X"), (3, "é café")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    clash = odd.withColumns({c: F.lit("x") for c in ("ids", "terms", "rank", "score", "query", "item_id")})
    got = ranked(S.rank_documents(clash, items.withColumn("doc_id", F.lit(1)).withColumn("terms", F.lit(1))))
    assert got == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert S.rank_documents(none, items).collect() == [] and S.rank_documents(odd, items.limit(0)).collect() == []
    assert S.rank_documents(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_documents_without_identifier_come_last(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a c"), (None, "a d"), (-4, "a e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert ranked(S.rank_documents(docs, items)) == brute([(None, "a b"), (3, "a c"), (None, "a d"), (-4, "a e")], [(1, "a b c d e")])


def test_numbers_of_any_size_are_packed():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 5, 2**62], np.int64)
    data, sizes = S.packed(values)
    assert S.unpacked(np.frombuffer(data, np.uint8)).tolist() == values.tolist()
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 6, 9] and len(S.unpacked(np.zeros(0, np.uint8))) == 0


def test_cursors_merge_in_ascending_order():
    rng = np.random.default_rng(2)
    postings = [sorted(int(p) * 20 + t for p in rng.choice(500, int(rng.integers(1, 200)), replace=False)) for t in range(20)]
    assert S.merge(postings, 20) == sorted(x for p in postings for x in p)


def test_a_segment_gives_back_what_it_was_made_of():
    texts = ["b a b", "", "c b", None, "ODD\0a"]
    ids, lengths, found, df, ends, data = S.segment([5, 2, None, 1, 3], texts)
    assert ids == [1, 2, 3, 5, None] and lengths == [0, 0, 2, 3, 2]
    postings, start = {}, 0
    for t, n, end in zip(found, df, ends, strict=True):
        own = S.unpacked(np.frombuffer(data, np.uint8)[start:end]).reshape(-1, 2)
        postings[t.decode()], start = list(zip(np.cumsum(own[:, 0]).tolist(), own[:, 1].tolist(), strict=True)), end
        assert len(own) == n
    assert postings == {"a": [(2, 1), (3, 1)], "b": [(3, 2), (4, 1)], "c": [(4, 1)], "odd": [(2, 1)]}


def test_long_texts_have_the_terms_of_their_parts(monkeypatch):
    text = "Ab, c12 É! " * 50 + "x" * 300
    want = [t for part in S.terms_of(text) for t in part]
    assert [t.decode() for t in want] == terms(text)
    monkeypatch.setattr(S, "SPAN", 40)
    assert [t for part in S.terms_of(text) for t in part] == want


def test_a_text_over_a_megabyte(spark, docs_of):
    texts = ["tide " * 200_000 + "table " * 100_000, "tide table", "else"]
    items = [(1, "table tide else")]
    assert ranked(S.rank_documents(docs_of(texts), spark.createDataFrame(items, "item_id long, text string"))) == brute(list(enumerate(texts)), items)

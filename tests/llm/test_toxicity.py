import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import toxicity as X

WORDS = "the river ran over stones and we walked home along quiet fields while birds sang above every roof".split()
BAD = ["idiot", "moron", "pathetic"]
HIDDEN = {"idiot": ["1d10t", "i d i o t", "IDIOOOT", "id!ot"], "moron": ["m0r0n", "m-o-r-o-n"], "pathetic": ["p4thetic", "path3t1c"]}


def corpus(n=600):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS, 30))
        toxic = int(i % 4 == 0)
        if toxic:
            bad = BAD[i % 3]
            words.insert(int(rng.integers(30)), bad if i % 8 else HIDDEN[bad][i % len(HIDDEN[bad])])
        rows.append((i, " ".join(words), "en", "s", 1, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long, toxic int")
    return df.drop("toxic"), df.select("doc_id", "toxic", F.lit(1).alias("quality"))


def test_trigrams_equal_counting():
    texts = ["Abc abé", "z"]
    padded = ["".join(c if c in X.ALPHABET else "_" for c in "__" + "\n\n".join(texts).lower() + "_")]
    want = Counter(padded[0][i : i + 3] for i in range(len(padded[0]) - 2))
    code = lambda c: X.ALPHABET.find(c) + 1
    got = X.trigram_array(texts)
    assert {k: got[code(k[0]) * X.SIZE**2 + code(k[1]) * X.SIZE + code(k[2])] for k in want} == want and got.sum() == sum(want.values())


def readings(token):
    """All (reading, channel cost) of a token without wildcards."""
    out = [("", 0.0)]
    for i, c in enumerate(token):
        new = []
        for text, cost in out:
            repeat = i and token[i - 1] == c
            if repeat:
                new.append((text, cost + X.DROP_REPEAT))
            for x, extra in [(c, 0.0)] if c in X.ALPHABET else [(x, X.SUBSTITUTE) for x in X.LEET.get(c, "")]:
                new.append((text + x, cost + extra + (X.KEEP_REPEAT if repeat else 0)))
        out = new
    return out


def test_viterbi_equals_all_paths(tables):
    model = X.CharModel(X.count_trigrams(tables[0]))

    def cost(text):
        codes = [0, 0, *(X._CODES[c] for c in text), 0]
        return sum(float(model.cost[codes[i], codes[i + 1], codes[i + 2]]) for i in range(len(codes) - 2))

    for token in ("1d10t", "m0r0n", "idiooot", "fi31d5", "roof", "bb1rd"):
        best = min((c + cost(t), t) for t, c in readings(token))
        assert model.decode(token) == best[1]


def test_hidden_words_are_restored(tables):
    r = X.Restorer(X.count_trigrams(tables[0]))
    for word, hidden in HIDDEN.items():
        for h in hidden:
            assert word in r.restore(f"the {h} walked").split(), h
    assert r.restore("We walked home, 2024 times!") == "we walked home, 2024 times!"
    assert r.restore(None) == "" and r.restore("a b and c") == "a b and c"


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in X.toxic_documents(docs, labels).collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out == (i in held) for i in got)
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_are_not_used(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.train(docs, labels)[1] == X.train(docs, flipped)[1]


def test_sample_is_bounded_and_weighted(tables):
    chosen, weight = X.sample_labels(tables[1], 50)
    counts = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 50, 1: 50} and weight[0] > weight[1] > 1


def test_odd_rows(odd, none, tables):
    counts, weights = X.train(*tables)
    got = X.score(odd.withColumn("score", F.lit("clash")), counts, weights).collect()
    assert len(got) == odd.count()
    alone = {r.score for r in got if not (r.text or "").strip()}
    assert len(alone) == 1 and len({r.score for r in got if r.text == "plain words here"}) == 1
    assert X.score(none, counts, weights).collect() == []


def test_without_labels(odd, tables):
    got = X.toxic_documents(odd, tables[1].where("false")).collect()
    assert {r.score for r in got} == {0.0} and {r.predicted for r in got} == {0}


def test_logistic_regression_reaches_its_optimum():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 2, (200, 3)), np.ones(200)]).astype(float)
    y = (x[:, 0] + rng.normal(0, 0.4, 200) > 0.5).astype(float)
    w = X.logistic(x, y, np.ones(200), 1.0)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + np.array([1, 1, 1, 1e-6]) * w).max() < 1e-4
    row, column = np.nonzero(x[:, :3])
    sparse = X.Incidence(row, column, 200, 3)
    assert np.allclose(X.logistic(sparse, y, np.ones(200), 1.0), w, atol=1e-5)
    rows, columns = np.arange(200) % 3 > 0, np.array([True, False, True])
    part, v = sparse.part(rows, columns), np.array([0.5, -2.0, 1.0])
    assert np.allclose(part @ v, x[rows][:, [0, 2, 3]] @ v) and np.allclose(part.back(y[rows]), x[rows][:, [0, 2, 3]].T @ y[rows])


SPACED = ["she is a stupid man and i am a fool", "an idiot is a stupid idiot and a moron", "y a un idiot"] * 40


def test_separators_are_nothing_or_the_end_of_a_word():
    r = X.Restorer(X.trigram_array(SPACED))
    assert r.restore("you a i d i o t here") == "you a idiot here"
    assert r.restore("a s t u p i d i d i o t") == "a stupid idiot"
    for text in ("a i d i o t", "s t u p i d i d i o t", "s-t-u-p-1-d-i-d-i-o-t", "i_d_i_o_t", "i d ! o t", "s t u p i d i d i o t !"):
        assert "idiot" in {w for p in r.pieces("you " + text) for w in r.words(p)}, text
    assert r.restore("1 2 3 4 5") == "1 2 3 4 5"


def test_long_tokens_are_decoded():
    r = X.Restorer(X.trigram_array(SPACED))
    for text in ("idi" + "o" * 60 + "t", "1d10t" + "!" * 60, "idi" + "o" * 5000 + "t", "1d10t" + "!" * 3000, "id*ot" + "*" * 3000):
        assert "idiot" in {w for p in r.pieces(text) for w in r.words(p)}, text[:9]


def test_arrays_of_states_decode_alike():
    model = X.CharModel(X.trigram_array(SPACED))
    for token in ("1d10t", "idiooot", "m0r0n!!!", "a i d i o t", "s t u p i d i d i 0 0 t", "id*ot", "st*p1d", "i!!d|0t"):
        assert model.decode_wild(token) == model.decode(token), token


def test_words_with_signs_or_long_runs_are_decoded():
    r = X.Restorer(X.trigram_array(["you pass an ass on the grass", "class mass"] * 40))
    assert "ass" in r.words("a55") and "pass" in r.words("pa$$") and "class" in r.words("c1ass")
    for word in ("a5", "5a", "ooo", "i!", "a1b", "xxx", "loop"):
        assert X._HIDDEN.search(word) and set(r.words(word)) >= set(X._WORD.findall(word)), word
    for word in ("plain", "2024", "a", "55"):
        assert not X._HIDDEN.search(word) and r.words(word) == X._WORD.findall(word)
    assert r.restore("grass for the class") == "grass for the class"


def test_nothing_that_hides_a_word_passes_the_gates():
    r = X.Restorer(X.trigram_array(SPACED))
    texts = ["iddiot", "idiiot", "i  d  i  o  t", "i.d-i.o.t", "i/d/i/o/t", "i,d,i,o,t", "i - d - i - o - t", "\uff49\uff44\uff49\uff4f\uff54", "i\u200bd\u200bi\u200bo\u200bt", "id\u00adiot", "\u0456d\u0456\u043et", "id\u0456\u03bft", "ID\u0406OT", "\uff11d\uff11ot", "i_d__i_o t"]
    for text in texts:
        assert "idiot" in {w for p in r.pieces(f"you {text} there") for w in r.words(p)}, text
    assert X.folded("\u043f\u0440\u043e\u0441\u0442\u043e \u0442\u0435\u043a\u0441\u0442 caf\u00e9") == "\u043f\u0440\u043e\u0441\u0442\u043e \u0442\u0435\u043a\u0441\u0442 caf\u00e9"
    assert X.folded("ABC") == "abc" and X.folded("") == ""


def test_repeated_rows_and_labels_teach_once(tables):
    docs, labels = tables
    twice = X.train(docs.unionByName(docs), labels.unionByName(labels))[1]
    once = X.train(docs, labels)[1]
    assert twice.keys() == once.keys()
    counts = X.count_trigrams(docs)
    assert X.fit(docs.unionByName(docs), labels.unionByName(labels), counts) == X.fit(docs, labels, counts)

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import templates as T

ITEM = "Yesterday the train that carried Alice Brown left the old station with 45 passengers and travelled 120 km through green hills before Alice Brown counted 45 tickets again"
SCHEMA = "item_id long, text string"


def tokens(text):
    (found,) = T.template([text])
    hashes, kinds, spans = found
    return [(int(k), text[a:b]) for k, (a, b) in zip(kinds, spans, strict=True)]


def test_template_tokens():
    assert tokens("It cost 1,234.5 euros. Then Anna Maria Lund ran 5 km to Rome\nWith us") == [
        (0, "It"), (0, "cost"), (T.NUMBER, "1,234.5"), (T.UNIT, "euros"), (0, "Then"), (T.NAME, "Anna Maria Lund"),
        (0, "ran"), (T.NUMBER, "5"), (T.UNIT, "km"), (0, "to"), (T.NAME, "Rome"), (0, "With"), (0, "us"),
    ]
    assert tokens("") == [] and [k for k, _ in tokens("10 20 m")] == [T.NUMBER, T.NUMBER, T.UNIT]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "a second passage that has nothing in common with anything else in this test at all"), (3, "few words only here"), (4, None), (5, "seven words that are in no other")], SCHEMA)


FILL = "some other words come first and fill the text. "
DOCS = {
    "verbatim": FILL + ITEM + " and more follows",
    "changed": FILL + ITEM.replace("45", "61").replace("120 km", "75 miles").replace("Alice Brown", "Peter Stone"),
    "inconsistent": FILL + ITEM.replace("45 tickets", "46 tickets").replace("Alice Brown counted", "Bob Green counted"),
    "clean": FILL * 5,
    "upper": FILL + ITEM.upper().replace("ALICE BROWN", "Alice Brown"),
    "short": "well, seven words that are in no other text",
    "part": FILL + " ".join(ITEM.split()[:9]),
}


def found(docs, items, **kw):
    return {(r.doc_id, r.item_id): r for r in T.find_leaks(docs, items, **kw).collect()}


def test_leaks(docs_of, items):
    docs = docs_of(list(DOCS.values()))
    got = found(docs, items)
    assert {(list(DOCS)[d], i) for d, i in got} == {("verbatim", 1), ("changed", 1), ("upper", 1), ("short", 5)}
    assert found(docs, items, common=0).keys() == got.keys()


def test_clashing_slots_are_no_leak(docs_of, spark):
    item = "take N apples and N pears then give N plums to the boy and keep N figs".replace("N", "3")
    items = spark.createDataFrame([(1, item)], SCHEMA)
    same, clash, merged = item.replace("3", "8"), item.replace("3", "8", 2).replace("3", "9"), "take 1 apples and 2 pears then give 3 plums to the boy and keep 4 figs"
    assert set(found(docs_of([same, clash, merged, item]), items)) == {(0, 1), (3, 1)}


def test_literal_windows_count_beside_clashing_ones(docs_of, spark):
    item = "they paid 7 coins for bread and 7 coins for cheese while many quiet people were standing around in the warm evening light and said nothing about it at all"
    items = spark.createDataFrame([(1, item)], SCHEMA)
    clash = item.replace("7", "8", 1)
    whole, part = found(docs_of([item, clash]), items)[0, 1], found(docs_of([item, clash]), items)[1, 1]
    assert whole.matched == whole.windows > part.matched > T.ENOUGH


def test_pairs_and_filtering(docs_of, items):
    docs = docs_of(list(DOCS.values())).withColumn("extra", F.lit(1))
    pairs = T.leaked_items(docs.unionByName(docs), items).collect()
    assert len(pairs) == len({(r.doc_id, r.item_id) for r in pairs})
    kept = T.without_leaks(docs, items)
    assert kept.columns == docs.columns and {list(DOCS)[r.doc_id] for r in kept.collect()} == {"clean", "part", "inconsistent"}


def test_odd_rows(odd, none, items, spark):
    assert T.leaked_items(odd, items).collect() == []
    assert T.without_leaks(odd, items).count() == odd.count()
    assert T.leaked_items(none, items).collect() == [] and T.leaked_items(odd, items.where("false")).collect() == []
    leak = spark.createDataFrame([(None, ITEM), (None, "clean words"), (2, ITEM), (2, "clean words")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in T.leaked_items(leak, items).collect()), key=str) == [(2, 1), (None, 1)]
    assert [r.text for r in T.without_leaks(leak, items).collect()] == ["clean words"] * 2


def windows_by_hand(text):
    own = [f"<{k}>" if k else t.lower() for k, t in tokens(text)]
    return {tuple(own[i : i + T.WINDOW]) for i in range(len(own) - T.WINDOW + 1)}


def test_verbatim_matches_equal_brute_force(spark, docs_of):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(50)]
    passages = [" ".join(rng.choice(words, 30)) for _ in range(6)]
    docs = [" ".join(rng.choice(words, 80)) + (" " + passages[i % 6] if i % 3 == 0 else "") for i in range(60)]
    got = set(found(docs_of(docs), spark.createDataFrame(list(enumerate(passages)), SCHEMA)))
    want = {(d, i) for d, x in enumerate(docs) for i, p in enumerate(passages) if len(windows_by_hand(x) & windows_by_hand(p)) >= T.ENOUGH}
    assert got == want and len(want) >= 20


OPENING = "Alice has 12 apples. Alice buys 7 more. Alice eats 3 pears. Alice sells 5 plums. Alice keeps the rest"


def test_names_that_open_sentences(docs_of, spark):
    items = spark.createDataFrame([(1, OPENING), (2, "What is the capital city of France?")], SCHEMA)
    docs = docs_of([OPENING.replace("Alice", "Bob").replace("12", "15"), "Q: What is the capital city of France?", "so, What is the capital city of France", OPENING.replace(". ", ".\n"), FILL])
    assert set(found(docs, items)) == {(0, 1), (1, 2), (2, 2), (3, 1)} == set(found(docs, items, common=0))


def test_verbatim_windows_short_of_literals(docs_of, spark):
    sums, names, title = "Compute 12 + 7 * 3 - 4 / 2", "Alice Brown, Peter Stone, Carmen Lund, Hugo Green", "Great Expectations And Other Famous Stories Retold"
    items = spark.createDataFrame(list(enumerate([sums, names, title])), SCHEMA)
    docs = docs_of([FILL + sums, "well: " + names, "We read " + title + " once", sums.replace("7", "8"), names.replace("Hugo", "Otto").replace("Carmen", "Claire")])
    assert set(found(docs, items)) == {(0, 0), (1, 1), (2, 2)} == set(found(docs, items, common=0))


def test_numbers_in_words():
    assert tokens("We saw twenty-five birds, two hundred thousand ants, 3 million bees and seven km more; five kilometres in one day. Millions came") == [
        (0, "We"), (0, "saw"), (T.NUMBER, "twenty-five"), (0, "birds"), (T.NUMBER, "two hundred thousand"), (0, "ants"), (T.NUMBER, "3 million"),
        (0, "bees"), (0, "and"), (T.NUMBER, "seven"), (0, "km"), (0, "more"), (T.NUMBER, "five"), (T.UNIT, "kilometres"), (0, "in"), (T.NUMBER, "one"), (T.UNIT, "day"), (0, "Millions"), (0, "came"),
    ]
    assert list(map(T.value, ["Twenty-Five", "two hundred thousand", "3 million", "2 thousand five hundred six", "1,234.5", "Anna  Lund", "five/six"])) == ["25", "200000", "3000000", "2506", "1,234.5", "anna lund", "five/six"]


def test_numbers_spelt_out_are_parameters(docs_of, spark):
    item = "Anna had twelve apples and gave five of them away so how many apples are left in the basket now"
    items = spark.createDataFrame([(1, item)], SCHEMA)
    docs = [FILL + item.replace("twelve", "thirty-one").replace("five", "seven"), FILL + item.replace("twelve", "31").replace("five", "7"), FILL]
    assert set(found(docs_of(docs), items)) == {(0, 1), (1, 1)}


SHORT = ["Who wrote Hamlet first", "name this city", "forty two", "gold"]


def test_items_of_few_words_stand_for_themselves(docs_of, spark):
    items = spark.createDataFrame(list(enumerate(SHORT)), SCHEMA)
    docs = ["Q: Who wrote Hamlet first?", "they asked who wrote Hamlet first of all", "so.\nName this city!\nwell", "please name this city", "Forty-two", "it is forty two. so", "gold", "gold. more", FILL + "\"who wrote hamlet first\" " + FILL, ""]
    assert set(found(docs_of(docs), items)) == {(0, 0), (2, 1), (4, 2), (6, 3), (8, 0)} == set(found(docs_of(docs), items, common=0))


def leaks_by_hand(text, item):
    """Matched words by level, with windows as tuples of tokens and plain loops."""

    def read(x):
        out = {}
        for r, own in T.readings([x]).items():
            (hashes, kinds, spans, word) = own[0]
            out[r] = [(int(k) if r != T.EXACT else 0, x[a:b].lower() if r == T.EXACT or not k else f"<{k}>", f"{k}:{T.value(x[a:b])}", int(w)) for k, (a, b), w in zip(kinds, spans, word, strict=True)]
        return out

    theirs, mine, places, total = read(item), read(text), [set(), set(), set()], [set(), set(), set()]
    kinds_of = {r: own[0][1] for r, own in T.readings([item]).items()}
    own_windows = {}
    for r, own in theirs.items():
        size = min(T.WINDOW, len(own))
        starts = range(len(own) - size + 1)
        literal = lambda i: sum(k == 0 for k in kinds_of[r][i : i + size].tolist())  # noqa: B023, E731
        if r != T.EXACT:
            own_windows[r] = (size, [i for i in starts if size >= T.LEAST and literal(i) * 2 >= size])
        else:
            bare = not own_windows[0][1] or not own_windows[1][1]
            own_windows[r] = (size, [i for i in starts if bare or literal(i) * 2 < size])
    for r, (size, at) in own_windows.items():
        for level in range(r, 3):
            total[level] |= {theirs[r][i][3] for i in at}
        for s in (T.OPENERS_LITERAL, T.OPENERS_NAMES) if r != T.EXACT else (T.EXACT,):
            lines = {}
            for j in range(len(mine[s]) - size + 1):
                for i in at:
                    if all(a[1] == b[1] for a, b in zip(theirs[r][i : i + size], mine[s][j : j + size], strict=True)):
                        lines.setdefault(j - i, []).append((i, j))
            for own in lines.values():
                pairs = {(a[2], b[2]) for i, j in own for a, b in zip(theirs[r][i : i + size], mine[s][j : j + size], strict=True) if a[0]}
                fine = len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
                for i, _ in own:
                    if fine or not any(t[0] for t in theirs[r][i : i + size]):
                        for level in range(r, 3):
                            places[level].add(theirs[r][i][3])
    share, matched, windows = max((len(p) / max(1, len(t)), len(p), len(t)) for p, t in zip(places, total, strict=True))
    return (matched, windows) if share >= T.SHARE or max(map(len, places)) >= T.ENOUGH else None


def test_templates_equal_brute_force(docs_of, spark):
    rng = np.random.default_rng(4)
    plain, names, numbers = ["river", "stone", "walks", "under", "quiet", "green", "over", "then", "boat"], ["Anna", "Bob Lund", "Carla"], ["3", "twelve", "4.5", "twenty six", "900"]

    def passage(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(names) if x < 0.12 else rng.choice(numbers) + (" km" if x < 0.16 else "") if x < 0.26 else rng.choice(plain) + ("." if x > 0.95 else ""))
        return " ".join(out)

    stem = "Read this question slowly and choose one of the answers below. "
    items = [(stem if i % 3 == 0 else "") + passage(int(rng.integers(6, 24))) for i in range(24)]

    def changed(x):
        for a, b in zip(names + numbers, ["Dora", "Emil Stone", "Fay"] + ["31", "nine", "77", "8.25", "forty one"], strict=True):
            if rng.random() < 0.5:
                x = x.replace(a, b) if rng.random() < 0.7 else x.replace(a, b, 1)
        return x

    docs = [f"{passage(10)} {changed(items[i % 24])} {passage(8)}" + (f" {items[i % 24]}" * 3 if i % 7 == 0 else "") for i in range(48)] + [stem + passage(15) for _ in range(6)]
    rows = spark.createDataFrame(list(enumerate(items)), SCHEMA)
    want = {(d, i): m for d, x in enumerate(docs) for i, y in enumerate(items) if (m := leaks_by_hand(x, y))}
    assert 20 < len(want) < len(docs) * 3
    for common in (0, 3, 10**9):
        assert {k: (r.matched, r.windows) for k, r in found(docs_of(docs), rows, common=common).items()} == want


def test_repeating_texts_leave_in_batches(docs_of, spark):
    """A window without slots leaves once; the others are counted by aggregates."""
    item = "they counted seven boats and nine green carts before the long rain came down over the old town wall"
    items = spark.createDataFrame([(1, item)], SCHEMA)
    text = (item + " ") * 3000
    windows = T.all_windows(docs_of([text]), "doc_id", "text", ((T.OPENERS_LITERAL, T.WINDOW),), T.bloom(T.all_windows(items, "item_id", "text", None).select("hash")))
    by = {r.s: r["count"] for r in windows.groupBy((F.size("slots") > 0).alias("s")).count().collect()}
    assert by[False] < 30 and by[True] > 3000
    assert set(found(docs_of([text]), items)) == {(0, 1)}

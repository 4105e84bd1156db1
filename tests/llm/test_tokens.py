import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptloom.llm import bpe, pieces, sst, unigram
from scriptloom.llm.common import Workspace

from .conftest import ODD

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
VOCAB = P.path("byte_bpe_50k.json")


def test_quick_pieces_cut_only_where_the_pattern_cuts():
    find = regex.compile(P.PATTERN).findall
    for parts in itertools.product(["a", " ", "\n", "'s", "!", "1", " "], repeat=5):
        text = "".join(parts)
        cut = pieces.quick_pieces(text)
        if cut is not None:
            assert "".join(cut) == text
            assert [w for p in cut for w in find(p)] == find(text), text


def test_texts_cut_together_are_cut_as_alone():
    texts = ["a b\nc d.", "", "x", " lead", "tab\there is", "two  spaces", "é ü\nñ", "nul\0", "nb\u00a0sp ace", "trail "]
    cut = pieces.cut_texts(texts)
    for i, text in enumerate(texts):
        own = [cut.pieces[j] for j in cut.index[cut.offsets[i] : cut.offsets[i + 1]]]
        alone = pieces.quick_pieces(text)
        assert cut.slow[i] == (alone is None) and (own == [""] if not alone else own == alone)
    got = cut.joined([p.encode() for p in cut.pieces], "u1")
    assert [bytes(g).decode() for g in got] == ["" if s else t for t, s in zip(texts, cut.slow, strict=True)]
    assert pieces.cut_texts([]).joined([], "u1") == []


def test_cache_keeps_early_pieces_and_changes_no_value():
    cache = pieces.PieceCache(lambda xs: [x.upper() for x in xs], 2)
    assert cache.fill([["a", "b"]])("a") == "A"
    get = cache.fill([["b", "c"]])
    # One of the first two stays; which one came first is not said.
    assert (get("b"), get("c")) == ("B", "C") and cache.known in ({"a": "A", "b": "B", "c": "C"}, {"b": "B", "c": "C"})
    assert cache.fill([["a", "b", "c", "d"]])("d") == "D"


def test_ids_equal_tiktoken_and_decode_back(odd):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=unigram.load_ranks(RANKS), special_tokens={})
    got = bpe.encode_decode(odd.withColumn("ids", F.lit("clash")), RANKS, P.PATTERN).collect()
    assert len(got) == odd.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_contraction_takes_the_leftmost_pair_of_least_rank():
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=unigram.load_ranks(RANKS), special_tokens={})
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abeinrsté"), rng.integers(2, 40))) for _ in range(3000)] + ["aaaa" * 50, "abab" * 60]
    got = bpe.coder(RANKS, P.PATTERN).words(words)
    assert all(np.frombuffer(got[w], "<u2").tolist() == enc.encode_ordinary(w) for w in words)


def test_empty_tables(spark, none):
    assert bpe.encode_decode(none, RANKS, P.PATTERN).collect() == []
    assert unigram.token_counts(none, RANKS, P.PATTERN).collect() == []
    assert sst.token_shards(spark, none, VOCAB).collect() == []


def best_by_enumeration(word, costs):
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(p in costs for p in parts):
            state = (sum(costs[p] for p in parts), len(parts))
            best = state if best is None or state < best else best
    return best[::-1]


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_trie_states_are_best_segmentations(limit):
    costs = unigram.zipf_costs(unigram.load_ranks(RANKS))
    trie = unigram.ForwardTrie(costs, limit)
    for word in [b"the", b"then", b" thereof", b"zzxq", "étés".encode(), b"theme", b"the"]:
        assert trie.count(word) == best_by_enumeration(word, costs)


def test_trie_shares_prefixes():
    trie = unigram.ForwardTrie(unigram.zipf_costs(unigram.load_ranks(RANKS)))
    trie.count(b"thereof")
    before = len(trie.states)
    trie.count(b"therein")
    assert len(trie.states) == before + 2


def test_costs_are_a_distribution():
    costs = unigram.zipf_costs({b"a": 0, b"b": 1, b"ab": 2})
    assert math.isclose(sum(math.exp(-c / 1e6) for c in costs.values()), 1, rel_tol=1e-5)


def plain_viterbi(word, costs):
    """(cost, tokens, segmentation) by a table of its own, without a trie."""
    best = [(0, 0, ())]
    for end in range(1, len(word) + 1):
        best.append(min(((best[i][0] + costs[word[i:end]], best[i][1] + 1, i) for i in range(max(0, end - 40), end) if word[i:end] in costs)))
    parts, end = [], len(word)
    while end:
        parts.append(word[best[end][2] : end])
        end = best[end][2]
    return best[-1][0], best[-1][1], parts


def test_the_whole_query_equals_brute_force(odd):
    ranks = unigram.load_ranks(RANKS)
    find, order = regex.compile(P.PATTERN).findall, sorted(ranks, key=ranks.get)
    words = {r: find(r.text or "") for r in odd.collect()}
    zipf, n, known = unigram.zipf_costs(ranks), dict.fromkeys(order, 0), {}
    for own in words.values():
        for w in own:
            for t in known.setdefault(w, plain_viterbi(w.encode(), zipf))[2]:
                n[t] += 1
    total = sum(n.values()) + len(n)
    costs = {t: round(1e6 * (math.log(total) - math.log(k + 1))) for t, k in n.items()}
    got = unigram.estimated_costs(odd, RANKS, P.PATTERN)
    assert np.abs(got - np.array([costs[t] for t in order])).max() <= 1
    costs, known = dict(zip(order, got.tolist(), strict=True)), {}
    out = unigram.token_counts(odd.withColumn("n_tokens", F.lit("clash")), RANKS, P.PATTERN).collect()
    assert len(out) == len(words)
    for r in out:
        best = [known.setdefault(w, plain_viterbi(w.encode(), costs)) for w in find(r.text or "")]
        assert (r.n_pretokens, r.n_tokens, r.cost_micronats) == (len(best), sum(b[1] for b in best), sum(b[0] for b in best))


def test_given_costs_are_used(docs_of):
    costs = np.array(list(unigram.zipf_costs(unigram.load_ranks(RANKS)).values()))
    r = unigram.token_counts(docs_of(["the the"]), RANKS, P.PATTERN, costs=costs).first()
    by_token = unigram.zipf_costs(unigram.load_ranks(RANKS))
    assert r.cost_micronats == plain_viterbi(b"the", by_token)[0] + plain_viterbi(b" the", by_token)[0]


def test_shards_are_closed_by_size(spark, docs_of):
    docs = docs_of([f"text {i} " * 400 for i in range(900)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id")))
    work = Workspace(spark, "rolled")
    made = sst.write_shards(docs, f"{work.path}/s", VOCAB, shard_bytes=1)
    manifest = work.save(made, "manifest")
    assert manifest.count() > 6 and manifest.where("first_id is null").count() > 1
    got = sorted(sst.read_shards(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [i for i in range(900) if i % 3]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    work.drop()


def test_shards_hold_every_document_in_order(spark, odd):
    tokenizer = Tokenizer.from_file(VOCAB)
    start = 0
    got = sst.token_shards(spark, odd, VOCAB).collect()
    want = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest()))
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    for r, w in zip(got, want, strict=True):
        ids = [*tokenizer.encode(w.text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(VOCAB)
    rng = np.random.default_rng(8)
    alphabet = list("abcdeéñßüxyz'.,!  \n\n12é漢字ǅªº²ⅷ\u0301\U0001f600")
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(4000)] + ODD[1:] + ["été, naïve. Straße\nZürich"]
    own = sst._Encoder(VOCAB)
    assert own.letters is not None
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own(texts)] == want
    own = sst._Encoder(VOCAB)
    own.letters = None
    assert [x.tolist() for x in own(texts)] == want


def test_lookup_by_binary_search(spark, docs_of):
    tokenizer = Tokenizer.from_file(VOCAB)
    docs = docs_of([f"document number {i} of many " * (i % 50) for i in range(2000)]).withColumn("doc_id", F.col("doc_id") * 3 - 900)
    work = Workspace(spark, "lookup")
    shards = sst.write_shards(docs, f"{work.path}/s", VOCAB).collect()
    assert sum(s.entries for s in shards) == 2000
    for s in shards:
        shard = sst.open_shard(s.path)
        assert len(shard.blocks) > 1 or s.entries < 400
        for i in range(0, 2000, 97):
            found = shard.lookup(i * 3 - 900)
            if s.first_id <= i * 3 - 900 <= s.last_id:
                assert found.tolist() == [*tokenizer.encode(f"document number {i} of many " * (i % 50), add_special_tokens=False).ids, 0]
            else:
                assert found is None
            assert shard.lookup(i * 3 - 899) is None
        absent = sum(shard.may_have(sst.key_of(10**9 + i)) for i in range(5000))
        assert absent < 250  # ten bits a key: about one in a hundred
    work.drop()


def test_damaged_index_is_noticed(tmp_path):
    with open(tmp_path / "x.sst", "wb") as f:
        w = sst.ShardWriter(f, False)
        w.add(sst.key_of(1), np.array([1, 2], "<u4"))
        w.close()
    data = bytearray((tmp_path / "x.sst").read_bytes())
    data[sst.Shard(open_(tmp_path)).blocks[0][2]] ^= 255
    (tmp_path / "x.sst").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        sst.Shard(open_(tmp_path))


def open_(tmp_path):
    import pyarrow as pa

    return pa.OSFile(str(tmp_path / "x.sst"))


def test_digests(docs_of):
    r = bpe.digest_ids(bpe.encode_decode(docs_of(["plain words"]), RANKS, P.PATTERN, keep=["doc_id"])).first()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=unigram.load_ranks(RANKS), special_tokens={})
    ids = enc.encode_ordinary("plain words")
    assert r.asDict() == {"doc_id": 0, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(b"plain words").hexdigest()}
    assert len(ODD) == 15


def test_long_words_equal_tiktoken():
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=unigram.load_ranks(RANKS), special_tokens={})
    rng, code = np.random.default_rng(3), bpe.coder(RANKS, P.PATTERN)
    kinds = ["acgt", "ab", "abeinrst", "aé", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    words = ["".join(rng.choice(list(k), n)) for k in kinds for n in (40, 65, 200, 700)] + ["a" * 3001, "ab" * 999, "the" * 300, "\U0001f600" * 90]
    got = code.words(words)
    assert all(np.frombuffer(got[w], "<u2").tolist() == enc.encode_ordinary(w) for w in words)
    long = code.contracted([(w, w.encode()) for w in words], bpe.LONG_SQL)
    assert long == {w: b for w, b in code.contracted([(w, w.encode()) for w in words], bpe.ENCODE_SQL).items()}
    assert all(b"".join(code.cut(w.encode())) == w.encode() for w in words)


def test_a_word_of_100_kilobytes():
    import time

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=unigram.load_ranks(RANKS), special_tokens={})
    rng, code = np.random.default_rng(4), bpe.coder(RANKS, P.PATTERN)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    start = time.time()
    for word in ("".join(rng.choice(letters, 100_000)), "a" * 100_000, "ab" * 50_000):
        ((ids, back),) = code([word])
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(word) and back == word.encode()
    assert time.time() - start < 120


def test_documents_are_decoded_from_their_ids():
    code = bpe.coder(RANKS, P.PATTERN)
    ids = [np.array(x, "<u2") for x in ([], [5, 5, 7], [300, 2, 40_000], [])]
    names = {v: k for k, v in code.ranks.items()}
    assert code.decoded(ids) == [b"".join(names[i] for i in x.tolist()) for x in ids] and code.decoded([]) == []


def test_words_met_already_are_not_contracted_again(monkeypatch):
    code = bpe.Coder(RANKS, P.PATTERN)
    first = dict(zip("ab", code(["zqxvorn zqxvorm", "zqxvorp"]), strict=True))
    asked, contracted = [], code.contracted
    monkeypatch.setattr(code, "contracted", lambda rest, sql: asked.extend(w for w, _ in rest) or contracted(rest, sql))
    ((ids, back),) = code(['zqxvorn, zqxvorm! zqxvorq zqxvorn.'])
    assert sorted(asked) == [" zqxvorn", " zqxvorq"] and back == b"zqxvorn, zqxvorm! zqxvorq zqxvorn." and len(first) == 2
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=unigram.load_ranks(RANKS), special_tokens={})
    assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(back.decode())


def test_each_word_is_walked_once_whatever_stands_around_it(monkeypatch):
    costs = unigram.zipf_costs(ranks := unigram.load_ranks(RANKS))
    counter = unigram._Counter(RANKS, P.PATTERN, np.array([costs[t] for t in sorted(ranks, key=ranks.get)]))
    asked, count = [], counter.trie.count
    monkeypatch.setattr(counter.trie, "count", lambda w: asked.append(w) or count(w))
    texts = ["a zqxvorn zqxvorm zqxvorm, zqxvorm! zqxvorm.", "zqxvorm zqxvorm?  zqxvorn", "", "a zqxvorm zqxvorn;"]
    got = [counter([t])[0].tolist() for t in texts]
    assert asked.count(b" zqxvorm") == asked.count(b" zqxvorn") == 1
    for text, row in zip(texts, got, strict=True):
        best = [plain_viterbi(w.encode(), costs) for w in regex.compile(P.PATTERN).findall(text)]
        assert row == [len(best), sum(b[1] for b in best), sum(b[0] for b in best)]


def test_places_that_no_token_reaches_are_left_out_without_loss():
    costs = unigram.zipf_costs(unigram.load_ranks(RANKS))
    rng, trie, looked = np.random.default_rng(5), unigram.ForwardTrie(costs, 2000), []
    words = ["".join(rng.choice(list("abeinrsté the"), rng.integers(1, 40))).encode() for _ in range(1500)]
    for w in words:
        cost, tokens, parts = plain_viterbi(w, costs)
        assert trie.count(w) == (tokens, cost) and trie.tokens(w) == parts
    trie.clear()
    trie.costs = type("Costs", (dict,), {"get": lambda self, t: looked.append(t) or dict.get(self, t)})(costs)
    trie.count(b"zqxv" * 10)
    assert len(looked) < 200  # 820 pairs of places

"""Parts of the operators that need no Spark, against plain versions of themselves."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from tessera.llm import minhash, mixing, packing, quality, rangecoder, simhash, suffixes, tokenfile, tokens, toxicity


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), max_size=200), max_size=6))
def test_range_coder_round_trip(blocks):
    arrays = [np.array(b, "<u2") for b in blocks]
    coded = rangecoder.encode(arrays)
    assert [a.tolist() for a in rangecoder.decode(coded)] == blocks
    # a block does not depend on the blocks coded with it
    assert [rangecoder.encode([a])[0] for a in arrays] == coded


def test_range_coder_compresses_and_detects_damage():
    ids = np.tile(np.arange(50, dtype="<u2"), 40)
    (block,) = rangecoder.encode([ids])
    assert len(block) < len(ids) / 2
    for at in (0, 5, 9, 13, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(Exception):  # noqa: B017  a wrong count may fail anywhere in decoding
            assert rangecoder.decode([bytes(broken)])[0].tolist() != ids.tolist()
            raise ValueError


def test_range_coder_beats_zlib_on_real_ids():
    import duckdb
    from tessera.llm import tokenfile, tokens
    encode = tokens.ids()
    texts = duckdb.connect().sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    ids = np.frombuffer(b"".join(encode(t) + b"\x02\x00" for t, in texts), "<u2")
    for size in (tokenfile.BLOCK, 2048):
        blocks = [ids[k:k + size] for k in range(0, len(ids), size)]
        coded = rangecoder.encode(blocks)
        assert sum(map(len, coded)) < 0.92 * sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks)
        assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(coded), strict=True))


def test_coder_memory_of_a_lane():
    rng = np.random.default_rng(2)
    blocks = [rng.zipf(1.4, tokenfile.BLOCK).clip(1, 65535).astype("<u2") for _ in range(512)]

    def peak(work):
        tracemalloc.start()
        got = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most / len(blocks)

    coded, most = peak(lambda: rangecoder.encode(blocks))
    assert most < 17_000
    decoded, most = peak(lambda: rangecoder.decode(coded))
    assert most < 17_000
    assert all((a == b).all() for a, b in zip(blocks, decoded, strict=True))


def test_words_are_remembered_once():
    text = "tree tree, Tree (tree) it's 's naïve Naïve naïve! ß"
    own = tokens.Ids(public_tokenizers.path(tokens.VOCABULARY))
    whole = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own(text), "<u2").tolist() == whole
    own.forget()
    own("tree")
    own("tree, Tree")
    assert "tree" in own.words and "tree" not in own.pieces
    own.forget()
    assert not own.words and not own.older and not own.pieces
    assert np.frombuffer(own(text), "<u2").tolist() == whole


def test_order_0_counts_follow_a_shuffled_block():
    """No order-1 or order-2 context repeats usefully in a shuffled block: what is saved, order 0 saves."""
    rng = np.random.default_rng(1)
    skewed = rng.permutation(np.repeat(np.arange(64, dtype="<u2") * 701, np.r_[np.full(4, 200), np.full(60, 4)])).astype("<u2")
    p = np.unique(skewed, return_counts=True)[1] / len(skewed)
    entropy = float(-(p * np.log2(p)).sum() * len(skewed) / 8)
    (block,) = rangecoder.encode([skewed])
    assert len(block) < 1.25 * entropy + 64 * 2.5


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZé ßñÿµ×'s<|endoftext>\t\n\x0b\x1c\x85\xa0 İΣ1²٣_.,!中🙂ﬁ́", max_size=40))
def test_word_ids_equal_whole_text_ids(text):
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY)).encode(text, add_special_tokens=False).ids \
        if not hasattr(test_word_ids_equal_whole_text_ids, "t") else test_word_ids_equal_whole_text_ids.t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.ids()(text), "<u2").tolist() == whole


test_word_ids_equal_whole_text_ids.t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def test_word_cache_bounds(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    own = tokens.Ids(public_tokenizers.path(tokens.VOCABULARY))
    for text in ("one two three four five six", "four five seven", "x" * 500 + " one", ""):
        assert np.frombuffer(own(text), "<u2").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert "x" * 500 not in own.words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=30), st.binary(max_size=20), st.integers(0, 6))
def test_deep_shallow_sorts(strings, shared, shallow):
    strings = [shared + s for s in strings]
    order = suffixes.deep_shallow(strings, shallow=shallow)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[k] for k in order] == sorted(strings)


def test_equal_strings_have_equal_anchors():
    rng = random.Random(5)
    core = bytes(rng.randrange(97, 102) for _ in range(300))
    a, b = core, b"zz" * 40 + core + b"yy" * 40
    at_a, g_a, _ = suffixes.anchors(a)
    at_b, g_b, _ = suffixes.anchors(b)
    inside = {(p, g) for p, g in zip(at_b - 80, g_b, strict=True) if 0 <= p <= 300 - suffixes.GRAM}
    for start in range(0, 201):                            # every 100-byte string holds an anchor that both texts have
        own = {(p, g) for p, g in zip(at_a, g_a, strict=True) if start <= p <= start + 100 - suffixes.GRAM}
        assert own & inside


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_pairs_equal_brute_force(radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(3))]))
    group = np.sort(rng.integers(0, 3, len(fp)))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp))
            if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}
    got = {(int(i), int(j)) for a, b in simhash.linked_pairs(group, fp, radius) for i, j in zip(a, b, strict=True)}
    assert got == want


def test_fingerprint_bits():
    words = "The cat THE Cat the cat sat".encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(b"The cat THE Cat\tthe\ncat sat") == want
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_plan_uses_every_piece_once_and_fills_exactly():
    rng = random.Random(2)
    for limit in (8, 64, 2048):
        for _ in range(6):
            counts = {}
            for _ in range(400):
                n = rng.choice([limit, rng.randint(1, limit), rng.randint(1, max(1, limit // 8))])
                counts[n] = counts.get(n, 0) + 1
            made = packing.plan(counts, limit)
            used = {}
            for lengths, times in made:
                assert sum(lengths) <= limit and times > 0
                for n in lengths:
                    used[n] = used.get(n, 0) + times
            assert used == counts
            least = -(-sum(k * v for k, v in counts.items()) // limit)
            assert sum(t for _, t in made) <= least + max(2, least // 10)
    assert packing.plan({5: 3, 3: 3}, 8) == [([5, 3], 3)]
    assert packing.plan({4: 1, 2: 1, 1: 2}, 8) == [([4, 2, 1, 1], 1)]
    assert packing.plan({}, 8) == []


def test_joined_crc():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    cuts = [0, 0, 17, 2048, 2049, 5000]
    parts = [(zlib.crc32(raw[a:b]), b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert tokenfile.joined_crc(parts) == zlib.crc32(raw)


def test_minhash_estimates_jaccard():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    a, b = " ".join(words[:500]), " ".join(words[100:])
    sa, sb = set(minhash.shingles(a).tolist()), set(minhash.shingles(b).tolist())
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    assert len(sa) == len(grams(words[:500]))
    true = len(grams(words[:500]) & grams(words[100:])) / len(grams(words[:500]) | grams(words[100:]))
    assert len(sa & sb) / len(sa | sb) == pytest.approx(true)
    assert abs(minhash.likeness(minhash.signature(a), minhash.signature(b)) - true) < 0.15
    assert minhash.hexed(minhash.signature("")) == "ffff" * minhash.PERMUTATIONS
    assert len(minhash.shingles("only three words")) == 1


def test_quality_counts():
    text = "a b c\na b c\n\n \nd é# a b c\n$ x"
    assert quality.counts(text.encode()) == (13, 14, 2, 1, 9)
    assert quality.counts(b"") == (0, 0, 0, 0, 0)


def brute_repeats(words):
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(covered)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeats(words)


def test_grammar_notes_target_negation_and_reported_speech():
    model = toxicity.DEFAULT

    def pattern(clause):
        return [p for p, _ in toxicity.clause_patterns(clause, model, {})]

    assert pattern("what an idiot") == [0]
    assert pattern("you are an idiot") == [4]
    assert pattern("you are not an idiot") == [4 + 2]
    assert pattern("not one of all those who were here is an idiot") == [4]     # out of the negation's reach
    assert pattern("he said you idiot") == [4 + 1]
    assert pattern('a "stupid" plan') == [1]
    assert pattern("i will kill you") == [8]
    assert pattern("you i will kill") == [12]
    # the composition is the product of the single machines
    one = [toxicity.events(), toxicity.noted(toxicity.TARGET), toxicity.noted(toxicity.NEGATION, toxicity.SCOPE), toxicity.reported()]
    rng = random.Random(1)
    for _ in range(200):
        classes = [rng.randrange(7) for _ in range(12)]
        states, state = [m.start for m in one], toxicity.GRAMMAR.start
        for c in classes:
            steps = [m.arcs[s, c] for m, s in zip(one, states, strict=True)]
            states = [s for s, _ in steps]
            state, out = toxicity.GRAMMAR.arcs[state, c]
            assert out == tuple(o for _, o in steps)


def test_clauses_are_scored_not_words():
    m = toxicity.DEFAULT
    plain = toxicity.score(toxicity.totals("You are an idiot.", m), m)
    negated = toxicity.score(toxicity.totals("You are not an idiot.", m), m)
    said = toxicity.score(toxicity.totals("She said not one word about an idiot.", m), m)
    none = toxicity.score(toxicity.totals("You are here. It is late.", m), m)
    assert plain > negated > none
    assert plain > said > none
    assert toxicity.score(toxicity.totals("", m), m) == none


def test_solve_small_systems():
    assert mixing._solve([[2.0, 0.0], [0.0, 4.0]], [2.0, 4.0]) == [1.0, 1.0]
    assert mixing._solve([[1.0, 0.0], [0.0, 0.0]], [3.0, 0.0]) == [3.0, 0.0]
    x = mixing._solve([[4.0, 1.0, 0.5], [1.0, 3.0, 0.2], [0.5, 0.2, 2.0]], [1.0, 2.0, 3.0])
    assert np.allclose(np.array([[4, 1, .5], [1, 3, .2], [.5, .2, 2]]) @ x, [1, 2, 3])

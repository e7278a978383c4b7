"""Factorisation machine, stripes and prefix trie; names that clash, repeated rows; estimates and the pipeline against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tessera.llm import divergence, factorisation, line_dedup, minhash, mixing, packing, prefixtrie, quality, simhash, tokens

from test_operators import DOCS, ROWS, prose


# ------------------------------------------------------------------ factorisation machine
def test_pairwise_identity():
    rng = np.random.default_rng(3)
    model = factorisation.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), ())
    at, x = rng.choice(50, 9, replace=False), rng.normal(size=9)
    pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(9) for j in range(i + 1, 9))
    assert model.margin(at, x) == pytest.approx(0.3 + model.weights[at] @ x + pairs)


def test_features_read_the_whole_text_in_pieces():
    text = ("Wort für Wort " * 500 + "\nEnd!! " * 40).encode()
    assert factorisation.word_counts(text, 100) == Counter(text.lower().split())
    assert factorisation.word_counts(b"x" * 1000, 10) == Counter({b"x" * 1000: 1})
    buckets, values, stats = factorisation.features(b"")
    assert len(buckets) == 0 and np.isfinite(stats).all()
    assert factorisation.length_bin(None) == factorisation.LENGTHS - 1 and factorisation.length_bin(-5) == 0


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for k in range(500):
        good = k % 5 != 0
        text = prose(rng.randint(60, 200), rng)
        rows.append((k, text if good else " | ".join(text.split()) if k % 2 else text.upper() + "!!", len(text) if k % 3 else None, "en", "s"))
        marks.append((k, int(good), 0))
    return (spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, lang string, source string").repartition(4),
            spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))


def test_factorisation_learns_outside_the_held_out_fold(spark, graded):
    docs, labels = graded
    got = {r.doc_id: r for r in factorisation.classify(docs, labels).collect()}
    held = {k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {k for k, r in got.items() if r.held_out} == held
    assert sum(got[k].predicted == int(k % 5 != 0) for k in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = factorisation.train(docs, labels), factorisation.train(docs, turned)
    assert (a.factors == b.factors).all() and (a.weights == b.weights).all() and a.bias == b.bias
    other = docs.select("doc_id", "text", "n_chars", F.lit("xx").alias("lang"), F.lit("yy").alias("source"))
    assert {(r.doc_id, r.score) for r in factorisation.classify(other, labels, a).collect()} == {(k, r.score) for k, r in got.items()}


def test_factorisation_awkward_rows(spark, graded):
    docs = spark.createDataFrame([(i, t, "l_id", 1, "x", None) for i, t in ROWS], "doc_id bigint, text string, l_id string, label int, quality string, n_chars bigint")
    got = factorisation.classify(docs, graded[1]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = graded[1].where("quality > 5")
    assert {r.score for r in factorisation.classify(docs, none).collect()} == {0.5}
    assert factorisation.classify(docs.limit(0), graded[1]).count() == 0
    assert factorisation.classify(docs.drop("n_chars"), graded[1]).count() == len(ROWS)


# ------------------------------------------------------------------ stripes
def brute_divergence(rows, least, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
             for text, lang, source in rows]
    out = set()
    for lang in {w[0] for w in words}:
        df = Counter(t for l, _, ws in words if l == lang for t in set(ws))
        kept = sorted(t for t, n in df.items() if n >= least)
        groups = sorted({s for l, s, _ in words if l == lang})
        by = {s: Counter(t for l, g, ws in words if (l, g) == (lang, s) for t in ws if t in kept) for s in groups}
        whole = sum(by.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10 ** 9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in groups:
            pair = [(-sum(abs(share(by[s], t) - share(by[o], t)) for t in kept), o.encode(), o) for o in groups if o != s]
            term = [(share(whole, t) - share(by[s], t), t.encode(), t) for t in kept if by[s][t] and share(by[s], t) > share(whole, t)]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("cells", [divergence.CELLS, 3])
def test_divergence_against_brute_force(spark, cells):
    rng = random.Random(1)
    vocabulary = ["alpha", "Beta", "γάμμα", "delta-eps", "zeta1eta", "ÄÖ", "\U0001F600", "x\x00y", "ﬁ"]
    rows = [(None if k % 17 == 0 else "" if k % 19 == 0 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))),
             rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(160)]
    rows += [("only here", "fr", "q")] + rows[:20]
    docs = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "text string, lang string, source string, term string, salt int, n int").repartition(5)
    got = {tuple(r) for r in divergence.divergence(docs, least=6, top=4, cells=cells).collect()}
    assert got == brute_divergence(rows, 6, 4)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_long_texts_are_folded_in_pieces_and_shares_are_exact():
    text = ("wörter und Wörter, " * 300).encode()
    assert divergence.terms(text, 50) == divergence.terms(text)
    assert divergence.terms(b"y" * 500, 20) == Counter({b"y" * 500: 1})
    big = np.array([0, 7, 10 ** 14, 4 * 10 ** 15], np.int64)
    got = divergence.share(big, np.int64(4 * 10 ** 15 + 10 ** 14), 1000)
    assert got.tolist() == [1 + 10 ** 9 * (int(c) + 5) // (4 * 10 ** 15 + 10 ** 14 + 5000) for c in big]


# ------------------------------------------------------------------ prefix trie
def brute_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16]
            convs.setdefault(c, []).append((t is not None, t or 0, r, x[:64], digest, x))
    convs = {c: [(t[2], t[5]) for t in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, d == len(seq)))
    kids = Counter(s[:-1] for s in nodes if s)
    leaves, saved = Counter(), Counter()
    for s in sorted(nodes, key=len, reverse=True):
        leaves[s] += not kids[s]
        saved[s] += (len(nodes[s]) - 1) * len(s[-1][1].encode()) if s else 0
        if s:
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    return sorted((min(nodes[s])[0], len(s), min(nodes[s[:-1]])[0] if s else -1, len(m), kids[s], leaves[s], saved[s],
                   hashlib.sha256(",".join(str(c) for c, e in sorted(m) if e).encode()).hexdigest()) for s, m in nodes.items())


def trie_rows(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], "conv_id bigint, turn bigint, role string, text string, top string, depth int, node binary")
    found = prefixtrie.trie(frame.repartition(4), **options).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in found)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(12)
    rows = []
    for c in range(60):
        for t in range(rng.choice([0, 1, 2, 3, 6, 12])):
            rows.append((c, t if rng.random() > 0.03 else None, rng.choice(["user", "user", None]), rng.choice(["hi", "hi", "ho é", "", None, f"own {c}"])))
    rows += [(70, t, "user", f"long {t}") for t in range(400)] + [(71, t, "user", f"long {t % 7}") for t in range(50)]
    rows += [(72, 0, "a", "same"), (72, 0, "a", "same"), (72, 0, "a", "other"), (None, 1, "user", "nobody")]
    rows += [(c, t, "user", "copy " + "w" * 70) for c in range(80, 140) for t in range(9)]
    return rows


@pytest.mark.parametrize("local", [prefixtrie.LOCAL, 40])
def test_trie_against_brute_force(spark, talks, local, monkeypatch):
    if local == 40:                       # several rounds of splits in Spark, many children, several pieces of ends
        monkeypatch.setattr(prefixtrie, "MANY_CHILDREN", 3)
        monkeypatch.setattr(prefixtrie, "BLOCK", 16)
        monkeypatch.setattr(prefixtrie, "PIECE", 60)
    assert trie_rows(spark, talks, local=local) == brute_trie(talks)


def test_trie_of_a_conversation_over_several_ranges(spark, talks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_rows(spark, talks, local=300) == brute_trie(talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_sql_and_empty(spark, talks):
    plain = [r for r in talks if r[0] != 72]                      # ties are ordered alike in both
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", plain)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in con.sql(prefixtrie.SQL).fetchall()) == brute_trie(plain)
    assert trie_rows(spark, [(None, 1, "a", "b")]) == []


def test_centroid_split_on_random_forests():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        shape = rng.random()
        parent = np.array([-1] + [int(rng.integers(max(0, i - 3) if shape < 0.4 else 0, i)) if rng.random() > 0.02 else -1 for i in range(1, n)])
        own, values = rng.integers(1, 50, n), rng.integers(0, 1 << 60, (n, 2)) >> 8
        weight, want = own.copy(), values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                want[parent[i]] += want[i]
        assert (prefixtrie.split_forest(parent, weight, values) == want).all()


# ------------------------------------------------------------------ names that clash, repeated rows
CLASHING = ("toxic", "l_id", "k_id", "k_th", "k_lang", "kept_id", "_", "row", "key0", "kept0", "th", "id", "root", "starts", "others", "text_", "fp")


def test_columns_with_clashing_names(spark):
    names = ", ".join(f"`{c}` int" for c in CLASHING)
    more = [k for k in range(len(CLASHING))]
    docs = spark.createDataFrame([(i, t, "en", "s", *more) for i, t in ROWS], f"doc_id bigint, text string, lang string, source string, {names}")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 3 == 0)) for i, _ in ROWS if i is not None], "doc_id bigint, quality int, toxic int")
    for out in (quality.keep_good(docs), simhash.keep_one(docs), mixing.keep_mix(docs, labels),
                line_dedup.line_dedup(docs, keep=("lang", "source", *CLASHING)).drop("n_lines", "n_removed")):
        rows = out.collect()
        assert set(out.columns) == set(docs.columns)
        assert all(r[c] == k for r in rows for k, c in enumerate(CLASHING))
    assert mixing.mix(docs, labels).count() == len(ROWS)


def test_keep_one_leaves_one_row_per_component(spark):
    text, other = prose(60), prose(60)
    rows = [(3, text, 1), (3, text, 2), (3, text, 3), (9, text, 4), (5, other, 5), (5, other, 6), (3, prose(70), 7), (None, text, 8), (None, "alone and unnamed", 9),
            (None, "alone and unnamed", 10), (2, None, 11), (1, "", 12)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, k int").repartition(3)).collect()
    by = Counter(r.text or "" for r in kept)
    assert set(by.values()) == {1} and len(kept) == 5
    assert {(r.doc_id, r.text) for r in kept} == {(3, text), (5, other), (3, rows[6][1]), (None, "alone and unnamed"), (1, "")}


def test_minhash_components_against_brute_force_jaccard(spark):
    rng = random.Random(21)
    base = [prose(rng.randint(30, 90), rng).split() for _ in range(12)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):                        # chains of copies with ever more words changed
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = prose(1, rng)
            texts.append(" ".join(words))
    texts += ["", None, "one two", "one two", texts[0].upper()]
    grams = [frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if grams[a] == grams[b] or (both and both >= 0.8 * (len(grams[a]) + len(grams[b]) - both)):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, band int, key string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < len(texts)


# ------------------------------------------------------------------ the robust estimate in plain Python
def plain_estimate(x, keep=quality.KEEP, steps=quality.STEPS):
    """Centre, inverse, scale by concentration from three starts, least determinant."""
    quantile = lambda v, q: np.sort(v)[max(math.ceil(q * len(v)) - 1, 0)]
    floor = np.diag(np.square(quality.FLOOR))
    median = np.array([quantile(c, 0.5) for c in x.T])
    mad = 1.4826 * np.array([quantile(np.abs(c - m), 0.5) for c, m in zip(x.T, median, strict=True)])
    sign = np.sign(x - median)
    corr = quality.SHRINK * np.sin(np.pi / 2 * sign.T @ sign / len(x))
    np.fill_diagonal(corr, 1)
    found = []
    for centre, cov in ((median, np.diag(mad ** 2)), (x.mean(0), np.cov(x.T, bias=True)), (median, corr * np.outer(mad, mad))):
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov + floor), x - centre)
            near = x[d <= quantile(d, keep)]
            centre, cov = near.mean(0), np.cov(near.T, bias=True)
        found.append((np.linalg.slogdet(cov + floor)[1], len(found), centre, np.linalg.inv(cov + floor)))
    _, _, centre, inverse = min(found, key=lambda f: f[:2])
    d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
    return centre, inverse, max(quantile(d, 0.5) / quality.CHI2_MEDIAN, 1.0)


def test_robust_estimate_against_plain_python(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(160, 5)) @ rng.normal(size=(5, 5)) + 3
    mixed[:35] += [9, -7, 5, 0, 4]
    other = rng.normal(size=(90, 5)) * [1, 2, 0.001, 3, 0.5]
    rows = [("en", "a", *map(float, r)) for r in mixed] + [("de", None, *map(float, r)) for r in other]
    frame = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(3)
    got = {(r.level, r.g_lang, r.g_source): r for r in quality.fit(frame).collect()}
    for key, x in (((0, "en", "a"), mixed), ((1, "en", None), mixed), ((0, "de", None), other), ((2, None, None), np.r_[mixed, other])):
        centre, inverse, scale = plain_estimate(x)
        assert np.allclose(got[key].centre, centre) and np.allclose(got[key].inverse, inverse.ravel()) and got[key].scale == pytest.approx(scale)
    assert np.abs(np.array(got[0, "en", "a"].centre) - mixed[35:].mean(0)).max() < 0.6       # the planted rows do not pull it


# ------------------------------------------------------------------ posteriors and the pipeline in plain Python
def test_posteriors_against_plain_python(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng.randint(5, 80), rng) + (" rotten" * rng.randint(1, 3) if k % 6 == 0 else "") + (" $$$ ###" if k % 5 == 1 else "")) for k in range(120)]
    marks = [(k, int(k % 5 != 1), int(k % 6 == 0)) for k in range(0, 120, 2)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    telling = mixing.telling_words(docs, labels)
    assert list(telling) == ["rotten"]
    split = lambda t: re.split(r"[^\w]+|_", t.lower())

    def stats(t):
        n, w = len(t.split()), split(t)
        return n, (math.log1p(len(t)), math.log1p(len(t) / max(n, 1)), math.sqrt(len(re.findall(r"[#*$%&|<>]", t)) / max(len(t), 1)), len(set(w)) / len(w)), w

    domain = {k: "toxic" if t else "low" if not q else "clean" for k, q, t in marks}
    toxic_words = [split(rows[k][1]) for k, _, t in marks if t]
    rest_words = [split(rows[k][1]) for k, _, t in marks if not t]
    rate = lambda docs_: (sum(w.count("rotten") for w in docs_) + 0.5) / sum(map(len, docs_))
    t_rate, r_rate = rate(toxic_words), rate(rest_words)
    assert telling["rotten"] == pytest.approx((t_rate, r_rate))
    model = {}
    for d in ("clean", "low", "toxic"):
        x = np.array([stats(rows[k][1])[1] for k in domain if domain[k] == d])
        model[d] = (len(x), x.mean(0), x.var(0) + mixing.FLOOR)
    got = {r.id: r for r in mixing._domains(docs, labels).collect()}
    for k, text in rows:
        n, x, w = stats(text)
        logs = {}
        for d, (size, mean, var) in model.items():
            v = var + np.array([0, mixing.SPREAD / max(n, 1), 0, 0])
            logs[d] = math.log(size) + float((-(np.array(x) - mean) ** 2 / (2 * v) - 0.5 * np.log(v)).sum())
        logs["toxic"] += w.count("rotten") * math.log(t_rate / r_rate) - len(w) * (t_rate - r_rate)
        e = {d: math.exp(v - max(logs.values())) for d, v in logs.items()}
        for d in e:
            assert got[k][f"p_{d}"] == pytest.approx(e[d] / sum(e.values()), abs=1e-6)


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[k:k + width]) for k in range(max(len(words) - width + 1, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pipeline_run_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(9)
    shared = "\n".join(prose(12, rng) for _ in range(5))
    texts = ["\n".join(prose(20, rng) for _ in range(rng.randint(3, 8))) for _ in range(60)]
    texts[5], texts[30] = texts[4], texts[12] + " x"
    texts[7] += "\n" + shared
    texts[40] = prose(70, rng) + "\n" + shared + "\n" + prose(70, rng)
    texts += ["short one", "", "same words here " * 40, prose(5000, rng)]
    texts += [texts[-1] + f" ending {k}" for k in range(4)]               # one line: only their fingerprints are near
    rows = [(3 * k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(500, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3 * k, 1, 0) for k in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def good(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
        return len(words) >= 50 and 100 * len(covered) <= 50 * len(words)

    left = [(i, t) for i, t, *_ in rows if good(t)]                       # too few rows for an estimate
    seen, cut = set(), []
    for i, t in left:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if w in seen and re.search(r"\S", "\n".join(w)):
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        cut.append((i, "\n".join(line for p, line in enumerate(lines) if p not in gone)))
    prints = [plain_fingerprint(t) for _, t in cut]
    root = list(range(len(cut)))
    for a in range(len(cut)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    kept = [cut[k] for k in range(len(cut)) if root[k] == k]              # one domain only: mixing keeps all
    assert len(kept) < len(cut) < len(rows) and any(a[1] != b[1] for a, b in zip(left, cut, strict=True))
    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    want = []
    for i, text in kept:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want += [(i, p, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


def searched_plan(counts, limit):
    """The first step of the plan by plain search: exact complements from the longest length down."""
    have, out = [counts.get(k, 0) for k in range(limit + 1)], []
    left = dict(counts)
    for length in range(limit, 0, -1):
        while have[length]:
            have[length] -= 1
            gap, rest = limit - length, None
            options = [[gap]] if gap and have[gap] else []
            options = options or [[a, gap - a] for a in range(gap - 1, (gap - 1) // 2, -1)
                                  if have[a] and have[gap - a] and (2 * a != gap or have[a] > 1)][:1]
            if gap and not options:
                for a in range(gap - 2, 0, -1):
                    if have[a] and 3 * a >= gap and not options:
                        have[a] -= 1
                        g = gap - a
                        options = [[a, b, g - b] for b in range(g - 1, (g - 1) // 2, -1)
                                   if have[b] and have[g - b] and (2 * b != g or have[b] > 1)][:1]
                        have[a] += 1
            rest = options[0] if options else ([] if not gap else None)
            have[length] += 1
            if rest is None:
                have[length] = 0
                continue
            kinds = Counter([length, *rest])
            times = min(have[k] // n for k, n in kinds.items())
            for k, n in kinds.items():
                have[k] -= n * times
                left[k] -= n * times
            out.append(([length, *rest], times))
    return out, left


def test_sum_index_finds_what_a_search_finds():
    rng = random.Random(2)
    for _ in range(80):
        limit = rng.choice([8, 17, 60])
        counts = {k: rng.choice([1, 1, 2, 9]) for k in range(1, limit + 1) if rng.random() < rng.choice([0.2, 0.6, 1])}
        want, left = searched_plan(counts, limit)
        got = packing.plan(counts, limit)
        assert got[:len(want)] == want
        rest = Counter()
        for lengths, times in got[len(want):]:
            assert sum(lengths) <= limit
            rest.update({k: n * times for k, n in Counter(lengths).items()})
        assert {k: n for k, n in left.items() if n} == dict(rest)


def test_stages_on_empty_tables(spark):
    import corpus_pipeline
    nothing = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "/root/testdata/sf0.001").count() == 0
    assert packing.pack(nothing).count() == 0

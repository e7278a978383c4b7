"""The operators on small tables with every awkward case, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tessera.llm import (line_dedup, minhash, mixing, packing, quality, simhash, suffixes, tokenfile, tokens, toxicity,
                         warc)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, pos int, fp bigint, length int"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


SHARED = "\n".join(prose(12) for _ in range(6))
LONG = "\n".join(prose(40) for _ in range(120))
TEXTS = [None, "", " \n\t ", "one", "Two WORDS", SHARED, SHARED, "x y\n" + SHARED + "\nend of it", LONG, LONG[:-1] + "z",
         "a" * 5000, prose(80), prose(80) + " é中\U0001F600 " + prose(3), "you are an idiot and a moron", "same line\n" * 9, "\n\n\n\n"]
ROWS = [(k * 7, t) for k, t in enumerate(TEXTS)] + [(35, SHARED), (35, prose(60)), (None, SHARED), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src", None, "x", 1, 2, 3) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (7, None, None), (None, 1, 1), (91, 1, 1), (91, 1, 1), (999, 0, 1), (35, 0, 0)],
                                 "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return (r[0] is not None, r[0], r[1] or "")


def test_line_dedup(docs, nothing):
    got = sorted(line_dedup.line_dedup(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_removed))
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].text is None or by[None][1].text is None
    assert {r.n_removed for r in by[None]} == {0}                       # null ids come first: theirs is the first occurrence
    assert [r.n_removed for r in by[42]] == [6] and by[42][0].text == ""
    assert by[49][0].text == "x y\nend of it"
    assert by[98][0].n_removed == 8 and by[98][0].n_lines == 10          # the first window stays
    assert by[105][0].n_removed == 0                                     # blank windows do not count
    assert line_dedup.line_dedup(nothing).count() == 0


def test_packing_places_every_piece(docs, nothing):
    packed = packing.pack(docs, limit=64, with_ids=True)
    rows = packed.collect()
    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    want = []
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, p, 64 * p, len(ids[s:s + 64]), zlib.crc32(np.array(ids[s:s + 64], "<u4").tobytes()))
                 for p, s in enumerate(range(0, len(ids), 64))]
    norm = lambda x: sorted(x, key=lambda r: tuple(-1 if v is None else v for v in r))
    assert norm([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]) == norm(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(w[3] for w in want) // 64) + 1
    made = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.length for r in made) and len(made) == len(by)
    assert packing.pack(nothing).count() == 0


def test_simhash_components(docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    fps = [simhash.fingerprint((t or "").encode()) for _, t in ROWS]
    root = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            for j in range(len(ROWS)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for k, (i, _) in enumerate(ROWS):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    want = sorted((f"{fps[k]:016x}", i if i is not None else -1, least.get(root[k], -1)) for k, (i, _) in enumerate(ROWS))
    assert sorted((r.fingerprint, -1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_heavy_buckets_are_dealt_again(spark):
    rng = np.random.default_rng(8)
    fp = np.unique(np.concatenate([(np.uint64(7) << np.uint64(32)) | rng.integers(0, 1 << 14, 60, dtype=np.uint64),
                                   rng.integers(0, 1 << 64, 60, dtype=np.uint64)]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint"), heavy=4)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    near = {int(x): [int(y) for y in fp.view(np.int64) if (int(x) ^ int(y)) & (2 ** 64 - 1) and ((int(x) ^ int(y)) & (2 ** 64 - 1)).bit_count() <= 2]
            for x in fp.view(np.int64)}
    for x, others in near.items():
        for y in others:
            assert roots.get(x, x) == roots.get(y, y)
    linked = sum(bool(v) for v in near.values())
    assert len(roots) <= linked


def brute_suffixes(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], zlib.crc32((r[1] or "").encode()))):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        fresh = []
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i, t] = (len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
        del fresh
    return out


@pytest.mark.parametrize("group", [suffixes.GROUP, 2])
def test_suffix_dedup(spark, docs, nothing, group):
    rows = [(i, t) for i, t in ROWS if not (i == 35 and t != SHARED)] + [(200, LONG[1000:1180] + prose(5) + LONG[300:399]), (201, "ab" * 300)]
    want = brute_suffixes(rows)
    got = suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), group).collect()
    mine = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)
    assert mine == sorted((-1 if i is None else i, *want[i, t]) for i, t in rows)
    if group != 2:
        assert suffixes.suffix_dedup(docs).count() == len(ROWS)          # ids shared by different texts
        assert suffixes.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("group", [suffixes.GROUP, 2])
def test_suffix_dedup_repeated_first_occurrence(spark, group):
    rng = random.Random(5)
    first = prose(300, rng)
    parts = [prose(20, rng) + first[k:k + 90] + prose(20, rng) for k in range(0, 1200, 150)]       # grams in common, but no 100 bytes
    rows = [(1, first), (1, first), (1, first), *((k + 2, t) for k, t in enumerate(parts)), (50, prose(9, rng) + first[200:500])]
    want = brute_suffixes(rows)
    assert want[1, first][1] == 0 < want[rows[-1]][1]
    got = suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), group).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *want[i, t]) for i, t in rows)


def test_minhash_pairs(docs, nothing, spark):
    got = minhash.fingerprint_pairs(docs).collect()
    assert len(got) == len(ROWS)
    rows = [(k, prose(RNG.randint(0, 30))) for k in range(40)]
    got = {r.doc_id: r for r in minhash.fingerprint_pairs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + other[:half]
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert r.fingerprint == minhash.hexed(minhash.signature(t)) and r.edited_fingerprint == minhash.hexed(minhash.signature(edited))
        assert r.near_next == minhash.likeness(minhash.signature(t), minhash.signature(other))
    assert minhash.fingerprint_pairs(nothing).count() == 0
    assert minhash.fingerprint_pairs(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")).first().near_next == 1.0


def test_minhash_near_duplicates(docs, nothing):
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert (42, 35) in got and (63, 56) in got and (77, 77) in got
    assert minhash.near_duplicates(nothing).count() == 0


def test_token_files(docs, nothing, spark):
    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    assert tokenfile.encode_and_read(docs).count() == len(ROWS)
    rows = [(k * 3, x) for k, x in enumerate(TEXTS)]
    want, start = [], 0
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfile.encode_and_read(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == want
    assert tokenfile.encode_and_read(nothing).count() == 0


def test_written_token_files_leave_no_words_in_the_workers(docs, spark, tmp_path):
    tokenfile.write_ids(docs, str(tmp_path / "ids"))

    def held(batches):
        from tessera.llm import tokens
        for _ in batches:
            pass
        n = sum(len(x) for encode in tokens._loaded.values() for x in (encode.words, encode.older, encode.pieces))
        yield pa.RecordBatch.from_pydict({"id": pa.array([n], pa.int64())})

    assert {r.id for r in spark.range(0, 64, 1, 8).mapInArrow(held, "id bigint").collect()} == {0}


def test_quality(docs, nothing, spark):
    got = {}
    for r in quality.quality(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t in [(k * 7, t) for k, t in enumerate(TEXTS) if k * 7 != 35]:
        r = got[k][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality.counts((t or "").encode())
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (not r.base_failed)                             # too few rows for an estimate
    rng = random.Random(3)
    rows = [(k, prose(rng.randint(100, 200), rng), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join(w + "***" for w in prose(120, rng).split()), "en", "s") for k in range(15)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {1000 + k for k in range(15)}
    assert quality.quality(nothing).count() == 0


def test_warc(spark):
    rows = [(1, "u\r\n1", "<p>a</p>", 5), (2, None, "<p>a</p>", 5), (3, "u3", None, 5), (4, "u4", "", 5), (4, "u4", "", 5),
            (None, "n", "é\r\n\r\nx", 5), (6, "u6", "y" * 100_000, 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, keeper int")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(pages).collect()}
    assert got == {(1, "revisit", 2, 8), (2, "response", None, 8), (3, "revisit", 4, 0), (4, "response", None, 0),
                   (None, "response", None, 7), (6, "response", None, 100_000)}
    import base64
    for r in warc.archive_pages(pages).collect():
        if r.page_id == 6:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(b"y" * 100_000).digest()).decode()
    assert all(r.record_type == "response" for r in warc.archive_pages(pages, min_bytes=10 ** 6).collect())
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_files_hold_the_original_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "one"), (2, "http://b", "one\r\n\r\ntwo")], "page_id bigint, url string, html string")
    archive = warc.write_archive(pages, str(tmp_path / "a"))
    warc.export(archive, str(tmp_path / "w"), compression="none")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    found = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b": ")[1])
        found.append(rest[:n])
        assert rest[n:n + 4] == b"\r\n\r\n"
        raw = rest[n + 4:]
    assert sorted(found) == [b"one", b"one\r\n\r\ntwo"]


def brute_rates(n, p, goal, rounds):
    r, m = np.ones(len(n)), (p * n[:, None]).T @ p
    m += 1e-6 * m.diagonal().max() * np.eye(len(m))
    for _ in range(rounds):
        off = (r * n) @ p - goal
        r = np.maximum(0.0, r - p @ np.linalg.solve(m, off))
    return r


def test_mixing_rates(spark, docs, labels, nothing):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5, 0.3, 0.2], 200)
    n = rng.integers(0, 500, 200)
    rows = spark.createDataFrame([(int(k), *map(float, q)) for k, q in zip(n, p, strict=True)], "n bigint, p_clean double, p_low double, p_toxic double")
    total = n @ p
    goal = dict(zip(mixing.DOMAINS, (total * [1.1, 0.3, 0.2]).tolist(), strict=True))
    got = rows.select("n", "p_clean", "p_low", "p_toxic", mixing.fit_rates(rows, goal, rounds=12, tolerance=0).alias("r")).toPandas()
    want = brute_rates(got.n.to_numpy(float), got[["p_clean", "p_low", "p_toxic"]].to_numpy(), np.array(list(goal.values())), 12)
    assert np.allclose(got.r, want, atol=1e-6)
    full = rows.select("n", "p_clean", "p_low", "p_toxic", mixing.fit_rates(rows, goal).alias("r")).toPandas()
    made = (full.r * full.n).to_numpy() @ full[["p_clean", "p_low", "p_toxic"]].to_numpy()
    assert np.allclose(made, list(goal.values()), rtol=0.02)             # with the production number of rounds
    assert (got.r >= 0).all()
    mixed = mixing.mix(docs, labels).collect()
    assert len(mixed) == len(ROWS) and all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in mixed)
    assert mixing.mix(nothing, labels).count() == 0
    assert {r.p_clean for r in mixing.mix(docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.keep_mix(docs, labels).columns == docs.columns


@pytest.fixture(scope="module")
def domains(spark):
    """Documents (with labels) of three domains; some clean ones mention a telling word once, some are very short."""
    rng = random.Random(3)
    rows = []
    for k in range(400):
        rows.append((k, prose(rng.randint(300, 600) if k % 20 else 4, rng) + (" scoundrel" if k % 40 == 1 else ""), 1, 0))
    for k in range(400, 480):
        words = prose(rng.randint(100, 400), rng).split()
        rows.append((k, " ".join("scoundrel" if rng.random() < 0.03 else w for w in words) + " scoundrel", 1, 1))
    for k in range(480, 600):
        rows.append((k, " ".join(w + "$$$" for w in prose(rng.randint(100, 400), rng).split()), 0, 0))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int").repartition(4)
    return frame.select("doc_id", "text").cache(), frame.select("doc_id", "quality", "toxic").cache()


def test_mixing_keeps_clean_documents(domains):
    docs, labels = domains
    rate = {r.id: r.rate for r in mixing.mix(docs, labels).collect()}
    assert min(rate[k] for k in range(400)) >= 1
    assert max(rate[k] for k in range(400, 600)) < 0.5
    kept = {r.doc_id for r in mixing.keep_mix(docs, labels).collect()}
    assert kept >= set(range(400))


def test_mixing_draw_meets_the_targets(domains):
    docs, labels = domains
    rows = mixing._domains(docs, labels)
    got = rows.withColumn("r", mixing.fit_chances(rows, mixing.TARGETS)).toPandas()
    assert got.r.between(0, 1).all()
    there = np.array([(got.r * got.n * got[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    assert there / there.sum() == pytest.approx(list(mixing.TARGETS.values()), rel=1e-3)
    scarce = mixing.fit_chances(rows, {"clean": 0.1, "low": 0.8, "toxic": 0.1})
    assert rows.where("p_low > 0.99").agg(F.min(scarce)).first()[0] == 1
    sizes = {r.id: r.n for r in rows.collect()}
    kept = [r.doc_id for r in mixing.keep_mix(docs, labels).collect()]
    assert set(kept) >= set(range(400))
    tokens = np.array([sum(sizes[k] for k in kept if a <= k < b) for a, b in ((0, 400), (480, 600), (400, 480))])
    assert tokens / tokens.sum() == pytest.approx([0.97, 0.02, 0.01], abs=0.012)


def test_toxicity_learns_outside_the_held_out_fold(spark, docs, labels, nothing):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(600):
        toxic = k % 5 == 0
        words = prose(60, rng).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(60), rng.choice(["zorfwug", "zorfnix", "blarg"]))
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    m = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    held = d.select("doc_id", toxicity.held_out().alias("held")).where("held").select("doc_id")
    assert {r.doc_id for r in held.collect()} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2}
    got = toxicity.toxicity(d, m).join(m, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    # turning the labels of the held-out fold around changes nothing
    turned = m.join(held.withColumn("t", F.lit(True)), "doc_id", "left").select("doc_id", "quality", F.when(F.col("t"), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    assert toxicity.train(d, turned) == toxicity.train(d, m)
    all_ = toxicity.toxicity(docs, labels).collect()
    assert len(all_) == len(ROWS) and all(0 <= r.score <= 1 for r in all_)
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_pipeline_stages(spark, docs, nothing):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for table in (docs, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf)
            assert out.columns == table.columns, name
            kept = out.select("doc_id").collect()
            assert len(kept) <= table.count()
    good = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()} == good
    cut = {r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, sf).collect()}
    assert cut == {r.text for r in line_dedup.line_dedup(docs).collect()}
    named = {r.doc_id for r in simhash.near_duplicates(docs).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} - {None} == named
    assert packing.pack(nothing).columns == corpus_pipeline.packing_stage(spark, nothing, sf).columns

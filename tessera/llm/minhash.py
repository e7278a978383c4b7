"""Document fingerprints by MinHash.

A document's words (split on ASCII white space, A-Z lower-cased) are hashed and
combined to ``SHINGLE``-word shingles; a text with fewer words is one shingle, a
wordless one has none.  ``PERMUTATIONS`` universal hash functions a*x + b over
the 32-bit shingle hashes are applied in numpy to all shingles of a document at once, and
the low 16 bits of each minimum make the fingerprint.  The likeness
of two fingerprints is the share of equal places, an estimate of the Jaccard similarity of the shingle sets.

``neighbours`` gives each document the text that follows it in ascending
``doc_id`` order with one shuffle of the texts: rows are dealt to ranges whose bounds are rows of
the table (from a sample of ids and sizes, so that ranges hold about ``RANGE_BYTES``; the sample decides only where they
begin), each range is one partition, and the first row of a range is dealt to the range before it as well.

``near_duplicates`` cuts signatures into bands joined in Spark and verifies Jaccard
similarity on the exact shingle sets.  First every member of a band's bucket is
compared with the bucket's first member only, which joins groups of near copies
of any size into components in linear work; then, in buckets that still hold several
components, members of different components are compared.  A bucket of mutual near copies
is thus never expanded into pairs, and no link that joins two components is lost.

Ids must be whole numbers.

Defined results: null text is the empty text; equal texts have equal fingerprints
(all ``f`` for no shingle), with likeness 1; repeated rows and equal ids are ordered by a hash of the
text and follow one another; null ids come first; the only row of a table is followed by itself; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialise, prepare
from .simhash import components

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
SIMILARITY = 0.8
_draw = np.random.default_rng(20240501)
A = (_draw.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
B = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Words whose hashes a worker remembers, and shingles handled at once.
REMEMBERED = 400_000
BLOCK = 1024
#: Ids sampled to place the ranges of ``neighbours``, and bytes of text in a range.
SAMPLE = 20_000
RANGE_BYTES = 16 << 20

_known: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_known) > REMEMBERED:
            _known.clear()
        out = [h if (h := _known.get(w)) is not None else _known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words]
        return np.array(out, np.uint64)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = max(len(h) - width + 1, 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ (out >> np.uint64(31))) * MIX[k % len(MIX)] + h[k:k + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def signature(text: str, width: int = SHINGLE) -> np.ndarray:
    """The ``PERMUTATIONS`` 16-bit places of a text's fingerprint."""
    x = (shingles(text, width) >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), BLOCK):
        np.minimum(low, (A * x[k:k + BLOCK] + B).min(axis=1), out=low)
    return low.astype(np.uint16)


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def neighbours(docs: DataFrame) -> DataFrame:
    """part, own, id, th, text: ascending rows per part; a part's last row (own false) is the first of the next part."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint")).alias("bytes")).first()
    every = max(1, -(-size["n"] // SAMPLE))
    keys = rows.select("id", "th", F.octet_length("text").cast("bigint").alias("size"))
    some = (keys.where(F.pmod(F.hash("id", "th"), F.lit(every)) == 0).groupBy("id", "th").agg(F.sum("size").alias("size"))
            .orderBy("id", "th").limit(4 * SAMPLE).collect())
    first = keys.agg(F.min(F.struct("id", "th")).alias("k")).first()["k"]
    weigh = {(r[0] is not None, r[0], r[1]): r[2] for r in some}
    if first is not None:
        weigh.setdefault((first[0] is not None, first[0], first[1]), 0)
    sample = sorted(weigh)
    parts = max(spark.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // RANGE_BYTES))
    # ranges of about equal bytes: a bound where the sampled texts before it pass the next share
    ends = list(accumulate(weigh[k] + 1 for k in sample))
    bounds = sorted({sample[min(bisect_left(ends, ends[-1] * k // parts + 1), len(sample) - 1)] for k in range(parts)} | {sample[0]}) if sample else []

    @F.pandas_udf(LongType())
    def code(ids: pd.Series, th: pd.Series) -> pd.Series:
        """Twice the part of a row, plus one if the row is the part's bound."""
        out = []
        for i, t, missing in zip(ids, th, ids.isna(), strict=True):
            mine = (False, None, t) if missing else (True, int(i), t)
            part = max(bisect_right(bounds, mine) - 1, 0)
            out.append(2 * part + (bounds[part] == mine))
        return pd.Series(out, dtype="int64")

    part = F.shiftright("code", 1)
    before = F.when(part == 0, len(bounds) - 1).otherwise(part - 1)
    copies = F.when(F.col("code") % 2 == 1, F.array(F.struct(part.alias("part"), F.lit(True).alias("own")),
                                                    F.struct(before.alias("part"), F.lit(False).alias("own")))
                    ).otherwise(F.array(F.struct(part.alias("part"), F.lit(True).alias("own"))))
    dealt = (rows.select("*", code("id", "th").alias("code"))
             .select(F.explode(copies).alias("c"), "id", "th", "text").select("c.part", "c.own", "id", "th", "text"))
    return dealt.repartitionById(max(len(bounds), 1), F.col("part").cast("int")).sortWithinPartitions("part", F.desc("own"), "id", "th")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``.

    The edited text has its last half replaced by as much of the next document's beginning.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held = None                                       # the row before: range, id, text, signature
        closed = None                                     # the range whose first following row has come
        for b in batches:
            ids, cols = [], [[] for _ in kinds]
            for k, (r, own, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)):
                if closed == r:
                    continue                              # repeats of a following row
                sig = signature(text)
                if held is not None and held[0] == r:
                    n = len(held[2])
                    half = n // 2
                    edited = held[2][:n - half] + text[:half]
                    esig = signature(edited)
                    ids.append(held[1])
                    row = (n, hashlib.sha256(edited.encode()).hexdigest(), hexed(held[3]), hexed(esig), likeness(held[3], esig), likeness(held[3], sig))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                if not own:
                    closed = r
                held = (r, b.column(2).slice(k, 1), text, sig) if own else None
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids)] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return neighbours(docs).mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                            "edited_fingerprint string, near_edited double, near_next double")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(
        both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """doc_id, component_id (the least id of the component) for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("cid", F.md5("text"))
    classes = rows.groupBy("cid").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            sigs = [signature(t).reshape(bands, -1) for t in texts]
            keys = [[xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(s)] for s in sigs]
            sets = [np.unique(shingles(t)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))],
                                             ["cid", "least", "bands", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = materialise(classes.select("cid", "least", "text").mapInArrow(
        run, f"cid string, least {kind}, bands array<bigint>, shingles array<bigint>"), "minhash-classes")
    sets = table.select("cid", "shingles")
    members = table.select("cid", F.posexplode("bands").alias("band", "key"))
    first = members.groupBy("band", "key").agg(F.min("cid").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialise(members.join(first, ["band", "key"]), "minhash-buckets")
    star = materialise(_verified(shared.where("cid != b").select(F.col("cid").alias("a"), "b").distinct(), sets, similarity), "minhash-stars")
    roots = components(star, "minhash-links")
    own = shared.join(roots, shared.cid == roots.node, "left").select("band", "key", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = own.groupBy("band", "key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").drop("mixed")
    left = own.join(mixed, ["band", "key"])
    # pairs of components first, then their members: members of one component never meet
    mine = left.select("band", "key", "root").distinct()
    pairs = mine.join(mine.select("band", "key", F.col("root").alias("other")), ["band", "key"]).where("root < other")
    others = left.select("band", "key", F.col("cid").alias("b"), F.col("root").alias("other"))
    across = (left.select("band", "key", F.col("cid").alias("a"), "root").join(pairs, ["band", "key", "root"])
              .join(others, ["band", "key", "other"]).select("a", "b").distinct())
    found = materialise(star.union(_verified(across, sets, similarity)), "minhash-pairs")
    roots = components(found, "minhash-links")
    named = table.join(roots, table.cid == roots.node, "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select(F.col("cid").alias("of"), "component_id")
    return rows.join(of, rows.cid == of.of).select("doc_id", "component_id")

"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: a document's words (split on ASCII white space, A-Z lower-cased)
give ``SHINGLE``-word shingles, each hashed with XXH64 (seed 42); a fingerprint
bit is 1 if it is set in more than half of the hashes.

Links: two fingerprints that differ in at most ``RADIUS`` (2) bits agree in at
least two of four 16-bit blocks, so every distinct fingerprint is dealt to six
buckets, one per pair of blocks.  Buckets above ``HEAVY`` fingerprints are dealt
again on three parts of the other 32 bits (two differing bits leave one part
equal), after which a bucket leaves at most 22 free bits and so has a fixed upper bound of
members.  Copies of a text share one fingerprint and are one member.

Inside a bucket the bits stand vertically: plane b holds bit b of all members,
64 members to a word.  Comparing every member with the one ``d`` places on is an
exclusive-or of each plane with itself shifted by d; the 64 partial results are
added by carry-save counters (ones, twos, and a sticky "over the radius"), and a
64-member block is abandoned as soon as all its members are over.  A bucket
yields a star of links around its smallest linked member, never all pairs.

Components: links between fingerprints go through alternating large-star and
small-star rounds, each a written table, until every node hangs off a root.

Defined results: null and wordless texts have fingerprint 0, linked like any
other; repeated rows share a component; a null ``doc_id`` keeps its row but never
names a component (a component of null ids only has a null ``component_id``); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matching, materialise, prepare, text_bytes

SHINGLE = 3
RADIUS = 2
SEED = 42
HEAVY = 1 << 14
#: Members compared at once by one task, besides those of one bucket.
CHUNK = 1 << 17
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k:k + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): hash of the text and fingerprint, as a signed long, of every row of ``docs``."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), text_bytes("text").alias("raw")).mapInArrow(
        run, f"doc_id {kind}, th bigint, fp bigint")


def _planes(fp: np.ndarray, extra: int) -> np.ndarray:
    """64 bit planes of ``fp``, 64 members to a word, followed by ``extra`` words of zeros."""
    n = -(-len(fp) // 64)
    bits = np.unpackbits(np.pad(fp, (0, n * 64 - len(fp))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.pad(packed, ((0, 0), (0, extra)))


def linked_pairs(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS):
    """Yield arrays (i, j), i < j, of members of one group within ``radius`` bits; ``group`` is sorted.

    Counts up to ``radius`` (at most 2) are held by two carry-save counters.
    """
    assert 0 <= radius <= 2
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))    # of each member's group
    longest = int(np.diff(np.r_[starts, n]).max())
    planes = _planes(fp, longest // 64 + 2)
    lanes = -(-n // 64)
    reach = np.pad(ends - np.arange(n), (0, lanes * 64 - n))             # partners lie less than this far on
    for d in range(1, longest):
        inside = np.packbits(reach > d, bitorder="little").view(np.uint64)
        live = np.flatnonzero(inside)
        over = ~inside[live]
        ones = np.zeros(len(live), np.uint64)
        twos = np.zeros(len(live), np.uint64)
        q, r = d >> 6, np.uint64(d & 63)
        left = np.uint64(64) - r
        for b in range(64):
            p = planes[b]
            there = p[live + q] if not r else (p[live + q] >> r) | (p[live + q + 1] << left)
            diff = p[live] ^ there
            carry = ones & diff
            ones ^= diff
            twos |= carry
            over |= (ones, twos, ones & twos)[radius]
            if b % 8 == 7:
                stay = over != FULL
                if not stay.all():
                    live, over, ones, twos = live[stay], over[stay], ones[stay], twos[stay]
                    if not len(live):
                        break
        if len(live):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(live), 64)
            w, lane = np.nonzero(hit)
            i = live[w] * 64 + lane
            yield i, i + d


def stars(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for every member linked to a smaller one of its group."""
    root = np.arange(len(fp))
    for i, j in linked_pairs(group, fp, radius):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child], fp[root[child]]


def links(distinct: DataFrame, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """(a, b): stars of links between the distinct fingerprints of ``distinct`` (fp bigint)."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        keys.append(F.struct((F.lit(t << 32) + F.shiftleft(block[i], 16) + block[j]).alias("bucket"),
                             (F.shiftleft(block[k], 16) + block[m]).alias("rest")))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.bucket", "k.rest")
    sizes = dealt.groupBy("bucket").count().where("count > 1")
    part = [F.col("rest").bitwiseAND(F.lit(0x7FF)), F.shiftright("rest", 11).bitwiseAND(F.lit(0x7FF)), F.shiftright("rest", 22)]
    subs = F.array(*(F.lit((s + 1) << 11) + p for s, p in enumerate(part)))
    rows = dealt.join(sizes, "bucket").select(
        "bucket", F.explode(F.when(F.col("count") > heavy, subs).otherwise(F.array(F.lit(0).cast("bigint")))).alias("sub"), "fp")

    def run(batches):
        held: list[np.ndarray] = []
        rows = 0

        def flush(last):
            nonlocal held, rows
            if not rows:
                return None
            all_ = np.concatenate(held, axis=1)
            cut = all_.shape[1]
            if not last:                                 # the last bucket may go on in the next batch
                cut -= int((all_[:2] == all_[:2, -1:]).all(axis=0).sum())
            held, rows = [all_[:, cut:]], all_.shape[1] - cut
            if not cut:
                return None
            own = all_[:, :cut]
            change = np.r_[True, (own[:2, 1:] != own[:2, :-1]).any(axis=0)]
            a, b = stars(np.cumsum(change), own[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        limit = CHUNK
        for b in batches:
            held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
            rows += b.num_rows
            if rows >= limit:
                out = flush(False)
                limit = max(CHUNK, 2 * rows)             # an unfinished bucket is joined with twice as much next time
                if out is not None and out.num_rows:
                    yield out
        out = flush(True)
        if out is not None and out.num_rows:
            yield out

    return (rows.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "fp")
            .mapInArrow(run, "a bigint, b bigint").distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) that is not its component's least node, that least node.

    Alternating large-star and small-star rounds (about log^2 of a component's
    size); both keep only minima per node, combined map-side, and join them back.
    """
    while True:
        both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        sym = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialise(sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.union(parent.select("a", F.col("m").alias("b"))).where("a != b").distinct(), name)
        kids = edges.groupBy("a").agg(F.count("*").alias("n"))
        loose = kids.where("n > 1").select("a").union(edges.join(kids.select(F.col("a").alias("k")), F.col("b") == F.col("k"), "left_semi").select("a"))
        if loose.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _named(docs: DataFrame, width: int, radius: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Prints (doc_id, th, fp) of every row, and for every fingerprint (``of``) its component: root and least id."""
    prints = materialise(fingerprints(docs, width), "simhash-prints")
    groups = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    roots = components(links(groups.select("fp"), radius, heavy), "simhash-links")
    named = groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, materialise(named.join(least, "root").select(F.col("fp").alias("of"), "root", "component_id"), "simhash-table")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text)."""
    prints, table = _named(docs, width, radius, heavy)
    return prints.join(table, prints.fp == table.of).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id (a null id last), of several the smallest text hash.

    Of rows that are alike in id and text any one stays, whatever their other columns hold.
    """
    prints, table = _named(docs, width, radius, HEAVY)
    rows = prints.join(table.select("of", "root"), prints.fp == table.of).groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    best = materialise(rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "th", "n"), order).alias("b")).select("b.*"), "simhash-kept")
    keys = [docs["doc_id"], F.xxhash64(docs["text"])]
    alone = matching(docs, best.where("n = 1").select("doc_id", "th"), keys)
    repeated = matching(docs, best.where("n > 1").select("doc_id", "th"), keys)
    row = F.struct(*[repeated[f"`{c}`"] for c in repeated.columns]).alias("row")
    one = (repeated.select(row, repeated["doc_id"].alias("id"), F.xxhash64(repeated["text"]).alias("th"))
           .dropDuplicates(["id", "th"]).select("row.*"))
    return alone.unionByName(one)

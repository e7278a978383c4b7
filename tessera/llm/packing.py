"""Best-fit packing by exact-complement hashing.

Documents are cut into pieces of at most ``LIMIT`` tokens, and pieces are packed
into sequences of ``LIMIT`` tokens.  The plan depends only on how many pieces there are of
each length, at most ``LIMIT`` numbers whatever the input.  From the longest length down, the gap a
piece leaves is filled exactly: by one length, by a pair, or by a triple whose
sum is the gap, found in an index of the single, pair and triple sums of the lengths still available; each
find is consumed as often as the counts allow.  What has no exact complement is
packed best-fit: the longest available length that fits, until nothing does.  Each step uses
up at least one length, so the plan has a number of patterns bounded by ``LIMIT``, not by the input.

Pieces then get their places without a global sort: they are ranked inside
(length, shard) groups of bounded size, shard totals give the ranks within a
length, and a piece finds its pattern by binary search in the plan's table of ranks.

Defined results: a null or empty text is one piece holding only the end id; repeated rows, null
ids and equal lengths are separate pieces with places of their own; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, prepare

LIMIT = 2048
END = 0
#: Pieces ranked together by one task.
SHARD = 200_000


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str = tokens.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``with_ids`` adds ids (little-endian unsigned 32-bit)."""
    prepare(docs.sparkSession)
    end = np.array([END], "<u2").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        encode = tokens.ids(vocabulary)
        for b in batches:
            at, cols = [], [[] for _ in names[1:]]
            for k, text in enumerate(b.column(1).to_pylist()):
                full = np.frombuffer(encode(text or "") + end, "<u2").astype("<u4")
                for p, start in enumerate(range(0, len(full), limit)):
                    raw = full[start:start + limit].tobytes()
                    at.append(k)
                    for c, v in zip(cols, (p, start, len(raw) // 4, zlib.crc32(raw), raw), strict=False):
                        c.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64()))]
                                             + [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


class Sums:
    """Index of single, pair and triple sums of the lengths still available.

    Under each sum the lengths that make it up stand in order of the longest, with a pointer past those that are used up:
    counts only fall, so what the pointer has passed never comes back, and a find costs no search of the lengths. One
    piece of a length can be held, as the one to be completed; ``have`` is without it.
    """

    def __init__(self, have: np.ndarray):
        self.have, self.held = have, np.zeros_like(have)
        self.pairs: dict[int, list[int]] = {}              # sum -> shorter lengths, the shortest first
        self.triples: dict[int, list[int]] = {}            # sum -> longest lengths, the longest first
        self.passed: dict[tuple[int, int], int] = {}       # (parts, sum) -> entries used up

    def hold(self, length: int, n: int = 1) -> None:
        self.have[length] -= n
        self.held[length] += n

    def _left(self, short: int, total: int, counts: np.ndarray) -> bool:
        return bool(counts[short] and counts[total - short] and (2 * short != total or counts[short] > 1))

    def _open_pairs(self, total: int) -> tuple[list[int], int]:
        """The entries of a pair sum, and the first one that is not used up."""
        every = self.have + self.held
        if total not in self.pairs:
            short = np.arange(1, total // 2 + 1)
            ok = (every[short] > 0) & (every[total - short] > 0) & ((2 * short != total) | (every[short] > 1))
            self.pairs[total] = short[ok].tolist()
        found, at = self.pairs[total], self.passed.get((2, total), 0)
        while at < len(found) and not self._left(found[at], total, every):
            at += 1
        self.passed[2, total] = at
        return found, at

    def pair(self, total: int) -> list[int] | None:
        """The pair with this sum whose longer length is longest."""
        if total < 2:
            return None
        found, at = self._open_pairs(total)
        return next(([total - s, s] for s in found[at:] if self._left(s, total, self.have)), None)

    def triple(self, total: int) -> list[int] | None:
        """The triple with this sum whose longest length is longest."""
        every = self.have + self.held
        if total not in self.triples:
            longest = np.flatnonzero(every[:max(total - 1, 0)])[::-1]
            self.triples[total] = longest[3 * longest >= total].tolist()
        found, at = self.triples[total], self.passed.get((3, total), 0)
        while at < len(found) and not (every[found[at]] and self._any_pair(total - found[at])):
            at += 1
        self.passed[3, total] = at
        for longest in found[at:]:
            if self.have[longest] and self._any_pair(total - longest):
                self.hold(longest)
                two = self.pair(total - longest)
                self.hold(longest, -1)
                if two:
                    return [longest, *two]
        return None

    def _any_pair(self, total: int) -> bool:
        if total < 2:
            return False
        found, at = self._open_pairs(total)
        return at < len(found)

    def complement(self, gap: int) -> list[int] | None:
        """Available lengths that fill ``gap`` exactly: one, two or three."""
        return [gap] if self.have[gap] else self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), from the number of pieces of each length."""
    have = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[list[int], int]] = []
    sums = Sums(have)

    def take(lengths: list[int]) -> None:
        kinds = np.bincount(lengths, minlength=limit + 1)
        used = np.flatnonzero(kinds)
        times = int((have[used] // kinds[used]).min())
        have[used] -= times * kinds[used]
        out.append((lengths, times))

    alone = np.zeros(limit + 1, np.int64)                 # no exact complement was left when their turn came
    for length in range(limit, 0, -1):
        while have[length]:
            if length == limit:
                take([length])
                continue
            sums.hold(length)
            rest = sums.complement(limit - length)
            sums.hold(length, -1)
            if rest is None:
                alone[length], have[length] = have[length], 0
            else:
                take([length, *rest])
    have[:] = alone
    for length in range(limit, 0, -1):                    # best fit of the residuals
        while have[length]:
            lengths, left = [length], limit - length
            have[length] -= 1
            while left and (fits := np.flatnonzero(have[1:left + 1])).size:
                best = int(fits[-1]) + 1
                n = min(int(have[best]), left // best)
                lengths += [best] * n
                have[best] -= n
                left -= n * best
            np.add.at(have, lengths, 1)
            take(lengths)
    return out


def _slots(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Per use of a length by a pattern: length, first rank, uses per sequence, first sequence, offset in it."""
    rows, rank, sequence = [], {}, 0
    for lengths, times in patterns:
        offsets = [0, *accumulate(lengths)]
        k = 0
        while k < len(lengths):
            n = next((m for m in range(k, len(lengths)) if lengths[m] != lengths[k]), len(lengths)) - k
            first = rank.get(lengths[k], 0)
            rows.append((lengths[k], first, n, sequence, offsets[k]))
            rank[lengths[k]] = first + n * times
            k += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(rows: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """``rows`` (a written table of pieces with ``length`` from 1 to ``limit``) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # limit rows at most
    slots = _slots(plan(counts, limit))
    shards = max(1, -(-sum(counts.values()) // shard))
    keys = [c for c in rows.columns if c not in ("length", "ids")]
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    totals = dealt.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    before = totals.select(F.col("length").alias("_l"), F.col("_shard").alias("_s"),
                           (F.sum("_n").over(Window.partitionBy("length").orderBy("_shard")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_shard").orderBy(*keys))
    ranked = (dealt.withColumn("_inside", inside)
              .join(before, (F.col("length") == F.col("_l")) & (F.col("_shard") == F.col("_s")))
              .withColumn("_rank", F.col("_before") + F.col("_inside") - 1).drop("_l", "_s", "_shard", "_inside", "_before"))
    names = rows.columns

    def run(batches):
        key = slots[:, 0] << 48 | slots[:, 1]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            _, first, n, sequence, offset = slots[np.searchsorted(key, length << 48 | rank, "right") - 1].T
            copy, use = np.divmod(rank - first, n)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(sequence + copy), pa.array(offset + use * length)],
                                             [*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(run, f"{ddl}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str = tokens.VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and offset; ``with_ids`` keeps the token ids."""
    return place(materialise(pieces(docs, limit, vocabulary, with_ids), "packing-pieces"), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences themselves, from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))     # at most limit tokens in all
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.expr("aggregate(parts, X'', (a, p) -> a || p.ids)").alias("ids"))

"""Exact substring dedup over a sparse suffix array, sorted deep-shallow.

A byte goes if some ``MATCH``-byte string over it also starts earlier.  Sorting every suffix of
the corpus is not needed for that: of the suffixes starting inside any ``MATCH``-byte string,
the one whose first ``GRAM`` bytes have the least hash is an *anchor*, and equal strings have equal
anchors at equal places.  So only anchors (about one byte in 35) are taken, with up to
``MATCH`` bytes of suffix to the right and the bytes to the left that a string around the anchor
can reach (its context).

1. Anchors go by gram hash to tasks that sort them by (hash, context hash, document, place) and
   stream over them.  An anchor whose whole context occurred earlier is covered as far as its context reaches;
   within a batch of documents this is settled before the shuffle, so that of a passage in a third of all
   documents each batch sends one anchor per context.
   The first of each context goes on, if its gram has other contexts too.
2. Those fetch their context bytes.  The suffixes of a gram, and the reversed bytes to the left, are sorted
   deep-shallow: multikey quicksort to ``SHALLOW`` bytes, then blind tries order the groups that still
   agree.  From the sorted order and its longest common prefixes follows, for each of the
   places an anchor can have in a string, which anchors stand in equal strings; all but the earliest
   are covered there.  Grams with more than ``GROUP`` contexts are not gathered in a task: their strings are
   grouped by digest in Spark, combined map-side.
3. Covered ranges meet their documents again, are merged and cut out.

The texts are shuffled once; both joins with them share the exchange.

In step 1 a context counts as met before if its gram and its whole context have equal 64-bit rolling hashes; the bytes are
not compared again, so that two different contexts of one gram are taken for one with a chance of 2^-64 per
pair.  Ids must be whole numbers.

Defined results: null text has no bytes; texts under ``MATCH`` bytes lose nothing; matches never cross documents;
rows with the same id and text are one document and get the same
result, rows with the same id and another text are ordered by start, then by a checksum; a null id counts as the
smallest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, text_bytes

MATCH = 100
GRAM = 32
SHALLOW = 16
GROUP = 1 << 17
#: Contexts worked on together by one task, besides those of one gram.
CHUNK = 1 << 16
NO_ID = -(1 << 63)
_draw = np.random.default_rng(20240502)
BYTE = _draw.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = int(_draw.integers(0, 1 << 63)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)


def _sliding(f, a: np.ndarray, width: int) -> np.ndarray:
    """f over every run of ``width`` entries, by doubling."""
    done = 1
    while done * 2 <= width:
        a, done = f(a[:-done], a[done:]), done * 2
    return f(a[:len(a) - (width - done)], a[width - done:]) if done < width else a


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(17, n.bit_length())
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def anchors(text: bytes, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, hashes of their grams, and hashes of their contexts."""
    n, width = len(text), match - gram + 1
    if n < match:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _power(n + 1)
    sums = np.r_[np.uint64(0), np.cumsum(BYTE[np.frombuffer(text, np.uint8)] * up[:n])]
    g = (sums[gram:] - sums[:-gram]) * down[:n - gram + 1]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    least = _sliding(np.minimum, g, width)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), width) == g)
    left, right = np.maximum(at - (width - 1), 0), np.minimum(at + match, n)
    c = (sums[right] - sums[left]) * down[left]
    c ^= ((at - left) * 1000 + (right - at)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = (c ^ (c >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return at, g[at].view(np.int64), c.view(np.int64)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings that share a long prefix: nodes know their depth and branching bytes only."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [None, {}, [first]]             # depth (None: leaf), children, members of a leaf

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, k: int) -> None:
        s, node = self.strings[k], self.root
        while node[0] is not None:                        # blind: only branching bytes are looked at
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[2][0]]
        if s == other:
            node[2].append(k)
            return
        depth = common(s, other)
        node = self.root
        while node[0] is not None and node[0] < depth:
            node = node[1][self._byte(s, node[0])]
        leaf = [None, {}, [k]]
        if node[0] == depth:
            node[1][self._byte(s, depth)] = leaf
        else:
            node[:] = [depth, {self._byte(other, depth): node[:], self._byte(s, depth): leaf}, []]

    def ordered(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            out += node[2]
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], members: list[int] | None = None, shallow: int = SHALLOW) -> list[int]:
    """The members (places in ``strings``) in ascending order of their strings."""
    todo = [(list(range(len(strings))) if members is None else members, 0, shallow)]
    out: list[int] = []
    while todo:
        group, depth, limit = todo.pop()
        if len(group) < 2:
            out += group
            continue
        if len(group) == 2:
            a, b = group
            out += group if strings[a] <= strings[b] else [b, a]
            continue
        if depth >= limit:
            trie = BlindTrie(strings, group[0])
            for k in group[1:]:
                trie.add(k)
            out += trie.ordered()
            continue
        own = [strings[k] for k in group]
        low, high = min(own), max(own)
        skip = common(low, high)
        if skip == len(low) == len(high):                 # all equal
            out += group
            continue
        if skip > depth:                                  # bytes that all share cost no partition
            depth, limit = skip, max(limit, skip + shallow)
        keys = [s[depth:depth + 1] for s in own]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [k for k, c in zip(group, keys, strict=True) if c < pivot]
        same = [k for k, c in zip(group, keys, strict=True) if c == pivot]
        more = [k for k, c in zip(group, keys, strict=True) if c > pivot]
        todo += [(more, depth, limit), (same, depth + 1 if pivot else limit, limit), (less, depth, limit)]
    return out


def _sorted_prefixes(strings: list[bytes], bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all strings group by group, common prefix with the one before (-1 at a group's first), lengths."""
    order = np.empty(len(strings), np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        order[a:b] = deep_shallow(strings, list(range(a, b)))
    size = np.array([len(s) for s in strings], np.int64)
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)[order]
    apart = np.concatenate([table[1:] != table[:-1], np.ones((max(len(table) - 1, 0), 1), bool)], axis=1)
    prefix = np.minimum(np.argmax(apart, axis=1), np.minimum(size[order][1:], size[order][:-1]))
    prefix = np.r_[-1, prefix] if len(strings) else prefix
    prefix[bounds[:-1]] = -1
    return order, prefix, size


def covered(left: list[bytes], right: list[bytes], bounds: np.ndarray, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which anchors stand in a string that an earlier one stands in too: their numbers, and how many bytes it reaches left and right.

    Groups lie between ``bounds``, the earliest anchor of each first; ``left`` holds the bytes before the anchors.
    """
    n = len(right)
    r_order, r_prefix, r_size = _sorted_prefixes(right, bounds, match)
    l_order, l_prefix, l_size = _sorted_prefixes([s[::-1] for s in left], bounds, match - gram)
    most, least = np.full(n, -1, np.int64), np.full(n, match, np.int64)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(match - gram + 1):                     # the anchor's place in the string
        ok = np.flatnonzero((l_size >= o) & (r_size >= match - o))
        if len(ok) < 2:
            continue
        r_class[r_order] = np.cumsum(r_prefix < match - o)
        l_class[l_order] = np.cumsum(l_prefix < o)
        _, first, which = np.unique(r_class[ok] * (n + 1) + l_class[ok], return_index=True, return_inverse=True)
        later = ok[first[which] < np.arange(len(ok))]
        most[later] = o
        least[later] = np.minimum(least[later], o)
    hit = np.flatnonzero(most >= 0)
    return hit, most[hit], match - least[hit]


def _rows(docs: DataFrame) -> DataFrame:
    """d (id, null as the smallest), c (checksum of the text), raw."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("id"), text_bytes("text").alias("raw"))
    return own.select(F.coalesce("id", F.lit(NO_ID)).alias("d"), F.crc32("raw").alias("c"), "raw")


def _groups(batches, chunk: int):
    """Record batches joined so that each holds whole groups of equal first column, about ``chunk`` rows."""
    held, rows, limit = [], 0, chunk
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            t = pa.concat_batches(held)
            h = t.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut:
                yield t.slice(0, cut)
            held, rows = [t.slice(cut)], t.num_rows - cut
            limit = max(chunk, 2 * rows)                  # a group that goes on is joined with twice as much next time
    if rows:
        yield pa.concat_batches(held)


def _once(batches):
    """Record batches without the rows that equal the row before in their first three columns (h, d, pc)."""
    last = np.zeros((3, 0), np.int64)
    for b in batches:
        x = np.concatenate([last, np.stack([b.column(k).to_numpy() for k in range(3)])], axis=1)
        new = np.r_[True, (x[:, 1:] != x[:, :-1]).any(axis=0)][last.shape[1]:]
        last = x[:, -1:]
        if new.any():
            yield b if new.all() else b.filter(pa.array(new))


def _found(rows: DataFrame) -> DataFrame:
    """d, pc (place << 32 | checksum), h: anchors of grams that occur again; whole is true where the whole context occurred earlier."""

    def scan(batches):
        for b in batches:
            got = [anchors(t) for t in b.column(2).to_pylist()]
            n = np.array([len(g[0]) for g in got], np.int64)
            if not n.sum():
                continue
            at, h, c = (np.concatenate([g[k] for g in got]) for k in range(3))
            d = np.repeat(b.column(0).to_numpy(), n)
            pc = at << 32 | np.repeat(b.column(1).to_numpy(), n)
            # what occurred earlier in this batch is settled here and need not meet its gram's other anchors
            order = np.lexsort((pc, d, c, h))
            x = np.stack([h, c, d, pc])[:, order]
            again = np.r_[False, (x[:, 1:] == x[:, :-1]).all(axis=0)]
            done = np.r_[False, (x[:2, 1:] == x[:2, :-1]).all(axis=0)] & ~again
            x[0] = np.where(done, x[2] * 0x9E3779B1 + x[3], x[0])
            x = np.concatenate([x, done[None]])[:, ~again]
            for k in range(0, x.shape[1], 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in x[:, k:k + (1 << 16)]], ["h", "c", "d", "pc", "done"])

    def classify(batches):
        last = np.zeros((5, 0), np.int64)                 # the last decided row and the one that waits for the next
        for b in batches:
            new = np.stack([b.column(k).to_numpy() for k in range(5)])
            x = np.concatenate([last, new], axis=1)
            yield from emit(x, last.shape[1], False)
            last = x[:, -2:]
        if last.shape[1]:
            yield from emit(last, last.shape[1], True)

    def emit(x, skip, end):
        """Decide every row that has its neighbours in x; the first ``skip`` rows were there before, the last one waits unless ``end``."""
        n = x.shape[1]
        lo, hi = max(skip - 1, 0), n if end else n - 1
        if hi <= lo:
            return
        h, c, done = x[0], x[1], x[4] > 0
        before_h = np.r_[False, (h[1:] == h[:-1]) & ~done[1:] & ~done[:-1]]
        before_c = before_h & np.r_[False, c[1:] == c[:-1]]
        again = before_c & np.r_[False, (x[2:4, 1:] == x[2:4, :-1]).all(axis=0)]        # the same occurrence once more
        after_h = np.r_[before_h[1:], False]
        keep = (before_h | after_h | done) & ~again
        keep[:lo] = False
        keep[hi:] = False
        k = np.flatnonzero(keep)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(x[2, k]), pa.array(x[3, k]), pa.array(h[k]), pa.array((before_c | done)[k])], ["d", "pc", "h", "whole"])

    found = rows.mapInArrow(scan, "h bigint, c bigint, d bigint, pc bigint, done bigint")
    return (found.repartition("h").sortWithinPartitions("h", "c", "d", "pc")
            .mapInArrow(classify, "d bigint, pc bigint, h bigint, whole boolean"))


def _span(place, left, right):
    """A covered range as one long: place << 16 | bytes left << 8 | bytes right."""
    return F.shiftleft(place, 16) + F.shiftleft(left.cast("bigint"), 8) + right.cast("bigint")


def covered_spans(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """d, c, span: ranges of documents (see ``_rows``) covered by strings that start earlier."""
    reach = MATCH - GRAM
    found = materialise(_found(rows), "suffixes-anchors")
    place = F.shiftright("pc", 32)
    check = F.col("pc").bitwiseAND(F.lit(0xFFFFFFFF))
    whole = found.where("whole").select("d", check.alias("c"), _span(place, F.lit(reach), F.lit(MATCH)).alias("span"))
    sizes = found.where("NOT whole").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    asked = materialise(found.where("NOT whole").join(sizes, "h").select("h", "d", "pc", check.alias("c"), (F.col("n") > group).alias("big")), "suffixes-asked")

    def contexts(big: bool) -> DataFrame:
        own = rows.join(asked.where(F.col("big") == big).withColumnsRenamed({"d": "a_d", "c": "a_c"}),
                        (F.col("d") == F.col("a_d")) & (F.col("c") == F.col("a_c")))
        start = F.greatest(place - reach, F.lit(0))
        return own.select("h", "d", "pc", (place - start).cast("int").alias("l"),
                          F.substring("raw", (start + 1).cast("int"), (place - start + MATCH).cast("int")).alias("context"))

    def sort(batches):
        for t in _groups(_once(batches), CHUNK):          # a document that stands in several rows comes once for each
            h, d, pc = (t.column(k).to_numpy() for k in range(3))
            ctx, left = t.column(4).to_pylist(), t.column(3).to_pylist()
            bounds = np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)]
            hit, l, r = covered([x[:k] for x, k in zip(ctx, left, strict=True)], [x[k:] for x, k in zip(ctx, left, strict=True)], bounds)
            span = (pc[hit] >> 32) << 16 | l << 8 | r
            yield pa.RecordBatch.from_arrays([pa.array(d[hit]), pa.array(pc[hit] & 0xFFFFFFFF), pa.array(span)], ["d", "c", "span"])

    small = (contexts(False).repartition("h").sortWithinPartitions("h", "d", "pc")
             .mapInArrow(sort, "d bigint, c bigint, span bigint"))
    strings = contexts(True).select("d", "pc", F.explode(F.expr(
        f"transform(filter(sequence(0, l), o -> octet_length(context) - l >= {MATCH} - o), "
        f"o -> named_struct('o', o, 's', unhex(md5(substring(context, l - o + 1, {MATCH})))))")).alias("s")).select("d", "pc", "s.o", "s.s")
    here = F.struct("d", place.alias("p"), (F.lit(0) - F.col("o")).alias("o"), "pc")
    first = strings.groupBy("s", "o").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first != last").select("s", "o", "first")
    large = strings.join(first, ["s", "o"]).where(here != F.col("first")).select(
        "d", check.alias("c"), _span(place, F.col("o"), F.lit(MATCH) - F.col("o")).alias("span"))
    return whole.union(small).union(large)


def cut(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """The text without its covered ranges, how many bytes went, in how many runs."""
    n = len(text)
    place, left, right = spans >> 16, spans >> 8 & 0xFF, spans & 0xFF
    start, end = np.maximum(place - left, 0), np.minimum(place + right, n)
    real = end - start >= MATCH
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start[real], 1)
    np.add.at(depth, end[real], -1)
    gone = np.cumsum(depth[:-1]) > 0
    if not gone.any():
        return text, 0, 0
    runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def suffix_dedup(docs: DataFrame, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text); ``with_text`` adds kept (bytes)."""
    prepare(docs.sparkSession)
    rows = _rows(docs)
    spans = covered_spans(rows, group).groupBy("d", "c").agg(F.collect_list("span").alias("spans")).withColumnsRenamed({"d": "s_d", "c": "s_c"})
    joined = rows.join(spans, (F.col("d") == F.col("s_d")) & (F.col("c") == F.col("s_c")), "left").select("d", "raw", "spans")
    names = ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches):
        for b in batches:
            out = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                kept, gone, runs = cut(t, s.values.to_numpy()) if s.is_valid else (t, 0, 0)
                out.append((len(t), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][:len(names) - 1], names)

    ddl = "d bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(run, ddl).select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), *names[1:])

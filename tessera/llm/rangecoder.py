"""Adaptive context-mixing range coder for token ids.

A block of ids is coded on its own: all model state is reset at its start, and
its header holds a checksum of its ids.  Ids under 65,536 are coded one by one.
Three predictions are mixed, each with a weight that follows how often it has been right:

* order 2 and order 1 look up the id that followed the last two ids, or the last
  one, in small hashed tables, each entry with a confidence;
* order 0 gives every id met in the block a probability by how often it has been met: counts in
  hashed slots, summed in three levels (a tree of 16 x 8 x 8 slots).

What the mixture leaves is the escape: an id new to the block, coded by its 16 bits.
The probabilities drive a carry-less range coder with a 48-bit low and 16-bit
output words.  Blocks do not depend on each other, so many of them ("lanes") are coded
and decoded in step, one numpy operation for all; coding one lane or a thousand gives
the same bytes.  A lane's model takes about 8 KB.  Counts are summed as whole numbers in 32-bit floats, whose sums are exact; all
other arithmetic is in integers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TCMR"
HEADER = struct.Struct("<4sIII")           # magic, ids, crc32 of the ids as little-endian 32-bit, crc32 of the words
TABLE = 9                                  # bits of the order-1 and order-2 tables, and of the parts of a 16-bit unit
# order 0: 16 parts of a block's slots, 8 of a part, 8 slots of those
SLOTS = 1024
MOST = 1 << 12                             # ids of a block at most: order 0's share of the range holds them all
ONE = 4096                                 # a probability or weight of one
RIGHT = np.array([3500 * (c + 1) // (c + 4) for c in range(16)], np.int32)     # chance of a prediction by its confidence
ONCE = np.int32(1)
OVER = np.triu(np.ones((16, 16), np.float32), 1)                       # counts @ OVER: the sums before each place
LOW = np.uint64((1 << 48) - 1)
TOP, BOTTOM = np.uint64(1 << 32), np.uint64(1 << (16 + TABLE))
SHIFT = np.uint64(16)


class _Coder:
    """Range coder state of all lanes; ``words`` is given when decoding."""

    def __init__(self, lanes: int, steps: int, words: list[np.ndarray] | None = None):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, LOW, np.uint64)
        self.at = np.zeros(lanes, np.int64)
        if words is None:
            # word by word, all lanes of a word together: the room for words that are not written is never touched
            self.out = np.zeros(lanes * (2 * steps + 8), "<u2")
            self.base, self.apart = np.arange(lanes, dtype=np.int64), lanes
        else:
            size = np.array([len(w) for w in words], np.int64)
            self.base, self.apart = np.cumsum(size + 4) - size - 4, 1
            self.out = np.zeros(int((size + 4).sum()), "<u2")
            for b, w in zip(self.base.tolist(), words, strict=True):
                self.out[b:b + len(w)] = w
            self.code = np.zeros(lanes, np.uint64)
            for _ in range(3):
                self.code = self.code << SHIFT | self.out[self.base + self.at * self.apart]
                self.at += 1
        self.decoding = words is not None

    def narrow(self, lanes, start: np.ndarray, size: np.ndarray, bits) -> None:
        """Take the part [start, start + size) of 2^bits of the range of ``lanes`` (a slice or an index array)."""
        r = self.range[lanes] >> bits
        low = (self.low[lanes] + r * start) & LOW
        rng = r * size
        need = ((low ^ ((low + rng) & LOW)) < TOP) | (rng < BOTTOM)
        self.low[lanes], self.range[lanes] = low, rng
        todo = np.flatnonzero(need) if isinstance(lanes, slice) else lanes[need]
        while len(todo):
            low, rng = self.low[todo], self.range[todo]
            apart = (low ^ ((low + rng) & LOW)) >= TOP
            rng = np.where(apart, (~low + np.uint64(1)) & (BOTTOM - np.uint64(1)), rng)
            place = self.base[todo] + self.at[todo] * self.apart
            if self.decoding:
                self.code[todo] = ((self.code[todo] << SHIFT) & LOW) | self.out[place]
            else:
                self.out[place] = low >> np.uint64(32)
            self.at[todo] += 1
            low = (low << SHIFT) & LOW
            rng = rng << SHIFT
            self.low[todo], self.range[todo] = low, rng
            todo = todo[((low ^ ((low + rng) & LOW)) < TOP) | (rng < BOTTOM)]

    def value(self, lanes, bits) -> np.ndarray:
        """Where in 2^bits the code of ``lanes`` stands."""
        r = self.range[lanes] >> bits
        v = ((self.code[lanes] - self.low[lanes]) & LOW) // r
        return np.minimum(v, (np.uint64(1) << bits) - np.uint64(1))

    def finish(self) -> list[np.ndarray]:
        for _ in range(3):
            self.out[self.base + self.at * self.apart] = self.low >> np.uint64(32)
            self.low = (self.low << SHIFT) & LOW
            self.at += 1
        return [self.out[b:b + n * self.apart:self.apart] for b, n in zip(self.base.tolist(), self.at.tolist(), strict=True)]


def _code(sizes: np.ndarray, coder: _Coder, ids: np.ndarray | None) -> np.ndarray | None:
    """Run the model over all lanes, ``sizes`` descending; ids (steps x lanes) to encode, or None to decode them."""
    lanes, steps = len(sizes), int(sizes.max(initial=0))
    rows = np.arange(lanes, dtype=np.int64) << TABLE
    one, two = np.zeros(lanes << TABLE, np.int32), np.zeros(lanes << TABLE, np.int32)     # id | confidence << 16
    holder = np.zeros(lanes * SLOTS, np.uint16)                        # order 0: the id of a slot that was met
    # how often the ids of a slot were met, and the same summed by the two levels above
    levels = [np.zeros(k * lanes, np.uint16) for k in (16, 128, SLOTS)]
    total = np.zeros(lanes, np.int32)
    chance = np.full(lanes, ONE // 4, np.int32)                        # weight of order 0 in what the others leave
    weight1, weight2 = np.full(lanes, ONE // 3, np.int32), np.full(lanes, ONE // 3, np.int32)
    p1, p2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    decoded = None if ids is not None else np.zeros((steps, lanes), "<u2")
    left = np.searchsorted(-sizes, -np.arange(steps), "left")          # lanes with more than t ids
    mask, whole = (1 << TABLE) - 1, np.uint64(16 + TABLE)
    every = np.arange(lanes, dtype=np.int64)
    for t in range(steps):
        n = int(left[t])
        s = slice(0, n)
        q1, row, w1, w2, z, lane = p1[s], rows[s], weight1[s], weight2[s], chance[s], every[s]
        mixed = q1 * 40503
        i1 = row + (mixed >> 5 & mask)
        i2 = row + ((mixed ^ (p2[s] * 30103)) >> 5 & mask)
        e1, e2 = one.take(i1), two.take(i2)
        c1, n1, c2, n2 = e1 & 0xFFFF, e1 >> 16, e2 & 0xFFFF, e2 >> 16
        b1 = w2 * RIGHT.take(n2) >> 8
        b2 = b1 + (w1 * RIGHT.take(n1) >> 8) * (c1 != c2)
        b3 = b2 + np.maximum((65536 - b2 >> 4) * z >> 8, MOST >> TABLE)
        unit = (b3 - b2 << TABLE) // np.maximum(total[s], 1)           # of the range, per time met
        if ids is not None:
            x = ids[t, s].astype(np.int32)
            h2, h1 = c2 == x, c1 == x
            k0, k1 = h2 & (b1 > 0), h1 & (b2 > b1)        # an order whose weight is spent offers nothing
            slot = _slot(x)
            times = levels[2].take(lane * SLOTS + slot).astype(np.int32)
            k2 = (holder.take(lane * SLOTS + slot) == x) & (times > 0) & ~(k0 | k1)
            k3 = ~(k0 | k1 | k2)
            before = _before(levels[0].reshape(-1, 16)[s], slot >> 6)
            before += _before(levels[1].reshape(-1, 8).take(lane * 16 + (slot >> 6), axis=0), slot >> 3 & 7)
            before += _before(levels[2].reshape(-1, 8).take(lane * 128 + (slot >> 3), axis=0), slot & 7)
            before = before.astype(np.int32)
        else:
            v = coder.value(s, whole).astype(np.int32)
            u = v >> TABLE
            k3, k2 = u >= b3, u >= b2
            k1 = (u >= b1) & ~k2
            k2 &= ~k3
            r = np.clip((v - (b2 << TABLE)) // unit, 0, np.maximum(total[s] - 1, 0)).astype(np.float32)
            part, before = _find(levels[0].reshape(-1, 16)[s], r)
            base = lane * 16 + part
            for level in levels[1:]:
                part, low = _find(level.reshape(-1, 8).take(base, axis=0), r - before)
                before += low
                base = (base << 3) + part
            before, times = before.astype(np.int32), levels[2].take(base).astype(np.int32)
            x = np.where(k2, holder.take(base), np.where(k1, c1, c2))
        start = np.where(k3, b3, b1 * k1) << TABLE
        size = np.where(k3, 65536 - b3, np.where(k1, b2 - b1, b1)) << TABLE
        start = np.where(k2, (b2 << TABLE) + before * unit, start)
        size = np.where(k2, times * unit, size)
        coder.narrow(s, start.astype(np.uint64), size.astype(np.uint64), whole)
        far = np.flatnonzero(k3)
        if ids is not None:
            coder.narrow(far, x[far].astype(np.uint64), np.uint64(1), np.uint64(16))
        else:
            sym = coder.value(far, np.uint64(16))
            coder.narrow(far, sym, np.uint64(1), np.uint64(16))
            x[far] = sym
            decoded[t, s] = x
            h2, h1 = c2 == x, c1 == x
            slot = _slot(x)
        at = lane * SLOTS + slot
        more = np.where(holder.take(at) == x, ONCE, ONCE - levels[2].take(at))      # a new id takes the slot over
        holder[at] = x
        for level in reversed(levels):
            level[at] = level.take(at) + more
            at >>= 3
        total[s] += more
        z += ((k2 * 4000 - z) >> 5) * (k2 | k3)
        share, some = 4093 - 2047 * (h1 & h2), h1 | h2
        w1 += ((h1 * share - w1) >> 5) * some
        w2 += ((h2 * share - w2) >> 5) * some
        for table, i, c, m, h in ((one, i1, c1, n1, h1), (two, i2, c2, n2, h2)):
            m = np.where(h, np.minimum(m + 1, 15), m - 1)
            table[i] = np.where(m < 0, x, c | m << 16)
        p2[s] = q1
        p1[s] = x
    return decoded


def _before(counts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each row of counts the sum of the ``place`` first."""
    width = counts.shape[1]
    return (counts.astype(np.float32) @ OVER[:width, :width]).take(np.arange(len(place)) * width + place)


def _find(counts: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of counts the place that holds unit ``r``, and the sum before it."""
    width = counts.shape[1]
    sums = counts.astype(np.float32) @ OVER[:width, :width]
    place = np.bitwise_count((sums <= r[:, None]).view(np.uint64)).sum(axis=1, dtype=np.int64) - 1 if width > 8 else \
        np.bitwise_count((sums <= r[:, None]).view(np.uint64))[:, 0].astype(np.int64) - 1
    return place, sums.take(np.arange(len(r)) * width + place)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x * 40503 & 0xFFFF) >> 6


def _order(sizes: list[int]) -> np.ndarray:
    return np.argsort(-np.array(sizes, np.int64), kind="stable")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """One coded block for each array of ids (unsigned 16-bit)."""
    if not blocks:
        return []
    order = _order([len(b) for b in blocks])
    sizes = np.array([len(blocks[k]) for k in order], np.int64)
    steps = int(sizes.max())
    if steps > MOST:
        raise ValueError(f"a block holds at most {MOST} ids")
    ids = np.zeros((len(blocks), steps), "<u2")
    for k, o in enumerate(order.tolist()):
        ids[k, :len(blocks[o])] = blocks[o]
    ids = np.ascontiguousarray(ids.T)
    coder = _Coder(len(blocks), steps)
    _code(sizes, coder, ids)
    out: list[bytes] = [b""] * len(blocks)
    for o, words in zip(order.tolist(), coder.finish(), strict=True):
        raw = words.tobytes()
        crc = zlib.crc32(blocks[o].astype("<u4").tobytes())
        out[o] = HEADER.pack(MAGIC, len(blocks[o]), crc, zlib.crc32(raw)) + raw
    return out


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each coded block; raises ValueError for a damaged one."""
    if not coded:
        return []
    heads, words = [], []
    for block in coded:
        magic, n, crc, sum_ = HEADER.unpack_from(block)
        raw = block[HEADER.size:]
        if magic != MAGIC or zlib.crc32(raw) != sum_:
            raise ValueError("damaged block: its words do not match their checksum")
        heads.append((n, crc))
        words.append(np.frombuffer(raw, "<u2"))
    order = _order([n for n, _ in heads])
    sizes = np.array([heads[k][0] for k in order], np.int64)
    coder = _Coder(len(coded), 0, [words[k] for k in order])
    ids = np.ascontiguousarray(_code(sizes, coder, None).T)
    out: list[np.ndarray] = [ids[0]] * len(coded)
    for k, o in enumerate(order.tolist()):
        out[o] = ids[k, :heads[o][0]]
        if zlib.crc32(out[o].astype("<u4").tobytes()) != heads[o][1]:
            raise ValueError("damaged block: its ids do not match their checksum")
    return out

"""Prefix trie of conversations, rolled up by centroid decomposition.

**Rebuilding.**  Conversation c starts with the first h turns of conversation
c - c % 5 (h = crc32(c) % 9) and goes on with its own turns after its first h.  Turns shrink to a digest and a size
and are sorted once into ranges by (c - c % 5, c, turn), the shared conversation first.  A node is a
polynomial over the digests of its turns modulo 2^127 - 1.  Polynomials of consecutive pieces
combine, so a first pass reduces each range to a short summary, the driver folds the summaries (one per
range) to the state at each range's start, and a second pass writes one row per
conversation and depth.  A conversation may spread over any number of ranges.

**Nodes.**  Rows of equal node are aggregated (combined before the shuffle): smallest member, members, and the
weight of the subtree: the rows of its members from this depth on.

**Rollup.**  The forest of parent edges is split recursively.  The centroid z of a component is its deepest node
with more than half of its weight; without z the component falls into parts of at
most half the weight: one below each child of z, and one above.  What lies at or below z is totalled over the
component and added to z and to the path from z to the component's top; the members of z name that path.  After
all rounds each node has its subtree's total.  Components of more than ``LOCAL`` weight are split by Spark, all of them
at once in each round; the others are split in numpy, many at a time, each whole in one task.

**Ends.**  Ids of the members that end at a node are joined in sorted ranges to pieces of
about ``PIECE`` characters before the pieces of a node meet in one task, which hashes them one after the other.

Ids must be whole numbers.

Defined results: a null role or text is empty; turns are ordered by turn (null first), then role, then the text's first
64 characters, then a digest of the text; repeated turns each count; rows whose conv_id is null (or no whole number) belong to no
conversation; a conversation left without turns is a member of the root; an empty table
gives no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

GROUP = 5                     # conversations that share their first turns
HEADS = 8                     # turns shared at most (crc32 mod HEADS + 1)
#: Largest weight of a component handled whole in one task; rows handled at once there.
LOCAL = 65_536
ROWS = 50_000
#: Rows of one conversation dealt together where a round's split is joined to the nodes.
BLOCK = 65_536
PIECE = 65_536
#: A parent with more children than this (or than a 10,000th of all nodes) is joined by broadcast.
MANY_CHILDREN = 4_096

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F
ORDER = ["anchor", "follows", "conv_id", "turn", "role", "head", "digest"]


def shared_turns(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % (HEADS + 1)


def extend(node: int, digests) -> int:
    """The polynomial of a sequence followed by more digests."""
    for d in digests:
        node = (node * BASE + d) % PRIME
    return node


def turns_of(conversations: DataFrame) -> DataFrame:
    """anchor, follows, conv_id, turn, role, head, digest, size: one narrow row per turn."""
    conv = F.try_to_number(F.col("conv_id").cast("string"), F.lit("S9999999999999999999")).cast("bigint") \
        if conversations.schema["conv_id"].dataType.simpleString() == "string" else F.col("conv_id").cast("bigint")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(conv.alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    anchor = F.col("conv_id") - F.col("conv_id") % GROUP
    return rows.select(anchor.alias("anchor"), (F.col("conv_id") != anchor).alias("follows"), "conv_id", "turn", "role",
                       F.substring("text", 1, 64).alias("head"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("size"))


class State:
    """Where the rows read so far end: group, its first turns, conversation, its rows, its rebuilt node."""

    def __init__(self, anchor=None, heads=(), conv=None, n=0, node=0):
        self.anchor, self.heads, self.conv, self.n, self.node = anchor, [tuple(h) for h in heads], conv, n, node

    def start(self, anchor: int, conv: int) -> None:
        if conv == self.conv:
            return
        if anchor != self.anchor:
            self.anchor, self.heads = anchor, []
        self.conv, self.n, self.node = conv, 0, 0
        self.node = extend(0, (d for d, _ in self.heads[:self.shared()]))

    def shared(self) -> int:
        return 0 if self.conv == self.anchor else shared_turns(self.conv)

    def run(self, run: dict) -> None:
        """Take in the summary of ``n`` further rows of one conversation."""
        self.start(run["anchor"], run["conv"])
        skip = min(max(self.shared() - self.n, 0), run["n"])
        if run["n"] > skip:
            left = pow(BASE, run["n"] - skip, PRIME)
            first = extend(0, (d for d, _ in run["heads"][:skip]))
            self.node = (self.node * left + run["node"] - first * left) % PRIME
        if self.conv == self.anchor:
            self.heads = (self.heads + [tuple(h) for h in run["heads"]])[:HEADS]
        self.n += run["n"]

    def json(self) -> list:
        return [self.anchor, self.heads, self.conv, self.n, self.node]


def _summaries(rows: DataFrame) -> DataFrame:
    """part, runs: of each range the first run, the run of the last group's shared conversation, and the last run."""
    def run(batches):
        part, runs = None, {}

        def told():
            kept = [runs["first"]] + [r for k in ("anchor", "last") if (r := runs.get(k)) and r is not runs["first"]]
            kept = [r for k, r in enumerate(kept) if all(r is not x for x in kept[:k])]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([json.dumps(kept)])], ["part", "runs"])

        for b in batches:
            for p, anchor, conv, digest, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if runs:
                        yield told()
                    part, runs = p, {}
                now = runs.get("last")
                if now is None or now["conv"] != conv:
                    now = {"conv": conv, "anchor": anchor, "n": 0, "node": 0, "heads": []}
                    runs["last"] = now
                    runs.setdefault("first", now)
                    if conv == anchor:
                        runs["anchor"] = now
                    elif runs.get("anchor", now)["anchor"] != anchor:
                        del runs["anchor"]
                value = int.from_bytes(digest, "big")
                now["n"] += 1
                now["node"] = (now["node"] * BASE + value) % PRIME
                if len(now["heads"]) < HEADS:
                    now["heads"].append((value, size))
        if runs:
            yield told()

    return rows.select("part", "anchor", "conv_id", "digest", "size").mapInArrow(run, "part int, runs string")


def _carried(summaries: list) -> dict:
    """range -> (state at its start, rows of the conversations at its ends), from the summaries in order."""
    state, total, carried = State(), {}, {}
    told = sorted((r["part"], json.loads(r["runs"])) for r in summaries)
    for part, runs in told:
        carried[part] = state.json()
        for r in runs:
            state.run(r)
        for r in runs:
            total[r["conv"]] = total.get(r["conv"], 0) + r["n"]
    return {part: (carried[part], {r["conv"]: total[r["conv"]] for r in runs}) for part, runs in told}


def members(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, size, len: a row per rebuilt conversation and depth, the root (depth 0) included."""
    prepare(conversations.sparkSession)
    dealt = turns_of(conversations).repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "trie-turns")
    rows = dealt.repartition("part").sortWithinPartitions("part", *ORDER)
    carried = _carried(_summaries(rows).collect())                # one row per range
    names = ["conv_id", "depth", "node", "parent", "size", "len"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        part, state, totals, out, held = None, None, {}, [], []

        def rebuilt(rows: list, total: int):
            """Rows of the conversation at hand, in order: its first ones, or all."""
            shared = state.shared()
            heads = state.heads[:shared]
            length = len(heads) + max(total - shared, 0)
            conv, own = state.conv, state.conv == state.anchor
            if not state.n:
                at, before = 0, None
                out.append((conv, 0, _key(0), None, 0, length))
                for d, (value, size) in enumerate(heads, 1):
                    before, at = at, (at * BASE + value) % PRIME
                    out.append((conv, d, _key(at), _key(before), size, length))
            for digest, size in rows:
                state.n += 1
                value = int.from_bytes(digest, "big")
                if own and len(state.heads) < HEADS:
                    state.heads.append((value, size))
                if state.n > shared:
                    before, state.node = state.node, (state.node * BASE + value) % PRIME
                    out.append((conv, len(heads) * (not own) + state.n - shared, _key(state.node), _key(before), size, length))

        def batch():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for p, anchor, conv, digest, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part or conv != state.conv:
                    if held:
                        rebuilt(held, totals.get(state.conv, len(held)))
                        held = []
                    if p != part:
                        part = p
                        start, totals = carried[p]
                        state = State(*start)
                    state.start(anchor, conv)
                held.append((digest, size))
                if conv in totals and len(held) >= 4096:          # at a range's end: it may be long, its total is known
                    rebuilt(held, totals[conv])
                    held = []
                if len(out) >= 20_000:
                    yield batch()
        if held:
            rebuilt(held, totals.get(state.conv, len(held)))
        if out:
            yield batch()

    return rows.select("part", "anchor", "conv_id", "digest", "size").mapInArrow(
        run, "conv_id bigint, depth bigint, node binary, parent binary, size bigint, len bigint")


def _key(node: int) -> bytes:
    return node.to_bytes(16, "big")


def split_forest(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of ``values`` (columns) by centroid decomposition of a whole forest.

    ``parent`` holds indices of earlier rows (-1 for a top), ``weight`` the weight of each subtree.
    """
    n = len(parent)
    par, size = parent.tolist(), [1] * n
    for i in range(n - 1, -1, -1):
        if par[i] >= 0:
            size[par[i]] += size[i]
    pre, free, tops = [0] * n, [0] * n, 0
    for i, p in enumerate(par):                               # places in preorder: a subtree is an interval
        if p < 0:
            pre[i], tops = tops, tops + size[i]
        else:
            pre[i] = free[p]
            free[p] += size[i]
        free[i] = pre[i] + 1
    pre, end = np.array(pre), np.array(pre) + np.array(size)
    weight, total = weight.copy(), np.zeros_like(values)
    live = np.argsort(pre)
    label = np.cumsum(parent[live] < 0)
    while len(live):
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(live)]))
        whole = np.maximum.reduceat(weight[live], first)
        light = np.where(2 * weight[live] > whole[of], weight[live], np.iinfo(np.int64).max)
        z = live[np.lexsort((light, of))[first]]              # the deepest of those with more than half
        zs = z[of]
        below = (pre[live] > pre[zs]) & (pre[live] < end[zs])
        path = (pre[live] < pre[zs]) & (end[live] > pre[zs])
        held = np.where((below | (live == zs))[:, None], values[live], 0)
        sums = np.add.reduceat(held, first, axis=0)
        total[z] += sums
        total[live[path]] += sums[of[path]]
        weight[live[path]] -= weight[zs[path]]
        child = below & (parent[live] == zs)
        part = np.where(below, len(first) + np.cumsum(child), of)
        stay = live != zs
        order = np.lexsort((pre[live[stay]], part[stay]))
        live, label = live[stay][order], part[stay][order]
    return total


def _local(settled: DataFrame) -> DataFrame:
    """node, leaves, saved: totals within components that are whole in one task, many at a time."""
    names = ["node", "leaves", "saved"]

    def solve(rows):
        place = {r[0]: k for k, r in enumerate(rows)}
        parent = np.array([-1 if r[0] == r[2] else place[r[1]] for r in rows], np.int64)
        total = split_forest(parent, np.array([r[3] for r in rows], np.int64), np.array([r[4:] for r in rows], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(total[:, 0]), pa.array(total[:, 1])], names)

    def run(batches):
        rows = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(rows) >= ROWS and r[2] != rows[-1][2]:
                    yield solve(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield solve(rows)

    dealt = settled.repartition("top").sortWithinPartitions("top", "depth")
    return dealt.select("node", "parent", "top", "weight", "leaves", "saved").mapInArrow(run, "node binary, leaves bigint, saved bigint")


def rollup(forest: DataFrame, rows: DataFrame, local: int = LOCAL) -> DataFrame:
    """node, leaves, saved summed over the subtree of each node.

    ``forest``: node, parent, conv (its smallest member), depth, weight, leaves, saved; ``rows``: the members.
    """
    state = forest.select("node", "parent", "conv", "depth", "weight", "leaves", "saved",
                          F.lit(_key(0)).alias("top"), F.lit(0).cast("bigint").alias("top_depth"))
    added = []
    while True:
        tops = state.groupBy("top", "top_depth").agg(F.max("weight").alias("whole"), F.count("*").alias("n"))
        # components are disjoint, so at most (weight of the forest) / local of them are heavy
        heavy = materialise(tops.where((F.col("whole") > local) & (F.col("n") > 1)).select("top", "top_depth", "whole"), "trie-heavy")
        added.append(("settled", state.join(F.broadcast(heavy.select("top")), "top", "left_anti")))
        if heavy.isEmpty():
            break
        big = state.join(F.broadcast(heavy.select("top", "whole")), "top")
        z = (big.where("2 * weight > whole").groupBy("top", "top_depth")
             .agg(F.min_by(F.struct("node", "conv", "depth", "weight"), "weight").alias("z")))
        z = materialise(z.select("top", F.col("top_depth").alias("z_top_depth"), F.col("z.node").alias("z_node"), F.col("z.conv").alias("z_conv"),
                                 F.col("z.depth").alias("z_depth"), F.col("z.weight").alias("z_weight")), "trie-centroids")
        few = F.broadcast(z)
        path = (rows.join(few, (F.col("conv_id") == F.col("z_conv")) & (F.col("depth") >= F.col("z_top_depth")) & (F.col("depth") < F.col("z_depth")))
                .select(F.col("node").alias("p_node"), F.col("top").alias("p_top"), F.col("z_weight").alias("p_weight")))
        path = materialise(path, "trie-paths")
        blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("len") / BLOCK)))
        below = (rows.join(few, F.col("parent") == F.col("z_node"))
                 .select(F.col("top").alias("b_top"), F.col("conv_id").alias("b_conv"), F.col("node").alias("b_node"), blocks.alias("b_block")))
        moved = (big.join(few, "top")
                 .join(path.drop("p_top"), F.col("node") == F.col("p_node"), "left")
                 .join(below, (F.col("top") == F.col("b_top")) & (F.col("conv") == F.col("b_conv")) & (F.col("depth") > F.col("z_depth"))
                       & (F.floor(F.col("depth") / BLOCK) == F.col("b_block")), "left"))
        moved = materialise(moved.select(
            "node", "parent", "conv", "depth", (F.col("weight") - F.coalesce("p_weight", F.lit(0))).alias("weight"), "leaves", "saved",
            F.coalesce("b_node", "top").alias("top"), F.when(F.col("b_node").isNotNull(), F.col("z_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            F.col("top").alias("old"), (F.col("node") == F.col("z_node")).alias("is_z"), F.col("b_node").isNotNull().alias("is_below")), "trie-split")
        sums = (moved.where("is_z OR is_below").groupBy("old").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        sums = materialise(sums, "trie-sums")
        at = z.select(F.col("z_node").alias("node"), F.col("top").alias("p_top")).unionByName(path.select(F.col("p_node").alias("node"), "p_top"))
        added.append(("path", at.join(F.broadcast(sums), F.col("p_top") == F.col("old")).select("node", "leaves", "saved")))
        state = moved.where("NOT is_z").drop("old", "is_z", "is_below")
    settled = [x for kind, x in added if kind == "settled"]
    found = [x for kind, x in added if kind == "path"]
    whole = settled[0]
    for x in settled[1:]:
        whole = whole.unionByName(x)
    out = _local(whole)
    for x in found:
        out = out.unionByName(x)
    return out.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def end_hashes(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 for rows (node, conv_id): the ids in ascending order, comma-joined, hashed."""
    def pieces(batches):
        at, ids, size = None, [], 0

        def told():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
                                              ["node", "first", "ids"])

        for b in batches:
            for node, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (node != at or size > PIECE):
                    yield told()
                    ids, size = [], 0
                at = node
                ids.append(conv)
                size += 20
        if ids:
            yield told()

    def hashes(batches):
        at, sha = None, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

        for b in batches:
            for node, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node != at:
                    if sha:
                        yield told()
                    at, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            yield told()

    sorted_ids = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = sorted_ids.mapInArrow(pieces, "node binary, first bigint, ids string")
    dealt = joined.repartition("node").sortWithinPartitions("node", "first")
    return dealt.select("node", "ids").mapInArrow(hashes, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialise(members(conversations), "trie-members")
    nodes = materialise(rows.groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("parent").alias("parent"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight")), "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, F.col("node") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0))),
                        "trie-families")
    forest = nodes.select("node", "parent", "conv", "depth", "weight", (F.col("n_children") == 0).cast("bigint").alias("leaves"),
                          ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    totals = rollup(forest, rows, local)

    many = max(MANY_CHILDREN, nodes.count() // 10_000)            # parents with more children: fewer than 10,000
    named = nodes.select(F.col("node").alias("p_node"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("p_children"))
    crowded = named.where(F.col("p_children") > many).select("p_node", "parent_conv_id")
    child = nodes.join(F.broadcast(crowded), F.col("parent") == F.col("p_node"), "left")
    near = child.where("p_node IS NOT NULL OR parent IS NULL")
    far = child.where("p_node IS NULL AND parent IS NOT NULL").drop("p_node", "parent_conv_id").join(
        named.where(F.col("p_children") <= many).drop("p_children"), F.col("parent") == F.col("p_node"))
    out = near.unionByName(far)
    ends = end_hashes(rows.where("len = depth"))
    return (out.join(totals, "node").join(ends, "node", "left")
            .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


SQL = r"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 head AS (SELECT conv_id, conv_id - conv_id % 5 AS anchor, xor(CAST(4294967295 AS UBIGINT), list_reduce(
            list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS UBIGINT[])),
                                     lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, CAST(3988292384 AS UBIGINT)) ELSE y // 2 END))) % 9 AS h
          FROM (SELECT DISTINCT conv_id FROM own)),
 turns AS (SELECT head.conv_id, 0 AS late, own.i, own.role, own.text FROM head JOIN own ON own.conv_id = head.anchor AND own.i <= head.h
           UNION ALL SELECT conv_id, 1, i, role, text FROM head JOIN own USING (conv_id) WHERE i > h),
 placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY late, i) AS depth, text,
                   sha256(octet_length(encode(role)) || ':' || role || text) AS turn FROM turns),
 path AS (SELECT conv_id, depth, octet_length(encode(text)) AS size,
                 sha256(string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
          UNION ALL SELECT conv_id, 0, 0, '' FROM head),
 row_of AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
                   lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM path),
 node AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
          FROM row_of GROUP BY node, depth),
 kids AS (SELECT parent AS node, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
 below AS (SELECT r.node, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved_tokens
           FROM node u LEFT JOIN kids USING (node) JOIN path r ON r.conv_id = u.conv_id AND r.depth <= u.depth GROUP BY r.node)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM node v LEFT JOIN node p ON p.node = v.parent LEFT JOIN kids ON kids.node = v.node JOIN below ON below.node = v.node
"""

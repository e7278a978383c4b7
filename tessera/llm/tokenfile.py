"""Token-ID output: binary files of range-coded id blocks.

Documents are put in ascending ``doc_id`` order by a range shuffle, encoded,
closed with ``END`` and cut, file by file, into blocks of ``BLOCK`` ids.  A file (one
part of a Parquet folder, so that a lost task's file is written again and never
half seen) has a row per block: its number, the coded bytes (see
``rangecoder``: magic, counts, checksums, words), and which documents lie in
it - their ids, how many ids of each, and the first one's number in the file.

Every block is decoded on its own; a document that spans blocks is put together
from its pieces, whose checksums are combined in order.  File totals, one number per file,
give each file's first position.

Defined results: null and empty texts hold the end id only; repeated rows and
equal doc_ids are separate documents, ordered by a hash of the text; null ids come first; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.session import scratch_path

from . import rangecoder, tokens
from .common import prepare

END = 2
BLOCK = 1024
#: Blocks coded or decoded in step: a file of usual text in two rounds, each of about 80 MB in the worker.
LANES = 6144
#: Bytes of text per file: enough blocks to code many in step.
FILE_BYTES = 32 << 20


def write_ids(docs: DataFrame, path: str, vocabulary: str = tokens.VOCABULARY, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of ``docs`` (doc_id, text) under ``path``, in files of about ``file_bytes`` of text."""
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // file_bytes))
    end = np.array([END], "<u2").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = tokens.ids(vocabulary)
        raw, size = [], 0                                   # ids not yet in a block
        docs_, lens = [], []                                # documents in ``raw``: id, ids left (copies: a slice would hold its batch of texts)
        block, number = 0, 0                                # of the file's next block and its first document

        def cut(last):
            nonlocal raw, size, docs_, lens, block, number
            ids, raw = np.frombuffer(b"".join(raw), "<u2"), []
            n = len(ids) if last else len(ids) // BLOCK * BLOCK
            parts = [ids[k:k + BLOCK] for k in range(0, n, BLOCK)]
            rows, k = [], 0
            for part in parts:
                room, own_docs, own_lens, first = len(part), [], [], number
                while room:
                    take = min(room, lens[k])
                    own_docs.append(docs_[k])
                    own_lens.append(take)
                    room -= take
                    lens[k] -= take
                    if not lens[k]:
                        k += 1
                        number += 1
                rows.append((block, own_docs, own_lens, first))
                block += 1
            raw, size, docs_, lens = [ids[n:].tobytes()], len(ids) - n, docs_[k:], lens[k:]
            coded = rangecoder.encode(parts)
            flat = pa.concat_arrays([d for r in rows for d in r[1]]) if rows else None
            offsets = pa.array(np.cumsum([0] + [len(r[1]) for r in rows]), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(coded, pa.binary()), pa.ListArray.from_arrays(offsets, flat),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.int64())],
                ["block", "coded", "docs", "lens", "number"])

        for b in batches:
            own = b.column(0).take(pa.array(range(b.num_rows), pa.int32()))
            for k, text in enumerate(b.column(1).to_pylist()):
                got = encode(text or "") + end
                raw.append(got)
                size += len(got) // 2
                docs_.append(own.slice(k, 1))
                lens.append(len(got) // 2)
                if size >= LANES * BLOCK:
                    yield cut(False)
        encode.forget()
        if size:
            yield cut(True)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text")
    (rows.repartitionByRange(files, "doc_id", key).sortWithinPartitions("doc_id", key)
     .mapInArrow(run, f"block bigint, coded binary, docs array<{kind}>, lens array<bigint>, number bigint")
     .withColumn("file", F.spark_partition_id())
     .write.option("compression", "none").parquet(path))


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, number (of the document in its file), at (ids of the file before), n, crc, doc_id: pieces of documents, decoded."""
    prepare(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    names = ["file", "number", "at", "n", "crc", "doc_id"]

    def run(batches):
        for b in _lanes(batches):
            out = []
            rows = zip(*(b.column(c).to_pylist() for c in ("file", "block", "number", "lens")), rangecoder.decode(b.column("coded").to_pylist()), strict=True)
            for file, block, number, lens, ids in rows:
                raw, at = ids.astype("<u4").tobytes(), 0
                for k, n in enumerate(lens):
                    out.append((file, number + k, block * BLOCK + at, n, zlib.crc32(raw[4 * at:4 * (at + n)])))
                    at += n
            kinds = (pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                                             + [b.column("docs").flatten()], names)

    return blocks.select("file", "block", "number", "coded", "docs", "lens").mapInArrow(
        run, f"file int, number bigint, at bigint, n bigint, crc bigint, doc_id {kind}")


def _lanes(batches):
    """Batches of about ``LANES`` rows."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= LANES:
            whole, held, rows = pa.concat_batches(held), [], 0
            yield whole
    if rows:
        yield pa.concat_batches(held)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of the pieces with these (crc32, bytes) put together: crc32 is linear, zeros carry the first one on."""
    total = 0
    for crc, size in parts:
        while size > 0:
            step = min(size, 1 << 20)
            zeros = bytes(step)
            total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros)
            size -= step
        total ^= crc
    return total


@F.pandas_udf(LongType())
def _joined(parts: pd.Series) -> pd.Series:
    return parts.map(lambda rows: joined_crc([(r["crc"], 4 * r["n"]) for r in rows]))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``path``."""
    sizes = spark.read.parquet(path).select("file", F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    first, rows = 0, []
    for r in sizes.groupBy("file").agg(F.sum("n").alias("n")).orderBy("file").collect():      # one row per file
        rows.append((r["file"], first))
        first += r["n"]
    starts = spark.createDataFrame(rows, "of int, first bigint")
    whole = read_pieces(spark, path).groupBy("file", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    return whole.join(F.broadcast(starts), F.col("file") == F.col("of")).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", _joined("parts").alias("ids_crc32"))


def encode_and_read(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary)
    return read_ids(docs.sparkSession, path)

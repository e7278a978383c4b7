"""Text quality by a factorisation machine.

A document's features are its hashed words (``BUCKETS`` buckets, log counts scaled to length 1), one bin for
each of its structure statistics, and one bin for its declared length (``n_chars``, the only metadata used).  The machine
adds a weight per feature and, for every pair of features, the inner product of
their ``RANK`` factors; by the identity

    sum over i<j of <v_i, v_j> x_i x_j  =  1/2 * sum over f of ((sum v_if x_i)^2 - sum (v_if x_i)^2)

a document is scored in time linear in its features.  The score is the logistic of the sum.

Weights and factors are fitted by AdaGrad on labelled documents outside the held-out fold, at most
``TRAIN_ROWS`` of them (those with the smallest hashes of their ids), both classes weighing alike.
Labels, lang, source and doc_id are no features.  Bins lie between the training sample's quantiles.
Every text is read whole, in pieces of about ``PIECE`` bytes.

Defined results: null and empty texts have no words and are scored by their other bins; a null or absent n_chars has a bin
of its own; null labels, and labels without a document, are not learned from; of repeated labels each
counts; repeated rows are scored alike; without labelled rows of both classes every score is the share
of the class (1/2 without any); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

FOLDS, HELD_OUT = 5, 0        # documents whose crc32(id) mod FOLDS is HELD_OUT are held out
CUTOFF = 0.3
TRAIN_ROWS = 12_000
BUCKETS = 1 << 14
RANK = 8
BINS = 16
EPOCHS, BATCH, RATE, RIDGE = 12, 64, 0.1, 1e-4
PIECE = 1 << 20

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?"
LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")
SPACE = re.compile(rb"[\x20\x09-\x0d]")
STATISTICS = ("words", "bytes a word", "distinct words", "upper case", "digits", "symbols", "stops", "exclamations",
              "words without letters", "commonest word", "lines", "words a line", "repeated lines")
LENGTHS = 48                  # bins of n_chars by powers of two; the last is for null
SIZE = BUCKETS + BINS * len(STATISTICS) + LENGTHS


def held_out(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_counts(text: bytes, piece: int = PIECE) -> Counter:
    """Occurrences of the words (split on ASCII white space, A-Z lower-cased) of a whole text."""
    found, start = Counter(), 0
    while start < len(text):
        cut = SPACE.search(text, start + piece) if start + piece < len(text) else None
        end = cut.start() if cut else len(text)
        found.update(text[start:end].lower().split())
        start = end
    return found


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of a text's words, and its structure statistics."""
    found = word_counts(text)
    n, size = sum(found.values()), max(len(text), 1)
    buckets = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % BUCKETS
    counts = np.fromiter(found.values(), np.float64, len(found))
    values = np.log1p(counts)
    values /= max(np.sqrt((values ** 2).sum()), 1e-9)
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    bare = sum(c for w, c in found.items() if not LETTERS.search(w))
    top = counts.max() if len(counts) else 0.0
    words = max(n, 1)
    stats = np.array([np.log2(1 + n), sum(len(w) * c for w, c in found.items()) / words, len(found) / words,
                      share(UPPER) / max(share(UPPER + LOWER), 1 / size), share(DIGITS), share(SYMBOLS), share(STOPS), share(b"!"),
                      bare / words, top / words, np.log2(1 + len(lines)), n / max(len(lines), 1),
                      1 - len(set(lines)) / max(len(lines), 1)])
    return buckets.astype("<u2"), values.astype("<f4"), stats


def length_bin(n_chars: int | None) -> int:
    return LENGTHS - 1 if n_chars is None else min(int(max(n_chars, 0)).bit_length(), LENGTHS - 2)


@dataclass(frozen=True)
class Model:
    """bias; weight and factors per feature; edges of each statistic's bins."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    edges: tuple

    def places(self, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of all features of a document."""
        bins = [BUCKETS + BINS * k + int(np.searchsorted(e, v)) for k, (e, v) in enumerate(zip(self.edges, stats, strict=True))]
        more = np.array([*bins, BUCKETS + BINS * len(STATISTICS) + length], np.int64)
        return np.concatenate([buckets.astype(np.int64), more]), np.concatenate([values, np.full(len(more), len(more) ** -0.5, np.float32)])

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        return float(self.bias + self.weights[at] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx ** 2).sum()))

    def score(self, text: bytes, n_chars: int | None) -> float:
        z = self.margin(*self.places(*features(text), length_bin(n_chars)))
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def constant(share: float) -> Model:
    """Every score is ``share``."""
    z = float(np.log(share / (1 - share)))
    return Model(z, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32), ((),) * len(STATISTICS))


def fit(rows: list[tuple], epochs: int = EPOCHS, rank: int = RANK, seed: int = 1) -> Model:
    """The machine for rows of (label, buckets, values, statistics, length bin)."""
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return constant((y.sum() + 1) / (len(y) + 2) if len(y) else 0.5)
    stats = np.array([r[3] for r in rows])
    edges = tuple(np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in stats.T)
    draw = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE), draw.normal(0, 0.05, (SIZE, rank)), edges)
    placed = [model.places(*r[1:]) for r in rows]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, v, bias = model.weights, model.factors, 0.0
    gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for k in range(0, len(order), BATCH):
            part = order[k:k + BATCH]
            at = np.concatenate([placed[i][0] for i in part])
            x = np.concatenate([placed[i][1] for i in part]).astype(np.float64)
            sizes = np.array([len(placed[i][0]) for i in part])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            vx = v[at] * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = bias + np.add.reduceat(w[at] * x, starts) + 0.5 * ((total ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), starts))
            slope = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            each = np.repeat(slope, sizes) * x
            used, where = np.unique(at, return_inverse=True)
            dw = np.bincount(where, each, len(used)) + RIDGE * w[used]
            pull = each[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(rank)], axis=1) + RIDGE * v[used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            gb += slope.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            bias -= RATE * slope.sum() / np.sqrt(gb)
    return Model(float(bias), w.astype(np.float32), v.astype(np.float32), edges)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The machine fitted to labelled documents outside the held-out fold."""
    prepare(docs.sparkSession)
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
              .select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
              .orderBy("h", "l_id").limit(train_rows).select("l_id", "label"))
    rows = _rows(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))        # train_rows pairs at most

    def run(batches):
        for b in batches:
            found = [features(t.as_py()) for t in b.column(1)]
            lengths = [length_bin(n) for n in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary()),
                 pa.array([f[2].tolist() for f in found], pa.list_(pa.float64())), pa.array(lengths, pa.int32())],
                ["label", "buckets", "word_values", "stats", "length"])

    sample = rows.select("label", "text", "n_chars").mapInArrow(
        run, "label int, buckets binary, word_values binary, stats array<double>, length int")
    found = materialise(sample, "factorisation-training").collect()
    found.sort(key=lambda r: (r["label"], bytes(r["buckets"]), bytes(r["word_values"]), r["length"]))
    return fit([(int(r["label"] > 0), np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["word_values"], "<f4"), r["stats"], r["length"])
                for r in found])


def _rows(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), length.alias("n_chars"))


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= ``CUTOFF``) for every row of ``docs`` (doc_id, text, n_chars)."""
    prepare(docs.sparkSession)
    model = model or train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            scores = [model.score(t.as_py(), n) for t, n in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = _rows(docs).select("doc_id", held_out().alias("held_out"), "text", "n_chars")
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))

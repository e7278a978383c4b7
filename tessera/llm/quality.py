"""Quality rules: base rules, then robust multivariate outliers per language and source.

Each document gets counts (words, characters in words, symbols, repeated lines,
words in repeated three-word windows).  Documents under ``MIN_WORDS`` words or with more than half
of their words repeated fail the base rules.  The others become a vector of five transformed
statistics, and each (language, source) group gets a minimum-covariance-determinant
estimate of centre and scatter; documents whose Mahalanobis distance exceeds
``CUTOFF`` are rejected.

The estimate is made by concentration steps over all rows, as Spark aggregates: from each of three
deterministic starts (medians with median deviations; means with covariances; medians with
sign correlations) keep the ``KEEP`` share of rows nearest to the
current estimate (their distance quantile is a mergeable sketch), take the mean
and covariance of those, and repeat, ``STEPS`` times in all; a step never raises the determinant.  Of the three the
one whose covariance has the least determinant is the estimate.  Every step is a map-side combined aggregate
per group, so a source with a third of all rows is summed in parts; no group's
rows ever meet in one task.  Groups under ``MIN_ROWS`` rows use the estimate of their
language, and if that is small too the one of the whole table; with fewer than that in
the whole table nothing is rejected beyond the base rules.

Scatter gets a floor per statistic (``FLOOR``): a statistic that is constant for most of a group,
such as "no symbols at all", must not make every other document an outlier.

Defined results: null text has no words (base_failed); null languages and sources are
groups of their own; repeated rows each count and get the same verdict; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import matching, materialise, prepare, same, text_bytes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP = 0.75
STEPS = 3
SHRINK = 0.9                   # of sign correlations
MIN_ROWS = 200
#: Squared robust distance above which a document is rejected.  Five normal statistics exceed 50 once in 10^9;
#: real statistics have longer tails, and a clean document must not go, hence twice that.
CUTOFF = 100.0
#: Least standard deviation of each transformed statistic.
FLOOR = (0.25, 0.25, 0.02, 0.35, 0.05)
CHI2_MEDIAN = 4.351            # of five degrees of freedom
SYMBOLS = re.compile(rb"[#*$%&|<>]")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = len(FLOOR)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a three-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    hit = count[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The counts named by ``COUNTS`` for one text."""
    words = text.split()
    body = b"".join(words)
    dup, seen = 0, set()
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    chars = len(body) - len(re.findall(rb"[\x80-\xBF]", body)) if not body.isascii() else len(body)
    symbols = sum(map(body.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return len(words), chars, symbols, dup, repeated_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), lang, source, the counts, base_failed."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = np.array([counts(t) for t in b.column(4).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(rows[:, i]) for i in range(len(COUNTS))],
                                             ["doc_id", "th", "lang", "source", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), text_bytes("text").alias("raw"))
    out = raw.mapInArrow(run, f"doc_id {kind}, th bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return out.withColumn("base_failed", F.expr(
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics x0..x4 of rows that passed the base rules."""
    return stats.where("NOT base_failed").select(
        "*", F.log("n_words").alias("x0"), F.log(F.try_divide("word_chars", "n_words")).alias("x1"),
        F.sqrt(F.try_divide("n_symbols", "word_chars")).alias("x2"), F.log1p("n_dup_lines").alias("x3"),
        F.try_divide("n_repeat_words", "n_words").alias("x4"))


def _levels(rows: DataFrame) -> DataFrame:
    """Each row once for its (language, source), its language and the whole table, as level and group."""
    group = F.array(*(F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit(None)).alias("g_lang"),
                               (F.col("source") if k < 1 else F.lit(None)).alias("g_source")) for k in range(3)))
    return rows.select(*(f"x{i}" for i in range(DIMS)), F.explode(group).alias("g")).select("g.*", *(f"x{i}" for i in range(DIMS)))


GROUP = ("level", "g_lang", "g_source")


def _with(rows: DataFrame, model: DataFrame) -> DataFrame:
    m = model.select(*(F.col(c).alias(f"m_{c}") for c in GROUP), *(c for c in model.columns if c not in GROUP))
    return rows.join(m, reduce(lambda a, b: a & b, (same(F.col(c), F.col(f"m_{c}")) for c in GROUP))).drop(*(f"m_{c}" for c in GROUP))


def _distance():
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(DIMS)]
    return reduce(lambda a, b: a + b, (d[i] * d[j] * F.col("inverse")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)))


SHAPE = StructType([StructField("inverse", ArrayType(DoubleType())), StructField("logdet", DoubleType())])


@F.pandas_udf(SHAPE)
def _shape(cov: pd.Series) -> pd.DataFrame:
    """Inverse and log determinant of scatter matrices (with the floor added)."""
    floor = np.diag(np.square(FLOOR))
    made = [np.asarray(c, float).reshape(DIMS, DIMS) + floor for c in cov]
    return pd.DataFrame({"inverse": [np.linalg.inv(m).ravel() for m in made], "logdet": [float(np.linalg.slogdet(m)[1]) for m in made]})


def _starts(rows: DataFrame) -> DataFrame:
    """level, g_lang, g_source, start, rows, centre, cov: the three starts of every group.

    0: medians and median deviations; 1: means and covariances; 2: medians, median deviations and the signs'
    correlations (sin of half pi times the mean product of signs), shrunk to a definite matrix.
    """
    xs = [f"x{i}" for i in range(DIMS)]
    pairs = [(i, j) for i in range(DIMS) for j in range(DIMS)]
    first = rows.groupBy(*GROUP).agg(F.count("*").alias("rows"), F.array(*(F.percentile_approx(x, 0.5) for x in xs)).alias("median"),
                                     F.array(*(F.avg(x) for x in xs)).alias("mean"), F.array(*(F.covar_pop(xs[i], xs[j]) for i, j in pairs)).alias("cov"))
    sign = [F.signum(F.col(x) - F.col("median")[i]) for i, x in enumerate(xs)]
    dev = _with(rows, first).groupBy(*GROUP, "rows", "median", "mean", "cov").agg(
        F.array(*(F.percentile_approx(F.abs(F.col(x) - F.col("median")[i]), 0.5) for i, x in enumerate(xs))).alias("mad"),
        F.array(*(F.avg(sign[i] * sign[j]) for i, j in pairs)).alias("signs"))
    scale = [F.col("mad")[i] * 1.4826 for i in range(DIMS)]
    plain = F.array(*(F.pow(scale[i], 2) if i == j else F.lit(0.0) for i, j in pairs))
    signed = F.array(*(F.pow(scale[i], 2) if i == j else SHRINK * scale[i] * scale[j] * F.sin(F.col("signs")[DIMS * i + j] * (np.pi / 2)) for i, j in pairs))
    made = F.array(*(F.struct(F.lit(k).alias("start"), c.alias("centre"), v.alias("cov"))
                     for k, (c, v) in enumerate(((F.col("median"), plain), (F.col("mean"), F.col("cov")), (F.col("median"), signed)))))
    return dev.select(*GROUP, "rows", F.explode(made).alias("s")).select(*GROUP, "s.start", "rows", "s.centre", "s.cov")


def fit(rows: DataFrame, keep: float = KEEP, steps: int = STEPS) -> DataFrame:
    """level, g_lang, g_source, rows, centre, inverse, scale: one robust estimate per group.

    Every start of a group is concentrated ``steps`` times; the one whose scatter then has the least
    determinant is the estimate.  All groups and starts go through each step together.
    """
    rows = materialise(_levels(rows), "quality-vectors")
    xs = [f"x{i}" for i in range(DIMS)]
    key = [*GROUP, "start", "rows"]
    flat = lambda f: F.array(*(f(xs[i], xs[j]) for i in range(DIMS) for j in range(DIMS)))

    def model_of(df: DataFrame) -> DataFrame:
        return materialise(df.withColumn("shape", _shape("cov")).select(*key, "centre", F.col("shape.inverse").alias("inverse"),
                                                                        F.col("shape.logdet").alias("logdet")), "quality-model")

    model = model_of(_starts(rows))
    for _ in range(steps):
        cut = _with(rows, model).groupBy(*key, "centre", "inverse").agg(F.percentile_approx(_distance(), keep).alias("cut"))
        near = _with(rows, cut).where(_distance() <= F.col("cut"))
        model = model_of(near.groupBy(*key).agg(F.array(*(F.avg(x) for x in xs)).alias("centre"), flat(F.covar_pop).alias("cov")))
    best = model.groupBy(*GROUP, "rows").agg(F.min_by(F.struct("centre", "inverse"), F.struct("logdet", "start")).alias("b"))
    best = materialise(best.select(*GROUP, "rows", "b.centre", "b.inverse"), "quality-model")
    half = _with(rows, best).groupBy(*GROUP, "rows", "centre", "inverse").agg(F.percentile_approx(_distance(), 0.5).alias("half"))
    # the half nearest to the centre makes the scatter too small: scale distances to the median they should have
    return materialise(half.select(*GROUP, "rows", "centre", "inverse",
                                   F.greatest(F.col("half") / CHI2_MEDIAN, F.lit(1.0)).alias("scale")), "quality-model")


def quality(docs: DataFrame, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): th, the counts, base_failed, kept, distance (squared)."""
    stats = materialise(statistics(docs), "quality-stats")
    rows = vectors(stats)
    model = fit(rows).where(F.col("rows") >= min_rows)
    joined = stats
    for k in range(3):
        m = model.where(F.col("level") == k).select(
            F.col("g_lang").alias(f"l{k}"), F.col("g_source").alias(f"s{k}"), F.struct("centre", "inverse", "scale").alias(f"model{k}"))
        on = [same(F.col("lang"), F.col(f"l{k}"))] * (k < 2) + [same(F.col("source"), F.col(f"s{k}"))] * (k < 1)
        joined = joined.join(m, reduce(lambda a, b: a & b, on), "left") if on else joined.join(F.broadcast(m), F.lit(True), "left")
    best = F.coalesce(*(F.col(f"model{k}") for k in range(3)))
    base = joined.select(*stats.columns, best.alias("model"))
    vec = base.select("*", F.log("n_words").alias("x0"), F.log(F.try_divide("word_chars", "n_words")).alias("x1"),
                      F.sqrt(F.try_divide("n_symbols", "word_chars")).alias("x2"), F.log1p("n_dup_lines").alias("x3"),
                      F.try_divide("n_repeat_words", "n_words").alias("x4"),
                      F.col("model.centre").alias("centre"), F.col("model.inverse").alias("inverse"))
    distance = F.when(~F.col("base_failed"), _distance() / F.col("model.scale"))
    return vec.select(*stats.columns, distance.alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    kept = quality(docs).where("kept").select("doc_id", "th", "lang", "source")
    return matching(docs, kept, [docs["doc_id"], F.xxhash64(docs["text"]), docs["lang"].cast("string"), docs["source"].cast("string")])

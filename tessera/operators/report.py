"""Report tables (rows D10, K1-K7).

Recommendations, the metric summary and display bands are projections of the
one-row-per-dataset scores table; lists are built as arrays and exploded, so
they stay distributed however many datasets there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import DATASET
from .score import color_band

# ---------------------------------------------------------------------------
# FIXED VALUES -- recommendation texts (levels and wording).
# ---------------------------------------------------------------------------
REC_HIGH = ("CRITICAL", "Mask/remove {n} HIGH-confidence PII instance(s) immediately.")
REC_MEDIUM = ("WARNING", "Review {n} MEDIUM-confidence PII finding(s).")
REC_LOW = ("INFO", "{n} LOW-confidence finding(s) — likely false positives.")
REC_QUALITY = ("WARNING", "Fix {n} quality rule failure(s).")
REC_DUPS = ("WARNING", "Deduplicate {n} exact row(s).")
REC_PACK = ("WARNING", "{n} business logic check(s) failed in the {pack} pack.")
REC_DRIFT = ("CRITICAL", "Schema drift — review newly added sensitive columns.")
REC_AUTOMATE = ("INFO", "Automate scanning on every file upload.")
REC_HEALTHY = ("OK", "Data is healthy. Automate monitoring to maintain this score.")
# ---------------------------------------------------------------------------


def _rec(cond, level_text, n=None, pack=None):
    level, text = level_text
    parts = []
    rest = text
    for token, val in (("{n}", n), ("{pack}", pack)):
        if token in rest:
            head, rest2 = rest.split(token, 1)
            parts.append(F.lit(head))
            parts.append(val.cast("string") if not isinstance(val, str) else F.lit(val))
            rest = rest2
    parts.append(F.lit(rest))
    msg = F.concat(*parts) if len(parts) > 1 else F.lit(text)
    return F.when(cond, F.struct(F.lit(level).alias("level"), msg.alias("message")))


def recommendations(scores: DataFrame, pack_name: str | None = None) -> DataFrame:
    """K1: ordered (level, message) list per dataset; "healthy" when nothing applies.

    Needs scores with pii_high/medium/low, failed, exact_duplicates, overall and
    optionally pack_failed / drift_alerts.
    """
    c = F.col
    pf = c("pack_failed") if "pack_failed" in scores.columns else F.lit(0)
    da = c("drift_alerts") if "drift_alerts" in scores.columns else F.lit(0)
    recs = [_rec(c("pii_high") > 0, REC_HIGH, c("pii_high")),
            _rec(c("pii_medium") > 0, REC_MEDIUM, c("pii_medium")),
            _rec(c("pii_low") > 0, REC_LOW, c("pii_low")),
            _rec(c("failed") > 0, REC_QUALITY, c("failed")),
            _rec(c("exact_duplicates") > 0, REC_DUPS, c("exact_duplicates"))]
    if pack_name:
        recs.append(_rec(pf > 0, REC_PACK, pf, pack_name))
    recs += [_rec(da > 0, REC_DRIFT), _rec(c("overall") < 70, REC_AUTOMATE)]
    arr = F.filter(F.array(*recs), lambda x: x.isNotNull())
    healthy = F.array(F.struct(F.lit(REC_HEALTHY[0]).alias("level"), F.lit(REC_HEALTHY[1]).alias("message")))
    arr = F.when(F.size(arr) > 0, arr).otherwise(healthy)
    return (scores.select(DATASET, F.posexplode(arr).alias("pos", "r"))
            .select(DATASET, (F.col("pos") + 1).cast("int").alias("position"), "r.level", "r.message"))


def summary_table(scores: DataFrame) -> DataFrame:
    """K2: metric / value rows (8 per dataset) from the scores row."""
    metrics = [("Overall score", "overall"), ("Privacy", "privacy"), ("Quality", "quality"),
               ("Completeness", "completeness"), ("HIGH PII", "pii_high"), ("MEDIUM PII", "pii_medium"),
               ("Quality failures", "failed"), ("Exact duplicates", "exact_duplicates")]
    s = scores.select(DATASET, *[F.col(c).cast("string").alias(m) for m, c in metrics])
    return s.unpivot([DATASET], [m for m, _ in metrics], "metric", "value")


def duplicate_band(scores: DataFrame) -> DataFrame:
    """K7: colour band of ``100 - 5 x duplicate_pct`` (floored at 0)."""
    return scores.select(DATASET, "duplicate_pct",
                         color_band(F.greatest(F.lit(0.0), 100.0 - F.col("duplicate_pct") * 5.0)).alias("band"))


def preview(df: DataFrame, n: int = 50, order: str | None = None) -> DataFrame:
    """K5: data preview (a row limit is the feature here).

    With ``order`` (``read_order`` of ``read_ordered``) the first ``n`` rows of every dataset in that order, the
    same ones under any partitioning; each task keeps its own first ``n`` before the shuffle.
    """
    if order is None:
        return df.limit(n)
    w = Window.partitionBy(DATASET).orderBy(order)
    return df.withColumn("row", F.row_number().over(w)).where(F.col("row") <= n).drop(order)

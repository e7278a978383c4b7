"""Health scores, one row per dataset (rows I1-I6, K6).

Inputs are the small per-dataset aggregates of the other operators; they are
joined on ``dataset`` (one row per dataset on every side).  Arithmetic follows
the original order of operations in doubles, and ``int()`` truncation is a
cast to int.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import profiles as P
from ..frame import DATASET


def privacy(actionable: Column, rows: Column) -> Column:
    """100 - int(density*50) - min(2n, 60), clamped to 0..100."""
    density = actionable.cast("double") / F.greatest(rows, F.lit(1)).cast("double")
    raw = F.lit(100) - (density * 50.0).cast("int") - F.least(actionable * 2, F.lit(60))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("int")


def quality_score(passed: Column, total: Column) -> Column:
    """int(passed/total*100); 100 when there are no checks."""
    return F.when(total > 0, (passed.cast("double") / total.cast("double") * 100.0).cast("int")).otherwise(100)


def completeness(dup_pct: Column) -> Column:
    """max(0, 100 - int(dup_pct*2))."""
    return F.greatest(F.lit(0), F.lit(100) - (dup_pct * 2.0).cast("int")).cast("int")


def overall(priv: Column, qual: Column, comp: Column, penalty: Column) -> Column:
    """int(.38P + .38Q + .18C) - penalty, clamped to 0..100."""
    s = (priv * 0.38 + qual * 0.38 + comp * 0.18).cast("int") - penalty
    return F.greatest(F.lit(0), F.least(F.lit(100), s)).cast("int")


def grade(score: Column) -> Column:
    """Letter grade with its label."""
    out = None
    for floor, label in P.GRADES:
        out = F.when(score >= floor, label) if out is None else out.when(score >= floor, label)
    return out.otherwise(P.GRADE_FLOOR)


def color_band(score: Column) -> Column:
    """J9 / K7 colour band of a score: 85 / 70 / 55 thresholds."""
    return (F.when(score >= 85, "green").when(score >= 70, "amber").when(score >= 55, "orange")
            .otherwise("red"))


def scores(shape: DataFrame, risk: DataFrame, quality_summary: DataFrame, dups: DataFrame,
           packs: DataFrame | None = None, with_penalty: bool = True) -> DataFrame:
    """I1-I6 per dataset.

    ``shape``: dataset, rows, columns; ``risk``: dataset, pii_high/medium/low;
    ``quality_summary``: dataset, total_checks, passed, failed; ``dups``:
    dataset, exact_duplicates, duplicate_pct (+ near_duplicates);
    ``packs``: dataset, pack_penalty.
    """
    j = (shape.join(risk, DATASET, "left").join(quality_summary, DATASET, "left")
         .join(dups.select(DATASET, "exact_duplicates", "near_duplicates", "duplicate_pct"), DATASET, "left"))
    if packs is not None and with_penalty:
        j = j.join(packs.select(DATASET, "pack_penalty"), DATASET, "left")
    else:
        j = j.withColumn("pack_penalty", F.lit(0))
    j = j.fillna(0, ["pii_high", "pii_medium", "pii_low", "total_checks", "passed", "failed",
                     "exact_duplicates", "near_duplicates", "pack_penalty"]).fillna(0.0, ["duplicate_pct"])
    act = F.col("pii_high") + F.col("pii_medium")
    return (j.withColumn("privacy", privacy(act, F.col("rows")))
            .withColumn("quality", quality_score(F.col("passed"), F.col("total_checks")))
            .withColumn("completeness", completeness(F.col("duplicate_pct")))
            .withColumn("pack_penalty", F.col("pack_penalty").cast("int"))
            .withColumn("overall", overall(F.col("privacy"), F.col("quality"), F.col("completeness"),
                                           F.col("pack_penalty")))
            .withColumn("grade", grade(F.col("overall"))))


def shape(df: DataFrame, key: str | None = None) -> DataFrame:
    """K6: rows and columns per dataset (columns = data columns, without dataset / key)."""
    n_cols = len([c for c in df.columns if c not in (DATASET, key)])
    return df.groupBy(DATASET).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(n_cols))


def should_alert(scores_df: DataFrame, threshold: int = 70) -> DataFrame:
    """Datasets scoring under ``threshold`` or with any HIGH finding."""
    return scores_df.where((F.col("overall") < threshold) | (F.col("pii_high") > 0))


def alerts(scores_df: DataFrame, threshold: int = 70) -> DataFrame:
    """K4: alert records (file, overall, grade, HIGH count, quality failures, exact duplicates)."""
    return should_alert(scores_df, threshold).select(
        DATASET, "overall", "grade", "pii_high", F.col("failed").alias("quality_failed"), "exact_duplicates")

"""Gold metrics table and trend analytics (rows A14, A15, J1-J13).

The gold table is append-only: one 15-column row per scan, and beside it mergeable
states per day, file and grade (counts, sums, first and last by time).  Totals
merge the states; the series are projections of the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import DATASET
from .score import color_band

GOLD_COLUMNS = ["timestamp", "filename", "trigger", "rows", "columns", "health_score", "grade",
                "privacy_score", "quality_score", "completeness_score", "high_pii", "medium_pii", "low_pii",
                "quality_failed", "duplicate_pct"]

# FIXED VALUES -- zone labels of the health-score series and trend arrows.
ZONES = [(85, "A — Healthy"), (70, "B — Acceptable")]
ZONE_FLOOR = "Needs attention"
TREND_UP, TREND_DOWN, TREND_FLAT = "↑ ", "↓ ", "→ stable"


def gold_rows(scores: DataFrame, scanned_at=None, trigger: str = "batch") -> DataFrame:
    """Project the 15 gold columns from a scores table (one row per dataset)."""
    ts = F.current_timestamp() if scanned_at is None else scanned_at
    return scores.select(
        ts.alias("timestamp"), F.col(DATASET).alias("filename"),
        (F.col("trigger") if "trigger" in scores.columns else F.lit(trigger)).alias("trigger"),
        F.col("rows").cast("bigint").alias("rows"), F.col("columns").cast("bigint").alias("columns"),
        F.col("overall").cast("int").alias("health_score"), "grade",
        F.col("privacy").cast("int").alias("privacy_score"), F.col("quality").cast("int").alias("quality_score"),
        F.col("completeness").cast("int").alias("completeness_score"),
        F.col("pii_high").cast("int").alias("high_pii"), F.col("pii_medium").cast("int").alias("medium_pii"),
        F.col("pii_low").cast("int").alias("low_pii"), F.col("failed").cast("int").alias("quality_failed"),
        F.col("duplicate_pct").cast("double").alias("duplicate_pct"))


def read_gold(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Gold source with a parsed timestamp, in order of time (CSV snapshots are accepted too)."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).orderBy("timestamp", "filename")


SUMS = {"scans": None, "sum_health": "health_score", "sum_quality": "quality_score", "HIGH": "high_pii",
        "MEDIUM": "medium_pii", "LOW": "low_pii"}
STATE_KEY = ["day", "filename", "grade"]


def day_states(gold: DataFrame) -> DataFrame:
    """Mergeable states per day, file and grade: counts, sums, the first and the last scan by time."""
    scan = F.struct("timestamp", "filename", "health_score")
    rows = gold.withColumn("day", F.to_date("timestamp"))
    return rows.groupBy(*STATE_KEY).agg(
        *[F.sum(F.col(c) if c else F.lit(1)).cast("bigint").alias(name) for name, c in SUMS.items()],
        F.min(scan).alias("first"), F.max(scan).alias("last"))


def merge_states(states: DataFrame, *by: str) -> DataFrame:
    """States merged over ``by`` (all of them to one row without it)."""
    return states.groupBy(*by).agg(*[F.sum(name).alias(name) for name in SUMS], F.min("first").alias("first"),
                                   F.max("last").alias("last"))


class GoldTable:
    """A14 + A15: the append-only gold table with its day states beside it.

    Every append writes its rows under ``<path>/batch_id=...`` and then their states under
    ``<path>_days/batch_id=...``; both replace what an earlier try of the same append left, and no append touches
    another's files.  Analytics merge the small states and read no scan again; rows whose append was
    lost between the two writes have their states computed when they are read.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, batch: "str | int | None" = None) -> None:
        part = f"batch_id={uuid.uuid4().hex if batch is None else batch}"
        rows.select(*GOLD_COLUMNS).write.mode("overwrite").parquet(f"{self.path}/{part}")
        own = self.spark.read.parquet(f"{self.path}/{part}")
        day_states(own).write.mode("overwrite").parquet(f"{self.path}_days/{part}")

    def rows(self) -> DataFrame:
        """All scans, in order of time."""
        return read_gold(self.spark, self.path).select(*GOLD_COLUMNS)

    def states(self) -> DataFrame:
        names = [*STATE_KEY, *SUMS, "first", "last"]
        saved = self.spark.read.parquet(f"{self.path}_days")
        rows = self.spark.read.parquet(self.path).withColumn("batch_id", F.col("batch_id").cast("string"))
        had = saved.select(F.col("batch_id").cast("string").alias("batch_id")).distinct()
        lost = rows.join(had, "batch_id", "left_anti")
        return saved.select(*names).unionByName(day_states(lost).select(*names))


def _states(gold: "DataFrame | GoldTable") -> DataFrame:
    return gold.states() if isinstance(gold, GoldTable) else day_states(gold)


def summary(gold: "DataFrame | GoldTable") -> DataFrame:
    """Total scans, averages (1 decimal), HIGH total, last score and trend, from the day states."""
    whole = merge_states(_states(gold))
    share = lambda c: F.bround(F.col(c) / F.col("scans"), 1)
    trend = F.when(F.col("scans") > 1, F.col("last.health_score") - F.col("first.health_score")).otherwise(0).cast("int")
    return (whole.select(F.coalesce("scans", F.lit(0)).alias("total_scans"), share("sum_health").alias("avg_health_score"),
                         F.col("HIGH").alias("total_high_pii"), share("sum_quality").alias("avg_quality_score"),
                         F.col("last.health_score").alias("last_score"), trend.alias("trend"))
            .withColumn("trend_label", F.when(F.col("trend") > 0, F.concat(F.lit(TREND_UP), F.col("trend")))
                        .when(F.col("trend") < 0, F.concat(F.lit(TREND_DOWN), F.abs(F.col("trend"))))
                        .otherwise(F.lit(TREND_FLAT))))


def score_series(gold: DataFrame) -> DataFrame:
    """Health score over time with its grade zone."""
    zone = F.when(F.col("health_score") >= ZONES[0][0], ZONES[0][1]).when(
        F.col("health_score") >= ZONES[1][0], ZONES[1][1]).otherwise(ZONE_FLOOR)
    return gold.select("timestamp", "filename", "health_score", zone.alias("zone")).orderBy("timestamp", "filename")


def pii_exposure(gold: "DataFrame | GoldTable") -> DataFrame:
    """HIGH / MEDIUM / LOW per file (repeat scans stack), long form, from the day states."""
    return merge_states(_states(gold), "filename").unpivot(["filename"], ["HIGH", "MEDIUM", "LOW"], "risk", "n")


def quality_series(gold: DataFrame) -> DataFrame:
    """Quality score per scan with its colour band (85 / 70 / 55)."""
    return gold.select("timestamp", "filename", "quality_score", color_band(F.col("quality_score")).alias("band"))


def duplicate_series(gold: DataFrame) -> DataFrame:
    """Duplicate rate over time."""
    return gold.select("timestamp", "filename", "duplicate_pct").orderBy("timestamp", "filename")


def dimension_scores(gold: DataFrame) -> DataFrame:
    """Privacy / quality / completeness per scan in long form."""
    d = gold.select("timestamp", "filename", F.col("privacy_score").alias("Privacy"),
                    F.col("quality_score").alias("Quality"), F.col("completeness_score").alias("Completeness"))
    return d.unpivot(["timestamp", "filename"], ["Privacy", "Quality", "Completeness"], "dimension", "score")


def grade_distribution(gold: "DataFrame | GoldTable") -> DataFrame:
    """Scans per grade and share, most frequent first, from the day states.

    The share divides by a total over the grouped result (at most five
    grades), so the global window runs over five rows, not over the scans.
    """
    g = merge_states(_states(gold), "grade").select("grade", "scans")
    return (g.withColumn("share", F.bround(F.col("scans") * 100.0 / F.sum("scans").over(Window.partitionBy()), 1))
            .orderBy(F.desc("scans"), "grade"))


def display_history(gold: DataFrame) -> DataFrame:
    """All columns of the history table, timestamp and health score formatted."""
    shown = {"timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm"),
             "health_score": F.concat(F.col("health_score").cast("string"), F.lit("/100"))}
    return gold.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in GOLD_COLUMNS])

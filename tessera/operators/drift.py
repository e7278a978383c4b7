"""Schema catalogs, baselines and drift (rows A3, A16, A17, H1-H5).

A catalog is a table ``(dataset, column, ordinal, dtype, row_count)``; type
names follow the pandas vocabulary (``int64``, ``float64``, ``object`` ...)
so baselines stay comparable with ones saved by the original tool.  Drift is
one full outer join of two catalogs on ``(dataset, column)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import frame
from .. import profiles as P
from ..frame import DATASET

CHANGE_SCHEMA = ("dataset string, type string, column string, severity string, message string, "
                 "before string, after string")


def dtype_name(dt: T.DataType) -> str:
    """Spark type -> pandas dtype name."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "float64"
    if isinstance(dt, T.DecimalType):
        return "float64" if dt.scale > 0 else "int64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    if isinstance(dt, T.StringType):
        return "object"
    return dt.simpleString()


def catalog(df: DataFrame, key: str | None = None) -> DataFrame:
    """Column catalog per dataset, with the dataset's row count.

    One aggregation (``count`` per dataset); the column list is schema
    metadata, emitted with ``explode`` of a literal array -- no cross join.
    """
    df = frame.with_dataset(df)
    cols = [c for c in df.columns if c not in (DATASET, key)]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                                 F.lit(dtype_name(df.schema[c].dataType)).alias("dtype"))
                        for i, c in enumerate(cols)])
    return (df.groupBy(DATASET).agg(F.count(F.lit(1)).alias("row_count"))
            .select(DATASET, "row_count", F.explode(entries).alias("e"))
            .select(DATASET, "e.column", "e.ordinal", "e.dtype", "row_count"))


def catalogs(groups: list[DataFrame], key: str | None = None) -> DataFrame:
    """The catalog of several frames, each with its own columns and types (``read_groups``): drift is then per file."""
    return reduce(DataFrame.unionByName, [catalog(g, key) for g in groups])


def with_saved_at(cat: DataFrame, saved_at=None) -> DataFrame:
    """Stamp a catalog as a baseline (``saved_at`` defaults to now)."""
    ts = F.current_timestamp() if saved_at is None else F.lit(saved_at).cast("timestamp")
    return cat.withColumn("saved_at", ts)


def save_baseline(cat: DataFrame, path: str, saved_at=None) -> None:
    """Append a baseline to a parquet table partitioned by dataset."""
    with_saved_at(cat, saved_at).write.mode("append").partitionBy(DATASET).parquet(path)


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """The most recent baseline of each dataset."""
    last = baselines.groupBy(DATASET).agg(F.max("saved_at").alias("saved_at"))
    return baselines.join(last, [DATASET, "saved_at"], "left_semi")


def load_baseline(spark, path: str) -> DataFrame:
    """Read the baseline table and keep the latest baseline per dataset."""
    return latest_baseline(spark.read.parquet(path))


# FIXED VALUES -- change types, severities and messages of ``drift_changes`` and the statuses of ``drift_status``.
def drift_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """H1-H4: one row per added / removed / retyped column (datasets with a baseline only)."""
    cur = current.select(DATASET, "column", F.col("dtype").alias("after"))
    base = baseline.select(DATASET, "column", F.col("dtype").alias("before"))
    # datasets on both sides: one only in the baseline was not scanned, its columns were not removed
    has_base = baseline.select(DATASET).intersect(current.select(DATASET))
    j = cur.join(base, [DATASET, "column"], "full_outer").join(has_base, DATASET, "left_semi")
    crit = F.lit(False)
    low = F.lower(F.col("column"))
    for w in P.CRITICAL_COLUMN_WORDS:
        crit = crit | low.contains(w)
    added = F.col("before").isNull() & F.col("after").isNotNull()
    removed = F.col("after").isNull() & F.col("before").isNotNull()
    retyped = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before") != F.col("after"))
    q = lambda s: F.concat(F.lit("'"), F.col("column"), F.lit("'"), F.lit(s))
    return (j.where(added | removed | retyped).select(
        DATASET,
        F.when(added, "column_added").when(removed, "column_removed").otherwise("type_changed").alias("type"),
        "column",
        F.when(added & crit, "CRITICAL").when(added, "WARNING").when(removed, "INFO").otherwise("WARNING")
        .alias("severity"),
        F.when(added & crit, F.concat(F.lit("HIGH RISK: New column "), q(" contains a sensitive keyword — "
                                                                        "immediate review required.")))
        .when(added, F.concat(F.lit("New column "), q(" added since last scan.")))
        .when(removed, F.concat(F.lit("Column "), q(" was in baseline but is now missing.")))
        .otherwise(F.concat(F.lit("Column "), q(" type changed: "), F.col("before"), F.lit(" -> "), F.col("after")))
        .alias("message"),
        "before", "after"))


def drift_status(current: DataFrame, baseline: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """H5: status per current dataset: drift_detected / stable / no_baseline, with a summary."""
    if changes is None:
        changes = drift_changes(current, baseline)
    datasets = current.select(DATASET).distinct()
    bdate = baseline.groupBy(DATASET).agg(F.max("saved_at").cast("string").alias("baseline_date"))
    summ = (changes.groupBy(DATASET).agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "column_added", F.col("column")))).alias("added"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "column_removed", F.col("column")))).alias("removed"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "type_changed", F.col("column")))).alias("type_changes"),
        F.count_if(F.col("severity") == "CRITICAL").alias("alerts"),
        F.count(F.lit(1)).alias("n_changes")))
    empty = F.array().cast("array<string>")
    return (datasets.join(bdate, DATASET, "left").join(summ, DATASET, "left")
            .select(DATASET,
                    F.when(F.col("baseline_date").isNull(), "no_baseline")
                    .when(F.coalesce(F.col("n_changes"), F.lit(0)) > 0, "drift_detected").otherwise("stable")
                    .alias("status"),
                    "baseline_date",
                    F.coalesce("added", empty).alias("added"), F.coalesce("removed", empty).alias("removed"),
                    F.coalesce("type_changes", empty).alias("type_changes"),
                    F.coalesce("alerts", F.lit(0)).cast("bigint").alias("alerts")))

"""Conventions shared by all operators.

Every table an operator works on carries a ``dataset`` column (the file or
batch a row came from), so one job serves any number of datasets and every
result is keyed by it.  Rows are identified by user key columns; when there
are none a surrogate ``row_key`` is taken at read time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATASET = "dataset"
ROW_KEY = "row_key"


def col(name: str) -> Column:
    """Column reference that tolerates dots and spaces in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(name: str, dtype: T.DataType) -> Column:
    """The value of a column, null where it is missing: NaN counts as missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def with_dataset(df: DataFrame, dataset: "str | Column | None" = None) -> DataFrame:
    """Ensure a ``dataset`` column (literal name, expression, or keep the existing one)."""
    if dataset is None:
        if DATASET in df.columns:
            return df
        dataset = "default"
    c = F.lit(dataset) if isinstance(dataset, str) else dataset
    return df.withColumn(DATASET, c.cast("string"))


def with_row_key(df: DataFrame, key: "str | None" = None) -> tuple[DataFrame, str]:
    """Return ``(df, key_name)``; adds a surrogate ``row_key`` when no key is given.

    The surrogate comes from ``monotonically_increasing_id`` taken right after
    the scan, which is stable for the same input files and split settings.
    Never a global ``row_number`` (that would funnel every row through one task).
    """
    if key is not None:
        return df, key
    if ROW_KEY in df.columns:
        return df, ROW_KEY
    return df.withColumn(ROW_KEY, F.monotonically_increasing_id()), ROW_KEY


def value_columns(df: DataFrame, key: "str | None" = None, exclude=()) -> list[str]:
    """Data columns: everything except the dataset column, the key and ``exclude``."""
    skip = {DATASET, key, *exclude}
    return [c for c in df.columns if c not in skip]


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows of a table just read when it has fewer splits than cores.

    Text scans are CPU-bound; a table stored as one large row group would run
    as one task.  With as many splits as cores or more nothing is added.  Only for a
    fresh read: counting the splits of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

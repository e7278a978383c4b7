"""Helpers shared by the operators: shipping code, written intermediate tables, row identity."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows per Arrow batch handed to Python.  Documents are whole texts, so batches are kept short:
#: a batch holds this many texts, whatever their length.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Let the Python workers import this package, and keep Arrow batches of whole texts short."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", REPO)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files every executor can read."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(col: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null (still a hash or sort-merge join key)."""
    return a.eqNullSafe(b)


def matching(docs: DataFrame, kept: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` equal a row of ``kept`` (its columns in order, null equal to null).

    The columns of ``docs`` travel as one struct, so their names cannot clash with anything.
    """
    left = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *(k.alias(f"key{i}") for i, k in enumerate(keys)))
    right = kept.toDF(*(f"kept{i}" for i in range(len(keys))))
    on = reduce(lambda a, b: a & b, (same(F.col(f"key{i}"), F.col(f"kept{i}")) for i in range(len(keys))))
    return left.join(right, on, "left_semi").select("row.*")

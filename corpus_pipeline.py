"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.

Defined results, for every stage: an empty table gives an empty result; columns besides doc_id, text,
lang, source and n_chars may have any name and go along unchanged.  Null or empty texts fail the quality rules; a text
whose lines all go in line dedup stays as the empty text, one of which is left by near-dedup.  Null ids
are ids of their own; rows that are alike are separate documents until near-dedup, which leaves one row per
component (a null id only if all its ids are null).  Very long texts are read whole; ties are settled by
doc_id, then by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, packing, quality, simhash
from tessera.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null languages and sources are groups of their own."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three-line windows seen before go; n_chars follows the text where lines went, and stays else (null too)."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = line_dedup.line_dedup(docs, keep=others)
    if "n_chars" in others:
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays, the one with the smallest doc_id (then the smallest text hash)."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that bring the domains to their target weights; without labels all stay."""
    return mixing.keep_mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in packed sequences; an empty text is one piece of the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Robust covariances, fingerprints, rates and packing have no SQL form; ``run`` is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Queries over the driver's tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (divergence, factorisation, line_dedup, minhash, mixing, packing, prefixtrie, quality, simhash, suffixes,
               tokenfile, toxicity, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of three-line windows seen before."""
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by the pattern grammar."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in packed sequences."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 100-byte strings that start earlier."""
    return suffixes.suffix_dedup(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every document and its edited text, and their likeness."""
    return minhash.fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids written to range-coded files and read back."""
    return tokenfile.encode_and_read(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    return quality.quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and mixing rate of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        F.col("id").alias("doc_id"), "n_tokens", "p_clean", "p_low", "p_toxic", "rate")


def op11_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the factorisation machine."""
    return factorisation.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with totals of its subtree."""
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_warc, op4_packing, op5_simhash, op6_suffix_dedup,
                            op7_minhash, op8_token_ids, op9_quality, op10_mixing, op11_factorisation, op12_divergence,
                            op13_prefix_trie)}

SQL = {"op1_line_dedup": line_dedup.SQL, "op3_warc": warc.SQL, "op12_divergence": divergence.SQL,
       "op13_prefix_trie": prefixtrie.SQL}

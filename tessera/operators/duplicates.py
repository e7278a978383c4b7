"""Duplicate analysis (rows G1-G3).

Rows are grouped once, on their values, with long texts and binaries replaced by
their SHA-256 digest: one read of the table, one shuffle of at most 32 bytes per
text cell, the same plan at every size.  Every aggregation combines map-side, so
a value repeated in a third of all rows collapses inside each map task before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import frame
from ..frame import DATASET, col

# FIXED VALUES -- the characters Python's str.strip() removes (str.isspace()):
# ASCII \t \n \v \f \r, the separators U+001C-U+001F, space, U+0085, U+00A0,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def normalize(c) -> "F.Column":
    """G2 normalisation: null -> '', lower case, strip surrounding whitespace.

    ``trim`` with an explicit character set works on the ends only (cost of
    the whitespace run), unlike an anchored regex tried at every position.
    """
    return F.trim(F.lower(F.coalesce(c, F.lit(""))), F.lit(WHITESPACE))


DIGEST_BYTES = 32


def compact(c, dtype: T.DataType):
    """A grouping value equal where ``c`` is equal: texts and binaries of 32 bytes or more as their SHA-256.

    Shorter ones stay as their bytes, so that the two forms differ in length.
    """
    if not isinstance(dtype, (T.StringType, T.BinaryType)):
        return c
    raw = c.cast("binary")
    return F.when(F.octet_length(raw) < DIGEST_BYTES, raw).otherwise(F.unhex(F.sha2(raw, 256)))


def duplicates(df: DataFrame, key: str | None = None, near: bool = True) -> DataFrame:
    """G1-G3 per dataset: total_rows, exact_duplicates, near_duplicates, duplicate_pct.

    Rows are compared on every column except the dataset and ``key`` (nulls
    compare equal, as in a grouping; maps whatever the order of their entries).
    Near duplicates use only string columns (null -> '', lower case,
    stripped); with none they are 0.  Rows are grouped on their values first; the
    exact groups, not the rows, are normalised, digested and grouped again.
    """
    groups, texts, _ = value_groups(frame.with_dataset(df), key, near)
    if not texts:
        return finish(groups.groupBy(DATASET).agg(F.sum("_n").alias("total_rows"),
                                                   F.sum(F.col("_n") - 1).alias("exact_duplicates")))
    near_groups = (groups.select(DATASET, near_digest(texts), "_n").groupBy(DATASET, "_near")
                   .agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") - 1).alias("_e")))
    return finish(near_groups.groupBy(DATASET).agg(
        F.sum("_m").alias("total_rows"), F.sum("_e").alias("exact_duplicates"),
        F.sum(F.col("_m") - 1).alias("near_duplicates")))


def value_groups(df: DataFrame, key: str | None, near: bool) -> tuple[DataFrame, list[int], list[str]]:
    """Rows grouped on their values (``_v*``, ``_l*``, ``_n``), the places of text columns, and the columns compared."""
    vals = frame.value_columns(df, key)
    texts = [i for i, c in enumerate(vals) if isinstance(df.schema[c].dataType, T.StringType)] if near else []
    cells = [compact(col(c), df.schema[c].dataType).alias(f"_v{i}") for i, c in enumerate(vals)]
    # a long text leaves only its digest in the group: the token of its normal form goes along
    cells += [F.when(F.octet_length(col(vals[i])) >= DIGEST_BYTES, token(col(vals[i]))).alias(f"_l{i}") for i in texts]
    groups = (df.select(DATASET, *cells)
              .groupBy(DATASET, *[f"_v{i}" for i in range(len(vals))], *[f"_l{i}" for i in texts])
              .agg(F.count(F.lit(1)).alias("_n")))
    return groups, texts, vals


def cell_text(c, dtype: T.DataType) -> "F.Column":
    """A cell as text with its length in front, equal where the cells are equal; null for null."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        t = F.hex(compact(c, dtype))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        t = (c + F.lit(0.0)).cast("string")                    # -0.0 equals 0.0
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        t = F.to_json(F.struct(c.alias("v")))
    else:
        t = c.cast("string")
    return F.concat(F.length(t).cast("string"), F.lit(":"), t)


def row_digest(df: DataFrame, key: str | None) -> "F.Column":
    """A digest equal for rows that are exact duplicates, whichever batch they come with."""
    # by name, as files of other formats may have their columns in another order; a null cell counts like an absent column
    cells = [F.concat(F.lit(f"{len(c)}:{c}="), cell_text(col(c), df.schema[c].dataType)) for c in sorted(frame.value_columns(df, key))]
    return F.unhex(F.sha2(F.concat_ws(" ", *cells) if cells else F.lit(""), 256))


def row_states(df: DataFrame, key: str | None = None, near: bool = True, digest: str | None = None) -> DataFrame:
    """dataset, exact, near, n: one row per different row, to be merged with those of other batches.

    ``digest`` names a column that holds the rows' digests already.
    """
    df = frame.with_dataset(df)
    vals = sorted(frame.value_columns(df, key, (digest,)))
    texts = [c for c in vals if isinstance(df.schema[c].dataType, T.StringType)] if near else []
    parts = [p for c in texts for p in (F.length(token(col(c))).cast("string"), token(col(c)))]
    near_key = F.unhex(F.sha2(F.concat_ws(" ", *parts), 256)) if texts else F.lit(None).cast("binary")
    exact = row_digest(df, key) if digest is None else col(digest)
    # rows with one ``exact`` have one ``near``: both are grouped on, as a binary aggregate would sort every row
    return (df.select(DATASET, exact.alias("exact"), near_key.alias("near"))
            .groupBy(DATASET, "exact", "near").agg(F.count(F.lit(1)).alias("n")))


def token(c) -> "F.Column":
    """Stands for the normal form of a text: itself if short, else its SHA-256 (longer than any short one)."""
    n = normalize(c)
    return F.when(F.octet_length(n) < DIGEST_BYTES, n).otherwise(F.sha2(n, 256))


def near_digest(texts: list[int]) -> "F.Column":
    """``_near`` of an exact group: one digest of the normal forms of its text cells.

    Each token's length in front of it keeps ("a", "bc") apart from ("ab", "c").
    """
    parts = []
    for i in texts:
        t = F.coalesce(F.col(f"_l{i}"), token(F.col(f"_v{i}").cast("string")))
        parts += [F.length(t).cast("string"), t]
    return F.unhex(F.sha2(F.concat_ws(" ", *parts), 256)).alias("_near")


def finish(out: DataFrame) -> DataFrame:
    if "near_duplicates" not in out.columns:
        out = out.withColumn("near_duplicates", F.lit(0).cast("bigint"))
    return out.select(
        DATASET, F.col("total_rows").cast("bigint").alias("total_rows"),
        F.col("exact_duplicates").cast("bigint").alias("exact_duplicates"),
        F.coalesce(F.col("near_duplicates"), F.lit(0)).cast("bigint").alias("near_duplicates"),
        duplicate_pct(F.col("exact_duplicates"), F.col("total_rows")).alias("duplicate_pct"))


def duplicate_pct(exact, total):
    """Percent of rows that are exact repeats, 1 decimal (half-even); 0 for empty input."""
    return F.when(total > 0, F.bround(exact * 100.0 / total, 1)).otherwise(F.lit(0.0))

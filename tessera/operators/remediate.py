"""Remediation (rows C19-C21, D7-D10).

Masking is a pure per-cell function: the risk of a match depends only on its
column and its cell, never on the pattern, so every actionable match of a
cell is replaced *in the row* by folding ``replace`` over the cell's matches
(pattern order, then match order).  No finding table, no join, no shuffle.
Deduplication runs on the original values first and masking after, in the
same plan, so rows differing only in masked digits are not merged.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import frame
from .. import profiles as P
from ..frame import DATASET, col
from ..functions import pii
from ..profiles import get_profile

KEY_CONF = "spark.tessera.encryption.secret"   # "secret": hidden by Spark's default conf redaction


def encryption_key(spark, key: "str | bytes | None" = None) -> Column:
    """AES key as a binary literal, from the argument or ``spark.tessera.encryption.secret``.

    The key is base64 text of 16, 24 or 32 bytes.  A missing key is an error
    (C20), never a silent pass-through.
    """
    if key is None:
        key = spark.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"{KEY_CONF} not set: supply a base64 AES key (16/24/32 bytes) to encrypt or decrypt")
    raw = key if isinstance(key, bytes) else base64.b64decode(key)
    if len(raw) not in (16, 24, 32):
        raise ValueError("encryption secret must decode to 16, 24 or 32 bytes")
    return F.unbase64(F.lit(base64.b64encode(raw).decode()))


def _maskable(dtype: T.DataType) -> bool:
    """Column types whose text can hold a match (numbers only a 16-digit card)."""
    kind = pii.text_kind(dtype)
    if kind == "text":
        return True
    if kind == "number":
        if isinstance(dtype, T.DecimalType):
            return dtype.precision >= 16
        return isinstance(dtype, (T.LongType, T.FloatType, T.DoubleType))
    return False


def _mask_types(name: str, dtype: T.DataType, prof, sensitivity) -> list[str]:
    types = prof.active_types(sensitivity)
    if pii.text_kind(dtype) == "number":
        types = [t for t in types if t == "CREDIT_CARD"]
    if pii.is_email_column(name, prof):
        types = [t for t in types if t != "EMAIL"]
    return types


def _replacement(m: Column, conf: Column, key: Column | None) -> Column:
    if key is None:
        return m["masked"]
    return F.when(conf >= P.RISK_HIGH_AT, pii.encrypt_token(m["raw_value"], key)).otherwise(m["masked"])


def mask_frame(df: DataFrame, profile="cli", sensitivity="medium", key: str | None = None,
               columns: list[str] | None = None, encrypt_key: Column | None = None) -> DataFrame:
    """D7 (and D8 with ``encrypt_key``): the table with actionable PII replaced in place.

    Every column keeps its type.  In text columns matches are replaced by
    their masks (or tokens); in numeric columns that can hold a 16-digit
    card number an actionable match nulls the value, as a number has no
    masked form.  Nulls stay null.

    The cells of a row are packed into an array and masked by one per-cell
    expression (nested ``transform``: prefilter facts, then matches, then the
    fold), with the per-column rules (class, e-mail exemption) read from
    literal arrays by position.  The plan is the same size for 5 or 5,000
    columns and needs no shuffle.
    """
    prof = get_profile(profile)
    df = frame.with_dataset(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = columns if columns is not None else frame.value_columns(df, key)
    todo = [c for c in df.columns if c in names and _maskable(fields[c])
            and _mask_types(c, fields[c], prof, sensitivity)]
    texts = [c for c in todo if pii.text_kind(fields[c]) == "text"]
    numbers = [c for c in todo if pii.text_kind(fields[c]) == "number"]
    staged = df
    if texts:
        staged = staged.withColumn("__t", _mask_cells(texts, fields, prof, sensitivity, encrypt_key, numeric=False))
    if numbers:
        staged = staged.withColumn("__n", _mask_cells(numbers, fields, prof, sensitivity, None, numeric=True))
    pos_t = {c: i for i, c in enumerate(texts)}
    pos_n = {c: i for i, c in enumerate(numbers)}
    out = []
    for c in df.columns:
        if c in pos_t:
            out.append(F.col("__t").getItem(pos_t[c]).alias(c))
        elif c in pos_n:
            out.append(F.when(F.col("__n").getItem(pos_n[c]), F.lit(None).cast(fields[c])).otherwise(col(c)).alias(c))
        else:
            out.append(col(c))
    return staged.select(*out)


def _mask_cells(cols: list[str], fields: dict, prof, sensitivity, key: Column | None, numeric: bool) -> Column:
    """Array expression over the cells of ``cols``: masked texts, or (numeric) "null this value" flags."""
    # literal arrays and the packed cells as SQL text: one JVM-side parse, however many columns
    classes = F.expr("array(" + ", ".join(pii.sql_str(pii.column_class(c, prof)) for c in cols) + ")")
    emails = F.expr("array(" + ", ".join("true" if pii.is_email_column(c, prof) else "false" for c in cols) + ")")
    types = prof.active_types(sensitivity)
    if numeric:
        types = [t for t in types if t == "CREDIT_CARD"]
    cells = F.expr("array(" + ", ".join(pii.as_text_sql(c, fields[c]) for c in cols) + ")")

    def facts(cell, i):
        f = pii.prefilter_columns(cell)
        return F.struct(cell.alias("cell"), classes[i].alias("cls"), emails[i].alias("email"),
                        f["has_digit"].alias("d"), f["has_at"].alias("a"))

    def matched(x):
        guards = {t: (x["a"] & ~x["email"]) if t == "EMAIL" else x["d"] for t in types}
        return F.struct(x["cell"].alias("cell"), x["cls"].alias("cls"),
                        pii.match_structs(x["cell"], types, prof, guards).alias("m"))

    def scored(x):
        # the confidence (lower-case copy + keyword search of the cell) once per
        # cell with matches, not once per match inside the fold
        return F.struct(x["cell"].alias("cell"), x["m"].alias("m"),
                        F.when(F.size(x["m"]) > 0, pii.confidence(x["cls"], x["cell"], prof)).alias("conf"))

    def fold(x):
        conf = x["conf"]
        if numeric:
            return (F.size(x["m"]) > 0) & (conf >= P.RISK_MEDIUM_AT)
        folded = F.aggregate(x["m"], x["cell"],
                             lambda acc, m: F.replace(acc, m["raw_value"], _replacement(m, conf, key)))
        # LOW findings are never touched (D-5)
        return F.when(F.size(x["m"]) == 0, x["cell"]).when(conf >= P.RISK_MEDIUM_AT, folded).otherwise(x["cell"])

    return F.transform(F.transform(F.transform(F.transform(cells, facts), matched), scored), fold)


def dedup(df: DataFrame, key: str | None = None) -> DataFrame:
    """Drop exact duplicate rows per dataset, keeping the first (lowest key).

    Rows are grouped on their values with ``min(key)``: one read, one shuffle,
    the same plan at every size.  The grouping combines map-side, so a value
    repeated in a third of all rows collapses before the shuffle.
    """
    df = frame.with_dataset(df)
    if key is None:
        return df.dropDuplicates()
    vals = frame.value_columns(df, key)
    return (df.groupBy(DATASET, *[col(c) for c in vals]).agg(F.min(col(key)).alias(key))
            .select(*[col(c) for c in df.columns]))


def remediate(df: DataFrame, profile="cli", sensitivity="medium", key: str | None = None,
              mask: bool = True, dedup_rows: bool = True, encrypt_key: Column | None = None) -> DataFrame:
    """Dedup on the original values, then mask (or encrypt HIGH) in row."""
    out = dedup(df, key) if dedup_rows else frame.with_dataset(df)
    if mask or encrypt_key is not None:
        out = mask_frame(out, profile, sensitivity, key, encrypt_key=encrypt_key)
    return out


def decrypt_column(tokens: Column, key: Column) -> Column:
    """C20 over a column of tokens; bad tokens give null, an empty token is an error."""
    return pii.decrypt_token(tokens, key)


def protection_status(scores: DataFrame, encrypted: bool) -> DataFrame:
    """Encryption flag and HIGH findings protected vs masked only, per dataset."""
    return scores.select(
        DATASET,
        F.struct(F.lit(bool(encrypted)).alias("encryption_enabled"),
                 (F.col("pii_high") if encrypted else F.lit(0)).cast("int").alias("high_risk_pii_protected"),
                 (F.lit(0) if encrypted else F.col("pii_high")).cast("int").alias("high_risk_pii_masked_only"))
        .alias("protection_status"))

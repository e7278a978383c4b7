"""Data-quality checks (rows A18, B4-B6, E1-E14).

The suite is generated on the driver from the schema (names and types are
metadata) and runs as **one** ``groupBy(dataset).agg`` of conditional counts;
only uniqueness checks need their own aggregation on the checked column.
Results come back as one row per (dataset, check).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import frame
from .. import profiles as P
from ..frame import DATASET, col
from ..functions.pii import sql_str
from ..profiles import get_profile

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# FIXED VALUES -- names and detail texts of the checks.
CHECK_NAMES = {
    "exist": "column to exist",
    "not_null": "column values to not be null",
    "regex": "column values to match regex",
    "between": "column values to be between",
    "unique": "column values to be unique",
}
STRICT_NAMES = {"not_null": "not null", "email": "email format", "age": "age 0-120", "nonneg": "non-negative"}
STRICT_DETAIL = {"not_null": "{n} null(s)", "email": "{n} invalid", "age": "{n} out-of-range", "nonneg": "{n} negative"}

RESULT_SCHEMA = ("dataset string, check_idx int, check string, column string, passed boolean, "
                 "total bigint, unexpected_count bigint, unexpected_percent double, detail string")


@dataclass
class Check:
    kind: str                      # exist | not_null | regex | between | unique
    column: str
    name: str = ""
    pattern: str | None = None
    min: float | None = None
    max: float | None = None
    mostly: float | None = None
    search: bool = True            # regex: search anywhere (suite) vs match at start (strict)
    strict_key: str | None = None  # function-profile check id, for the detail text
    detail_tpl: str | None = None  # detail text with {n}, for strict checks
    extra: dict = field(default_factory=dict)


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric-dtype guard."""
    return isinstance(dtype, NUMERIC)


def find_column(df: DataFrame, *keywords, overrides: dict | None = None, role: str | None = None):
    """First column in table order whose lower-cased name contains a keyword.

    ``overrides[role]`` names the column explicitly (the first-match rule
    resolves "total" to ``subtotal`` when that column comes first).
    """
    if overrides and role and role in overrides:
        return overrides[role] if overrides[role] in df.columns else None
    for c in df.columns:
        if c == DATASET:
            continue
        if any(k in c.lower() for k in keywords):
            return c
    return None


def id_columns(names) -> list[str]:
    """Id columns by name."""
    return [c for c in names if re.search(P.ID_COLUMN_REGEX, c)]


def build_suite(df: DataFrame, profile="cli", rules: list[dict] | None = None,
                key: str | None = None) -> list[Check]:
    """Checks generated from column names / types, then custom rules.

    Custom rules on unknown columns are skipped; ``between`` needs both bounds.
    """
    prof = get_profile(profile)
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in df.columns if c not in (DATASET, key)]
    checks: list[Check] = []
    if prof.legacy_quality:
        def legacy(kind, c, key, **kw):
            name, tpl = P.LEGACY_CHECKS[key]
            return Check(kind, c, name.format(col=c), strict_key=key, detail_tpl=tpl, **kw)
        checks += [legacy("not_null", c, "not_null") for c in names if re.search(P.ID_COLUMN_REGEX, c)]
        checks += [legacy("regex", c, "email", pattern=P.EMAIL_FORMAT_REGEX, search=False)
                   for c in names if "email" in c.lower()]
        checks += [legacy("between", c, "age", min=0, max=120) for c in names
                   if "age" in c.lower() and is_numeric(fields[c])]
        checks += [legacy("between", c, "nonneg", min=0) for c in names
                   if any(k in c.lower() for k in prof.nonneg_words) and is_numeric(fields[c])]
        return checks
    if prof.strict_quality:
        for c in names:
            low = c.lower()
            if re.search(P.ID_COLUMN_REGEX, c):
                checks.append(Check("not_null", c, STRICT_NAMES["not_null"], strict_key="not_null"))
            if "email" in low:
                checks.append(Check("regex", c, STRICT_NAMES["email"], P.EMAIL_FORMAT_REGEX, search=False,
                                    strict_key="email"))
            if "age" in low and is_numeric(fields[c]):
                checks.append(Check("between", c, STRICT_NAMES["age"], min=0, max=120, strict_key="age"))
            if any(k in low for k in prof.nonneg_words) and is_numeric(fields[c]):
                checks.append(Check("between", c, STRICT_NAMES["nonneg"], min=0, strict_key="nonneg"))
        return checks
    for c in names:                                                           # E1
        checks.append(Check("exist", c))
    for c in id_columns(names):                                               # E2
        checks.append(Check("not_null", c))
    for c in [c for c in names if "email" in c.lower()]:                      # E3
        checks.append(Check("regex", c, pattern=P.EMAIL_FORMAT_REGEX, mostly=P.FORMAT_MOSTLY))
    for c in names:                                                           # E5
        if any(k in c.lower() for k in prof.nonneg_words) and is_numeric(fields[c]):
            checks.append(Check("between", c, min=0))
    for c in [c for c in names if "age" in c.lower()]:                        # E6
        if is_numeric(fields[c]):
            checks.append(Check("between", c, min=0, max=120))
    for c in [c for c in names if re.search(P.ZIP_COLUMN_REGEX, c)]:          # E7
        checks.append(Check("regex", c, pattern=P.ZIP_FORMAT_REGEX, mostly=P.FORMAT_MOSTLY))
    for r in rules or []:                                                     # E8-E11
        c, t = r.get("column"), r.get("type")
        if c not in names:
            continue
        if t == "not_null":
            checks.append(Check("not_null", c))
        elif t == "between" and "min" in r and "max" in r:
            checks.append(Check("between", c, min=r["min"], max=r["max"]))
        elif t == "regex" and "pattern" in r:
            checks.append(Check("regex", c, pattern=r["pattern"]))
        elif t == "unique":
            checks.append(Check("unique", c))
    for ch in checks:
        ch.name = ch.name or CHECK_NAMES[ch.kind]
    return checks


def _value(c: str, dtype: T.DataType) -> Column:
    if is_numeric(dtype):
        return frame.present(c, dtype).cast("double")
    return F.expr(f"try_cast(`{c}` as double)")


def _text(c: str, dtype: T.DataType) -> Column:
    return col(c) if isinstance(dtype, T.StringType) else col(c).cast("string")


def python_regex_to_java(pattern: str) -> str:
    """A user rule written for Python's ``re``: named groups / back-references in Java syntax,
    Unicode character classes as in Python."""
    p = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", pattern)
    p = re.sub(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)", r"\\k<\1>", p)
    return "(?U)" + p


def _unexpected(ch: Check, dtype: T.DataType) -> Column:
    """Condition for an unexpected value (nulls and NaN never unexpected except for not_null)."""
    here = frame.present(ch.column, dtype).isNotNull()
    if ch.kind == "not_null":
        return ~here
    if ch.kind == "regex":
        pat = ch.pattern if ch.search else "^(?:" + ch.pattern + ")"
        return here & ~_text(ch.column, dtype).rlike(python_regex_to_java(pat))
    if ch.kind == "between":
        v = _value(ch.column, dtype)
        cond = F.lit(False)
        if ch.min is not None:
            cond = cond | (v < F.lit(float(ch.min)))
        if ch.max is not None:
            cond = cond | (v > F.lit(float(ch.max)))
        if not is_numeric(dtype):   # a non-numeric value cannot be in range
            cond = cond | v.isNull()
        return here & cond
    raise ValueError(ch.kind)


def check_aggs(df: DataFrame, checks: list[Check]) -> list[Column]:
    """Conditional counts of every non-unique check, to run inside one ``groupBy(dataset).agg``."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, ch in enumerate(checks):
        if ch.kind in ("exist", "unique"):
            continue
        aggs.append(F.count(frame.present(ch.column, fields[ch.column])).alias(f"nn{i}"))
        aggs.append(F.count_if(_unexpected(ch, fields[ch.column])).alias(f"u{i}"))
    return aggs


def unique_key(c: str, dtype: T.DataType) -> Column:
    """Bytes equal where values are equal: the value's text, or the SHA-256 of a longer one; null where missing."""
    v = frame.present(c, dtype)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        v = v + F.lit(0.0)                                     # -0.0 equals 0.0
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        v = F.to_json(F.struct(v.alias("v")))
    raw = v if isinstance(dtype, T.BinaryType) else v.cast("string").cast("binary")
    return F.when(F.octet_length(raw) < 32, raw).otherwise(F.unhex(F.sha2(raw, 256)))


def unique_groups(df: DataFrame, checks: list[Check]) -> DataFrame | None:
    """(dataset, rule, key, n) of every unique rule at once - one pass over the rows, one exchange.

    Each row becomes one narrow entry per rule, counted before the shuffle; a value
    held by a third of all rows is one entry per task.  ``rule`` is the place of the first check of that column.
    """
    places = {}
    for i, ch in enumerate(checks):
        if ch.kind == "unique":
            places.setdefault(ch.column, i)
    if not places:
        return None
    entries = [F.struct(F.lit(i).alias("rule"), unique_key(c, df.schema[c].dataType).alias("key")) for c, i in places.items()]
    return (df.select(DATASET, F.explode(F.array(*entries)).alias("e")).where("e.key IS NOT NULL")
            .groupBy(DATASET, F.col("e.rule").alias("rule"), F.col("e.key").alias("key")).agg(F.count(F.lit(1)).alias("n")))


def with_unique_counts(base: DataFrame, df: DataFrame, checks: list[Check], groups: DataFrame | None = None) -> DataFrame:
    """All members of repeated values, for any number of unique rules from one grouping."""
    groups = unique_groups(df, checks) if groups is None else groups
    if groups is None:
        return base
    first, aggs = {}, []
    for i, ch in enumerate(checks):
        if ch.kind == "unique":
            mine = F.col("rule") == first.setdefault(ch.column, i)
            aggs += [F.sum(F.when(mine, F.col("n")).otherwise(0)).alias(f"nn{i}"),
                     F.sum(F.when(mine & (F.col("n") > 1), F.col("n")).otherwise(0)).alias(f"u{i}")]
    counts = groups.groupBy(DATASET).agg(*aggs)
    return base.join(counts, DATASET, "left").fillna(0, [c for c in counts.columns if c != DATASET])


def check_rows(base: DataFrame, checks: list[Check]) -> DataFrame:
    """E13 + E14: one result row per (dataset, check) from the aggregate row of each dataset.

    The rows are one SQL expression (``inline`` of an array of structs), parsed
    once on the JVM, so a suite of hundreds of checks builds in milliseconds.
    """
    rows = []
    for i, ch in enumerate(checks):
        head = f"'check_idx', {i}, 'check', {sql_str(ch.name)}, 'column', {sql_str(ch.column)}"
        if ch.kind == "exist":
            rows.append(f"named_struct({head}, 'passed', true, 'total', n_total, "
                        "'unexpected_count', CAST(0 AS BIGINT), 'unexpected_percent', CAST(NULL AS DOUBLE), "
                        "'detail', CAST(NULL AS STRING))")
            continue
        u, nn = f"u{i}", f"nn{i}"
        denom = "n_total" if ch.kind == "not_null" else nn
        pct = f"CASE WHEN {denom} > 0 THEN {u} * 100.0D / {denom} END"
        if ch.mostly is not None:
            passed = f"({nn} = 0 OR ({nn} - {u}) / {nn} >= {float(ch.mostly)!r}D)"
        else:
            passed = f"({u} = 0)"
        if ch.strict_key:
            tpl = ch.detail_tpl or STRICT_DETAIL[ch.strict_key]
            pre, post = tpl.split("{n}")
            detail = f"CASE WHEN {u} > 0 THEN concat({sql_str(pre)}, CAST({u} AS STRING), {sql_str(post)}) ELSE 'OK' END"
        else:
            detail = f"CASE WHEN NOT {passed} THEN format_string('%d bad value(s)', {u}) END"
        rows.append(f"named_struct({head}, 'passed', {passed}, 'total', n_total, "
                    f"'unexpected_count', CAST({u} AS BIGINT), 'unexpected_percent', {pct}, 'detail', {detail})")
    if not rows:
        return base.sparkSession.createDataFrame([], RESULT_SCHEMA)
    return base.selectExpr(f"`{DATASET}`", "inline(array(" + ", ".join(rows) + "))")


def run_checks(df: DataFrame, checks: list[Check], profile="cli") -> DataFrame:
    """E13 + E14: one result row per (dataset, check), all counts from one aggregate."""
    df = frame.with_dataset(df)
    base = df.groupBy(DATASET).agg(F.count(F.lit(1)).alias("n_total"), *check_aggs(df, checks))
    return check_rows(with_unique_counts(base, df, checks), checks)


def run_quality(df: DataFrame, profile="cli", rules: list[dict] | None = None, key: str | None = None) -> DataFrame:
    """E12 + E13: build the suite for ``df`` and run it."""
    df = frame.with_dataset(df)
    return run_checks(df, build_suite(df, profile, rules, key), profile)


def summarize(results: DataFrame) -> DataFrame:
    """E13 summary: total / passed / failed / overall success per dataset."""
    return (results.groupBy(DATASET)
            .agg(F.count(F.lit(1)).alias("total_checks"),
                 F.count_if(F.col("passed")).alias("passed"),
                 F.count_if(~F.col("passed")).alias("failed"))
            .withColumn("overall_success", F.col("failed") == 0))


def pass_rate(summary: DataFrame) -> DataFrame:
    """K3: integer percent of passed checks, 100 when there are none."""
    return summary.withColumn(
        "pass_rate", F.when(F.col("total_checks") > 0,
                            F.floor(F.col("passed") / F.col("total_checks") * 100.0)).otherwise(100).cast("int"))


def failures(results: DataFrame) -> DataFrame:
    """Failed checks with their unexpected count and percent."""
    return results.where(~F.col("passed")).select(DATASET, "check_idx", "check", "column", "unexpected_count",
                                                  "unexpected_percent")

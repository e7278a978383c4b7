"""PII column expressions (rows C1-C21 of the survey).

Everything here returns a :class:`pyspark.sql.Column`; nothing collects data.
Column-name rules are resolved on the driver from the schema (they are
metadata) and folded into literals, so the per-cell work is a handful of
``regexp_extract_all`` / ``contains`` calls inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profiles as P
from ..profiles import Profile, get_profile

SAFE, RISKY, FREE = "safe", "risky", "free"

# Python's str patterns are Unicode-aware (\d, \s, \w, \b); Java's are not by
# default, and Java's \b changed meaning between JDK 17 and 19.  Compiling with
# UNICODE_CHARACTER_CLASS gives the same classes on every JDK.
UNICODE = "(?U)"


def java_regex(pattern: str) -> str:
    return UNICODE + pattern

MATCH_TYPE = T.StructType([
    T.StructField("pii_type", T.StringType(), False),
    T.StructField("raw_value", T.StringType(), True),
    T.StructField("masked", T.StringType(), True),
])


# ---------------------------------------------------------------- driver side
def _has_word(name: str, words, mode: str = "substring") -> bool:
    low = name.lower().strip()
    if mode == "token":
        toks = set(t for t in re.split(r"[^0-9a-z]+", low) if t)
        return any(w in toks for w in words)
    return any(w in low for w in words)


def column_class(name: str, profile: "str | Profile" = "cli") -> str:
    """C9 (column part): safe / risky / free, first rule wins."""
    prof = get_profile(profile)
    if _has_word(name, prof.safe_col_words, prof.match):
        return SAFE
    if _has_word(name, prof.risky_col_words, prof.match):
        return RISKY
    return FREE


def is_email_column(name: str, profile: "str | Profile" = "cli") -> bool:
    """A column that legitimately holds e-mail addresses."""
    return name.lower().strip() in get_profile(profile).email_columns


# -------------------------------------------------------------- cell helpers
def words_in(text: Column, words) -> Column:
    """Any of ``words`` occurs as a substring of ``lower(text)``."""
    low = F.lower(text)
    cond = None
    for w in words:
        c = low.contains(w)
        cond = c if cond is None else (cond | c)
    return cond if cond is not None else F.lit(False)


def confidence(col_class: Column, cell: Column, profile: "str | Profile" = "cli") -> Column:
    """Context confidence from the column class and the cell text."""
    prof = get_profile(profile)
    ctx = words_in(cell, prof.risky_context_words)
    return (F.when(col_class == SAFE,
                   F.when(ctx, F.lit(P.CONF_SAFE_WITH_CONTEXT)).otherwise(F.lit(P.CONF_SAFE)))
            .when(col_class == RISKY, F.lit(P.CONF_RISKY_COLUMN))
            .when(ctx, F.lit(P.CONF_CONTEXT))
            .otherwise(F.lit(P.CONF_DEFAULT)))


def confidence_for(column_name: str, cell: Column, profile: "str | Profile" = "cli") -> Column:
    """C9 with the column part folded to a literal (wide / per-column form)."""
    return confidence(F.lit(column_class(column_name, profile)), cell, profile)


def risk_tier(conf: Column) -> Column:
    """>=0.75 HIGH, >=0.40 MEDIUM, else LOW."""
    return (F.when(conf >= P.RISK_HIGH_AT, F.lit("HIGH"))
            .when(conf >= P.RISK_MEDIUM_AT, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def risk_rank(risk: Column) -> Column:
    """Sort key HIGH < MEDIUM < LOW."""
    return F.when(risk == "HIGH", 0).when(risk == "MEDIUM", 1).otherwise(2)


def reason(col_class: Column, column_name: Column) -> Column:
    """C11: reason text from the column class."""
    def fmt(template):
        head, tail = template.split("{col}")
        return F.concat(F.lit(head), column_name, F.lit(tail))
    return (F.when(col_class == SAFE, fmt(P.REASON_SAFE))
            .when(col_class == RISKY, fmt(P.REASON_RISKY))
            .otherwise(fmt(P.REASON_FREE)))


# ------------------------------------------------------------------- masks
def mask(pii_type: str, v: Column, profile: "str | Profile" = "cli") -> Column:
    """Partial mask of one matched value of a known type."""
    prof = get_profile(profile)
    if pii_type == "SSN":
        return F.regexp_replace(v, java_regex(P.MASK_SSN_REGEX), P.MASK_SSN_PREFIX)
    if pii_type == "CREDIT_CARD":
        digits = F.regexp_replace(v, java_regex(P.MASK_CARD_REGEX), "")
        return (F.when(F.length(digits) >= 4, F.concat(F.lit(P.MASK_CARD_PREFIX), F.substring(digits, -4, 4)))
                .otherwise(F.lit(P.MASK_CARD_NO_DIGITS)))
    if pii_type == "PHONE":
        return F.regexp_replace(v, java_regex(P.MASK_PHONE_REGEX), P.MASK_PHONE_PREFIX)
    if pii_type == "EMAIL":
        parts = F.split(v, "@")
        return (F.when(F.size(parts) == 2,
                       F.concat(F.substring(parts.getItem(0), 1, 2), F.lit("***@"), parts.getItem(1)))
                .otherwise(F.lit(P.MASK_EMAIL_BAD)))
    if pii_type == "DATE_OF_BIRTH":
        return F.regexp_replace(v, java_regex(P.MASK_DOB_REGEX), F.lit(prof.dob_mask_prefix))
    if pii_type == "PASSPORT":
        return F.concat(F.substring(v, 1, 2), F.lit(P.MASK_PASSPORT_SUFFIX))
    if prof.pad_fallback_mask:
        return F.concat(F.substring(v, 1, 2), F.repeat(F.lit(P.MASK_BULLET), F.greatest(F.lit(4), F.length(v) - 2)))
    return F.concat(F.substring(v, 1, 2), F.lit(P.MASK_BULLET * 4))


def mask_any(pii_type: Column, v: Column, profile: "str | Profile" = "cli") -> Column:
    """Mask where the type is a column value (dispatch with a ``when`` chain)."""
    prof = get_profile(profile)
    out = None
    for t, _ in prof.patterns:
        out = (F.when(pii_type == t, mask(t, v, prof)) if out is None
               else out.when(pii_type == t, mask(t, v, prof)))
    return out.otherwise(mask("_fallback", v, prof))


# ---------------------------------------------------------------- detection
def detect(cell: Column, pii_type: str, profile: "str | Profile" = "cli") -> Column:
    """All matches of one type in a cell, ``array<string>``."""
    return F.regexp_extract_all(cell, F.lit(java_regex(get_profile(profile).pattern(pii_type))), 0)


def _finding_of(t: str, prof: Profile):
    def build(m: Column) -> Column:
        return F.struct(F.lit(t).alias("pii_type"), m.alias("raw_value"), mask(t, m, prof).alias("masked"))
    return build


def match_structs(cell: Column, types, profile: "str | Profile" = "cli",
                  guards: dict | None = None) -> Column:
    """All matches of all ``types`` in a cell as ``array<struct<pii_type, raw_value, masked>>``.

    Order is pattern order, then match order -- the order findings are
    produced in, and the order masks are folded in (remediation).
    ``guards`` maps a type to a boolean Column; where it is false the type is
    skipped for that cell (email-column exemption, numeric-column pruning).
    """
    prof = get_profile(profile)
    parts = []
    for t in types:
        arr = F.transform(detect(cell, t, prof), _finding_of(t, prof))
        g = (guards or {}).get(t)
        if g is not None:
            arr = F.when(g, arr).otherwise(F.array().cast(T.ArrayType(MATCH_TYPE)))
        parts.append(arr)
    if not parts:
        return F.array().cast(T.ArrayType(MATCH_TYPE))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def prefilter_columns(cell: Column) -> dict:
    """Cheap per-cell facts that rule patterns out before any regex runs.

    Every pattern but EMAIL needs a digit; EMAIL needs an '@'.  Computing these
    once per cell (one character-class scan, one byte search) skips the
    regexes for the large share of text cells that hold neither.
    """
    return {"has_digit": cell.rlike(java_regex(r"\d")), "has_at": cell.contains("@")}


def prefilter_guards(types, has_digit: Column, has_at: Column) -> dict:
    """Per-type guard from the prefilter facts (exact: a guard never hides a match)."""
    return {t: (has_at if t == "EMAIL" else has_digit) for t in types}


def and_guards(a: dict, b: dict) -> dict:
    out = dict(a)
    for t, g in b.items():
        out[t] = g if t not in out else (out[t] & g)
    return out


# ------------------------------------------------------------ text of a cell
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def text_kind(dtype: T.DataType) -> str | None:
    """How a column is scanned: 'text', 'number', or None (cannot hold a match)."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)) or isinstance(dtype, NESTED_TYPES):
        return "text"
    if isinstance(dtype, NUMERIC_TYPES):
        return "number"
    return None


def as_text(c: Column, dtype: T.DataType) -> Column:
    """String form of a cell, close to Python's ``str(cell)`` for what the patterns can see."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return c
    if isinstance(dtype, NESTED_TYPES):
        return F.to_json(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        # Spark prints 1e7 <= |x| < 1e16 in E-notation, Python in plain digits
        # (T3); the card pattern can only see the plain form, so render it.
        plain = F.concat(F.regexp_replace(d.cast("decimal(38,6)").cast("string"), r"\.?0+$", ""), F.lit(".0"))
        integral = (F.abs(d) >= 1e7) & (F.abs(d) < 1e16) & (d == F.floor(d))
        return F.when(integral, plain).otherwise(d.cast("string"))
    return c.cast("string")


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_text_sql(name: str, dtype: T.DataType) -> str:
    """``as_text`` as SQL text (one parse on the JVM instead of many calls per column)."""
    c = sql_ident(name)
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return c
    if isinstance(dtype, NESTED_TYPES):
        return f"to_json({c})"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = f"CAST({c} AS DOUBLE)"
        plain = f"concat(regexp_replace(CAST(CAST({d} AS DECIMAL(38,6)) AS STRING), '\\\\.?0+$', ''), '.0')"
        return (f"CASE WHEN abs({d}) >= 1e7 AND abs({d}) < 1e16 AND {d} = floor({d}) THEN {plain} "
                f"ELSE CAST({d} AS STRING) END")
    return f"CAST({c} AS STRING)"


# --------------------------------------------------------------- encryption
def encrypt_token(v: Column, key: Column) -> Column:
    """Recoverable token, base64 of AES-GCM (random IV, authenticated)."""
    return F.base64(F.aes_encrypt(v, key, F.lit("GCM")))


def decrypt_token(tok: Column, key: Column) -> Column:
    """C20: bulk decrypt; a bad or foreign token decrypts to null, an empty one is an error."""
    plain = F.try_aes_decrypt(F.unbase64(tok), key, F.lit("GCM")).cast("string")
    return F.when(tok == "", F.raise_error(F.lit("empty token: nothing to decrypt")).cast("string")).otherwise(plain)


def display_token(tok: Column) -> Column:
    """Short display form ``ENC[<first 24 chars>...]``."""
    return F.concat(F.lit("ENC["), F.substring(tok, 1, 24), F.lit("...]"))

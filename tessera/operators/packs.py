"""Industry packs: cross-column business rules (rows B8, F1-F11).

A pack is a list of rules; a rule exists only when its columns resolve
(first column in table order whose name contains a keyword, or an explicit
override).  All rules of a pack are counted in one ``groupBy(dataset).agg``;
the violating rows themselves stay a DataFrame (``violations``), never a list
on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import frame
from ..frame import DATASET, col
from .quality import find_column, is_numeric

# ---------------------------------------------------------------------------
# FIXED VALUES -- column keywords, check names and detail texts of the packs.
# ---------------------------------------------------------------------------
ECOMMERCE_KEYWORDS = {
    "order": ["order_date", "order_time", "purchase_date"],
    "ship": ["ship_date", "shipped_date", "delivery_date", "dispatch"],
    "price": ["price", "amount", "total", "subtotal", "revenue"],
    "quantity": ["quantity", "qty", "units", "count"],
    "signup": ["signup_date", "created_at", "registration", "join_date"],
}
FINANCE_KEYWORDS = {
    "subtotal": ["subtotal", "sub_total", "net", "base_amount"],
    "tax": ["tax", "vat", "gst", "sales_tax"],
    "total": ["total", "grand_total", "amount_due", "invoice_total"],
    "balance": ["balance", "outstanding", "due", "owed"],
}
HEALTHCARE_KEYWORDS = {
    "age": ["age", "patient_age"],
    "admission": ["admission", "admit_date", "check_in"],
    "discharge": ["discharge", "discharge_date", "check_out"],
    "dosage": ["dosage", "dose", "medication_amount"],
}
TEXTS = {
    "ship_after_order": ("Ship date after order date", "{n} row(s) shipped before order"),
    "price_nonneg": ("Prices non-negative ({c})", "{n} negative price(s)"),
    "quantity_int": ("Quantity is positive integer ({c})", "{n} invalid quantity row(s)"),
    "signup_past": ("Signup dates are in the past ({c})", "{n} future-dated row(s)"),
    "tax_rate": ("Tax = {rate}% of subtotal", "{n} incorrect tax row(s)"),
    "total_balance": ("Total = subtotal + tax", "{n} row(s) where total doesn't balance"),
    "balance_nonneg": ("No negative balances ({c})", "{n} negative balance(s)"),
    "age_range": ("Patient age in range 0-130 ({c})", "{n} implausible age(s)"),
    "discharge_after_admit": ("Discharge after admission", "{n} discharged before admitted"),
    "dosage_positive": ("Dosage positive ({c})", "{n} zero/negative dosage(s)"),
}
ALL_OK = "All OK"
DEFAULT_TAX_RATE = 0.07
MONEY_TOLERANCE = 0.02
MAX_PATIENT_AGE = 130
# Forms of dates in text that are tried after ISO ones, month before day.
DATE_FORMATS = ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy"]
# ---------------------------------------------------------------------------

RESULT_SCHEMA = ("dataset string, pack string, rule_idx int, rule string, check string, passed boolean, "
                 "bad_count bigint, detail string")


@dataclass
class Rule:
    rule: str
    check: str
    bad: Column          # row violates the rule
    detail: str          # template with {n}


def to_ts(c: str, dtype: T.DataType, formats: list[str] | None = None) -> Column:
    """Coercing date parse, ISO first, then ``formats``: unparsable -> null."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col(c).cast("timestamp")
    s = col(c).cast("string")
    parsed = [F.try_to_timestamp(s)] + [F.try_to_timestamp(s, F.lit(f)) for f in (DATE_FORMATS if formats is None else formats)]
    return F.coalesce(*parsed)


def round2(x: Column) -> Column:
    """Round to 2 decimals the way a vectorised ``Series.round(2)`` does (``rint(x*100)/100``)."""
    return F.rint(x * 100.0) / 100.0


def _num(df, c):
    return c is not None and is_numeric(dict((f.name, f.dataType) for f in df.schema.fields)[c])


def _val(df, c) -> Column:
    """A numeric column, NaN as null."""
    return frame.present(c, df.schema[c].dataType)


def ecommerce_rules(df: DataFrame, overrides: dict | None = None, as_of: Column | None = None,
                    formats: list[str] | None = None) -> list[Rule]:
    """F1-F4."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fc = lambda role: find_column(df, *ECOMMERCE_KEYWORDS[role], overrides=overrides, role=role)
    rules = []
    o, s = fc("order"), fc("ship")
    if o and s:
        ot, st = to_ts(o, types[o], formats), to_ts(s, types[s], formats)
        rules.append(Rule("ship_after_order", TEXTS["ship_after_order"][0],
                          ot.isNotNull() & st.isNotNull() & (st < ot), TEXTS["ship_after_order"][1]))
    p = fc("price")
    if _num(df, p):
        rules.append(Rule("price_nonneg", TEXTS["price_nonneg"][0].format(c=p), _val(df, p) < 0,
                          TEXTS["price_nonneg"][1]))
    q = fc("quantity")
    if _num(df, q):
        # a null quantity is invalid too (its remainder is not 0)
        rules.append(Rule("quantity_int", TEXTS["quantity_int"][0].format(c=q),
                          (_val(df, q) <= 0) | F.coalesce(_val(df, q).cast("double") % 1 != 0, F.lit(True)),
                          TEXTS["quantity_int"][1]))
    d = fc("signup")
    if d:
        now = as_of if as_of is not None else F.current_timestamp()
        rules.append(Rule("signup_past", TEXTS["signup_past"][0].format(c=d),
                          to_ts(d, types[d], formats) > now.cast("timestamp"), TEXTS["signup_past"][1]))
    return rules


def finance_rules(df: DataFrame, overrides: dict | None = None, tax_rate: float = DEFAULT_TAX_RATE,
                  **_) -> list[Rule]:
    """F5-F7 (``total`` resolves by first match unless overridden)."""
    fc = lambda role: find_column(df, *FINANCE_KEYWORDS[role], overrides=overrides, role=role)
    sub, tax, tot, bal = fc("subtotal"), fc("tax"), fc("total"), fc("balance")
    rules = []
    if sub and tax and _num(df, sub) and _num(df, tax):
        exp = round2(_val(df, sub) * F.lit(float(tax_rate)))
        rules.append(Rule("tax_rate", TEXTS["tax_rate"][0].format(rate=int(tax_rate * 100)),
                          F.abs(_val(df, tax) - exp) > MONEY_TOLERANCE, TEXTS["tax_rate"][1]))
    if sub and tax and tot and all(_num(df, c) for c in (sub, tax, tot)):
        exp = round2(_val(df, sub) + _val(df, tax))
        rules.append(Rule("total_balance", TEXTS["total_balance"][0],
                          F.abs(_val(df, tot) - exp) > MONEY_TOLERANCE, TEXTS["total_balance"][1]))
    if _num(df, bal):
        rules.append(Rule("balance_nonneg", TEXTS["balance_nonneg"][0].format(c=bal), _val(df, bal) < 0,
                          TEXTS["balance_nonneg"][1]))
    return rules


def healthcare_rules(df: DataFrame, overrides: dict | None = None, formats: list[str] | None = None,
                     **_) -> list[Rule]:
    """F8-F10."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fc = lambda role: find_column(df, *HEALTHCARE_KEYWORDS[role], overrides=overrides, role=role)
    rules = []
    a = fc("age")
    if _num(df, a):
        rules.append(Rule("age_range", TEXTS["age_range"][0].format(c=a),
                          (_val(df, a) < 0) | (_val(df, a) > MAX_PATIENT_AGE), TEXTS["age_range"][1]))
    ad, di = fc("admission"), fc("discharge")
    if ad and di:
        at, dt = to_ts(ad, types[ad], formats), to_ts(di, types[di], formats)
        rules.append(Rule("discharge_after_admit", TEXTS["discharge_after_admit"][0],
                          at.isNotNull() & dt.isNotNull() & (dt < at), TEXTS["discharge_after_admit"][1]))
    d = fc("dosage")
    if _num(df, d):
        rules.append(Rule("dosage_positive", TEXTS["dosage_positive"][0].format(c=d), _val(df, d) <= 0,
                          TEXTS["dosage_positive"][1]))
    return rules


PACKS = {"ecommerce": ecommerce_rules, "finance": finance_rules, "healthcare": healthcare_rules}


def pack_rules(df: DataFrame, pack: str, **opts) -> list[Rule]:
    """rules of a pack by name."""
    if pack not in PACKS:
        raise ValueError(f"unknown pack {pack!r}; choose from {sorted(PACKS)}")
    return PACKS[pack](frame.with_dataset(df), **opts)


def pack_aggs(rules: list[Rule], prefix: str = "b") -> list[Column]:
    """Violation counts of every rule, to run inside one ``groupBy(dataset).agg``."""
    return [F.count_if(F.coalesce(r.bad, F.lit(False))).alias(f"{prefix}{i}") for i, r in enumerate(rules)]


def pack_rows(agg: DataFrame, rules: list[Rule], pack: str, prefix: str = "b") -> DataFrame:
    """F11 result rows from the aggregate row of each dataset."""
    if not rules:
        return agg.sparkSession.createDataFrame([], RESULT_SCHEMA)
    rows = []
    for i, r in enumerate(rules):
        b = F.col(f"{prefix}{i}")
        head, tail = r.detail.split("{n}")
        rows.append(F.struct(F.lit(pack).alias("pack"), F.lit(i).alias("rule_idx"), F.lit(r.rule).alias("rule"),
                             F.lit(r.check).alias("check"), (b == 0).alias("passed"), b.alias("bad_count"),
                             F.when(b == 0, F.lit(ALL_OK))
                             .otherwise(F.concat(F.lit(head), b.cast("string"), F.lit(tail))).alias("detail")))
    return agg.select(DATASET, F.explode(F.array(*rows)).alias("r")).select(DATASET, "r.*")


def run_pack(df: DataFrame, pack: str, **opts) -> DataFrame:
    """one result row per (dataset, rule): passed, bad-row count, detail."""
    df = frame.with_dataset(df)
    rules = pack_rules(df, pack, **opts)
    if not rules:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    return pack_rows(df.groupBy(DATASET).agg(*pack_aggs(rules)), rules, pack)


def violations(df: DataFrame, pack: str, rule: str, **opts) -> DataFrame:
    """The rows that fail one rule of a pack (all columns kept, keys included)."""
    df = frame.with_dataset(df)
    for r in pack_rules(df, pack, **opts):
        if r.rule == rule:
            return df.where(F.coalesce(r.bad, F.lit(False)))
    raise ValueError(f"rule {rule!r} not present in pack {pack!r} for this table")


def pack_penalty(results: DataFrame) -> DataFrame:
    """I4: min(5 x failed rules, 20) per dataset (rules that could not run don't count)."""
    return (results.groupBy(DATASET)
            .agg(F.least(F.count_if(F.col("passed") == F.lit(False)) * 5, F.lit(20)).cast("int").alias("pack_penalty"),
                 F.count_if(F.col("passed") == F.lit(False)).alias("pack_failed")))

"""Registered queries over the driver's tables (see ``__spark_entry__``).

Each query takes ``(spark, sf_dir)`` and returns a DataFrame built from the
given parquet tables only; its work grows with them.  The matching DuckDB SQL
lives in :mod:`tessera.plans.oracle_queries`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import spread
from ..functions import pii as P
from ..operators import drift as D
from ..operators import duplicates as G
from ..operators import gold as J
from ..operators import packs as FP
from ..operators import quality as Q
from ..operators import remediate as R
from ..operators import report as K
from ..operators import scan as S
from ..operators import score as I
from ..sources import io as A
from ..session import scratch_path
from . import pipeline as PL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ datasets
def documents_ds(spark, sf_dir) -> DataFrame:
    """``documents`` keyed by ``doc_id``, one dataset per ``source``."""
    return (spread(table(spark, sf_dir, "documents"))
            .select(F.col("source").alias("dataset"), "doc_id", "text", "lang", "n_chars"))


def pages_ds(spark, sf_dir) -> DataFrame:
    """``pages`` keyed by ``page_id``, one dataset for the whole table."""
    return spread(table(spark, sf_dir, "pages")).select(F.lit("pages").alias("dataset"), "page_id", "url", "html")


def doc_findings(spark, sf_dir, profile="cli", sensitivity="high") -> DataFrame:
    return S.scan_pii(documents_ds(spark, sf_dir), profile, sensitivity, key="doc_id")


# ------------------------------------------------------------------- PII scan
def q_pii_findings(spark, sf_dir):
    """D1 + B1-B3 + C1-C11: every finding in ``documents`` (cli profile, high)."""
    return doc_findings(spark, sf_dir)


def q_pii_counts(spark, sf_dir):
    """D3 by risk: findings per dataset, type and risk."""
    return (doc_findings(spark, sf_dir).groupBy("dataset", "pii_type", "risk")
            .agg(F.count(F.lit(1)).alias("n")))


def q_pii_risk_counts(spark, sf_dir):
    """HIGH / MEDIUM / LOW per dataset, zero rows kept for clean datasets."""
    return S.risk_counts(doc_findings(spark, sf_dir), documents_ds(spark, sf_dir))


def q_pii_by_type(spark, sf_dir):
    """D3 + D4: instances and dominant risk per type."""
    return S.count_by_type(doc_findings(spark, sf_dir))


def q_pii_top15(spark, sf_dir):
    """D2 + D5: first 15 findings per type in report order, with overflow."""
    return (S.top_per_type(doc_findings(spark, sf_dir), 15)
            .select("dataset", "pii_type", "rank", "risk", "column", "row_key", "match_idx", "masked",
                    "more_instances"))


def q_pii_pages_function(spark, sf_dir):
    """D1 with the ``function`` profile at medium sensitivity over ``pages``."""
    return S.scan_pii(pages_ds(spark, sf_dir), "function", "medium", key="page_id")


# --------------------------------------------------------- derived datasets
def customer_notes_ds(spark, sf_dir) -> DataFrame:
    """``customer`` with a notes text derived from its keys: SSN-, date-, passport- and
    IBAN-shaped values (the driver data holds none), including excluded SSN areas."""
    c = table(spark, sf_dir, "customer")
    s = lambda e: e.cast("string")
    notes = F.concat(
        F.lit("SSN "), F.lpad(s(F.col("c_custkey") % 1000), 3, "0"), F.lit("-"),
        F.lpad(s(F.col("c_nationkey")), 2, "0"), F.lit("-"), F.lpad(s(F.col("c_custkey") % 10000), 4, "0"),
        F.lit(" born "), s(F.col("c_nationkey") % 12 + 1), F.lit("/"), s(F.col("c_custkey") % 28 + 1),
        F.lit("/19"), F.lpad(s(F.col("c_custkey") % 100), 2, "0"),
        F.lit(" passport "), F.upper(F.substring("c_mktsegment", 1, 2)), F.lpad(s(F.col("c_custkey")), 7, "0"),
        F.lit(" iban DE"), F.lpad(s(F.col("c_nationkey")), 2, "0"), F.lit("BANK"),
        F.lpad(s(F.col("c_custkey")), 10, "0"))
    return c.select(F.lit("customer").alias("dataset"), "c_custkey", "c_name", notes.alias("notes"))


def customer_quality_ds(spark, sf_dir) -> DataFrame:
    """``customer`` renamed so the name rules fire: id, email, age, zip, revenue, score."""
    c = table(spark, sf_dir, "customer")
    email = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.regexp_replace(F.lower("c_name"), "#", "_"))
             .otherwise(F.concat(F.regexp_replace(F.lower("c_name"), "#", "."), F.lit("@example.com"))))
    zipc = (F.when(F.col("c_nationkey") == 7, F.lit("XXXXX"))
            .otherwise(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")))
    return c.select(F.col("c_mktsegment").alias("dataset"),
                    F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_custkey")).alias("customer_id"),
                    F.col("c_name").alias("name"), email.alias("email"),
                    (F.col("c_nationkey") * 6 - 20).alias("age"), zipc.alias("zip_code"),
                    F.col("c_acctbal").alias("revenue"), F.col("c_nationkey").alias("score"))


def lineorders(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def ecommerce_ds(spark, sf_dir) -> DataFrame:
    j = lineorders(spark, sf_dir)
    return j.select(F.col("l_returnflag").alias("dataset"), "l_orderkey", "l_linenumber",
                    F.col("o_orderdate").alias("order_date"), F.col("l_shipdate").alias("ship_date"),
                    (F.col("l_extendedprice") * (F.col("l_discount") * 10 - 0.5)).alias("price"),
                    (F.col("l_quantity") - 3).alias("quantity"), F.col("o_orderdate").alias("signup_date"))


def finance_ds(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("dataset"), "l_orderkey", "l_linenumber",
                     F.col("l_extendedprice").alias("subtotal"),
                     (F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
                     (F.col("l_extendedprice") * (1 + F.col("l_tax")) - F.col("l_discount")).alias("total"),
                     (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("balance"))


def healthcare_ds(spark, sf_dir) -> DataFrame:
    j = lineorders(spark, sf_dir)
    return j.select(F.col("o_orderpriority").alias("dataset"), "l_orderkey", "l_linenumber",
                    (F.col("l_quantity") * 3 - 10).alias("patient_age"),
                    F.col("o_orderdate").alias("admission_date"), F.col("l_shipdate").alias("discharge_date"),
                    F.col("l_discount").alias("dosage"))


ECOM_AS_OF = "2000-01-01 00:00:00"
FINANCE_COLUMNS = {"subtotal": "subtotal", "tax": "tax", "total": "total", "balance": "balance"}
CUSTOM_RULES = [
    {"column": "o_orderpriority", "type": "not_null"},
    {"column": "o_totalprice", "type": "between", "min": 1000, "max": 400000},
    {"column": "o_orderpriority", "type": "regex", "pattern": "^[1-3]-"},
    {"column": "o_custkey", "type": "unique"},
    {"column": "o_orderkey", "type": "unique"},
    {"column": "no_such_column", "type": "not_null"},
    {"column": "o_totalprice", "type": "between", "min": 0},
]


# ---------------------------------------------------- PII on derived text
def q_pii_customer_notes(spark, sf_dir):
    """SSN / DOB / PASSPORT / IBAN findings and masks (cli, high)."""
    return S.scan_pii(customer_notes_ds(spark, sf_dir), "cli", "high", key="c_custkey")


# -------------------------------------------------------------- remediation
def q_mask_documents(spark, sf_dir):
    """D7 + C12-C18: documents with every HIGH/MEDIUM match masked in place (no dedup)."""
    return R.remediate(documents_ds(spark, sf_dir), "cli", "high", key="doc_id", dedup_rows=False)


def q_mask_documents_function(spark, sf_dir):
    """D7 with the function profile's masks (DOB prefix, fixed bullets), high sensitivity."""
    return R.remediate(documents_ds(spark, sf_dir), "function", "high", key="doc_id", dedup_rows=False)


def q_encrypt_roundtrip(spark, sf_dir):
    """C19-C21 + D8: HIGH matches become AES-GCM tokens that decrypt back; MEDIUM are masked.

    Per dataset: HIGH findings, tokens that decrypt to the raw value, raw HIGH
    values still present in the encrypted text (must be 0), display tokens of
    the right shape.  A per-run key is generated when none is configured.
    """
    import base64
    import os
    ds = customer_notes_ds(spark, sf_dir)
    conf_key = spark.conf.get(R.KEY_CONF, None)
    key = R.encryption_key(spark, conf_key or base64.b64encode(os.urandom(32)).decode())
    high = S.scan_pii(ds, "cli", "high", key="c_custkey").where(F.col("risk") == "HIGH")
    tok = high.withColumn("token", P.encrypt_token(F.col("raw_value"), key))
    checked = (tok.withColumn("back", R.decrypt_column(F.col("token"), key))
               .withColumn("shown", P.display_token(F.col("token"))))
    enc = R.remediate(ds, "cli", "high", key="c_custkey", dedup_rows=False, encrypt_key=key)
    # one row per customer on one side, several findings on the other: never collected as a broadcast, whatever the file's size says
    shown = enc.select(F.col("c_custkey").alias("row_key"), F.col("notes").alias("enc_notes")).hint("merge")
    resid = (high.join(shown, "row_key")
             .groupBy("dataset").agg(F.count_if(F.col("enc_notes").contains(F.col("raw_value"))).alias("residual")))
    return (checked.groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("high_findings"),
                 F.count_if(F.col("back") == F.col("raw_value")).alias("decrypted_ok"),
                 F.count_if(F.col("shown").rlike(r"^ENC\[.{24}\.\.\.\]$")).alias("display_ok"))
            .join(resid, "dataset", "left"))


def q_dedup_documents(spark, sf_dir):
    """Documents without exact repeats per source (first doc kept)."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), "doc_id", "text", "lang")
    return R.dedup(d, key="doc_id").select("dataset", "doc_id", "lang", F.length("text").alias("text_len"))


def q_remediate_documents(spark, sf_dir):
    """D7 + D9 together: dedup on original values, then mask; keys and masked lengths."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), "doc_id", "text", "lang")
    r = R.remediate(d, "cli", "high", key="doc_id")
    return r.select("dataset", "doc_id", "lang", F.length("text").alias("text_len"))


# ------------------------------------------------------------------ quality
def q_quality_suite(spark, sf_dir):
    """Generated expectation suite per market segment."""
    return Q.run_quality(customer_quality_ds(spark, sf_dir), "cli")


def q_quality_strict(spark, sf_dir):
    """Strict zero-violation checks (function profile)."""
    return Q.run_quality(customer_quality_ds(spark, sf_dir), "function")


def q_quality_legacy(spark, sf_dir):
    """E2, E4-E6 with the legacy profile's wording, order and keyword list."""
    return Q.run_quality(customer_quality_ds(spark, sf_dir), "legacy")


def q_quality_summary(spark, sf_dir):
    """E13 summary + K3 pass rate."""
    return Q.pass_rate(Q.summarize(Q.run_quality(customer_quality_ds(spark, sf_dir), "cli")))


def q_custom_rules(spark, sf_dir):
    """A18 + E8-E11: config rules (unknown columns and half-open ranges skipped)."""
    o = table(spark, sf_dir, "orders").withColumn("dataset", F.col("o_orderstatus"))
    return Q.run_quality(o, "cli", CUSTOM_RULES)


def q_quality_failures(spark, sf_dir):
    """Failed checks with unexpected count and percent."""
    o = table(spark, sf_dir, "orders").withColumn("dataset", F.col("o_orderstatus"))
    return Q.failures(Q.run_quality(o, "cli", CUSTOM_RULES))


# -------------------------------------------------------------------- packs
def q_pack_ecommerce(spark, sf_dir):
    """F1-F4 + F11 over lineitem joined to orders."""
    return FP.run_pack(ecommerce_ds(spark, sf_dir), "ecommerce",
                       as_of=F.lit(ECOM_AS_OF).cast("timestamp_ntz"))


def q_pack_finance(spark, sf_dir):
    """F5-F7 (column roles given explicitly)."""
    return FP.run_pack(finance_ds(spark, sf_dir), "finance", overrides=FINANCE_COLUMNS)


def q_pack_finance_first_match(spark, sf_dir):
    """F6 with first-match resolution: "total" resolves to ``subtotal``."""
    return FP.run_pack(finance_ds(spark, sf_dir), "finance")


def q_pack_healthcare(spark, sf_dir):
    """F8-F10."""
    return FP.run_pack(healthcare_ds(spark, sf_dir), "healthcare")


def q_pack_violations(spark, sf_dir):
    """Rows shipped before their order date, with their keys."""
    v = FP.violations(ecommerce_ds(spark, sf_dir), "ecommerce", "ship_after_order",
                      as_of=F.lit(ECOM_AS_OF).cast("timestamp_ntz"))
    return v.select("dataset", "l_orderkey", "l_linenumber",
                    F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
                    F.date_format("ship_date", "yyyy-MM-dd").alias("ship_date"))


# --------------------------------------------------------------- duplicates
def q_dup_documents(spark, sf_dir):
    """G1-G3 per source over (text, lang)."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), "text", "lang")
    return G.duplicates(d)


def q_dup_lineitem(spark, sf_dir):
    """G1-G3 over a low-cardinality lineitem projection (heavy repeats, hot groups)."""
    li = table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("dataset"), "l_returnflag",
                                                 "l_linestatus", "l_quantity")
    return G.duplicates(li)


# -------------------------------------------------------------------- drift
def orders_baseline_ds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("orders").alias("dataset"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                    "o_orderstatus")


def orders_current_ds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("orders").alias("dataset"), "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"),
                    "o_totalprice", "o_orderdate", "o_orderpriority",
                    F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("salary_band"))


BASELINE_AT = "2026-01-01 00:00:00"


def _drift(spark, sf_dir):
    base = D.with_saved_at(D.catalog(orders_baseline_ds(spark, sf_dir)), BASELINE_AT)
    cur = D.catalog(orders_current_ds(spark, sf_dir))
    return cur, D.latest_baseline(base)


def q_drift_changes(spark, sf_dir):
    """H1-H4: added (CRITICAL for sensitive names), removed, retyped columns."""
    cur, base = _drift(spark, sf_dir)
    return D.drift_changes(cur, base)


def q_drift_status(spark, sf_dir):
    """H5 + A17: status per dataset, baseline date and summary lists."""
    cur, base = _drift(spark, sf_dir)
    st = D.drift_status(cur, base)
    return st.select("dataset", "status", "baseline_date", F.array_join("added", ",").alias("added"),
                     F.array_join("removed", ",").alias("removed"),
                     F.array_join("type_changes", ",").alias("type_changes"), "alerts")


def q_type_profile(spark, sf_dir):
    """A3 + A16: observed types of an all-string copy of ``customer`` (whole-column promotion)."""
    c = table(spark, sf_dir, "customer")
    strings = c.select(F.lit("customer").alias("dataset"), *[F.col(x).cast("string").alias(x) for x in c.columns])
    return D.catalog(A.promote_numeric(strings))


# ------------------------------------------------------------------ scoring
SCORE_COLUMNS = ["dataset", "rows", "columns", "pii_high", "pii_medium", "pii_low", "total_checks", "passed",
                 "failed", "exact_duplicates", "near_duplicates", "duplicate_pct", "privacy", "quality",
                 "completeness", "pack_penalty", "overall", "grade"]


def doc_scan(spark, sf_dir, profile="cli", sensitivity="medium"):
    return PL.run_scan(documents_ds(spark, sf_dir), profile, sensitivity, key="doc_id")


def q_scores(spark, sf_dir):
    """I1-I6 + K6 + I7: health scores per documents source (cli profile, medium)."""
    return doc_scan(spark, sf_dir).scores.select(*SCORE_COLUMNS)


def q_scores_function(spark, sf_dir):
    """I1-I6 with the function profile (strict checks, no near duplicates)."""
    return doc_scan(spark, sf_dir, "function").scores.select(*SCORE_COLUMNS)


def q_recommendations(spark, sf_dir):
    """K1: ordered recommendations per dataset."""
    return K.recommendations(doc_scan(spark, sf_dir).scores)


def q_summary_table(spark, sf_dir):
    """K2: metric / value rows."""
    return K.summary_table(doc_scan(spark, sf_dir).scores)


def q_alerts(spark, sf_dir):
    """B10 + K4: alert records for datasets under 70 or with HIGH findings."""
    return I.alerts(doc_scan(spark, sf_dir).scores, 70)


def q_duplicate_band(spark, sf_dir):
    """K7: duplicate-rate colour band."""
    return K.duplicate_band(doc_scan(spark, sf_dir).scores)


def q_remediation_preview(spark, sf_dir):
    """B7 + B9: actionable findings and what they will become."""
    return S.remediation_preview(doc_scan(spark, sf_dir).findings)


def q_remediation_counts(spark, sf_dir):
    """Rows before -> after dedup and values to be changed, per source."""
    res = doc_scan(spark, sf_dir)
    return S.remediation_counts(res.findings, res.duplicates)


def q_protection_status(spark, sf_dir):
    """HIGH findings protected by encryption vs masked only."""
    r = R.protection_status(doc_scan(spark, sf_dir).scores, encrypted=True)
    return r.select("dataset", "protection_status.*")


# --------------------------------------------------------------------- gold
GOLD_T0 = "2026-07-22 00:00:00"


def gold_ds(spark, sf_dir) -> DataFrame:
    """Two scan runs over the documents sources as gold rows (A14), timestamps derived from keys."""
    first = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset")).agg(
        F.min("doc_id").cast("int").alias("first_doc"))
    runs = []
    for day, (profile, trigger) in enumerate([("cli", "http_manual"), ("function", "blob_automatic")]):
        sc = doc_scan(spark, sf_dir, profile).scores.join(first, "dataset")
        ts = F.lit(GOLD_T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(day), F.col("first_doc") % 24,
                                                                      F.col("first_doc") % 60)
        runs.append(J.gold_rows(sc, ts, trigger))
    return runs[0].unionByName(runs[1])


_GOLD: dict[tuple, str] = {}


def gold_table(spark, sf_dir) -> J.GoldTable:
    """The gold table of the two runs, written by one append per run; once written it is read by every J query of the session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _GOLD:
        path = scratch_path(spark, "gold")
        table_, rows = J.GoldTable(spark, path), gold_ds(spark, sf_dir)
        for run, trigger in enumerate(("http_manual", "blob_automatic")):
            table_.append(rows.where(F.col("trigger") == trigger), run)
        _GOLD[at] = path
    return J.GoldTable(spark, _GOLD[at])


def _fmt_ts(df):
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


def q_gold_rows(spark, sf_dir):
    """A14 + A15: the 15-column gold rows of two scan runs, read back in order of time."""
    return _fmt_ts(gold_table(spark, sf_dir).rows())


def q_gold_summary(spark, sf_dir):
    """Scans, averages, HIGH total, last score and trend, merged from the day states."""
    return J.summary(gold_table(spark, sf_dir))


def q_gold_appends(spark, sf_dir):
    """A14 + J1-J6: the summary after each append of a run; the second changes it without a scan."""
    rows = gold_table(spark, sf_dir).rows()
    grown, out = J.GoldTable(spark, scratch_path(spark, "gold-grown")), []
    for n, trigger in enumerate(("http_manual", "blob_automatic"), 1):
        grown.append(rows.where(F.col("trigger") == trigger), n)
        out.append(J.summary(J.GoldTable(spark, grown.path)).withColumn("appends", F.lit(n)))
        out[-1] = spark.createDataFrame(out[-1].collect(), out[-1].schema)      # one row, as it is after this append
    return out[0].unionByName(out[1])


def q_gold_score_series(spark, sf_dir):
    """Health score over time with grade zone."""
    return _fmt_ts(J.score_series(gold_table(spark, sf_dir).rows()))


def q_gold_pii_exposure(spark, sf_dir):
    """PII exposure per file, long form."""
    return J.pii_exposure(gold_table(spark, sf_dir))


def q_gold_quality_series(spark, sf_dir):
    """Quality score per scan with colour band."""
    return _fmt_ts(J.quality_series(gold_table(spark, sf_dir).rows()))


def q_gold_duplicate_series(spark, sf_dir):
    """Duplicate rate over time."""
    return _fmt_ts(J.duplicate_series(gold_table(spark, sf_dir).rows()))


def q_gold_dimensions(spark, sf_dir):
    """Dimension scores in long form."""
    return _fmt_ts(J.dimension_scores(gold_table(spark, sf_dir).rows()))


def q_gold_grades(spark, sf_dir):
    """Grade distribution."""
    return J.grade_distribution(gold_table(spark, sf_dir))


def q_gold_history(spark, sf_dir):
    """Display formatting of the history."""
    return J.display_history(gold_table(spark, sf_dir).rows())


# ------------------------------------------------------------ other tables
EVENT_RULES = [
    {"column": "user_id", "type": "not_null"},
    {"column": "value", "type": "between", "min": 0, "max": 400},
    {"column": "props", "type": "regex", "pattern": '^[{]"k": [0-9]+[}]$'},
    {"column": "event_id", "type": "unique"},
    {"column": "user_id", "type": "unique"},
]


def q_mask_pages(spark, sf_dir):
    """D7 over raw HTML pages with the function profile at medium sensitivity."""
    return R.remediate(pages_ds(spark, sf_dir), "function", "medium", key="page_id", dedup_rows=False)


def q_quality_events(spark, sf_dir):
    """E1, E2, E8-E11 over the events stream table, one dataset per event type."""
    e = table(spark, sf_dir, "events").withColumn("dataset", F.col("event_type"))
    return Q.run_quality(e, "cli", EVENT_RULES)


# ------------------------------------------------------ streaming and formats
def q_stream_scan(spark, sf_dir):
    """M1 + M2 + A6: documents staged as one folder per source, scanned by the file stream.

    Every task writes its own files into each source folder (no shuffle on the
    source, so a source holding a third of all rows is still written by all
    tasks).  A dataset must land whole in one micro-batch, so the stream takes
    every staged file in one ``availableNow`` batch; multi-batch runs and
    replays are covered by the streaming tests.
    Returns the gold rows the stream appended (without the wall-clock timestamp).
    """
    from ..streaming.autoscan import autoscan
    stage, out = scratch_path(spark, "stage"), scratch_path(spark, "autoscan")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang", "n_chars")
    docs.write.partitionBy("source").parquet(stage)
    q = autoscan(spark, stage, out, input_format="parquet", schema=spark.read.parquet(stage).schema,
                 profile="function", key="doc_id", dataset=F.col("source"), sensitivity="medium",
                 drop=["source"])
    q.awaitTermination()
    gold = spark.read.parquet(f"{out}/gold")
    return gold.drop("timestamp", "batch_id")


def q_format_roundtrip(spark, sf_dir):
    """A1-A10: customer -> csv -> (all-string read, numeric promotion) -> parquet -> json -> read back."""
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    p_csv, p_pq, p_js = (scratch_path(spark, n) for n in ("csv", "parquet", "json"))
    A.write_any(table(spark, sf_dir, "customer").select(*cols), p_csv, "csv")
    A.convert(spark, p_csv, p_pq, "parquet", in_fmt="csv")
    A.convert(spark, p_pq, p_js, "json", in_fmt="parquet")
    return A.read_any(spark, p_js, "json").select(*cols)


QUERIES = {
    "pii_findings": q_pii_findings,
    "pii_counts": q_pii_counts,
    "pii_risk_counts": q_pii_risk_counts,
    "pii_by_type": q_pii_by_type,
    "pii_top15": q_pii_top15,
    "pii_pages_function": q_pii_pages_function,
    "pii_customer_notes": q_pii_customer_notes,
    "mask_documents": q_mask_documents,
    "mask_documents_function": q_mask_documents_function,
    "encrypt_roundtrip": q_encrypt_roundtrip,
    "dedup_documents": q_dedup_documents,
    "remediate_documents": q_remediate_documents,
    "quality_suite": q_quality_suite,
    "quality_strict": q_quality_strict,
    "quality_legacy": q_quality_legacy,
    "quality_summary": q_quality_summary,
    "custom_rules": q_custom_rules,
    "quality_failures": q_quality_failures,
    "pack_ecommerce": q_pack_ecommerce,
    "pack_finance": q_pack_finance,
    "pack_finance_first_match": q_pack_finance_first_match,
    "pack_healthcare": q_pack_healthcare,
    "pack_violations": q_pack_violations,
    "dup_documents": q_dup_documents,
    "dup_lineitem": q_dup_lineitem,
    "drift_changes": q_drift_changes,
    "drift_status": q_drift_status,
    "type_profile": q_type_profile,
    "scores": q_scores,
    "scores_function": q_scores_function,
    "recommendations": q_recommendations,
    "summary_table": q_summary_table,
    "alerts": q_alerts,
    "duplicate_band": q_duplicate_band,
    "remediation_preview": q_remediation_preview,
    "remediation_counts": q_remediation_counts,
    "protection_status": q_protection_status,
    "gold_rows": q_gold_rows,
    "gold_summary": q_gold_summary,
    "gold_appends": q_gold_appends,
    "gold_score_series": q_gold_score_series,
    "gold_pii_exposure": q_gold_pii_exposure,
    "gold_quality_series": q_gold_quality_series,
    "gold_duplicate_series": q_gold_duplicate_series,
    "gold_dimensions": q_gold_dimensions,
    "gold_grades": q_gold_grades,
    "gold_history": q_gold_history,
    "mask_pages": q_mask_pages,
    "quality_events": q_quality_events,
    "stream_scan": q_stream_scan,
    "format_roundtrip": q_format_roundtrip,
}

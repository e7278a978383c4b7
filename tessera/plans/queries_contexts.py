"""Registered queries over customers with telling column names, context words and nulls: every branch of confidence
and risk, report order, pack penalty and drift in the recommendations, and stream options from the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import report as K
from ..operators import scan as S
from ..session import scratch_path
from ..streaming import autoscan as M
from . import oracle as O
from . import pipeline as PL
from .oracle_queries import described
from .queries import BASELINE_AT, table

COLUMNS = ["email", "contact_note", "serial_number", "employee_ssn", "remark"]


def contacts_ds(spark, sf_dir) -> DataFrame:
    """``customer`` with an e-mail column (exempt), a safe, a risky and two free columns, and remarks that are null or telling."""
    c = table(spark, sf_dir, "customer")
    part = lambda e, n: F.lpad(e.cast("string"), n, "0")
    email = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.org"))
    ssn = F.concat(part(F.col("c_custkey") % 999, 3), F.lit("-"), part(F.col("c_nationkey") + 1, 2), F.lit("-"), part(F.col("c_custkey") % 9999 + 1, 4))
    phone = F.concat(F.lit("415-"), part(F.col("c_custkey") % 1000, 3), F.lit("-"), part(F.col("c_custkey") % 10000, 4))
    return c.select(
        F.col("c_mktsegment").alias("dataset"), "c_custkey", email.alias("email"), F.concat(F.lit("write to "), email).alias("contact_note"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("ssn "), ssn)).otherwise(ssn).alias("serial_number"), ssn.alias("employee_ssn"),
        F.when(F.col("c_nationkey") % 3 != 0, F.concat(F.when(F.col("c_custkey") % 4 == 0, "confidential ").otherwise("call "), phone)).alias("remark"))


def q_pii_contexts(spark, sf_dir):
    """B2 + B3 + C9 + C10: findings with every confidence (1.0, 0.9, 0.75, 0.5, 0.15) and risk, e-mail column exempt, nulls dropped."""
    return S.scan_pii(contacts_ds(spark, sf_dir), "cli", "high", key="c_custkey")


def q_findings_order(spark, sf_dir):
    """The findings with their position in report order."""
    return S.ranked_findings(q_pii_contexts(spark, sf_dir)).select("dataset", "position", "risk", "column", "row_key", "match_idx", "pii_type")


def patients_ds(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("customer_id"), (F.col("c_nationkey") * 6 - 20).alias("patient_age"),
                    F.col("c_acctbal").alias("dosage"), F.concat(F.lit("seen "), F.col("c_name")).alias("remark"),
                    F.when(F.col("c_acctbal") > 5000, "high").otherwise("low").alias("salary_band"))


def _patient_scan(spark, sf_dir) -> PL.ScanResult:
    ds = patients_ds(spark, sf_dir)
    baseline = D.with_saved_at(D.catalog(ds.drop("salary_band")), BASELINE_AT)
    return PL.run_scan(ds, "cli", "medium", key="customer_id", pack="healthcare", baseline=baseline)


def q_pack_scores(spark, sf_dir):
    """I4 + H4 + I5: scores with the penalty of failed pack rules, and drift alerts, per dataset."""
    return _patient_scan(spark, sf_dir).scores.select("dataset", "rows", "failed", "pack_failed", "pack_penalty", "drift_alerts", "privacy",
                                                      "quality", "completeness", "overall", "grade")


def q_pack_recommendations(spark, sf_dir):
    """K1: recommendations with failed pack rules and critical drift."""
    return K.recommendations(_patient_scan(spark, sf_dir).scores, "healthcare")


def q_stream_options(spark, sf_dir):
    """M2 + A11: a stream whose sensitivity and output format come from the session; its silver rows read back."""
    incoming, out = scratch_path(spark, "incoming"), scratch_path(spark, "autoscan")
    contacts_ds(spark, sf_dir).withColumnRenamed("dataset", "segment").write.partitionBy("segment").parquet(incoming)
    spark.conf.set(M.CONF_SENSITIVITY, "high")
    spark.conf.set(M.CONF_OUTPUT_FORMAT, "json")
    try:
        segment = F.regexp_extract(F.col("_metadata.file_path"), "segment=([^/]+)/", 1)
        M.autoscan_folder(spark, incoming, out, profile="function", key="c_custkey", dataset=segment).awaitTermination()
    finally:
        spark.conf.unset(M.CONF_SENSITIVITY)
        spark.conf.unset(M.CONF_OUTPUT_FORMAT)
    doc = spark.read.json(f"{out}/results").select(F.col("file").alias("dataset"), "sensitivity", "output_format")
    silver = spark.read.json(f"{out}/silver").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("employee_ssn").startswith("XXX-XX-")).alias("masked_ssn"),
        F.count_if(F.col("contact_note").contains("***@")).alias("masked_email"), F.count_if(F.col("email").contains("***@")).alias("masked_own_email"),
        F.count_if(F.col("serial_number").contains("XXX-XX-")).alias("masked_serial"))
    return silver.join(doc, "dataset")


_SSN = ("lpad(CAST(c_custkey % 999 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || '-' || "
        "lpad(CAST(c_custkey % 9999 + 1 AS VARCHAR), 4, '0')")
_EMAIL = "'c' || CAST(c_custkey AS VARCHAR) || '@example.org'"
_PHONE = "'415-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"
_CELLS = O.cells_sql("customer", "c_mktsegment", "c_custkey", [
    ("email", f"({_EMAIL})", "text"), ("contact_note", f"('write to ' || {_EMAIL})", "text"),
    ("serial_number", f"(CASE WHEN c_custkey % 5 = 0 THEN 'ssn ' ELSE '' END || {_SSN})", "text"), ("employee_ssn", f"({_SSN})", "text"),
    ("remark", f"(CASE WHEN c_nationkey % 3 <> 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'confidential ' ELSE 'call ' END || {_PHONE} END)", "text")])
CONTEXTS = O.findings_sql(_CELLS, "cli", "high")
ORDER = f"""WITH f AS ({CONTEXTS})
SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, "column", row_key,
  match_idx) AS INTEGER) AS position, risk, "column", row_key, match_idx, pii_type FROM f"""

# the name "dosage" contains "age", so the 0-120 check applies to it as well; the key column is not checked
_PATIENTS = f"""p AS (SELECT c_mktsegment AS dataset, c_nationkey * 6 - 20 AS age, c_acctbal AS dosage FROM customer),
 a AS (SELECT dataset, count(*) AS rows, count_if(age < 0 OR age > 120) AS bad_age, count_if(dosage <= 0) AS bad_dosage,
   count_if(dosage < 0 OR dosage > 120) AS odd_dosage FROM p GROUP BY dataset),
 drift AS (SELECT count(*) AS alerts FROM ({described('x', "SELECT CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS salary_band FROM customer")})
           WHERE contains(col, 'salary')),
 s AS (SELECT dataset, rows, CAST((bad_age > 0)::INT + (odd_dosage > 0)::INT AS BIGINT) AS failed, 6 AS checks,
   CAST((bad_age > 0)::INT + (bad_dosage > 0)::INT AS BIGINT) AS pack_failed, alerts AS drift_alerts FROM a, drift),
 q AS (SELECT *, least(5 * pack_failed, 20) AS penalty, CAST(trunc((checks - failed)::DOUBLE / checks * 100.0::DOUBLE) AS INTEGER) AS quality FROM s),
 o AS (SELECT *, CAST(trunc(100 * 0.38::DOUBLE + quality * 0.38::DOUBLE + 100 * 0.18::DOUBLE) AS INTEGER) - penalty AS overall FROM q)"""
PACK_SCORES = f"""WITH {_PATIENTS}
SELECT dataset, rows, failed, pack_failed, CAST(penalty AS INTEGER) AS pack_penalty, drift_alerts, 100 AS privacy, quality, 100 AS completeness,
  CAST(overall AS INTEGER) AS overall, CASE WHEN overall >= 85 THEN 'A — Healthy' WHEN overall >= 70 THEN 'B — Acceptable'
  WHEN overall >= 55 THEN 'C — Needs attention' WHEN overall >= 40 THEN 'D — At risk' ELSE 'F — Critical' END AS grade FROM o"""
PACK_RECS = f"""WITH {_PATIENTS}
SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY k) AS INTEGER) AS position, level, message FROM (
  SELECT dataset, 1 AS k, 'WARNING' AS level, 'Fix ' || failed || ' quality rule failure(s).' AS message FROM o WHERE failed > 0
  UNION ALL SELECT dataset, 2, 'WARNING', pack_failed || ' business logic check(s) failed in the healthcare pack.' FROM o WHERE pack_failed > 0
  UNION ALL SELECT dataset, 3, 'CRITICAL', 'Schema drift — review newly added sensitive columns.' FROM o WHERE drift_alerts > 0
  UNION ALL SELECT dataset, 4, 'INFO', 'Automate scanning on every file upload.' FROM o WHERE overall < 70)"""
STREAM_OPTIONS = f"""WITH f AS ({O.findings_sql(_CELLS, 'function', 'high')}),
 m AS (SELECT dataset, count(DISTINCT CASE WHEN "column" = 'employee_ssn' THEN row_key END) AS masked_ssn,
  count(DISTINCT CASE WHEN "column" = 'contact_note' AND pii_type = 'EMAIL' THEN row_key END) AS masked_email,
  count(DISTINCT CASE WHEN "column" = 'serial_number' THEN row_key END) AS masked_serial FROM f WHERE risk <> 'LOW' GROUP BY dataset)
SELECT dataset, n AS rows, masked_ssn, masked_email, CAST(0 AS BIGINT) AS masked_own_email, masked_serial, 'high' AS sensitivity, 'json' AS output_format
FROM (SELECT c_mktsegment AS dataset, count(*) AS n FROM customer GROUP BY 1) JOIN m USING (dataset)"""

QUERIES = {
    "pii_contexts": q_pii_contexts,
    "findings_order": q_findings_order,
    "pack_scores": q_pack_scores,
    "pack_recommendations": q_pack_recommendations,
    "stream_options": q_stream_options,
}
SQL = {
    "pii_contexts": CONTEXTS,
    "findings_order": ORDER,
    "pack_scores": PACK_SCORES,
    "pack_recommendations": PACK_RECS,
    "stream_options": STREAM_OPTIONS,
}

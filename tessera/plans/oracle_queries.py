"""DuckDB oracle SQL for the registered queries (same names, same columns)."""

from __future__ import annotations

from . import oracle as O

DOC_CELLS = O.cells_sql("documents", "source", "doc_id", [
    ("text", "text", "text"),
    ("lang", "lang", "text"),
    ("n_chars", "CAST(n_chars AS VARCHAR)", "number"),
])
PAGE_CELLS = O.cells_sql("pages", "'pages'", "page_id", [
    ("url", "url", "text"),
    ("html", "html", "text"),
])

DOC_FINDINGS = O.findings_sql(DOC_CELLS, "cli", "high")


def _with_findings(body: str, findings: str = DOC_FINDINGS) -> str:
    return f"WITH findings AS ({findings})\n{body}"


SQL = {
    "pii_findings": DOC_FINDINGS,
    "pii_counts": _with_findings(
        "SELECT dataset, pii_type, risk, count(*) AS n FROM findings GROUP BY ALL"),
    "pii_risk_counts": _with_findings("""
SELECT d.dataset,
       CAST(coalesce(count_if(f.risk = 'HIGH'), 0) AS BIGINT) AS pii_high,
       CAST(coalesce(count_if(f.risk = 'MEDIUM'), 0) AS BIGINT) AS pii_medium,
       CAST(coalesce(count_if(f.risk = 'LOW'), 0) AS BIGINT) AS pii_low
FROM (SELECT DISTINCT source AS dataset FROM documents) d LEFT JOIN findings f USING (dataset)
GROUP BY d.dataset"""),
    "pii_by_type": _with_findings("""
SELECT dataset, pii_type, count(*) AS instances,
       CASE min(CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END)
            WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS dominant_risk
FROM findings GROUP BY ALL"""),
    "pii_top15": _with_findings("""
SELECT * FROM (
  SELECT dataset, pii_type,
         CAST(row_number() OVER (PARTITION BY dataset, pii_type ORDER BY
              CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, "column", row_key, match_idx)
              AS INTEGER) AS rank,
         risk, "column", row_key, match_idx, masked,
         CAST(greatest(count(*) OVER (PARTITION BY dataset, pii_type) - 15, 0) AS BIGINT) AS more_instances
  FROM findings) WHERE rank <= 15"""),
    "pii_pages_function": O.findings_sql(PAGE_CELLS, "function", "medium"),
}


# ------------------------------------------------------------ derived inputs
CUSTOMER_NOTES = ("'SSN ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || "
                  "lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"
                  " || ' born ' || CAST(c_nationkey % 12 + 1 AS VARCHAR) || '/' || CAST(c_custkey % 28 + 1 AS VARCHAR)"
                  " || '/19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' passport ' || "
                  "upper(substr(c_mktsegment, 1, 2)) || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || ' iban DE' || "
                  "lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || 'BANK' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')")
NOTES_CELLS = O.cells_sql("customer", "'customer'", "c_custkey", [
    ("c_name", "c_name", "text"), ("notes", CUSTOMER_NOTES, "text")])
NOTES_FINDINGS = O.findings_sql(NOTES_CELLS, "cli", "high")

CUSTOMER_Q = """SELECT c_mktsegment AS dataset, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey END AS customer_id,
  c_name AS name,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN replace(lower(c_name), '#', '_')
       ELSE replace(lower(c_name), '#', '.') || '@example.com' END AS email,
  c_nationkey * 6 - 20 AS age,
  CASE WHEN c_nationkey = 7 THEN 'XXXXX' ELSE lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS zip_code,
  c_acctbal AS revenue, c_nationkey AS score FROM customer"""

LINEORDERS = "lineitem JOIN orders ON l_orderkey = o_orderkey"
ECOM = f"""SELECT l_returnflag AS dataset, l_orderkey, l_linenumber, o_orderdate AS order_date, l_shipdate AS ship_date,
  l_extendedprice * (l_discount * 10 - 0.5::DOUBLE) AS price, l_quantity - 3 AS quantity, o_orderdate AS signup_date
  FROM {LINEORDERS}"""
FIN = """SELECT l_linestatus AS dataset, l_extendedprice AS subtotal, l_extendedprice * l_tax AS tax,
  l_extendedprice * (1 + l_tax) - l_discount AS total, l_extendedprice * (l_discount - 0.05::DOUBLE) AS balance
  FROM lineitem"""
HEALTH = f"""SELECT o_orderpriority AS dataset, l_quantity * 3 - 10 AS patient_age, o_orderdate AS admission_date,
  l_shipdate AS discharge_date, l_discount AS dosage FROM {LINEORDERS}"""


def D(x):
    return f"CAST({x} AS DOUBLE)"


def check_row(idx, name, column, kind, u=None, nn=None, mostly=None, strict=None):
    """One quality result row over a per-dataset aggregate CTE ``a`` (columns n_total + ...)."""
    if kind == "exist":
        return (f"SELECT dataset, {idx} AS check_idx, {O.q(name)} AS \"check\", {O.q(column)} AS \"column\", "
                f"true AS passed, n_total AS total, 0::BIGINT AS unexpected_count, NULL::DOUBLE AS unexpected_percent,"
                f" NULL::VARCHAR AS detail FROM a")
    denom = "n_total" if kind == "not_null" else nn
    passed = (f"({nn} = 0 OR {D(f'{nn} - {u}')} / {D(nn)} >= {mostly}::DOUBLE)" if mostly is not None else f"({u} = 0)")
    if strict:
        detail = f"CASE WHEN {u} > 0 THEN CAST({u} AS VARCHAR) || {O.q(strict)} ELSE 'OK' END"
    else:
        detail = f"CASE WHEN NOT {passed} THEN CAST({u} AS VARCHAR) || ' bad value(s)' END"
    return (f"SELECT dataset, {idx} AS check_idx, {O.q(name)} AS \"check\", {O.q(column)} AS \"column\", "
            f"{passed} AS passed, n_total AS total, CAST({u} AS BIGINT) AS unexpected_count, "
            f"CASE WHEN {denom} > 0 THEN {D(u)} * 100.0::DOUBLE / {D(denom)} END AS unexpected_percent, "
            f"{detail} AS detail FROM a")


EXIST, NN, RX, BT, UQ = ("column to exist", "column values to not be null", "column values to match regex",
                         "column values to be between", "column values to be unique")
EMAIL_RX = "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"
ZIP_RX = "^\\d{5}(-\\d{4})?$"

Q_CUSTOMER_AGG = f"""a AS (SELECT dataset, count(*) AS n_total,
  count(customer_id) AS nn_id, count_if(customer_id IS NULL) AS u_id,
  count(email) AS nn_email, count_if(email IS NOT NULL AND NOT regexp_matches(email, {O.q(EMAIL_RX)})) AS u_email,
  count(revenue) AS nn_rev, count_if(revenue IS NOT NULL AND revenue < 0) AS u_rev,
  count(score) AS nn_score, count_if(score IS NOT NULL AND score < 0) AS u_score,
  count(age) AS nn_age, count_if(age IS NOT NULL AND (age < 0 OR age > 120)) AS u_age,
  count(zip_code) AS nn_zip, count_if(zip_code IS NOT NULL AND NOT regexp_matches(zip_code, {O.q(ZIP_RX)})) AS u_zip
  FROM ({CUSTOMER_Q}) GROUP BY dataset)"""

QUALITY_SUITE = f"WITH {Q_CUSTOMER_AGG}\n" + "\nUNION ALL ".join(
    [check_row(i, EXIST, c, "exist") for i, c in enumerate(
        ["customer_id", "name", "email", "age", "zip_code", "revenue", "score"])]
    + [check_row(7, NN, "customer_id", "not_null", "u_id", "nn_id"),
       check_row(8, RX, "email", "regex", "u_email", "nn_email", 0.95),
       check_row(9, BT, "revenue", "between", "u_rev", "nn_rev"),
       check_row(10, BT, "score", "between", "u_score", "nn_score"),
       check_row(11, BT, "age", "between", "u_age", "nn_age"),
       check_row(12, RX, "zip_code", "regex", "u_zip", "nn_zip", 0.95)])

QUALITY_STRICT = f"WITH {Q_CUSTOMER_AGG}\n" + "\nUNION ALL ".join([
    check_row(0, "not null", "customer_id", "not_null", "u_id", "nn_id", strict=" null(s)"),
    check_row(1, "email format", "email", "regex", "u_email", "nn_email", strict=" invalid"),
    check_row(2, "age 0-120", "age", "between", "u_age", "nn_age", strict=" out-of-range"),
    check_row(3, "non-negative", "revenue", "between", "u_rev", "nn_rev", strict=" negative")])

QUALITY_SUMMARY = f"""WITH r AS ({QUALITY_SUITE})
SELECT dataset, count(*) AS total_checks, CAST(count_if(passed) AS BIGINT) AS passed,
       CAST(count_if(NOT passed) AS BIGINT) AS failed,
       count_if(NOT passed) = 0 AS overall_success,
       CAST(CASE WHEN count(*) > 0 THEN floor(count_if(passed)::DOUBLE / count(*) * 100.0::DOUBLE) ELSE 100 END AS INTEGER)
         AS pass_rate
FROM r GROUP BY dataset"""

CUSTOM_AGG = """a AS (SELECT o_orderstatus AS dataset, count(*) AS n_total,
  count(o_totalprice) AS nn_p, count_if(o_totalprice IS NOT NULL AND o_totalprice < 0) AS u_p0,
  count(o_orderpriority) AS nn_pr, count_if(o_orderpriority IS NULL) AS u_prn,
  count_if(o_totalprice IS NOT NULL AND (o_totalprice < 1000 OR o_totalprice > 400000)) AS u_pb,
  count_if(o_orderpriority IS NOT NULL AND NOT regexp_matches(o_orderpriority, '^[1-3]-')) AS u_rx
  FROM orders GROUP BY o_orderstatus),
uc AS (SELECT dataset, sum(n) AS nn_c, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS u_c FROM
  (SELECT o_orderstatus AS dataset, o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY ALL)
  GROUP BY dataset),
uo AS (SELECT dataset, sum(n) AS nn_o, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS u_o FROM
  (SELECT o_orderstatus AS dataset, o_orderkey, count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY ALL)
  GROUP BY dataset)"""
CUSTOM_CHECKS = "\nUNION ALL ".join(
    [check_row(i, EXIST, c, "exist") for i, c in enumerate(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])]
    + [check_row(6, BT, "o_totalprice", "between", "u_p0", "nn_p"),
       check_row(7, NN, "o_orderpriority", "not_null", "u_prn", "nn_pr"),
       check_row(8, BT, "o_totalprice", "between", "u_pb", "nn_p"),
       check_row(9, RX, "o_orderpriority", "regex", "u_rx", "nn_pr"),
       check_row(10, UQ, "o_custkey", "unique", "u_c", "nn_c"),
       check_row(11, UQ, "o_orderkey", "unique", "u_o", "nn_o")])
CUSTOM_RULES = (f"WITH {CUSTOM_AGG.replace('FROM orders GROUP BY o_orderstatus)', 'FROM orders GROUP BY o_orderstatus)', 1)},"
                f"\na2 AS (SELECT * FROM a JOIN uc USING (dataset) JOIN uo USING (dataset))\n"
                + CUSTOM_CHECKS.replace(" FROM a", " FROM a2"))
QUALITY_FAILURES = (f"WITH r AS ({CUSTOM_RULES})\nSELECT dataset, check_idx, \"check\", \"column\", unexpected_count, "
                    f"unexpected_percent FROM r WHERE NOT passed")


def pack_row(idx, rule, check, bad_col, head, tail, src="a"):
    return (f"SELECT dataset, {O.q(PACK_NAME[0])} AS pack, {idx} AS rule_idx, {O.q(rule)} AS rule, {O.q(check)} AS \"check\", "
            f"{bad_col} = 0 AS passed, CAST({bad_col} AS BIGINT) AS bad_count, "
            f"CASE WHEN {bad_col} = 0 THEN 'All OK' ELSE {O.q(head)} || CAST({bad_col} AS VARCHAR) || {O.q(tail)} END "
            f"AS detail FROM {src}")


PACK_NAME = ["ecommerce"]


def _pack(name, agg, rows):
    PACK_NAME[0] = name
    body = "\nUNION ALL ".join(pack_row(*r) for r in rows)
    return f"WITH a AS ({agg})\n{body}"


R2 = lambda x: f"(round_even(({x}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE)"

PACK_ECOM = _pack("ecommerce", f"""SELECT dataset,
  count_if(order_date IS NOT NULL AND ship_date IS NOT NULL AND ship_date < order_date) AS b0,
  count_if(price < 0) AS b1,
  count_if(quantity <= 0 OR coalesce(quantity % 1 <> 0, true)) AS b2,
  count_if(signup_date > TIMESTAMP '2000-01-01 00:00:00') AS b3
  FROM ({ECOM}) GROUP BY dataset""", [
    (0, "ship_after_order", "Ship date after order date", "b0", "", " row(s) shipped before order"),
    (1, "price_nonneg", "Prices non-negative (price)", "b1", "", " negative price(s)"),
    (2, "quantity_int", "Quantity is positive integer (quantity)", "b2", "", " invalid quantity row(s)"),
    (3, "signup_past", "Signup dates are in the past (signup_date)", "b3", "", " future-dated row(s)")])

PACK_FIN = _pack("finance", f"""SELECT dataset,
  count_if(abs(tax - {R2('subtotal * 0.07::DOUBLE')}) > 0.02::DOUBLE) AS b0,
  count_if(abs(total - {R2('subtotal + tax')}) > 0.02::DOUBLE) AS b1,
  count_if(balance < 0) AS b2
  FROM ({FIN}) GROUP BY dataset""", [
    (0, "tax_rate", "Tax = 7% of subtotal", "b0", "", " incorrect tax row(s)"),
    (1, "total_balance", "Total = subtotal + tax", "b1", "", " row(s) where total doesn't balance"),
    (2, "balance_nonneg", "No negative balances (balance)", "b2", "", " negative balance(s)")])

PACK_FIN_FIRST = _pack("finance", f"""SELECT dataset,
  count_if(abs(tax - {R2('subtotal * 0.07::DOUBLE')}) > 0.02::DOUBLE) AS b0,
  count_if(abs(subtotal - {R2('subtotal + tax')}) > 0.02::DOUBLE) AS b1,
  count_if(balance < 0) AS b2
  FROM ({FIN}) GROUP BY dataset""", [
    (0, "tax_rate", "Tax = 7% of subtotal", "b0", "", " incorrect tax row(s)"),
    (1, "total_balance", "Total = subtotal + tax", "b1", "", " row(s) where total doesn't balance"),
    (2, "balance_nonneg", "No negative balances (balance)", "b2", "", " negative balance(s)")])

PACK_HEALTH = _pack("healthcare", f"""SELECT dataset,
  count_if(patient_age < 0 OR patient_age > 130) AS b0,
  count_if(admission_date IS NOT NULL AND discharge_date IS NOT NULL AND discharge_date < admission_date) AS b1,
  count_if(dosage <= 0) AS b2
  FROM ({HEALTH}) GROUP BY dataset""", [
    (0, "age_range", "Patient age in range 0-130 (patient_age)", "b0", "", " implausible age(s)"),
    (1, "discharge_after_admit", "Discharge after admission", "b1", "", " discharged before admitted"),
    (2, "dosage_positive", "Dosage positive (dosage)", "b2", "", " zero/negative dosage(s)")])

PACK_VIOLATIONS = f"""SELECT dataset, l_orderkey, l_linenumber, strftime(order_date, '%Y-%m-%d') AS order_date,
  strftime(ship_date, '%Y-%m-%d') AS ship_date FROM ({ECOM})
  WHERE order_date IS NOT NULL AND ship_date IS NOT NULL AND ship_date < order_date"""

WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def NORM(x):
    return f"regexp_replace(lower(coalesce({x}, '')), '^{WS}+|{WS}+$', '', 'g')"


def dup_sql(src, cols, strings, dataset="dataset"):
    c = ", ".join(cols)
    n = ", ".join(f"{NORM(s)} AS n{i}" for i, s in enumerate(strings))
    return f"""WITH g AS (SELECT {dataset} AS dataset, {c}, count(*) AS n FROM ({src}) GROUP BY ALL),
e AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS exact_duplicates FROM g GROUP BY dataset),
nd AS (SELECT dataset, CAST(sum(m - 1) AS BIGINT) AS near_duplicates FROM
       (SELECT dataset, {n}, sum(n) AS m FROM g GROUP BY ALL) GROUP BY dataset)
SELECT e.dataset, total_rows, exact_duplicates, coalesce(near_duplicates, 0)::BIGINT AS near_duplicates,
       CASE WHEN total_rows > 0 THEN round_even(exact_duplicates * 100.0::DOUBLE / total_rows, 1) ELSE 0.0 END AS duplicate_pct
FROM e LEFT JOIN nd USING (dataset)"""


DUP_DOCS = dup_sql("SELECT source AS dataset, text, lang FROM documents", ["text", "lang"], ["text", "lang"])
DUP_LINE = dup_sql("SELECT 'lineitem' AS dataset, l_returnflag, l_linestatus, l_quantity FROM lineitem",
                   ["l_returnflag", "l_linestatus", "l_quantity"], ["l_returnflag", "l_linestatus"])

_DTYPE = """CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'int64' WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'float64'
  WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'datetime64[ns]' WHEN column_type = 'VARCHAR' THEN 'object' END"""


def described(dataset, query):
    """Columns and types of a query's result (its schema, not its rows)."""
    return f"SELECT '{dataset}' AS dataset, column_name AS col, {_DTYPE} AS dtype FROM (DESCRIBE {query})"


ORDERS_BEFORE = described("orders", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus FROM orders")
ORDERS_NOW = described("orders", """SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_totalprice, o_orderdate, o_orderpriority,
  CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS salary_band FROM orders""")
CUSTOMER_CELLS = """SELECT 'customer' AS dataset, v.col, v.ordinal, v.val FROM customer, LATERAL (VALUES ('c_custkey', 0, c_custkey::VARCHAR),
  ('c_name', 1, c_name), ('c_nationkey', 2, c_nationkey::VARCHAR), ('c_acctbal', 3, c_acctbal::VARCHAR), ('c_mktsegment', 4, c_mktsegment)) v(col, ordinal, val)"""


# ------------------------------------------------------------------ scores
def scores_sql(profile="cli", sensitivity="medium"):
    findings = O.findings_sql(DOC_CELLS, profile, sensitivity)
    cli = profile == "cli"
    checks = 3 if cli else 0
    near = ("(SELECT dataset, CAST(sum(m - 1) AS BIGINT) AS near_duplicates FROM (SELECT dataset, "
            f"{NORM('text')} AS a1, {NORM('lang')} AS a2, sum(n) AS m FROM g GROUP BY ALL) GROUP BY dataset)"
            if cli else "(SELECT DISTINCT dataset, 0::BIGINT AS near_duplicates FROM g)")
    return f"""WITH findings AS ({findings}),
risk AS (SELECT dataset, count_if(risk = 'HIGH') AS pii_high, count_if(risk = 'MEDIUM') AS pii_medium,
         count_if(risk = 'LOW') AS pii_low FROM findings GROUP BY dataset),
g AS (SELECT source AS dataset, text, lang, n_chars, count(*) AS n FROM documents GROUP BY ALL),
dx AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS exact_duplicates FROM g GROUP BY dataset),
nx AS {near},
b AS (SELECT dataset, rows, 3 AS columns, coalesce(pii_high, 0)::BIGINT AS pii_high,
        coalesce(pii_medium, 0)::BIGINT AS pii_medium, coalesce(pii_low, 0)::BIGINT AS pii_low,
        {checks}::BIGINT AS total_checks, {checks}::BIGINT AS passed, 0::BIGINT AS failed, exact_duplicates,
        coalesce(near_duplicates, 0)::BIGINT AS near_duplicates,
        CASE WHEN rows > 0 THEN round_even(exact_duplicates * 100.0::DOUBLE / rows, 1) ELSE 0.0 END AS duplicate_pct
      FROM dx LEFT JOIN risk USING (dataset) LEFT JOIN nx USING (dataset)),
c AS (SELECT *,
  CAST(greatest(0, least(100, 100 - CAST(trunc(CAST(pii_high + pii_medium AS DOUBLE) / greatest(rows, 1) * 50.0::DOUBLE) AS INTEGER)
       - least((pii_high + pii_medium) * 2, 60))) AS INTEGER) AS privacy,
  CAST(CASE WHEN total_checks > 0 THEN trunc(CAST(passed AS DOUBLE) / total_checks * 100.0::DOUBLE) ELSE 100 END AS INTEGER) AS quality,
  CAST(greatest(0, 100 - CAST(trunc(duplicate_pct * 2.0::DOUBLE) AS INTEGER)) AS INTEGER) AS completeness,
  0 AS pack_penalty FROM b),
d AS (SELECT *, CAST(greatest(0, least(100, CAST(trunc(privacy * 0.38::DOUBLE + quality * 0.38::DOUBLE
       + completeness * 0.18::DOUBLE) AS INTEGER) - pack_penalty)) AS INTEGER) AS overall FROM c)
SELECT *, CASE WHEN overall >= 85 THEN 'A — Healthy' WHEN overall >= 70 THEN 'B — Acceptable'
  WHEN overall >= 55 THEN 'C — Needs attention' WHEN overall >= 40 THEN 'D — At risk' ELSE 'F — Critical' END AS grade
FROM d"""


SCORES = scores_sql("cli")
SCORES_F = scores_sql("function")


def _on_scores(body, scores=SCORES):
    return f"WITH s AS ({scores})\n{body}"


RECS = _on_scores("""SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY k) AS INTEGER) AS position,
  level, message FROM (
  SELECT dataset, 1 AS k, 'CRITICAL' AS level, 'Mask/remove ' || pii_high || ' HIGH-confidence PII instance(s) immediately.' AS message FROM s WHERE pii_high > 0
  UNION ALL SELECT dataset, 2, 'WARNING', 'Review ' || pii_medium || ' MEDIUM-confidence PII finding(s).' FROM s WHERE pii_medium > 0
  UNION ALL SELECT dataset, 3, 'INFO', pii_low || ' LOW-confidence finding(s) — likely false positives.' FROM s WHERE pii_low > 0
  UNION ALL SELECT dataset, 4, 'WARNING', 'Fix ' || failed || ' quality rule failure(s).' FROM s WHERE failed > 0
  UNION ALL SELECT dataset, 5, 'WARNING', 'Deduplicate ' || exact_duplicates || ' exact row(s).' FROM s WHERE exact_duplicates > 0
  UNION ALL SELECT dataset, 8, 'INFO', 'Automate scanning on every file upload.' FROM s WHERE overall < 70
  UNION ALL SELECT dataset, 9, 'OK', 'Data is healthy. Automate monitoring to maintain this score.' FROM s
    WHERE NOT (pii_high > 0 OR pii_medium > 0 OR pii_low > 0 OR failed > 0 OR exact_duplicates > 0 OR overall < 70))""")
SUMMARY_TABLE = _on_scores("""SELECT dataset, metric, value FROM (
  SELECT dataset, 'Overall score' AS metric, CAST(overall AS VARCHAR) AS value FROM s
  UNION ALL SELECT dataset, 'Privacy', CAST(privacy AS VARCHAR) FROM s
  UNION ALL SELECT dataset, 'Quality', CAST(quality AS VARCHAR) FROM s
  UNION ALL SELECT dataset, 'Completeness', CAST(completeness AS VARCHAR) FROM s
  UNION ALL SELECT dataset, 'HIGH PII', CAST(pii_high AS VARCHAR) FROM s
  UNION ALL SELECT dataset, 'MEDIUM PII', CAST(pii_medium AS VARCHAR) FROM s
  UNION ALL SELECT dataset, 'Quality failures', CAST(failed AS VARCHAR) FROM s
  UNION ALL SELECT dataset, 'Exact duplicates', CAST(exact_duplicates AS VARCHAR) FROM s)""")
ALERTS = _on_scores("""SELECT dataset, overall, grade, pii_high, failed AS quality_failed, exact_duplicates
FROM s WHERE overall < 70 OR pii_high > 0""")
DUP_BAND = _on_scores("""SELECT dataset, duplicate_pct, CASE WHEN b >= 85 THEN 'green' WHEN b >= 70 THEN 'amber'
  WHEN b >= 55 THEN 'orange' ELSE 'red' END AS band FROM (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - duplicate_pct * 5.0::DOUBLE) AS b FROM s)""")
PROTECTION = _on_scores("""SELECT dataset, true AS encryption_enabled, CAST(pii_high AS INTEGER) AS high_risk_pii_protected,
  0 AS high_risk_pii_masked_only FROM s""")
DOC_FINDINGS_MEDIUM = O.findings_sql(DOC_CELLS, "cli", "medium")
PREVIEW = f"""WITH f AS ({DOC_FINDINGS_MEDIUM})
SELECT dataset, risk, "column", row_key, masked AS will_become FROM f WHERE risk IN ('HIGH', 'MEDIUM')"""

DUP_DOC_SCAN = dup_sql("SELECT source AS dataset, text, lang, n_chars FROM documents", ["text", "lang", "n_chars"], ["text", "lang"])
REMEDIATION_COUNTS = f"""SELECT d.dataset, d.total_rows AS rows_before, d.total_rows - d.exact_duplicates AS rows_after,
  coalesce(v.n, 0) AS values, coalesce(v.r, 0) AS rows_changed FROM ({DUP_DOC_SCAN}) d
LEFT JOIN (SELECT dataset, count(*) AS n, count(DISTINCT row_key) AS r FROM ({PREVIEW}) GROUP BY dataset) v USING (dataset)"""
GOLD = f"""WITH s1 AS ({SCORES}), s2 AS ({SCORES_F}),
fd AS (SELECT source AS dataset, CAST(min(doc_id) AS INTEGER) AS first_doc FROM documents GROUP BY source),
runs AS (
  SELECT s1.*, 0 AS day, 'http_manual' AS trigger, first_doc FROM s1 JOIN fd USING (dataset)
  UNION ALL SELECT s2.*, 1 AS day, 'blob_automatic' AS trigger, first_doc FROM s2 JOIN fd USING (dataset))
SELECT TIMESTAMP '2026-07-22 00:00:00' + to_days(day) + to_hours(first_doc % 24) + to_minutes(first_doc % 60) AS ts,
  dataset AS filename, trigger, CAST(rows AS BIGINT) AS rows, CAST(columns AS BIGINT) AS columns,
  overall AS health_score, grade, privacy AS privacy_score, quality AS quality_score,
  completeness AS completeness_score, CAST(pii_high AS INTEGER) AS high_pii, CAST(pii_medium AS INTEGER) AS medium_pii,
  CAST(pii_low AS INTEGER) AS low_pii, CAST(failed AS INTEGER) AS quality_failed, duplicate_pct FROM runs"""


def _on_gold(body):
    return f"WITH gd AS ({GOLD})\n{body}"


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"timestamp\""
SUMMARY = """SELECT {more}count(*) AS total_scans, round_even(avg(health_score), 1) AS avg_health_score,
  CAST(sum(high_pii) AS BIGINT) AS total_high_pii, round_even(avg(quality_score), 1) AS avg_quality_score,
  arg_max(health_score, strftime(ts, '%Y-%m-%d %H:%M:%S') || filename) AS last_score,
  CAST(CASE WHEN count(*) > 1 THEN arg_max(health_score, strftime(ts, '%Y-%m-%d %H:%M:%S') || filename)
       - arg_min(health_score, strftime(ts, '%Y-%m-%d %H:%M:%S') || filename) ELSE 0 END AS INTEGER) AS trend,
  CASE WHEN trend > 0 THEN '↑ ' || trend WHEN trend < 0 THEN '↓ ' || abs(trend) ELSE '→ stable' END AS trend_label
FROM {rows}"""
GOLD_SQL = {
    "gold_rows": _on_gold(f"SELECT {TS}, * EXCLUDE (ts) FROM gd"),
    "gold_summary": _on_gold(SUMMARY.format(more="", rows="gd")),
    "gold_appends": _on_gold(SUMMARY.format(more="1 AS appends, ", rows="gd WHERE trigger = 'http_manual'") + "\nUNION ALL BY NAME "
                             + SUMMARY.format(more="2 AS appends, ", rows="gd")),
    "gold_score_series": _on_gold(f"""SELECT {TS}, filename, health_score, CASE WHEN health_score >= 85 THEN 'A — Healthy'
  WHEN health_score >= 70 THEN 'B — Acceptable' ELSE 'Needs attention' END AS zone FROM gd"""),
    "gold_pii_exposure": _on_gold("""SELECT filename, risk, n FROM (
  SELECT filename, 'HIGH' AS risk, CAST(sum(high_pii) AS BIGINT) AS n FROM gd GROUP BY filename
  UNION ALL SELECT filename, 'MEDIUM', CAST(sum(medium_pii) AS BIGINT) FROM gd GROUP BY filename
  UNION ALL SELECT filename, 'LOW', CAST(sum(low_pii) AS BIGINT) FROM gd GROUP BY filename)"""),
    "gold_quality_series": _on_gold(f"""SELECT {TS}, filename, quality_score, CASE WHEN quality_score >= 85 THEN 'green'
  WHEN quality_score >= 70 THEN 'amber' WHEN quality_score >= 55 THEN 'orange' ELSE 'red' END AS band FROM gd"""),
    "gold_duplicate_series": _on_gold(f"SELECT {TS}, filename, duplicate_pct FROM gd"),
    "gold_dimensions": _on_gold(f"""SELECT {TS}, filename, dimension, score FROM (
  SELECT ts, filename, 'Privacy' AS dimension, privacy_score AS score FROM gd
  UNION ALL SELECT ts, filename, 'Quality', quality_score FROM gd
  UNION ALL SELECT ts, filename, 'Completeness', completeness_score FROM gd)"""),
    "gold_grades": _on_gold("""SELECT grade, count(*) AS scans,
  round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share FROM gd GROUP BY grade"""),
    "gold_history": _on_gold("""SELECT strftime(ts, '%Y-%m-%d %H:%M') AS "timestamp", filename, trigger,
  "rows", "columns", CAST(health_score AS VARCHAR) || '/100' AS health_score, grade, privacy_score, quality_score,
  completeness_score, high_pii, medium_pii, low_pii, quality_failed, duplicate_pct FROM gd"""),
}


def mask_sql(profile, sensitivity, src="documents", dataset="source", cols=(("text", "text"), ("lang", "lang"))):
    """Masked cells: fold replace over the cell's matches when its confidence is >= 0.40."""
    from ..profiles import get_profile
    prof = get_profile(profile)
    types = prof.active_types(sensitivity)
    outs = []
    for name, expr in cols:
        cls = O.column_class_sql(O.q(name), prof)
        conf = O.confidence_sql(cls, expr, prof)
        m = O.matches_sql(expr, "'text'", O.q(name), types, prof)
        outs.append(f"CASE WHEN {conf} >= 0.40 THEN list_reduce({m}, lambda acc, x: replace(acc, x.raw_value, x.masked),"
                    f" {expr}) ELSE {expr} END AS {name}")
    return outs


MASK_DOCS = ("SELECT source AS dataset, doc_id, " + ", ".join(mask_sql("cli", "high"))
             + ", n_chars FROM documents")
MASK_DOCS_F = ("SELECT source AS dataset, doc_id, " + ", ".join(mask_sql("function", "high"))
               + ", n_chars FROM documents")
DEDUP_DOCS = """SELECT source AS dataset, min(doc_id) AS doc_id, lang, CAST(length(text) AS INTEGER) AS text_len
FROM documents GROUP BY source, text, lang"""
REMEDIATE_DOCS = ("WITH dd AS (SELECT source, min(doc_id) AS doc_id, text, lang FROM documents GROUP BY source, text, lang),"
                  "\nm AS (SELECT source AS dataset, doc_id, " + ", ".join(mask_sql("cli", "high")) + " FROM dd)\n"
                  "SELECT dataset, doc_id, lang, CAST(length(text) AS INTEGER) AS text_len FROM m")
ENCRYPT = f"""WITH f AS ({NOTES_FINDINGS})
SELECT dataset, count(*) AS high_findings, count(*) AS decrypted_ok, count(*) AS display_ok, 0::BIGINT AS residual
FROM f WHERE risk = 'HIGH' GROUP BY dataset"""

SQL.update({
    "pii_customer_notes": NOTES_FINDINGS,
    "mask_documents": MASK_DOCS,
    "mask_documents_function": MASK_DOCS_F,
    "encrypt_roundtrip": ENCRYPT,
    "dedup_documents": DEDUP_DOCS,
    "remediate_documents": REMEDIATE_DOCS,
    "quality_suite": QUALITY_SUITE,
    "quality_strict": QUALITY_STRICT,
    "quality_summary": QUALITY_SUMMARY,
    "custom_rules": CUSTOM_RULES,
    "quality_failures": QUALITY_FAILURES,
    "pack_ecommerce": PACK_ECOM,
    "pack_finance": PACK_FIN,
    "pack_finance_first_match": PACK_FIN_FIRST,
    "pack_healthcare": PACK_HEALTH,
    "pack_violations": PACK_VIOLATIONS,
    "dup_documents": DUP_DOCS,
    "dup_lineitem": DUP_LINE,
    "scores": SCORES,
    "scores_function": SCORES_F,
    "recommendations": RECS,
    "summary_table": SUMMARY_TABLE,
    "alerts": ALERTS,
    "duplicate_band": DUP_BAND,
    "remediation_preview": PREVIEW,
    "remediation_counts": REMEDIATION_COUNTS,
    "protection_status": PROTECTION,
    **GOLD_SQL,
})

STREAM_GOLD = f"""WITH s AS ({SCORES_F})
SELECT dataset AS filename, 'blob_automatic' AS trigger, CAST(rows AS BIGINT) AS rows, CAST(columns AS BIGINT) AS columns,
  overall AS health_score, grade, privacy AS privacy_score, quality AS quality_score,
  completeness AS completeness_score, CAST(pii_high AS INTEGER) AS high_pii, CAST(pii_medium AS INTEGER) AS medium_pii,
  CAST(pii_low AS INTEGER) AS low_pii, CAST(failed AS INTEGER) AS quality_failed, duplicate_pct FROM s"""
FORMAT_ROUNDTRIP = """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
FROM customer"""
SQL.update({"stream_scan": STREAM_GOLD, "format_roundtrip": FORMAT_ROUNDTRIP})

EVENTS_AGG = """a AS (SELECT event_type AS dataset, count(*) AS n_total,
  count(event_id) AS nn_e, count_if(event_id IS NULL) AS u_en,
  count(user_id) AS nn_u, count_if(user_id IS NULL) AS u_un,
  count(value) AS nn_v, count_if(value IS NOT NULL AND (value < 0 OR value > 400)) AS u_v,
  count(props) AS nn_p, count_if(props IS NOT NULL AND NOT regexp_matches(props, '^[{]"k": [0-9]+[}]$')) AS u_p
  FROM events GROUP BY event_type),
ue AS (SELECT dataset, sum(n) AS nn_ue, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS u_ue FROM
  (SELECT event_type AS dataset, event_id, count(*) AS n FROM events WHERE event_id IS NOT NULL GROUP BY ALL)
  GROUP BY dataset),
uu AS (SELECT dataset, sum(n) AS nn_uu, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS u_uu FROM
  (SELECT event_type AS dataset, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL)
  GROUP BY dataset),
a2 AS (SELECT * FROM a JOIN ue USING (dataset) JOIN uu USING (dataset))"""
QUALITY_EVENTS = f"WITH {EVENTS_AGG}\n" + "\nUNION ALL ".join(
    [check_row(i, EXIST, c, "exist") for i, c in enumerate(
        ["event_id", "ts", "user_id", "event_type", "value", "props"])]
    + [check_row(6, NN, "event_id", "not_null", "u_en", "nn_e"),
       check_row(7, NN, "user_id", "not_null", "u_un", "nn_u"),
       check_row(8, NN, "user_id", "not_null", "u_un", "nn_u"),
       check_row(9, BT, "value", "between", "u_v", "nn_v"),
       check_row(10, RX, "props", "regex", "u_p", "nn_p"),
       check_row(11, UQ, "event_id", "unique", "u_ue", "nn_ue"),
       check_row(12, UQ, "user_id", "unique", "u_uu", "nn_uu")]).replace(" FROM a", " FROM a2")
MASK_PAGES = ("SELECT 'pages' AS dataset, page_id, "
              + ", ".join(mask_sql("function", "medium", cols=(("url", "url"), ("html", "html")))) + " FROM pages")
SQL.update({"mask_pages": MASK_PAGES, "quality_events": QUALITY_EVENTS})

QUALITY_LEGACY = f"WITH {Q_CUSTOMER_AGG}\n" + "\nUNION ALL ".join([
    check_row(0, "not null", "customer_id", "not_null", "u_id", "nn_id", strict=" null value(s)"),
    check_row(1, "email format", "email", "regex", "u_email", "nn_email", strict=" invalid email(s)"),
    check_row(2, "age range 0-120", "age", "between", "u_age", "nn_age", strict=" out-of-range age(s)"),
    check_row(3, "non-negative (revenue)", "revenue", "between", "u_rev", "nn_rev", strict=" negative value(s)"),
    check_row(4, "non-negative (score)", "score", "between", "u_score", "nn_score", strict=" negative value(s)")])
SQL.update({"quality_legacy": QUALITY_LEGACY})

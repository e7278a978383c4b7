"""Smaller operators: report order, preview, packs registry, run options, scan document, results history."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import packs as FP
from tessera.operators import report as K
from tessera.operators import scan as S
from tessera.plans.pipeline import run_scan, scan_document
from tessera.sources import io as A
from tessera.streaming.autoscan import CONF_OUTPUT_FORMAT, CONF_SENSITIVITY, run_options


def test_sort_findings_order(sample):
    rows = S.sort_findings(run_scan(sample, "cli", "medium").findings).collect()
    risks = [r.risk for r in rows]
    assert risks == sorted(risks, key={"HIGH": 0, "MEDIUM": 1, "LOW": 2}.get)
    assert [r.column for r in rows[:2]] == ["notes", "notes"]


def test_preview_limit(sample):
    assert K.preview(sample, 5).count() == 5


def test_unknown_pack(sample):
    with pytest.raises(ValueError, match="unknown pack"):
        FP.run_pack(sample, "retail")


def test_violations_rows(sample):
    bad = FP.violations(sample, "healthcare", "age_range").select("age").collect()
    assert sorted(r.age for r in bad) == [-3, 150]


def test_recommendations_sample(sample):
    recs = K.recommendations(run_scan(sample, "cli", "medium").scores).orderBy("position").collect()
    assert [r.level for r in recs] == ["CRITICAL", "INFO", "WARNING", "WARNING"]
    assert recs[0].message == "Mask/remove 2 HIGH-confidence PII instance(s) immediately."


def test_run_options_from_conf(spark):
    spark.conf.set(CONF_SENSITIVITY, "high")
    spark.conf.set(CONF_OUTPUT_FORMAT, "parquet")
    try:
        o = run_options(spark, "csv")
        assert (o["sensitivity"], o["output_format"], o["encrypt"], o["threshold"]) == ("high", "parquet", False, 70)
        assert run_options(spark, "json", sensitivity="low", output_format=None)["sensitivity"] == "low"
    finally:
        spark.conf.unset(CONF_SENSITIVITY)
        spark.conf.unset(CONF_OUTPUT_FORMAT)
    assert run_options(spark, "json")["output_format"] == "json"


def test_scan_document_and_history(spark, sample, tmp_path):
    doc = scan_document(run_scan(sample, "function", "medium"), "medium", trigger="http_manual")
    A.save_results(doc, str(tmp_path / "results"))
    A.save_results(doc.withColumn("file", F.lit("second.csv")), str(tmp_path / "results"))
    hist = A.results_history(spark, str(tmp_path / "results")).collect()
    assert len(hist) == 2 and hist[0].stored_at >= hist[1].stored_at
    d = [h for h in hist if h.file == "sample_customers.csv"][0]
    assert (d.scores.overall, d.pii_by_risk.HIGH, d.quality.failed, d.duplicates.exact_duplicates) == (42, 2, 4, 1)
    assert "raw_value" not in [f.name for f in doc.schema["pii_findings_top"].dataType.elementType.fields]
    assert len(d.quality.results) == 4 and d.trigger == "http_manual"


def test_health_check_flow(spark, tmp_path):
    import json
    import os

    from tests.conftest import FIXTURES
    from tessera.plans.health_check import health_check
    src = os.path.join(FIXTURES, "sample_customers.csv")
    base = str(tmp_path / "baseline")
    assert health_check(spark, src, baseline=base, save_schema=True) is None
    cfg = tmp_path / "config.json"
    cfg.write_text(json.dumps({"custom_expectations": [{"column": "name", "type": "unique"},
                                                       {"column": "nope", "type": "not_null"}]}))
    res = health_check(spark, src, pack="healthcare", config=str(cfg), baseline=base,
                       output=str(tmp_path / "results"))
    s = res.scores.first()
    assert (s.status, s.drift_alerts, s.pack_penalty) == ("stable", 0, 5)
    assert res.quality.where("check = 'column values to be unique'").first().unexpected_count == 2
    assert spark.read.json(str(tmp_path / "results")).count() == 1
    fresh = health_check(spark, src, baseline=str(tmp_path / "missing"))
    assert fresh.scores.first().status == "no_baseline"


def test_python_regex_rules(spark):
    from tessera.operators.quality import python_regex_to_java, run_quality
    assert python_regex_to_java(r"^(?P<a>\d)(?P=a)$") == r"(?U)^(?<a>\d)\k<a>$"
    df = spark.createDataFrame([("11",), ("12",), ("٣٣",)], "code string")
    r = run_quality(df, "cli", [{"column": "code", "type": "regex", "pattern": r"^(?P<d>\d)(?P=d)$"}])
    row = r.where("check = 'column values to match regex'").first()
    assert row.unexpected_count == 1          # "12"; Arabic-Indic digits count as digits, as in Python


def test_check_rows_schema_and_values(spark):
    """Quality result rows (built as one SQL expression): schema, mostly, strict detail, empty denominator."""
    from pyspark.sql import types as T

    from tessera.operators import quality as Q
    df = spark.createDataFrame(
        [("a", 1, "x@y.com"), ("a", None, "bad"), ("a", 200, None), ("b", None, None)],
        "dataset string, age int, email string")
    checks = [Q.Check("exist", "age", "column to exist"),
              Q.Check("not_null", "age", "column values to not be null", mostly=0.5),
              Q.Check("between", "age", "age 0-120", min=0, max=120, strict_key="age"),
              Q.Check("regex", "email", "column values to match regex", pattern="@")]
    out = Q.run_checks(df, checks)
    assert out.schema.simpleString() == T._parse_datatype_string(Q.RESULT_SCHEMA).simpleString()
    got = {(r.dataset, r.check_idx): r for r in out.collect()}
    assert len(got) == 8
    nn_a = got[("a", 1)]
    assert (nn_a.passed, nn_a.total, nn_a.unexpected_count) == (True, 3, 1)
    assert abs(nn_a.unexpected_percent - 100.0 / 3) < 1e-9
    assert got[("a", 2)].detail == "1 out-of-range" and got[("a", 2)].passed is False
    assert got[("b", 2)].detail == "OK" and got[("b", 2)].unexpected_percent is None
    assert got[("a", 3)].detail == "1 bad value(s)" and got[("b", 3)].detail is None
    # mostly: no non-null value to judge -> passed (as before the SQL form)
    assert got[("b", 1)].passed is True and got[("b", 1)].unexpected_count == 1 and got[("b", 0)].passed is True

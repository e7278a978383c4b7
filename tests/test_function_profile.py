"""The function profile on a small table of library loans: what is found, checked, scored, masked and written."""

import base64
import os

import pytest
from conftest import LOANS
from pyspark.sql import functions as F

from tessera.functions import pii
from tessera.operators import duplicates as G
from tessera.operators import quality as Q
from tessera.operators import remediate as R
from tessera.operators import scan as S
from tessera.operators import score as I
from tessera.plans.pipeline import run_scan
from tessera.sources import io as A

#: (row, column, type, risk, masked) by reading the rows: item_code is a safe name, desk_notes a free one,
#: "identity" is a context word, the e-mail column is exempt from its own type.
LOAN_FACTS = {
    (11, "item_code", "SSN", "LOW", "XXX-XX-7714"),
    (11, "desk_notes", "CREDIT_CARD", "MEDIUM", "XXXX-XXXX-XXXX-9855"),
    (12, "desk_notes", "SSN", "HIGH", "XXX-XX-9999"),
    (13, "desk_notes", "PHONE", "MEDIUM", "XXX-XXX-0187"),
    (14, "desk_notes", "DATE_OF_BIRTH", "MEDIUM", "**/*/1998"),
}
BY_LEVEL = {"low": {"SSN", "CREDIT_CARD"}, "medium": {"SSN", "CREDIT_CARD", "PHONE", "DATE_OF_BIRTH"},
            "high": {"SSN", "CREDIT_CARD", "PHONE", "DATE_OF_BIRTH", "EMAIL"}}


def secret(spark):
    return R.encryption_key(spark, base64.b64encode(os.urandom(32)).decode())


@pytest.mark.parametrize("level", [*BY_LEVEL, "no such level"])
def test_findings_of_every_level(loans, level):
    types = BY_LEVEL.get(level, BY_LEVEL["medium"])
    got = {(r.row_key, r.column, r.pii_type, r.risk, r.masked) for r in S.scan_pii(loans, "function", level, key="row_key").collect()}
    known = {f for f in LOAN_FACTS if f[2] in types}
    assert got - known == set() or {x[2] for x in got - known} <= {"PHONE"}
    assert known <= got


def test_a_value_is_never_shown_in_its_mask(loans):
    for r in S.scan_pii(loans, "cli", "high", key="row_key").collect():
        assert r.raw_value not in r.masked and len(r.masked) > 3


def test_strict_checks_count_every_bad_value(loans):
    got = {(r.column, r.check): (r.unexpected_count, r.passed, r.detail) for r in Q.run_quality(loans, "function", key="row_key").collect()}
    assert got == {("loan_id", "not null"): (1, False, "1 null(s)"), ("user_email", "email format"): (2, False, "2 invalid"),
                   ("reader_age", "age 0-120"): (2, False, "2 out-of-range"), ("fee_amount", "non-negative"): (1, False, "1 negative")}
    fixed = loans.where("row_key = 11")
    assert all(r.passed and r.detail == "OK" for r in Q.run_quality(fixed, "function", key="row_key").collect())


@pytest.mark.parametrize("repeats", [0, 1, 7])
def test_duplicates_do_not_depend_on_the_key(spark, loans, repeats):
    more = loans.where("row_key IN (12, 15)").crossJoin(spark.range(repeats)).withColumn("row_key", F.col("row_key") * 100 + F.col("id")).drop("id")
    table = loans.unionByName(more)
    r = G.duplicates(table, key="row_key").first()
    assert (r.total_rows, r.exact_duplicates) == (5 + 2 * repeats, 2 * repeats)
    assert r.duplicate_pct == round(200 * repeats / (5 + 2 * repeats), 1)
    left = R.remediate(table, "function", "high", key="row_key", mask=False)
    assert sorted(x.row_key for x in left.collect()) == [r[0] for r in LOANS]              # the smallest key of equal rows


def test_scores_follow_the_findings(loans):
    s = run_scan(loans, "function", "medium", key="row_key").scores.first()
    n = s.pii_high + s.pii_medium
    assert s.privacy == max(0, 100 - int(n / 5 * 50) - min(2 * n, 60))
    assert (s.quality, s.completeness, s.failed, s.total_checks) == (0, 100, 4, 4)
    assert s.overall == int(s.privacy * 0.38 + 100 * 0.18) and s.grade[0] == "F"
    good = run_scan(loans.where("row_key = 11").drop("desk_notes"), "function", "medium", key="row_key").scores.first()
    assert (good.privacy, good.quality, good.overall, good.grade) == (100, 100, 94, "A — Healthy")


def test_every_score_has_the_grade_of_its_floor(spark):
    floors = {"A": 85, "B": 70, "C": 55, "D": 40, "F": 0}
    for r in spark.range(101).select("id", I.grade(F.col("id")).alias("grade")).collect():
        assert r.grade[0] == next(g for g, low in floors.items() if r.id >= low)


def test_masking_changes_what_is_actionable_and_nothing_else(loans):
    before = {r[0]: r for r in LOANS}
    after = {r.row_key: r for r in R.remediate(loans, "function", "high", key="row_key", dedup_rows=False)
             .select(*loans.columns).collect()}
    names = loans.columns
    want = {k: list(r) for k, r in before.items()}
    for r in S.scan_pii(loans, "function", "high", key="row_key").collect():
        if r.risk != "LOW":
            i = names.index(r.column)
            want[r.row_key][i] = want[r.row_key][i].replace(r.raw_value, r.masked)
    assert {k: list(r) for k, r in after.items()} == want
    assert dict(R.remediate(loans, "function", "high", key="row_key").drop("dataset").dtypes) == dict(loans.dtypes)


def test_only_high_findings_become_tokens(spark, loans):
    key = secret(spark)
    out = R.remediate(loans, "function", "high", key="row_key", dedup_rows=False, encrypt_key=key)
    text = {r.row_key: r.desk_notes for r in out.collect()}
    head, rest = text[12].split("checked: ")
    token = rest.split(" (")[0]
    back = spark.createDataFrame([(token,)], "t string").select(R.decrypt_column(F.col("t"), key)).first()[0]
    assert head == "identity " and back == "219-09-9999" and "XXX-XXX-0187" in text[13] and text[15] is None


def test_tokens_need_their_key(spark):
    df = spark.createDataFrame([("a",), ("zwei drei",), ("é" * 30,)], "v string")
    key = secret(spark)
    t = df.select("v", pii.encrypt_token(F.col("v"), key).alias("t")).cache()
    assert all(r.b == r.v and r.t != r.v for r in t.withColumn("b", R.decrypt_column(F.col("t"), key)).collect())
    assert {r[0] for r in t.select(R.decrypt_column(F.col("t"), secret(spark))).collect()} == {None}
    with pytest.raises(Exception, match="empty token"):
        spark.createDataFrame([("",)], "t string").select(R.decrypt_column(F.col("t"), key)).collect()
    spark.conf.unset(R.KEY_CONF)
    with pytest.raises(ValueError, match="encryption.secret"):
        R.encryption_key(spark)


def test_formats_by_extension():
    found = {ext: A.format_of(f"/x/y.z/file.{ext}") for ext in ("csv", "CSV", "parquet", "json", "xls", "xlsx", "log")}
    assert found == {"csv": "csv", "CSV": "csv", "parquet": "parquet", "json": "json", "xls": "excel", "xlsx": "excel", "log": "csv"}
    assert A.format_of("/folder.v2/plain") == "csv"


@pytest.mark.parametrize("chain", [("csv", "json"), ("json", "parquet"), ("parquet", "csv"), ("csv", "parquet", "json", "csv")])
def test_values_survive_chains_of_formats(spark, loans, tmp_path, chain):
    table = loans.select("row_key", "loan_id", "fee_amount", "desk_notes")
    A.write_any(table, str(tmp_path / "0"), chain[0])
    for k, (a, b) in enumerate(zip(chain, chain[1:], strict=False)):
        A.convert(spark, str(tmp_path / str(k)), str(tmp_path / str(k + 1)), b, in_fmt=a)
    back = A.read_any(spark, str(tmp_path / str(len(chain) - 1)), chain[-1]).select(*table.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


def test_legacy_profile(spark, sample):
    r = run_scan(sample, "legacy", "whatever")            # unknown level -> medium
    s = r.scores.first()
    assert (s.overall, s.privacy, s.quality, s.pii_high, s.pii_medium, s.pii_low) == (42, 74, 0, 2, 2, 2)
    assert {q.check for q in r.quality.collect()} == {"not null", "email format", "age range 0-120", "non-negative (revenue)"}

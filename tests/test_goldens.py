"""Goldens on the 11 x 9 sample (hand-derived from the rules; see README)."""

import pytest

from tessera.plans.pipeline import run_scan

COLS = ["overall", "grade", "privacy", "quality", "completeness", "pii_high", "pii_medium", "pii_low",
        "failed", "exact_duplicates", "duplicate_pct", "rows", "columns"]


@pytest.mark.parametrize("profile,sens,expected", [
    ("cli", "medium", (72, "B — Acceptable", 87, 64, 82, 2, 0, 4, 5, 1, 9.1, 11, 9)),
    ("cli", "high", (72, "B — Acceptable", 87, 64, 82, 2, 0, 4, 5, 1, 9.1, 11, 9)),
    ("cli", "low", (74, "B — Acceptable", 94, 64, 82, 1, 0, 2, 5, 1, 9.1, 11, 9)),
    ("function", "medium", (42, "D — At risk", 74, 0, 82, 2, 2, 2, 4, 1, 9.1, 11, 9)),
    ("function", "high", (42, "D — At risk", 74, 0, 82, 2, 2, 2, 4, 1, 9.1, 11, 9)),
    ("function", "low", (47, "D — At risk", 87, 0, 82, 1, 1, 1, 4, 1, 9.1, 11, 9)),
])
def test_scores(sample, profile, sens, expected):
    row = run_scan(sample, profile, sens).scores.select(*COLS).collect()
    assert len(row) == 1
    assert tuple(row[0]) == expected


def test_healthcare_pack_penalty(sample):
    r = run_scan(sample, "cli", "medium", pack="healthcare")
    assert r.scores.select("overall", "pack_penalty").first() == (67, 5)


def test_findings_table(sample):
    f = run_scan(sample, "cli", "medium").findings
    got = sorted((r.pii_type, r.column, r.confidence, r.risk, r.masked)
                 for r in f.select("pii_type", "column", "confidence", "risk", "masked").collect())
    assert got == sorted([
        ("SSN", "notes", 0.75, "HIGH", "XXX-XX-3412"),
        ("DATE_OF_BIRTH", "notes", 0.75, "HIGH", "**/**/1985"),
        ("PHONE", "notes", 0.15, "LOW", "XXX-XXX-0199"),
        ("CREDIT_CARD", "notes", 0.15, "LOW", "XXXX-XXXX-XXXX-1111"),
        ("SSN", "serial_number", 0.15, "LOW", "XXX-XX-3412"),
        ("PHONE", "serial_number", 0.15, "LOW", "XXX-XXX-0199"),
    ])


def test_function_profile_scores_notes_findings(sample):
    f = run_scan(sample, "function", "medium").findings.where("column = 'notes'")
    got = sorted((r.pii_type, r.confidence) for r in f.select("pii_type", "confidence").collect())
    assert got == [("CREDIT_CARD", 0.5), ("DATE_OF_BIRTH", 0.9), ("PHONE", 0.5), ("SSN", 0.9)]

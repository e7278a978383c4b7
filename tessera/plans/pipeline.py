"""The full scan (row I7): findings, quality, duplicates, packs, drift -> scores.

``run_scan`` only builds lazy plans; nothing is collected.  Each part is a
narrow pass or a per-dataset aggregate, and the final scores table is one row
per dataset.  The nested scan document embeds only bounded lists (the checks
of the suite and the first 15 findings per type); every finding is written
to a table of its own (``stored_findings``).
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import frame
from ..frame import DATASET
from ..operators import drift as D
from ..operators import duplicates as G
from ..operators import packs as FP
from ..operators import quality as Q
from ..operators import remediate as R
from ..operators import scan as S
from ..operators import score as I
from ..profiles import get_profile


@dataclass
class ScanResult:
    findings: DataFrame
    quality: DataFrame
    quality_summary: DataFrame
    duplicates: DataFrame
    packs: DataFrame | None
    drift: DataFrame | None
    drift_changes: DataFrame | None
    scores: DataFrame
    key: str


def run_scan(df: DataFrame, profile="cli", sensitivity: str = "medium", key: str | None = None,
             rules: list[dict] | None = None, pack: str | None = None, pack_opts: dict | None = None,
             baseline: DataFrame | None = None, state=None) -> ScanResult:
    """Every check of a scan, per dataset, as lazy DataFrames.

    With ``state`` (a :class:`~tessera.streaming.state.BatchState`) counts, scores and duplicates cover what earlier
    batches brought of the same datasets as well; findings are those of ``df``.
    """
    prof = get_profile(profile)
    sensitivity = prof.level(sensitivity)
    df = frame.with_dataset(df)
    df, key = frame.with_row_key(df, key)
    findings = S.scan_pii(df, prof, sensitivity, key=key)
    risk = S.risk_counts(findings)          # datasets without findings get zeros in the scores join
    # one aggregate pass for row counts, every quality check and every pack rule
    checks = Q.build_suite(df, prof, rules, key)
    pack_rules = FP.pack_rules(df, pack, **(pack_opts or {})) if pack else []
    base = df.groupBy(DATASET).agg(F.count(F.lit(1)).alias("n_total"), *Q.check_aggs(df, checks),
                                   *FP.pack_aggs(pack_rules, "pk"))
    uniques = Q.unique_groups(df, checks)
    if state is None:
        dups = G.duplicates(df, key, near=prof.near_duplicates)
    else:
        base, risk, uniques, dups = state.merge(df, key, base, risk, uniques, checks, prof.near_duplicates)
    quality = Q.check_rows(Q.with_unique_counts(base, df, checks, uniques), checks)
    qsum = Q.summarize(quality)
    n_cols = len(frame.value_columns(df, key))
    shape = base.select(DATASET, F.col("n_total").alias("rows"), F.lit(n_cols).alias("columns"))
    packs = penalty = None
    if pack:
        packs = FP.pack_rows(base, pack_rules, pack, "pk")
        penalty = FP.pack_penalty(packs)
    scores = I.scores(shape, risk, qsum, dups, penalty, prof.pack_penalty)
    if penalty is not None:
        scores = scores.join(penalty.select(DATASET, "pack_failed"), DATASET, "left").fillna(0, ["pack_failed"])
    drift = changes = None
    if baseline is not None:
        cat = D.catalog(df, key)
        changes = D.drift_changes(cat, baseline)
        drift = D.drift_status(cat, baseline, changes)
        scores = scores.join(drift.select(DATASET, F.col("alerts").alias("drift_alerts"), "status"), DATASET, "left")
    return ScanResult(findings, quality, qsum, dups, packs, drift, changes, scores, key)


def run_scans(groups: list[DataFrame], **options) -> ScanResult:
    """I7 over files of different schemas: one scan per schema (``read_groups``), the results united.

    Each file is scanned by its own columns and types; every result stays keyed by dataset.
    """
    found = [run_scan(g, **options) for g in groups]
    if len(found) == 1:
        return found[0]

    def united(name: str) -> DataFrame | None:
        parts = [x for x in (getattr(r, name) for r in found) if x is not None]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    names = [f.name for f in fields(ScanResult) if f.name != "key"]
    return ScanResult(**{n: united(n) for n in names}, key=found[0].key)


def stored_findings(res: ScanResult) -> DataFrame:
    """Every finding as it may be stored: masked, without its raw value."""
    return res.findings.drop("raw_value")


def scan_document(res: ScanResult, sensitivity: str, scanned_at=None, trigger: str = "batch",
                  input_format: str | None = None, output_format: str | None = None,
                  encrypted: bool = False) -> DataFrame:
    """One nested document per dataset (bounded lists only), with formats and protection status."""
    ts = F.current_timestamp() if scanned_at is None else F.lit(scanned_at).cast("timestamp")
    sensitivity = sensitivity if sensitivity in ("low", "medium", "high") else "medium"   # B1 whitelist
    checks = (res.quality.groupBy(DATASET).agg(F.sort_array(F.collect_list(F.struct(
        "check_idx", "check", "column", "passed", "unexpected_count", "unexpected_percent", "detail"))).alias("results")))
    top = (S.top_per_type(res.findings, 15).drop("raw_value")
           .groupBy(DATASET).agg(F.sort_array(F.collect_list(F.struct(
               "pii_type", "rank", "risk", "column", "row_key", "match_idx", "masked", "confidence",
               "reason"))).alias("pii_findings_top")))
    s = (res.scores.join(checks, DATASET, "left").join(top, DATASET, "left")
         .join(R.protection_status(res.scores, encrypted), DATASET, "left"))
    return s.select(
        F.col(DATASET).alias("file"), ts.alias("scanned_at"), F.lit(sensitivity).alias("sensitivity"),
        F.struct(F.col("rows").alias("rows"), F.col("columns").alias("columns")).alias("shape"),
        F.struct("overall", "grade", "privacy", "quality", "completeness", "pack_penalty",
                 "pii_high", "pii_medium", "pii_low").alias("scores"),
        F.struct(F.col("pii_high").alias("HIGH"), F.col("pii_medium").alias("MEDIUM"),
                 F.col("pii_low").alias("LOW")).alias("pii_by_risk"),
        "pii_findings_top",
        F.struct(F.col("total_checks").alias("total"), "passed", "failed", "results").alias("quality"),
        F.struct(F.col("rows").alias("total_rows"), "exact_duplicates", "near_duplicates",
                 "duplicate_pct").alias("duplicates"),
        F.lit(trigger).alias("trigger"),
        F.lit(input_format).cast("string").alias("input_format"),
        F.lit(output_format).cast("string").alias("output_format"), "protection_status")

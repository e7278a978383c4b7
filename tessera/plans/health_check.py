"""One-call health check: the original tool's end-to-end flow on Spark.

read (any format, dataset = file, each file by its own columns and types) -> optionally save a schema baseline and
stop, or compare against the latest baseline -> scan (PII, quality incl.
custom rules, duplicates, optional industry pack) -> scores -> optionally
write the scan documents.  Everything stays lazy except the writes.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..operators import drift as D
from ..sources import io as A
from .pipeline import ScanResult, run_scans, scan_document, stored_findings


def load_rules(config: "dict | str | None") -> list[dict]:
    """``custom_expectations`` from a dict or a small JSON config file on the driver.

    A file that cannot be opened is an error: rules are never dropped silently.
    """
    if config is None:
        return []
    if isinstance(config, str):
        with open(config) as fh:
            config = json.load(fh)
    return list(config.get("custom_expectations", []))


def health_check(spark: SparkSession, path, fmt: str | None = None, profile: str = "cli",
                 sensitivity: str = "medium", pack: str | None = None, config=None,
                 baseline: str | None = None, save_schema: bool = False, output: str | None = None,
                 key: str | None = None, pack_opts: dict | None = None) -> ScanResult | None:
    """Scan ``path``; with ``save_schema`` only record the baseline at ``baseline`` and return None."""
    groups = A.read_groups(spark, path, fmt)
    if not groups:
        raise ValueError(f"no rows to scan under {path}")
    if save_schema:
        if not baseline:
            raise ValueError("save_schema needs a baseline path")
        D.save_baseline(D.catalogs(groups, key), baseline)
        return None
    base = None
    if baseline:
        try:
            base = D.load_baseline(spark, baseline)
        except AnalysisException as missing:  # no baseline table yet -> every dataset reports no_baseline
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            base = spark.createDataFrame([], "dataset string, column string, ordinal int, dtype string, "
                                             "row_count bigint, saved_at timestamp")
    res = run_scans(groups, profile=profile, sensitivity=sensitivity, key=key, rules=load_rules(config), pack=pack,
                    pack_opts=pack_opts, baseline=base)
    if output:
        # the document reads the findings three times (risk counts, top 15, overflow):
        # persisted, the regexes run once; the caller may unpersist ``res.findings``
        res.findings = res.findings.persist(StorageLevel.MEMORY_AND_DISK)
        in_fmt = fmt or A.format_of(path[0] if isinstance(path, (list, tuple)) else path)
        A.save_results(scan_document(res, sensitivity, input_format=in_fmt, output_format="json"), output)
        stored_findings(res).write.mode("append").parquet(output.rstrip("/") + "-findings")
    return res

"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into Spark's ``noop`` sink (every row is
produced, nothing is collected to the driver), ``$BENCH_RUNS`` times (default
2); the best time per query is reported.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.queries import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = [
    "pii_findings",          # D1 flagship: every cell of documents x 8 patterns
    "pii_pages_function",    # D1 over raw html, function profile
    "mask_documents",        # D7 in-row masking
    "remediate_documents",   # D9 + D7 dedup then mask
    "pii_top15",             # D5 window-group limit
    "quality_suite",         # E* fused aggregate
    "custom_rules",          # E8-E11 incl. uniqueness
    "pack_ecommerce",        # F* over lineitem x orders
    "pack_finance",
    "dup_documents",         # G1-G3
    "dup_lineitem",
    "scores",                # I7 full scan -> scores
    "gold_summary",          # J1-J6 over two scan runs
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="tessera-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JVM, parquet footers
    QUERIES["pii_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            best = dt if best is None else min(best, dt)
            spark.catalog.clearCache()      # every run starts without cached data
        times[name] = round(best, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "runs": f"best of {runs}"}))
    spark.stop()


if __name__ == "__main__":
    main()

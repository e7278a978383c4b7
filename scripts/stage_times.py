"""Stage timings of registered queries from Spark's event log (no UI, no server).

    python scripts/stage_times.py [sf_dir] query [query ...]

The event log goes to a fresh temporary folder; stages are listed with their
task count, wall time and the first line of their call site.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans.queries import QUERIES  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if "/" not in a]
    log_dir = tempfile.mkdtemp(prefix="tessera-eventlog-")
    spark = (SparkSession.builder.master("local[8]").appName("tessera-stages")
             .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir).config("spark.eventLog.compress", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    marks = []
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        marks.append((name, time.time() - t0))
    spark.stop()
    stages = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or not os.path.basename(path).startswith("events"):
            continue
        with open(path, errors="replace") as fh:
            for line in fh:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(ev, dict):
                    continue
                if ev.get("Event") == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
                    stages[info["Stage ID"]] = (dur, info["Number of Tasks"], info.get("Details", "").split("\n")[0])
    for name, dt in marks:
        print(f"{name}: {dt:.2f}s")
    for sid, (dur, n, site) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:15]:
        print(f"  stage {sid:4d} {dur:6.2f}s tasks={n:4d} {site[:100]}")
    print(f"(event log in {log_dir})")


if __name__ == "__main__":
    main(sys.argv)

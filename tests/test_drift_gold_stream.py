"""Drift, gold analytics, alerts and the streaming auto-scan."""

import os
import shutil

from pyspark.sql import functions as F

from tessera.operators import drift as D
from tessera.operators import gold as J
from tessera.streaming.autoscan import autoscan

FIX = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


def test_baseline_save_load_and_drift(spark, sample, tmp_path):
    path = str(tmp_path / "baselines")
    D.save_baseline(D.catalog(sample), path, "2026-01-01 00:00:00")
    D.save_baseline(D.catalog(sample.drop("notes")), path, "2025-01-01 00:00:00")
    base = D.load_baseline(spark, path)
    assert base.count() == 9                       # latest baseline only
    cur = D.catalog(sample.drop("zip_code").withColumn("password_hint", F.lit("x"))
                    .withColumn("age", F.col("age").cast("double")))
    ch = {r.column: r for r in D.drift_changes(cur, base).collect()}
    assert ch["password_hint"].severity == "CRITICAL"
    assert ch["zip_code"].type == "column_removed" and ch["zip_code"].severity == "INFO"
    assert ch["age"].message == "Column 'age' type changed: int64 -> float64"
    st = D.drift_status(cur, base).first()
    assert st.status == "drift_detected" and st.alerts == 1
    assert D.drift_status(D.catalog(sample), base).first().status == "stable"
    other = D.catalog(sample.withColumn("dataset", F.lit("new.csv")))
    assert D.drift_status(other, base).first().status == "no_baseline"


def test_gold_metrics_snapshot(spark):
    g = J.read_gold(spark, os.path.join(FIX, "metrics_check.csv"), "csv")
    s = J.summary(g).first()
    assert (s.total_scans, s.avg_health_score, s.total_high_pii, s.last_score, s.trend, s.trend_label) == \
        (4, 43.2, 7, 42, 0, "→ stable")
    grades = J.grade_distribution(g).collect()
    assert [(r.grade, r.scans, r.share) for r in grades] == [("D — At risk", 4, 100.0)]
    assert J.pii_exposure(g).where("filename = 'sample_customers.csv' AND risk = 'HIGH'").first().n == 2
    assert J.display_history(g).first().health_score.endswith("/100")


def test_stream_autoscan_csv(spark, tmp_path):
    inc = tmp_path / "incoming"
    inc.mkdir()
    shutil.copy(os.path.join(FIX, "sample_customers.csv"), inc / "customers_jan.csv")
    (inc / "notes.txt").write_text("skipped: unsupported extension")
    out = str(tmp_path / "out")
    q = autoscan(spark, str(inc), out, input_format="csv", sensitivity="medium")
    q.awaitTermination()
    gold = spark.read.parquet(f"{out}/gold").collect()
    assert len(gold) == 1
    r = gold[0]
    assert (r.filename, r.health_score, r.privacy_score, r.quality_score, r.completeness_score,
            r.high_pii, r.medium_pii, r.low_pii, r.quality_failed, r.duplicate_pct) == \
        ("customers_jan.csv", 42, 74, 0, 82, 2, 2, 2, 4, 9.1)
    silver = spark.read.csv(f"{out}/silver", header=True)
    assert silver.count() == 10
    notes = " ".join(x.notes for x in silver.collect())
    assert "372-88-3412" not in notes.replace("XXX-XX-3412", "")
    assert spark.read.parquet(f"{out}/alerts").count() == 1
    assert spark.read.json(f"{out}/results").first().scores.overall == 42


def test_stream_processing_time_trigger(spark, tmp_path):
    inc = tmp_path / "in"
    inc.mkdir()
    shutil.copy(os.path.join(FIX, "sample_customers.csv"), inc / "a.csv")
    out = str(tmp_path / "out")
    q = autoscan(spark, str(inc), out, input_format="csv", sensitivity="low", available_now=False,
                 processing_time="1 second", output_format="parquet")
    try:
        q.processAllAvailable()
        shutil.copy(os.path.join(FIX, "sample_customers.csv"), inc / "b.csv")
        q.processAllAvailable()
    finally:
        q.stop()
    gold = {r.filename: r for r in spark.read.parquet(f"{out}/gold").collect()}
    assert set(gold) == {"a.csv", "b.csv"} and gold["b.csv"].health_score == 47
    assert spark.read.parquet(f"{out}/silver").count() == 20


def test_restart_keeps_history_and_stores_every_finding(spark, tmp_path):
    inc, out = tmp_path / "in", str(tmp_path / "out")
    inc.mkdir()
    for day in ("day1", "day2"):            # a new start of the stream for each
        rows = "".join(f"{i},SSN 372-88-{3400 + i}\n" for i in range(20))
        (inc / f"{day}.csv").write_text("id,notes\n" + rows)
        autoscan(spark, str(inc), out, input_format="csv", sensitivity="medium").awaitTermination()
    assert {r.filename for r in spark.read.parquet(f"{out}/gold").collect()} == {"day1.csv", "day2.csv"}
    found = spark.read.parquet(f"{out}/findings")
    assert {(r.dataset, r["count"]) for r in found.groupBy("dataset").count().collect()} == {("day1.csv", 20), ("day2.csv", 20)}
    assert "raw_value" not in found.columns
    doc = spark.read.json(f"{out}/results").where("file = 'day2.csv'").first()
    assert (doc.input_format, doc.output_format, doc.protection_status.high_risk_pii_masked_only) == ("csv", "csv", 20)


def test_formats_that_arrive_later_are_scanned_into_one_gold_table(spark, tmp_path):
    from tessera.operators.gold import GoldTable
    from tessera.streaming.autoscan import autoscan_folder
    inc, out = tmp_path / "in", str(tmp_path / "out")
    inc.mkdir()
    (inc / "a.csv").write_text("id,notes\n1,SSN 372-88-3412\n")
    (inc / "b.csv").write_text("notes,more,id\nx,7,1\ny,unknown,2\n")
    (inc / "notes.txt").write_text("no table")
    q = autoscan_folder(spark, str(inc), out, sensitivity="medium", available_now=False, processing_time="1 second")
    try:
        q.processAllAvailable()
        (inc / "b.json").write_text('{"k": 1, "remark": "call 415-555-0199", "more": 2}\n{"k": 2, "remark": "x", "more": 3}\n')
        (inc / "c.JSON").write_text('[{"k": 1, "remark": "a"},\n {"k": 2, "remark": "b"}, {"k": 3}]')
        spark.range(4).coalesce(1).write.parquet(str(tmp_path / "staged"))
        part = next(p for p in os.listdir(tmp_path / "staged") if p.endswith(".parquet"))
        shutil.copy(tmp_path / "staged" / part, inc / "d.parquet")
        q.processAllAvailable()
    finally:
        q.stop()
    gold = GoldTable(spark, f"{out}/gold").rows().collect()
    rows = sorted((r.filename, r.rows, r.columns) for r in gold)
    assert [x for x in rows if x[0] != "d.parquet"] == [("a.csv", 1, 2), ("b.csv", 2, 3), ("b.json", 2, 3), ("c.JSON", 3, 2)]
    assert [r.timestamp for r in gold] == sorted(r.timestamp for r in gold)
    docs = {r.file: (r.input_format, r.output_format) for r in spark.read.json(f"{out}/results").collect()}
    assert docs["a.csv"] == ("csv", "csv") and docs["b.json"] == ("json", "json") and docs["d.parquet"] == ("parquet", "parquet")


def test_a_dataset_split_over_batches_scores_as_in_one(spark, tmp_path):
    from pyspark.sql import functions as F
    from tessera.plans.pipeline import run_scan
    from tessera.streaming.autoscan import autoscan_folder, process_groups, run_options
    rows = [(k % 11, f"P{k % 7}", "SSN 372-88-3412" if k % 9 == 0 else f" Row {k % 6} ", "bad" if k % 4 == 0 else "a@b.de", k % 5 - 1) for k in range(60)]
    rows[30:36], rows[50:56] = rows[2:8], rows[24:30]                          # repeats within and across batches
    whole = spark.createDataFrame(rows, "customer_id long, name string, notes string, email string, amount long").withColumn("dataset", F.lit("s"))
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1)
    inc, out = tmp_path / "in", str(tmp_path / "out")
    for k in range(3):
        part = spark.createDataFrame(rows[k * 20:k * 20 + 20], whole.drop("dataset").schema)
        part.coalesce(2).write.mode("append").format(("json", "parquet", "json")[k]).save(str(inc / "s"))
        autoscan_folder(spark, str(inc), out, profile="cli", sensitivity="medium", dataset=folder).awaitTermination()
    want = run_scan(whole, "cli", "medium").scores.first()
    last = spark.read.parquet(f"{out}/gold").orderBy(F.desc("timestamp")).first()
    assert last.filename == "s"
    assert (last.rows, last.health_score, last.privacy_score, last.quality_score, last.completeness_score, last.high_pii, last.medium_pii,
            last.quality_failed, last.duplicate_pct) == (60, want.overall, want.privacy, want.quality, want.completeness, want.pii_high,
                                                         want.pii_medium, want.failed, want.duplicate_pct)
    doc = spark.read.json(f"{out}/results").orderBy(F.desc("scanned_at")).first()
    assert (doc.duplicates.exact_duplicates, doc.duplicates.near_duplicates) == (want.exact_duplicates, want.near_duplicates)
    assert want.exact_duplicates == 12
    # a replay of the last batch changes nothing
    before = spark.read.parquet(f"{out}/gold").drop("timestamp").collect()
    last_id = max(r.batch_id for r in before)
    replay = spark.createDataFrame(rows[40:], whole.drop("dataset").schema).withColumn("dataset", F.lit("s"))
    replay = replay.select(*sorted(c for c in replay.columns if c != "dataset"), "dataset")
    process_groups([("json", replay)], last_id, out, run_options(spark, "json", sensitivity="medium"), "cli")
    assert sorted(map(tuple, spark.read.parquet(f"{out}/gold").drop("timestamp").collect())) == sorted(map(tuple, before))


def test_silver_files_are_bounded_by_size(spark, tmp_path):
    from pyspark.sql import functions as F
    from tessera.sources.io import save_clean
    df = spark.range(4000, numPartitions=8).select(
        F.when(F.col("id") < 3000, "big").otherwise(F.concat(F.lit("small"), (F.col("id") % 5).cast("string"))).alias("dataset"),
        "id", F.lit("x" * 50).alias("text"))
    path = str(tmp_path / "silver")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")         # else small files are put together further
    try:
        save_clean(df, path, file_bytes=60_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.format("binaryFile").load(path + "/*").select("path").collect()
    by = {}
    for r in files:
        name = r.path.split("dataset=")[1].split("/")[0]
        by[name] = by.get(name, 0) + 1
    assert by.pop("big") in (2, 3, 4) and by == {f"small{k}": 1 for k in range(5)}
    assert spark.read.parquet(path).count() == 4000


def test_gold_table_merges_states_and_survives_a_lost_one(spark, tmp_path):
    import random
    from tessera.operators.gold import GOLD_COLUMNS, GoldTable
    rng = random.Random(2)
    grades = ["A — Healthy", "B — Acceptable", "F — Critical"]
    table, rows = GoldTable(spark, str(tmp_path / "gold")), []
    schema = spark.read.option("header", True).csv(os.path.join(FIX, "metrics_check.csv")).columns
    assert schema == GOLD_COLUMNS
    kinds = ("timestamp string, filename string, trigger string, rows bigint, columns bigint, health_score int, grade string, privacy_score int, "
             "quality_score int, completeness_score int, high_pii int, medium_pii int, low_pii int, quality_failed int, duplicate_pct double")
    for batch in range(4):
        own = [(f"2026-0{rng.randint(1, 3)}-1{rng.randint(0, 9)} 0{rng.randint(0, 9)}:00:{batch}{k}", f"f{rng.randint(0, 2)}.csv", "t", 5, 3, rng.randint(0, 100),
                rng.choice(grades), 1, rng.randint(0, 100), 1, rng.randint(0, 4), 1, 0, 2, 1.5) for k in range(5)]
        rows += own
        frame = spark.createDataFrame(own, kinds).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        table.append(frame, batch)
        table.append(frame, batch)                            # a replay
        ordered = sorted(rows)
        s = J.summary(table).first()
        assert (s.total_scans, s.total_high_pii, s.last_score, s.trend) == (
            len(rows), sum(r[10] for r in rows), ordered[-1][5], ordered[-1][5] - ordered[0][5])
        assert s.avg_health_score == J.summary(table.rows()).first().avg_health_score
    shutil.rmtree(str(tmp_path / "gold_days" / "batch_id=2"))                       # the states of one append were never written
    assert J.summary(table).first() == J.summary(table.rows()).first()
    assert J.grade_distribution(table).collect() == J.grade_distribution(table.rows()).collect()
    assert sorted(J.pii_exposure(table).collect()) == sorted(J.pii_exposure(table.rows()).collect())
    assert [r.timestamp for r in table.rows().collect()] == sorted(r.timestamp for r in table.rows().collect())


def test_missing_rule_file_is_an_error(tmp_path):
    import pytest
    from tessera.plans.health_check import load_rules
    with pytest.raises(FileNotFoundError):
        load_rules(str(tmp_path / "rules.json"))


def test_batch_replay_is_idempotent(spark, tmp_path):
    from tessera.sources.io import read_csv_strings
    from tessera.streaming.autoscan import process_batch, run_options
    batch = read_csv_strings(spark, os.path.join(FIX, "sample_customers.csv"))
    out = str(tmp_path / "out")
    opts = run_options(spark, "csv", sensitivity="medium")
    for _ in range(2):                      # the same micro-batch replayed after a failure
        process_batch(batch, 7, out, opts, promote=True)
    assert spark.read.parquet(f"{out}/gold").count() == 1
    assert spark.read.csv(f"{out}/silver", header=True).count() == 10
    assert spark.read.json(f"{out}/results").count() == 1


def test_row_states_are_hashed_and_earlier_rows_are_merged(spark, tmp_path):
    """One row per different row without a sort for it; later batches meet earlier rows by shuffles, never by a broadcast."""
    from tessera.operators import duplicates as G
    from tessera.plans.pipeline import run_scan
    from tessera.streaming.state import BatchState
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, "a", "Ann "), (2, "a", "Ann "), (3, "a", "ann"), (4, "b", None), (5, "b", "")], "id long, dataset string, name string")
    states = G.row_states(rows, "id")
    assert "SortAggregate" not in plan(states)
    got = states.collect()
    assert sorted((r.dataset, r.n) for r in got) == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]
    assert {d: len({r.near for r in got if r.dataset == d}) for d in "ab"} == {"a": 1, "b": 1}
    later = spark.createDataFrame([(6, "a", "Ann "), (7, "b", "new")], rows.schema)
    for i, df in enumerate((rows, later)):
        state = BatchState(str(tmp_path), i)
        scores = run_scan(df, "cli", "medium", key="id", state=state).scores.collect()
        assert [r.rows for r in sorted(scores, key=lambda r: r.dataset)] == ([3, 2], [4, 3])[i]
    unseen = state.unseen(later, "id")
    assert "BroadcastHashJoin" not in plan(unseen) and [r.id for r in unseen.collect()] == [7]


def test_parts_of_a_batch_run_together_with_one_digest_each(spark):
    """A batch of one file is dealt to all cores, and its row digests are computed once, in the rows it keeps."""
    from tessera.streaming.state import BatchState
    rows = spark.createDataFrame([(1, "a", "Ann"), (2, "a", "Bob")], "id long, dataset string, name string")
    kept = []
    state = BatchState("unused", 0)
    batch = state.hold_digests(rows, "id", lambda df: kept.append(df) or df)
    assert batch.columns == rows.columns and len(kept) == 1
    assert state._digested(batch, "id") is kept[0]

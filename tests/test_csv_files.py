"""CSV folders whose files differ in header and types: reading, promotion, baselines and drift per file."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import drift as D
from tessera.plans.health_check import health_check
from tessera.plans.pipeline import run_scans
from tessera.sources import csvfiles as C
from tessera.sources import io as A


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in [1]"                                   # a blank and glob characters in the path
    d.mkdir()
    (d / "a.csv").write_text("id,age,city\n1,30,Rome\n2, 41 ,Oslo\n")
    (d / "b.csv").write_text("city,id,age\nBonn,3,unknown\nLyon,4,22\n")
    (d / "c.csv").write_text("﻿id,city,id,\r\n7,Kyiv,8,9\r\n")
    (d / "d.csv").write_text("id,age,city\n")                 # a header only
    (d / "e.csv").write_text("")
    return str(d).replace("[", "\\[").replace("]", "\\]")


def test_header_names():
    assert C.header_names('a,"b,c",,a') == ("a", "b,c", "Unnamed: 2", "a.1")
    assert C.header_names("") == ()


def test_files_are_read_by_their_own_header(spark, folder):
    rows = {(r.dataset, r.id, r.age, r.city) for r in A.read_csv_strings(spark, folder).collect()}
    assert rows == {("a.csv", "1", "30", "Rome"), ("a.csv", "2", " 41 ", "Oslo"), ("b.csv", "3", "unknown", "Bonn"),
                    ("b.csv", "4", "22", "Lyon"), ("c.csv", "7", None, "Kyiv")}
    assert A.read_csv_strings(spark, folder).columns == ["id", "age", "city", "id.1", "Unnamed: 3", "dataset"]


def test_promotion_is_per_file(spark, folder):
    groups = A.read_groups(spark, folder, "csv")
    types = {g.first().dataset: {f.name: f.dataType.simpleString() for f in g.schema.fields} for g in groups}
    assert types["a.csv"]["age"] == "bigint" and types["b.csv"]["age"] == "string"
    assert "age" not in types["c.csv"] and types["c.csv"]["id.1"] == "bigint"
    united = A.read_any(spark, folder, "csv")
    assert dict(united.dtypes)["id"] == "bigint" and dict(united.dtypes)["age"] == "string"
    assert {r.age for r in united.where("dataset = 'a.csv'").collect()} == {"30", " 41 "}


def test_files_of_one_schema_are_one_group(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.csv").write_text(f"x,y\n{k},{'z' if k == 3 else k}\n")
    groups = A.read_groups(spark, str(tmp_path), "csv")
    assert sorted(g.select("dataset").distinct().count() for g in groups) == [1, 4]


def test_a_column_absent_in_one_file_is_reported_for_it_alone(spark, tmp_path):
    old, new, base = tmp_path / "old", tmp_path / "new", str(tmp_path / "base")
    for d in (old, new):
        d.mkdir()
    (old / "a.csv").write_text("id,age,city\n1,30,Rome\n")
    (old / "b.csv").write_text("id,age,city\n2,31,Bonn\n")
    (new / "a.csv").write_text("city,id,age\nRome,1,30\n")
    (new / "b.csv").write_text("id,city,password\nx2,Bonn,p\n")
    assert health_check(spark, str(old / "*.csv"), baseline=base, save_schema=True) is None
    res = health_check(spark, str(new / "*.csv"), baseline=base)
    got = {(r.dataset, r.type, r.column, r.severity) for r in res.drift_changes.collect()}
    assert got == {("b.csv", "column_removed", "age", "INFO"), ("b.csv", "column_added", "password", "CRITICAL"),
                   ("b.csv", "type_changed", "id", "WARNING")}
    assert {(r.dataset, r.status) for r in res.drift.collect()} == {("a.csv", "stable"), ("b.csv", "drift_detected")}
    # the age check runs for the file that has the column
    checks = {r.dataset for r in res.quality.where("column = 'age'").collect()}
    assert checks == {"a.csv"}
    shape = {r.dataset: r["columns"] for r in res.scores.collect()}
    assert shape == {"a.csv": 3, "b.csv": 3}


def test_scans_of_several_schemas_equal_scans_of_each_file(spark, folder):
    groups = A.read_groups(spark, folder, "csv")
    whole = {r.dataset: r for r in run_scans(groups, profile="cli", sensitivity="high").scores.collect()}
    for name in ("a.csv", "b.csv", "c.csv"):
        own = run_scans(A.read_groups(spark, f"{folder}/{name}", "csv"), profile="cli", sensitivity="high").scores.first()
        assert own.asDict() == {k: v for k, v in whole[name].asDict().items() if k in own.asDict()}


def test_saved_catalogs_keep_the_types_of_each_file(spark, folder, tmp_path):
    path = str(tmp_path / "base")
    D.save_baseline(D.catalogs(A.read_groups(spark, folder, "csv")), path, "2026-01-01 00:00:00")
    got = {(r.dataset, r.column): r.dtype for r in D.load_baseline(spark, path).collect()}
    assert got["a.csv", "age"] == "int64" and got["b.csv", "age"] == "object" and ("c.csv", "age") not in got
    assert D.load_baseline(spark, path).where(F.col("dataset") == "d.csv").isEmpty()


def test_preview_is_the_same_under_any_partitioning(spark, tmp_path):
    from tessera.operators import report as K
    for name in ("b", "a"):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{name}{i},{'x' * (i % 50)}\n" for i in range(3000)))
    want = {(f"{n}.csv", i + 1, f"{n}{i}") for n in "ab" for i in range(50)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "20k", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = A.read_ordered(spark, str(tmp_path / "*.csv"), "csv")
            shown = K.preview(rows, 50, C.READ_ORDER)
            assert {(r.dataset, r.row, r.k) for r in shown.collect()} == want
            assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_files_are_read_by_their_form(spark, tmp_path):
    (tmp_path / "array.json").write_text('\n [{"k": 1, "v": "a"},\n{"k": 2, "v": null}]')
    (tmp_path / "lines.json").write_text('{"k": 3, "w": 1.5}\n{"k": 4}\n')
    (tmp_path / "one.json").write_text('{\n "k": 5,\n "v": "z"\n}')
    rows = A.read_any(spark, str(tmp_path / "*.json"), "json").select("dataset", "k", "v", "w").collect()
    assert {tuple(r) for r in rows} == {("array.json", 1, "a", None), ("array.json", 2, None, None), ("lines.json", 3, None, 1.5),
                                        ("lines.json", 4, None, None), ("one.json", 5, "z", None)}
    groups = {g.first().dataset: sorted(c for c in g.columns if c != "dataset") for g in A.read_groups(spark, str(tmp_path / "*.json"), "json")}
    assert groups["lines.json"] == ["k", "w"] and ["k", "v"] in groups.values()


def test_results_are_listed_newest_first_without_being_read(spark, tmp_path):
    import os
    for k, name in enumerate(("old", "new", "broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "scan.json").write_text('{"file": "%s"}' % name if k < 2 else "{not json")
        os.utime(tmp_path / name / "scan.json", (1_700_000_000 + k * 60,) * 2)
    (tmp_path / "new" / "_SUCCESS").write_text("")
    index = A.results_index(spark, str(tmp_path)).collect()
    assert [r.path.split("/")[-2] for r in index] == ["broken", "new", "old"]
    assert A.load_result(spark, index[1].path).first().file == "new"

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from panelforge.sources import calendars, readers, sinks


def test_reports_elements_and_events(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a;b;c;d;e;f;g;h;i\n1;10;F;S;2020;Ei;31.12.2020;30.06.2021;Jah\n2;11;F;D;x;Jah;bad;;Ei\n")
    r = readers.reports(spark, str(tmp_path / "r.csv")).orderBy("report_id").collect()
    assert r[0].year == 2020 and str(r[0].filed) == "2021-06-30" and r[0].audited == 1 and r[1].year is None and r[1].period_end is None and r[1].consolidated
    (tmp_path / "e1.csv").write_text("report_id;table;label;element;value\n1;Balance;x;Assets;5\n1;Balance;x;Assets;6\n1;Skipped table;x;Cash;999999\n1;Balance;x;Cash;2\n9;Balance;x;Cash;1\n")
    ids = spark.createDataFrame([(1,)], "report_id long")
    got = readers.elements(spark, [str(tmp_path / "e1.csv")], ids, ["Assets", "Cash"], "^Skipped").collect()
    assert [(x.report_id, x.Assets, x.Cash) for x in got] == [(1, 5.0, 2.0)]
    (tmp_path / "c.json").write_text(json.dumps([{"code": 7, "cards": [{"entries": [{"date": "01.02.2020", "type": "K"}, {"date": "2020-03-01", "type": "Z"}]}]}], indent=1))
    assert [(r.code, str(r.date)) for r in readers.register_events(spark, str(tmp_path / "c.json"), "K").collect()] == [(7, "2020-02-01")]


def test_filings_and_loans(spark, tmp_path):
    (tmp_path / "sub.txt").write_text("adsh\tcik\tform\tperiod\tfiled\na\t1\t10-K\t20201231\t20210301\nb\t2\t8-K\t20201231\t20210301\n")
    (tmp_path / "num.txt").write_text("adsh\ttag\tddate\tqtrs\tvalue\na\tAssets\t20201231\t0\t5\na\tAssets\t20191231\t0\t4\na\tSales\t20201231\t4\t9\na\tSales\t20201231\t1\t3\n")
    got = readers.fundamentals(spark, str(tmp_path / "sub.txt"), str(tmp_path / "num.txt"), ["10-K"], ["Assets", "Sales"]).collect()
    assert [(r.adsh, r.Assets, r.Sales, str(r.filed)) for r in got] == [("a", 5.0, 9.0, "2021-03-01")]
    (tmp_path / "perf.txt").write_text("".join("|".join([loan, *["x"] * 7, code, *["y"] * 26]) + "\n" for loan, code in (("l1", "01"), ("l1", "03"), ("l2", "00"))))
    assert {r.loan_id: r.label for r in readers.distress_flags(spark, str(tmp_path / "perf.txt")).collect()} == {"l1": 1, "l2": 0}


def test_arff_and_zip(spark, tmp_path):
    (tmp_path / "s.arff").write_text("@RELATION x\n@ATTRIBUTE type {TRAIN,TEST}\n@attribute rowid INTEGER\n@ATTRIBUTE repeat INTEGER\n@ATTRIBUTE fold INTEGER\n@DATA\nTRAIN,3,0,0\nTRAIN,1,0,0\n% note\nTEST,2,0,0\n")
    assert {(r.repeat, r.fold, r.part): r.rows for r in readers.split_table(spark, str(tmp_path / "s.arff")).collect()} == {(0, 0, "train"): [1, 3], (0, 0, "test"): [2]}
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.csv", "Y, X\n1,0.5\n0,0.25\n")
    assert sorted(map(tuple, readers.zipped_table(spark, str(tmp_path / "d.zip"), "d.csv", "y long, x double").collect())) == [(0, 0.25), (1, 0.5)]


def test_guards_and_calendars(spark):
    assert readers.panel_weights("a=0.5, b=0.25") == {"a": 0.5, "b": 0.25}
    for bad in ("a", "a=2", "a=0.7,b=0.7", "a=0.1,a=0.1"):
        with pytest.raises(ValueError):
            readers.panel_weights(bad)
    with pytest.raises(ValueError):
        readers.panel(spark, "/x/eval_only/p.parquet")
    assert readers.feature_columns(spark.createDataFrame([(1, 2, 3)], "x int, label int, _group int")) == ["x"]
    assert [r.label for r in calendars.quarter_labels(spark, (2023, 4), (2024, 1)).orderBy("i").collect()] == ["2023q4", "2024q1"]
    assert [(str(r.start), str(r.end)) for r in calendars.month_windows(spark, "2024-01-15", "2024-02-03").orderBy("start").collect()] == [("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-03")]
    assert calendars.quarter_ends(spark, "2024-03-31", "2024-03-01").count() == 0


def test_dump(spark, tmp_path):
    tasks = spark.range(10).select(F.col("id").alias("task_id"), (F.col("id") * 2).alias("x"))
    sinks.write_dump(tasks, str(tmp_path / "d"), {"seed": 1}, 4)
    with pytest.raises(FileExistsError):
        sinks.write_dump(tasks, str(tmp_path / "d"), {"seed": 1}, 4)
    with pytest.raises(ValueError):
        sinks.open_dump(spark, str(tmp_path / "d"), {"seed": 2})
    assert sinks.open_dump(spark, str(tmp_path / "d"), {"seed": 1}).count() == 10
    assert sorted(r.task_id for r in sinks.dump_batch(spark, str(tmp_path / "d"), 1, 3, 4).collect()) == [3, 4, 5]
    for i in range(2):
        sinks.append_results(spark.createDataFrame([(f"d{i}", 0.5)], "data string, auc double"), str(tmp_path / "res"), "data")
    assert spark.read.parquet(str(tmp_path / "res")).count() == 2

"""Rules that queries over the given tables don't reach: refusals, hand-made cases, order and partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import metrics, scalars
from panelforge.operators import bootstrap, comparison, conditioning, relational, running, splits, temporal


def test_running_sums_do_not_depend_on_ranges(spark):
    rows = [(g, float(v), int(v) % 7) for g in ("a", "b") for v in np.random.default_rng(1).permutation(500)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(7)
    for descending in (False, True):
        for ranges in (2, 64):
            got = running.running_sum(df, ["g"], "v", {"s": "n"}, descending, ranges).where("g = 'a'").orderBy("v").collect()
            values = [int(r.v) % 7 for r in got]
            want = np.cumsum(values[::-1])[::-1] if descending else np.cumsum(values)
            assert [r.s for r in got] == want.tolist()


def test_label_window_is_half_open(spark):
    rows = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-01-01"), (3, "2020-01-01"), (4, "2020-01-01")], "k long, d string").select("k", F.to_timestamp("d").alias("t"))
    events = spark.createDataFrame([(1, "2020-01-02"), (2, "2020-01-04"), (3, "2020-01-05"), (4, None)], "k long, d string").select("k", F.to_timestamp("d").alias("e"))
    got = {r.k: r.label for r in relational.forward_label(rows, events, "k", "t", "e", "1 day", "2 days").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}  # in the lag, on the closing day, after it, no date


def test_refusals(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k long, v long")
    with pytest.raises(ValueError):
        relational.unique_or_fail(df, ["k"])
    with pytest.raises(ValueError):
        relational.refuse_leak(df, df, "k")
    with pytest.raises(ValueError):
        splits.by_time(df, "k", "v", F.lit(1), F.lit(2), on_overlap="raise")


def test_single_class_metrics_are_null(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.2), ("b", 1, 0.9), ("b", 0, 0.9), ("b", None, 0.5)], "g string, y int, p double")
    got = {r.g: r for r in metrics.rank_metrics(df, ["g"]).collect()}
    assert got["a"].auc is None and got["a"].ap is None and got["b"].auc == 0.5 and got["b"].ap == 0.5


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, p) for p in (0.0, 0.3, 0.6, 0.7, 1.0)], "y int, p double")
    assert [r.bin for r in metrics.calibration_table(df, []).orderBy("bin").collect()] == [0, 2, 5, 6, 9]


def test_top_decile_by_hand(spark):
    df = spark.createDataFrame([(i, int(i in (0, 5, 9)), 1 - i / 20) for i in range(20)], "_row_id int, y int, p double")
    assert metrics.ap_top_decile(df, []).first()[0] == 0.5


def test_sign_test(spark):
    for w, lo in ((0, 0), (5, 5), (9, 1), (30, 12)):
        got = spark.range(1).select(metrics.sign_test_p(F.lit(w), F.lit(lo)).alias("p")).first().p
        n = w + lo
        want = min(1, 2 * sum(math.comb(n, i) for i in range(min(w, lo) + 1)) / 2**n) if n else None
        assert got == (pytest.approx(want) if n else None)


def test_strengths_order_methods():
    import pandas as pd

    wins = pd.DataFrame([("a", "b", 9), ("b", "a", 1), ("b", "c", 8), ("c", "b", 2), ("a", "c", 10), ("c", "a", 0)], columns=["a", "b", "wins"])
    s = comparison.strengths(wins)
    assert s["a"] > s["b"] > s["c"] and abs(sum(s.values())) < 1e-9


def test_bootstrap_of_equal_scores(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(0.3).alias("a"), F.lit(0.3).alias("b"))
    r = bootstrap.paired_difference(df, "g", "y", "a", "b").first()
    assert r.diff == 0 and r.p == 1 and r.drawn == 200
    assert bootstrap.paired_difference(df, "g", "y", "a", "b", draws=20).first().p is None


def test_levels_of_one_fold_get_the_prior(spark):
    rows = [("x", 1.0, 0), ("x", 1.0, 0), ("z", 0.0, 0), ("z", 1.0, 1), (None, 0.0, 1)]
    df = spark.createDataFrame(rows, "l string, y double, f int")
    got = conditioning.out_of_fold(df, "l", "y", "f", "e").collect()
    assert {round(r.e, 6) for r in got if r.l in ("x", None)} == {0.6}
    assert sorted(round(r.e, 6) for r in got if r.l == "z") == [round(6 / 11, 6), round(7 / 11, 6)]


def test_quotas():
    assert splits.largest_remainder({"a": 50, "b": 30, "c": 20}, 11) == {"a": 6, "b": 3, "c": 2} or sum(splits.largest_remainder({"a": 50, "b": 30, "c": 20}, 11).values()) == 11
    assert splits.water_fill({"a": 2, "b": 50, "c": 60}, 32) == {"a": 2, "b": 15, "c": 15}


def test_trend_and_coherence(spark):
    ramp = spark.createDataFrame([(1, y, 2.0 * y) for y in range(8)] + [(2, 0, 1.0), (2, 3, 4.0)], "e long, y long, v double")
    got = {(r.e, r.y): r for r in temporal.trajectory(ramp, "e", "y", "v").collect()}
    assert got[1, 5].trend == pytest.approx(2) and got[1, 1].trend is None and got[1, 1].delta == 2 and got[2, 3].delta is None
    curves = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.1), (2, 0, 0.2), (2, 1, 0.1)], "c int, k int, p double")
    assert {r.c: r.monotone for r in temporal.curve_coherence(curves, ["c"], "k", "p").collect()} == {1: True, 2: False}


def test_inverse_normal_and_dates(spark):
    got = spark.range(1).select(*[scalars.inverse_normal(F.lit(p)).alias(f"p{i}") for i, p in enumerate((0.001, 0.5, 0.975))]).first()
    assert [round(x, 5) for x in got] == [-3.09023, 0.0, 1.95996]
    d = spark.sql("SELECT DATE '2026-01-31' AS a, DATE '2026-02-28' AS b").select(scalars.whole_months("a", "b").alias("m")).first()
    assert d.m == 0


def test_strengths_of_two_methods_are_the_log_odds():
    import pandas as pd

    got = comparison.strengths(pd.DataFrame({"a": ["x", "y"], "b": ["y", "x"], "wins": [8.0, 2.0]}))
    assert math.isclose(got["x"] - got["y"], math.log(8.5 / 2.5), abs_tol=1e-9) and math.isclose(got["x"] + got["y"], 0, abs_tol=1e-12)
    # a cycle of equal odds has equal strengths; a chain adds up its log odds; one that never lost has a finite strength
    cycle = comparison.strengths(pd.DataFrame({"a": list("xyz") * 2, "b": list("yzxzxy"), "wins": [3.0] * 3 + [1.0] * 3}))
    assert max(map(abs, cycle.values())) < 1e-9
    chain = comparison.strengths(pd.DataFrame({"a": ["x", "y", "y", "z"], "b": ["y", "x", "z", "y"], "wins": [6.0, 1.0, 4.0, 0.0]}))
    assert math.isclose(chain["x"] - chain["z"], math.log(6.5 / 1.5) + math.log(4.5 / 0.5), abs_tol=1e-6)


def test_cap_rows_has_all_it_should(spark):
    for lo in range(0, 60, 10):
        df = spark.range(lo, lo + 10)
        assert splits.cap_rows(df, 1, ["id"]).count() == 1 and splits.cap_rows(df, 10, ["id"]).count() == 10
    assert splits.cap_rows(spark.range(100), 10, ["id"]).count() == 10 and splits.cap_rows(spark.range(3), 10, ["id"]).count() == 3

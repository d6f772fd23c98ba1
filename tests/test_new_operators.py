"""Significance, ledgers, knobs and targets: refusals, hand-made cases and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import knobs, ledger, overlap, quantiles, running, significance, targets


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 300)] + [("b", float(v)) for v in rng.normal(size=77)] + [("c", 5.0), ("a", None), (None, 2.0), (None, 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    got = {r.g: r.q for r in quantiles.quantiles(df, ["g"], "v", probs).collect()}
    for g in ("a", "b", "c", None):
        assert np.allclose(got.pop(g), np.quantile([v for h, v in rows if h == g and v is not None], probs), atol=1e-12)
    assert not got and quantiles.quantiles(df.limit(0), [], "v", probs).count() == 0


def test_running_sum_over_texts(spark):
    rng = np.random.default_rng(5)
    words = sorted({"Brand#" + "".join(rng.choice(list("abc1"), 4)) for _ in range(300)})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "w string, n long").repartition(6)
    got = [r.s for r in running.running_sum(df, [], "w", {"s": "n"}).orderBy("w").collect()]
    assert got == list(itertools.accumulate(range(1, len(words) + 1)))


def auc(y, p, w):
    pos = [(s, k) for s, t, k in zip(p, y, w) if t]
    neg = [(s, k) for s, t, k in zip(p, y, w) if not t]
    return sum(a * b * ((s > t) + 0.5 * (s == t)) for s, a in pos for t, b in neg) / (sum(a for _, a in pos) * sum(b for _, b in neg))


def test_group_bootstrap_of_auc(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(rng.random() < 0.4), float(rng.integers(0, 6)), float(rng.integers(0, 6))) for g in rng.integers(0, 12, 60)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double").repartition(4)
    got = significance.rank_difference(df, [], "k", "y", "a", "b", "auc", draws=12, least=5).first()
    weights = {(r.d, r.k): r.w for r in spark.createDataFrame([(d, k) for d in range(1, 13) for k in range(12)], "d long, k long").withColumn("w", significance.poisson_weight("d", "k")).collect()}
    diff = lambda w: auc([r[1] for r in rows], [r[2] for r in rows], w) - auc([r[1] for r in rows], [r[3] for r in rows], w)
    draws = [diff([weights[d, r[0]] for r in rows]) for d in range(1, 13)]
    assert math.isclose(got["diff"], diff([1] * 60), abs_tol=1e-12) and got.drawn == 12
    assert np.allclose([got.low, got.high], np.quantile(draws, [0.025, 0.975]))
    assert math.isclose(got.p, min(1, max(2 * min(np.mean(np.array(draws) <= 0), np.mean(np.array(draws) >= 0)), 1 / 13)))
    one = significance.rank_difference(df.where("y = 1"), [], "k", "y", "a", "b", draws=3).first()
    assert one is None or one["diff"] is None


def test_refusals():
    with pytest.raises(ValueError):
        significance.refuse_coarse(100, 10)
    significance.refuse_coarse(2000, 10)
    with pytest.raises(ValueError):
        knobs.source_shares({"a": -1, "b": 2})
    with pytest.raises(ValueError):
        knobs.regime_distribution(3, 1.0)
    with pytest.raises(ValueError):
        knobs.feature_bands("0.5-0.2:1")
    assert knobs.feature_bands("0.1-0.3:2, 0.5-1") == [(0.1, 0.3, 2.0), (0.5, 1.0, 1.0)]
    assert targets.partition_depth(64_000, 4, 1000, 2, 6) == 4 and targets.partition_depth(100, 4, 1000, 2, 6) == 2


def test_ledgers_refuse_open_units_and_twice_scored(spark):
    units = spark.createDataFrame([(1,), (2,)], "u long")
    done = spark.createDataFrame([(1, None)], "u long, status string")
    with pytest.raises(ValueError):
        ledger.ledger(units, done, ["u"], "status", [])
    with pytest.raises(ValueError):
        ledger.merged_runs([units, units], ["u"])
    a, b = (spark.createDataFrame([("x", v), ("seed", s)], "name string, value string") for v, s in (("1", "1"), ("2", "3")))
    ledger.same_settings(a, a, "name", "value", [])
    with pytest.raises(ValueError):
        ledger.same_settings(a, b, "name", "value", ["seed"])


def test_shift_keeps_order_and_meets_the_mean(spark):
    rows = [(g, (i + 1) / 40) for g in ("a", "b") for i in range(30)]
    got = significance.shift_to_mean(spark.createDataFrame(rows, "g string, p double"), ["g"], "p", 0.2).orderBy("g", "p").collect()
    for g in ("a", "b"):
        s = [r.shifted for r in got if r.g == g]
        assert s == sorted(s) and math.isclose(np.mean(s), 0.2, abs_tol=1e-9)


def test_permutation_p_by_hand(spark):
    df = spark.createDataFrame([("m", 1.0, 1.0), ("m", 2.0, 2.0), ("m", 3.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0)], "g string, a double, b double")
    got = {r.g: r for r in significance.rho_permutation(df, ["g"], "a", "b").collect()}
    assert math.isclose(got["m"].p_two, 2 / 6) and math.isclose(got["m"].p_one, 1 / 6) and got["m"].exact and math.isnan(got["c"].rho if got["c"].rho is not None else math.nan)


def test_unordered_codes_follow_zipf_sizes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(600)] + [(600, None)], "k long, x double")
    got = knobs.unordered_codes(df, "x", 4, 1.0, "salt", "code").collect()
    sizes = sorted((sum(r.code == c for r in got) for c in range(4)), reverse=True)
    want = [600 / (k + 1) / sum(1 / (j + 1) for j in range(4)) for k in range(4)]
    assert max(abs(a - b) for a, b in zip(sizes, want)) <= 1.5 and next(r for r in got if r.x is None).code is None


def test_samplers_refuse_or_return_nothing(spark):
    df = spark.createDataFrame([(i, 0) for i in range(50)], "k long, y int")
    assert knobs.rate_thinned(df, "y", 0.1, ["k"]) is None
    with pytest.raises(ValueError):
        knobs.both_classes(df, df.limit(5), "y", "k", 2)
    with pytest.raises(ValueError):
        knobs.refuse_single_class(df, [], "y")
    with pytest.raises(ValueError):
        knobs.binarised(df, "y", F.lit(True), 0.5, "b")
    lone = spark.createDataFrame([(0, "only"), *[(i, "many") for i in range(1, 41)]], "k long, g string")
    folds = knobs.shuffle_folds(lone, "g", ["k"], 3, 0.25).collect()
    assert all(r.part == "train" for r in folds if r.g == "only") and [sum(r.part == "test" for r in folds if r.fold == f) for f in range(3)] == [10, 10, 10]


def test_columns_members_and_information(spark):
    names = [f"c{i}" for i in range(7)]
    sets = knobs.member_columns(names, 3, 2, "s")
    assert len(sets) == 3 and set().union(*sets) == set(names) and all(len(set(s)) == 3 for s in sets)
    df = spark.createDataFrame([(i % 2, i % 2, 1, i % 3) for i in range(60)], "y int, a int, b int, c int")
    assert knobs.best_columns(df, ["a", "b", "c"], "y", 1) == ["a"] and knobs.best_columns(df, ["b"], "y", 1) == []
    assert math.isclose({r.feature: r.mi for r in knobs.mutual_information(df, ["a"], "y").collect()}["a"], math.log(2))


def test_target_transforms(spark):
    df = spark.createDataFrame([(0.0,), (3.5,), (10.0,)], "y double")
    assert targets.log_target_refused(df, "y") is None and "below 0" in targets.log_target_refused(df.withColumn("y", F.col("y") - 1), "y")
    got = [r.v for r in df.select(targets.log_inverse(F.log1p("y")).alias("v")).collect()]
    assert np.allclose(got, [0, 3.5, 10]) and df.limit(1).select(targets.log_inverse(F.lit(-5.0)).alias("v")).first().v == 0
    cuts = targets.thresholds(spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "y double"), "y", 4).orderBy("i").collect()
    assert [(r.i, r.threshold) for r in cuts] == [(0, 1.0)]


def test_overlap_rule(spark):
    rows = [(0.5, 0, 0.0), (0.49, 3, 0.5), (0.49, 2, 1.0), (0.1, 9, 0.4)]
    got = [r.v for r in spark.createDataFrame(rows, "r double, c int, s double").select(overlap.overlaps(F.col("r"), F.col("c"), F.col("s")).alias("v")).collect()]
    assert got == [True, True, False, False]


def test_forward_labels_and_as_of_of_a_hot_key(spark):
    """One key has most rows; times on bucket edges, ties, nulls of keys and times, months that differ in length."""
    import datetime
    import random

    from panelforge.operators import relational

    rng = random.Random(8)
    start = datetime.datetime(2020, 1, 30)
    when = lambda: None if rng.random() < 0.03 else start + datetime.timedelta(hours=rng.randrange(0, 24 * 120, 6))
    key = lambda: rng.choice(["hot"] * 8 + ["a", None])
    rows, events = [(i, key(), when()) for i in range(300)], [(key(), when(), rng.randrange(5)) for _ in range(60)]
    left = spark.createDataFrame(rows, "i long, k string, t timestamp_ntz").repartition(3)
    right = spark.createDataFrame(events, "k string, e timestamp_ntz, v int")
    got = {r.i: r.label for r in relational.forward_label(left, right, "k", "t", "e", "2 days", "5 days").collect()}
    day = datetime.timedelta(days=1)
    assert got == {i: int(any(t and e and k == x and t + 2 * day < e <= t + 7 * day for x, e, _ in events)) for i, k, t in rows}
    found = {r.i: r.v for r in relational.as_of(left, right, "k", "t", "e", ["v"]).collect()}
    for i, k, t in rows:
        able = [(e, v) for x, e, v in events if x == k and e and t and e <= t]
        assert found[i] == (max(able)[1] if able else None)
    month = {r.i: r.label for r in relational.forward_label(left.where("t is not null"), right, "k", "t", "e", "0 days", "1 month").collect()}
    ends = {r.i: r.z for r in left.where("t is not null").selectExpr("i", "t + INTERVAL 1 MONTH AS z").collect()}
    assert month == {i: int(any(e and k == x and t < e <= ends[i] for x, e, _ in events)) for i, k, t in rows if t}

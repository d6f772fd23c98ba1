"""Spline columns, histogram trees, boosting: properties and brute force on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import splines, trees


def cox_de_boor(x, t, i, k):
    if k == 0:
        return 1.0 if t[i] <= x < t[i + 1] else 0.0
    a = (x - t[i]) / (t[i + k] - t[i]) * cox_de_boor(x, t, i, k - 1)
    return a + (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * cox_de_boor(x, t, i + 1, k - 1)


@pytest.mark.parametrize("degree", [1, 2, 3, 4])
def test_splines_follow_the_recursion_and_go_on_straight(spark, degree):
    knots = [-1.0, 0.0, 0.5, 2.0]
    xs = [-3.0, -2.0, -1.0, -0.4, 0.0, 0.3, 0.5, 1.9, 2.0, 3.0, 4.0, None, float("nan")]
    got = [r.b for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").coalesce(1).select("i", splines.basis(F.col("x"), knots, degree).alias("b")).orderBy("i").collect()]
    t = splines.padded(knots, degree)
    for x, b in zip(xs, got):
        if x is None or math.isnan(x):
            assert b is None
            continue
        assert len(b) == len(knots) + degree - 1 and abs(sum(b) - 1) < 1e-12
        if -1 <= x < 2:
            assert b == pytest.approx([cox_de_boor(x, t, i, degree) for i in range(len(b))], abs=1e-12)
    at = dict(zip(xs[:-2], got))
    assert np.array(at[-3.0]) - at[-2.0] == pytest.approx(np.array(at[-2.0]) - at[-1.0], abs=1e-12)
    assert np.array(at[4.0]) - at[3.0] == pytest.approx(np.array(at[3.0]) - at[2.0], abs=1e-12)
    near = [cox_de_boor(2 - 1e-7, t, i, degree) for i in range(len(at[2.0]))]
    assert (np.array(at[3.0]) - at[2.0]) * 1e-7 == pytest.approx(np.array(at[2.0]) - near, abs=1e-11)


def test_bad_knots_are_refused():
    with pytest.raises(ValueError):
        splines.basis(F.lit(1.0), [0.0, 0.0, 1.0])
    with pytest.raises(ValueError):
        splines.basis(F.lit(1.0), [0.0, 1.0], 0)


def test_tied_and_empty_columns_are_not_expanded(spark):
    df = spark.createDataFrame([(float(i), 1.0 if i % 4 else 0.0, None, float(i % 9)) for i in range(90)], "a double, b double, c double, d double")
    table, knots = splines.eligible_knots(df, ["a", "b", "c", "d"], 4, most=1)
    assert {r.column: (r.knots, r.values, r.expanded) for r in table.collect()} == {"a": (4, 90, True), "b": (2, 2, False), "c": (0, 0, False), "d": (4, 9, False)}
    out = splines.spline_columns(df, knots)
    assert out.columns == ["b", "c", "d", *[f"a_s{i}" for i in range(5)]] and out.count() == 90


def best_split(rows, cuts, least):
    """By brute force over all features and cuts, as (feature, cut) of the largest fall of the squared error."""
    best, sse = None, lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v)
    for f in sorted(cuts):
        for c in cuts[f]:
            low, high = [r["z"] for r in rows if r[f] is None or r[f] <= c], [r["z"] for r in rows if r[f] is not None and r[f] > c]
            if len(low) >= least and len(high) >= least:
                gain = sse([r["z"] for r in rows]) - sse(low) - sse(high)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                    best = (gain, f, c)
    return best and best[1:]


def test_trees_are_those_of_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b = rng.choice([None, *range(6)]), rng.uniform(-1, 1)
        rows.append({"tree": i % 2, "a": a, "b": b, "z": (3.0 if (a or 0) > 2 else 0.0) + (b > 0.2) * (1 + i % 2) + rng.gauss(0, 0.1)})
    df = spark.createDataFrame([(r["tree"], r["a"], r["b"], r["z"], 1.0) for r in rows], "tree int, a int, b double, z double, one double").repartition(3)
    cuts = trees.feature_cuts(df, ["a", "b"], 8)
    assert all(len(v) <= 7 and v == sorted(v) for v in cuts.values()) and 5.0 not in cuts["a"]
    got = trees.grow(df, cuts, "z", "one", 2, 10.0)
    for t in (0, 1):
        mine = [r for r in rows if r["tree"] == t]
        f, c = best_split(mine, cuts, 10)
        assert got.splits[t][1] == (f, c)
        for node, side in ((2, [r for r in mine if r[f] is None or r[f] <= c]), (3, [r for r in mine if r[f] is not None and r[f] > c])):
            assert got.splits[t].get(node) == best_split(side, cuts, 10)
    routed = df.select("tree", "a", "b", got.leaf(F.col("tree")).alias("leaf")).collect()
    for r in routed:
        node = 1
        while node in got.splits[r.tree]:
            f, c = got.splits[r.tree][node]
            node = 2 * node + (r[f] is not None and r[f] > c)
        assert r.leaf == node


def test_constant_targets_and_small_nodes_are_not_split(spark):
    df = spark.createDataFrame([(0, float(i), 2.0, 1.0) for i in range(20)], "tree int, a double, z double, one double")
    assert trees.grow(df, {"a": [4.0, 9.0]}, "z", "one", 2, 1.0).splits == {}
    df = df.withColumn("z", F.col("a"))
    assert trees.grow(df, {"a": [4.0, 9.0]}, "z", "one", 2, 11.0).splits == {}
    assert trees.grow(df.where("false"), {"a": [4.0]}, "z", "one", 2, 1.0).splits == {}


def test_bags_are_exact_and_differ(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    got = [sorted(r.k for r in g) for g in (trees.bags(df, "k", 3, 0.6).where(F.col("tree") == b).collect() for b in range(3))]
    assert [len(g) for g in got] == [61] * 3 and all(len(set(g)) == 61 for g in got) and all(a != b for a, b in itertools.combinations(got, 2))


def test_small_leaves_take_the_head_of_all_rows(spark):
    df = spark.createDataFrame([(i, float(i >= 95), float(i)) for i in range(100)], "k int, a double, y double")
    model = trees.PartitionedQuantiles(["a"], "y", "k", depth=1, least_share=0.01, least_rows=10, probs=(0.5,)).fit(df)
    assert {(r.a, r.q[0], r.own) for r in model.predict(df).collect()} == {(0.0, 47.0, 1), (1.0, 49.5, 0)}


def test_boosting_keeps_the_better_half_and_its_loss_falls(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((a, b, None if i % 97 == 0 else int(rng.random() < 1 / (1 + math.exp(-4 * (1 if a * b > 0 else -1))))))
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(3)
    fit, hold = df.where("a + b < 0.5"), df.where("a + b >= 0.5")
    configs = [{"depth": d, "rate": r, "least": 5.0} for d, r in ((1, 0.5), (2, 0.05), (2, 0.5), (3, 0.5))]
    model, ladder = trees.tuned_boosting(fit, hold, ["a", "b"], "y", configs, [2, 4], bins=8)
    first = {x["config"]: x for x in ladder if x["rung"] == 2}
    assert len(first) == 4 and sum(x["kept"] for x in first.values()) == 2
    assert max(x["loss"] for x in first.values() if x["kept"]) <= min(x["loss"] for x in first.values() if not x["kept"])
    last = [x for x in ladder if x["rung"] == 4]
    assert len(last) == 2 and sum(x["kept"] for x in last) == 1 and len(model.rounds) == 4
    kept = next(x for x in last if x["kept"])
    assert kept["loss"] < first[kept["config"]]["loss"]
    # the model's expression gives the scores that the loss was taken of
    z = [(r.z, r.y) for r in hold.where("y is not null").select(model.raw().alias("z"), "y").collect()]
    assert sum(math.log1p(math.exp(-abs(s))) + max(s, 0) - y * s for s, y in z) / len(z) == pytest.approx(kept["loss"], abs=1e-9)


def dense_solve(z, y, classes, penalty):
    """The same least sum by plain gradient steps with a line search, from another start, to a small gradient."""
    z = np.column_stack([z, np.ones(len(z))])
    k = 1 if classes == 2 else classes
    c = np.full((k, z.shape[1]), 0.1)
    ridge = np.ones_like(c) * penalty
    ridge[:, -1] = 0

    def value(c):
        s = z @ c.T
        if k == 1:
            p = 1 / (1 + np.exp(-s[:, 0]))
            return np.sum(np.logaddexp(0, s[:, 0]) - y * s[:, 0]) + 0.5 * (ridge * c * c).sum(), ((p - y) @ z)[None, :] + ridge * c
        s = s - s.max(axis=1, keepdims=True)
        p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        one = np.eye(k)[y]
        return -np.sum(np.log(p[np.arange(len(y)), y])) + 0.5 * (ridge * c * c).sum(), (p - one).T @ z + ridge * c

    step = 1e-3
    f, g = value(c)
    for _ in range(20000):
        if np.abs(g).max() < 1e-7:
            break
        while True:
            f2, g2 = value(c - step * g)
            if f2 <= f - 0.4 * step * (g * g).sum():
                break
            step /= 2
        c, f, g, step = c - step * g, f2, g2, step * 1.6
    return c, f


@pytest.mark.parametrize("classes", [2, 3])
def test_coefficients_equal_a_dense_solve(spark, classes):
    from panelforge.operators import readout

    rng = np.random.default_rng(classes)
    z = rng.standard_normal((300, 4))
    y = np.argmax(z @ rng.standard_normal((4, classes)) + rng.gumbel(size=(300, classes)), axis=1)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(z, y)], "z array<double>, y int").repartition(5)
    got = readout.fit_multinomial(rows, 4, classes, 2.0)
    want, _ = dense_solve(z, y, classes, 2.0)
    assert got[:, :-1] == pytest.approx(want[:, :-1], abs=1e-5)
    assert got[:, -1] - got[:, -1].mean() == pytest.approx(want[:, -1] - want[:, -1].mean(), abs=1e-5) if classes > 2 else got[:, -1] == pytest.approx(want[:, -1], abs=1e-5)


def test_readout_blocks_and_missing_values(spark):
    from panelforge.operators import readout

    rng = random.Random(6)
    rows = []
    for i in range(600):
        a = None if i % 11 == 0 else rng.uniform(-3, 3)
        f = rng.choice(["u", "v", "w", None])
        odds = -1 + (0 if a is None else 2 * math.cos(2 * a)) + (f == "v") * 2
        rows.append((a, float(i % 2), f, rng.random(), None if i % 50 == 0 else rng.random() < 1 / (1 + math.exp(-odds))))
    df = spark.createDataFrame(rows, "a double, b double, f string, p double, y boolean").repartition(3)
    model = readout.LinearReadout("y", ["a", "b"], ["f"], ["p"], levels=2, penalty=0.1, floor=0.02).fit(df)
    assert model.classes == [False, True] and list(model.splines) == ["a"] and model.coefficients.shape == (1, 6 + 1 + 2 + 2 + 1 + 1)
    got = model.score(df).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and min(r.probabilities) >= 0.01 - 1e-12 for r in got)
    loss = [-math.log(r.probabilities[r.y]) for r in got if r.y is not None]
    rate = sum(r.y for r in got if r.y is not None) / len(loss)
    assert sum(loss) / len(loss) < -0.85 * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
    odd = model.score(spark.createDataFrame([(float("nan"), None, "new", None, None)], df.schema)).first()
    assert abs(sum(odd.probabilities) - 1) < 1e-9
    with pytest.raises(ValueError):
        readout.LinearReadout("y", ["a"]).fit(df.where("y"))

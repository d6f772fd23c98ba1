"""Draws, boosted contexts and leave-out features: brute force and guarantees on small tables."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.operators import contexts
from panelforge.operators.scoring import LogisticScorer


def hash32(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def wait(key, w, salt):
    return -math.log((hash32(f"{key}|{salt}") + 0.5) / 2**32) / w


def test_the_draw_is_the_least_waits(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, rng.choice([None, 0.0, 0.1, 1.0, 5.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, g long, w double").repartition(4)
    got = {(r.g, r.k) for r in contexts.weighted_draw(df, ["g"], "w", "k", 20, "s").collect()}
    want = set()
    for g in range(3):
        able = sorted((wait(k, w, "s"), k) for k, x, w in rows if x == g and w)
        want |= {(g, k) for _, k in able[:20]}
    assert got == want
    one = {r.k for r in contexts.weighted_draw(df, [], "w", "k", 7, "s").collect()}
    assert one == {k for _, k in sorted((wait(k, w, "s"), k) for k, _, w in rows if w)[:7]}
    assert contexts.weighted_draw(df, [], "w", "k", 999, "s").count() == sum(bool(w) for *_, w in rows)


def test_heavier_rows_are_drawn_more_often(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") < 10, 4.0).otherwise(1.0).alias("w"))
    seen = Counter(r.k < 10 for s in range(30) for r in contexts.weighted_draw(df, [], "w", "k", 4, str(s)).collect())
    # the first of each draw is of a heavy row in 40 of 70 cases; of the four a little less
    assert 0.4 < seen[True] / 120 < 0.7


def test_a_missing_class_takes_the_place_of_the_lightest_row(spark):
    df = spark.createDataFrame([(i, float(i + 1), int(i in (3, 5))) for i in range(10)], "k long, w double, y int")
    drawn = df.where("k in (0, 8, 9)")
    assert {r.k for r in contexts.both_classes(drawn, df, "w", "k", "y").collect()} == {8, 9, 5}
    assert {r.k for r in contexts.both_classes(drawn, df.where("y = 0"), "w", "k", "y").collect()} == {0, 8, 9}


def test_rounds_lower_the_loss_and_hold_both_classes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        a = rng.uniform(-1, 1)
        rows.append((i, a, rng.uniform(-1, 1), None if i % 100 == 0 else int(rng.random() < 1 / (1 + math.exp(4 - 5 * a)))))
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    model = contexts.BoostedContexts(lambda: LogisticScorer(["a", "b"], "y"), ["a", "b"], "y", "k", rounds=2, size=60).fit(df)
    p = sum(r[3] or 0 for r in rows) / sum(r[3] is not None for r in rows)
    losses = [-(p * math.log(p) + (1 - p) * math.log(1 - p)), *[r["loss"] for r in model.history]]
    assert losses[1] < losses[0] and losses[2] <= losses[1] + 1e-3
    assert all(r["rows"] == 60 and 0 < r["positives"] < 60 for r in model.history)
    got = model.score(df).where("y is not null").select("p", "y").collect()
    assert -sum(math.log(r.p if r.y else 1 - r.p) for r in got) / len(got) == pytest.approx(losses[2], abs=1e-6)
    with pytest.raises(ValueError):
        contexts.BoostedContexts(None, ["a"], "y", "k").fit(df.where("y = 1"))


def test_no_entity_is_on_both_sides_and_weights_add_up(spark):
    rows = [(i, None if i % 50 == 0 else i % 23, int(i % 7 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, e long, y int").repartition(3)
    got = contexts.disjoint_draw(df, "e", "k", "y", 6, 90, 200, 0.5).collect()
    sides = {s: [r for r in got if r.side == s] for s in ("context", "query")}
    assert len(sides["context"]) == 90 and len(sides["query"]) == 200
    assert not {r.e for r in sides["context"]} & {r.e for r in sides["query"]} and len({r.e for r in sides["query"]}) == 6
    assert sum(r.y for r in sides["query"]) == 100 and all(r.weight is None for r in sides["context"])
    # the weighted share of positives is that of all rows of the query entities
    pool = [r for r in rows if r[1] in {x.e for x in sides["query"]}]
    assert sum(r.weight * r.y for r in sides["query"]) / 200 == pytest.approx(sum(r[2] for r in pool) / len(pool))
    assert sum(r.weight for r in sides["query"]) == pytest.approx(200)
    copies = Counter((r.side, r.k) for r in got)
    assert max(c for (s, _), c in copies.items() if s == "context") == 1
    plain = contexts.disjoint_draw(df.withColumn("y", F.lit(0)), "e", "k", "y", 6, 10, 20, 0.5).collect()
    assert len(plain) == 30 and all(r.weight is None for r in plain)
    assert contexts.disjoint_draw(df.where("false"), "e", "k", "y", 6, 10, 20, 0.5).count() == 0


def test_no_row_is_represented_by_itself(spark):
    """Other labels and values of a unit leave its own representation as it is, and change the others'."""
    rng = random.Random(5)
    rows = [(i, i % 12, rng.gauss(0, 1), rng.choice([0, 1, 1, None]), None if i % 9 == 0 else rng.gauss(2, 3)) for i in range(240)]
    make = lambda r: {x.k: (x.fold, x.a_llr, x.b_llr) for x in contexts.crossfit_representation(spark.createDataFrame(r, "k long, u long, a double, y int, b double"), "u", "y", ["a", "b"], 3).collect()}
    before = make(rows)
    fold = before[4][0]
    assert len({f for f, *_ in before.values()}) > 1
    after = make([(k, u, a, 1 - y if y is not None and before[k][0] == fold else y, b) for k, u, a, y, b in rows])
    same = lambda x, y: all(p == q or abs(p - q) < 1e-9 for p, q in zip(x, y) if p is not None and q is not None)
    assert all(same(before[k], after[k]) for k in before if before[k][0] == fold)
    assert not any(same(before[k], after[k]) for k in before if before[k][0] != fold and before[k][2] is not None)
    assert all(before[k][2] is None for k, *_, b in rows if b is None)

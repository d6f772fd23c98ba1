"""Families of score pairs, two runs, filters of hashes and the catalogue report."""

import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import comparison, overlap, significance


def test_many_pairs_equal_one_pair_at_a_time(spark):
    rng = random.Random(1)
    rows = [(i, u, i % 17, int(rng.random() < 0.3), round(rng.random(), 2), None if i == 5 else round(rng.random(), 2), round(rng.random(), 1)) for i, u in ((i, i % 3) for i in range(600))]
    rows += [(900, 7, 1, 1, 0.5, 0.5, 0.5), (901, 8, 1, 1, 0.5, 0.5, 0.5), (902, 8, 2, 0, 0.1, 0.4, 0.5)]
    df = spark.createDataFrame(rows, "i long, u long, g long, y int, a double, b double, c double").repartition(3)
    pairs = [("a", "b"), ("c", "a")]
    got = {(r.u, r.a, r.b): r for r in significance.many_differences(df, ["u"], "g", "y", ["a", "b", "c"], pairs, "auc", 40, 10, least_rows=3).collect()}
    assert set(got) == {(u, *p) for u in range(3) for p in pairs}  # a unit of one class, and one of two rows, are left out
    full = df.where("b is not null and u < 3")
    for a, b in pairs:
        for r in significance.rank_difference(full, ["u"], "g", "y", a, b, "auc", 40, 10).collect():
            x = got[(r.u, a, b)]
            assert (x.diff, x.drawn, x.low, x.high, x.p) == pytest.approx((r.diff, r.drawn, r.low, r.high, r.p))
    ordered = sorted(got.values(), key=lambda r: r.p)
    assert all(x.p_holm <= y.p_holm for x, y in zip(ordered, ordered[1:])) and ordered[0].p_holm == pytest.approx(min(1, ordered[0].p * 6))
    assert significance.many_differences(df.where("false"), ["u"], "g", "y", ["a", "b"], [("a", "b")], "ap", 10, 1).count() == 0


def test_a_filter_keeps_all_that_it_holds_and_little_else(spark):
    held = spark.range(0, 3000).select(F.md5(F.col("id").cast("string")).alias("h"))
    rows = spark.range(0, 60000).select("id", F.md5(F.col("id").cast("string")).alias("h")).repartition(4)
    one = overlap.hash_filter(held, "h", 1 << 16)
    assert len(one.first().words) == 1 << 10
    kept = overlap.may_be_in(rows, "h", one, 1 << 16)
    ids = [r.id for r in kept.select("id").collect()]
    assert set(range(3000)) <= set(ids) and len(ids) < 3000 + 0.01 * 57000
    assert overlap.may_be_in(rows, "h", overlap.hash_filter(held.where("false"), "h", 1 << 10), 1 << 10).count() == 0


def test_the_report_is_the_same_with_a_poor_filter(spark):
    """The filter's size changes what is sent, never a result; null cells, tables that share nothing, and empty ones."""
    rng = random.Random(2)
    base = [(float(rng.randrange(10_000)), rng.random(), None if i % 9 == 0 else float(i)) for i in range(500)]
    make = lambda rows: (spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    candidates = {"x": make(base[:300]), "y": make([(r[0] + 0.5, r[1] + 9, r[2]) for r in base]), "z": make(base[:0])}
    references = {"r": make(base[100:]), "s": make([(base[-i - 1][0], r[1], r[2]) for i, r in enumerate(base)]), "t": make([(1e9 + i, 2e9 + i, 3e9) for i in range(5000)])}
    results = []
    for bits in (1 << 7, 1 << 18):
        report, passed = overlap.catalogue_report(candidates, references, bits)
        results.append((sorted(map(str, report.collect())), {r.reference: (r.hashed, r.kept) for r in passed.collect()}))
    assert results[0][0] == results[1][0]
    assert results[1][1]["t"] == (5000, 0) and results[0][1]["t"][1] > 100 and results[1][1]["r"] == (400, 200)
    found = {r.candidate: r for r in report.collect()}
    assert (found["x"].best, found["x"].overlapping) == ("r", ["r"]) and found["x"].row_share == pytest.approx(2 / 3)
    assert found["z"].hashed == 0 and found["z"].best is None and found["z"].overlapping == []


def run(spark, own, rows, base=0.0):
    out = [(t, s, own, 1.0 + 0.1 * ((t + s) % rows), 10) for t in range(6) for s in range(2)]
    return spark.createDataFrame(out + [(t, s, "base", 1.2 + base * (t == 3), 10) for t in range(6) for s in range(2)], "task long, split long, method string, error double, n int")


def test_runs_on_other_splits_are_refused(spark):
    a, b = run(spark, "net", 3), run(spark, "net", 4)
    both, mine, other = comparison.combined_runs(a, b, ["task", "split"], "method", "error", ["base", "more"], ["n"])
    assert (mine, other) == ("net [a]", "net [b]") and both.count() == 36 and both.where("method = 'base'").count() == 12
    with pytest.raises(ValueError, match="differ on 2"):
        comparison.combined_runs(a, run(spark, "net", 4, 0.1), ["task", "split"], "method", "error", ["base"], ["n"])
    with pytest.raises(ValueError, match="differ on 12"):
        comparison.combined_runs(a, b.withColumn("n", F.lit(11)), ["task", "split"], "method", "error", ["base"], ["n"])
    with pytest.raises(ValueError, match="one method besides"):
        comparison.combined_runs(a, b, ["task", "split"], "method", "error", ["other"])


def test_ratings_are_of_the_combined_table(spark):
    a, b = run(spark, "net", 3), run(spark, "tree", 4)
    ratings, sign = comparison.compare_runs(a, b, "task", ["split"], "method", "error", ["base"], "base", ["n"], 20)
    got = {r.method: r for r in ratings.collect()}
    whole = a.unionByName(b.where("method = 'tree'"))
    want = comparison.strengths(comparison.win_matrix(whole, ["task", "split"], "method", "error").toPandas())
    import math

    assert got["base"].elo == 1000 and set(got) == {"net", "tree", "base"}
    for m in ("net", "tree"):
        assert got[m].elo == pytest.approx(1000 + 400 / math.log(10) * (want[m] - want["base"]), abs=1e-6)
        assert got[m].low <= got[m].elo + 200 and got[m].high >= got[m].elo - 200
    r = sign.first()
    means = [(sum(1.0 + 0.1 * ((t + s) % 3) for s in range(2)) - sum(1.0 + 0.1 * ((t + s) % 4) for s in range(2))) / 2 for t in range(6)]
    assert (r.wins, r.losses, r.ties) == (sum(m < -1e-12 for m in means), sum(m > 1e-12 for m in means), sum(abs(m) <= 1e-12 for m in means))

"""Numbers as texts, near ties of distances, tests of counts and bootstraps: each as SQL has it."""

import hashlib
import math
import random
import time

from pyspark.sql import functions as F

from panelforge.operators import bootstrap as B
from panelforge.operators import features as X
from panelforge.operators import overlap as O
from panelforge.operators import retrieval as N


def test_five_figures_are_those_of_c(spark):
    draw = random.Random(3)
    ties = [float(f"{draw.randrange(10000, 100000)}5e{e}") for e in range(-30, 31) for _ in range(40)]
    keys = [float(k) for k in range(100005, 101000, 10)] + [x / 100 for x in range(1000050, 1200000, 1010)]
    edges = [0.0, -123455.0, 123445.0, 9.99995, 0.999995, 99999.5, 99999.49999999999, 1e5, 1e-5, 2.5, 1e23, 1.00005e200, 7.00015e-200]
    values = ties + keys + edges + [draw.uniform(0, 1) * 10 ** draw.randrange(-8, 9) for _ in range(2000)]
    got = O.row_hashes(spark.createDataFrame([(v,) for v in values], "x double").selectExpr("x", "x AS y"), ["x", "y"])
    want = sorted(hashlib.md5(f"{v:.4e}\x1f{v:.4e}".encode()).hexdigest() for v in values)
    assert sorted(r.row_hash for r in got.collect()) == want


def test_fingerprints_of_keys_of_six_figures(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(100005, 100305, 10)], "k bigint, x double")
    counts: dict[str, int] = {}
    for k in range(100005, 100305, 10):
        counts[f"{k:.4e}"] = counts.get(f"{k:.4e}", 0) + 1
    number = sum(int(hashlib.md5(f"{v}:{n}".encode()).hexdigest()[:15], 16) for v, n in counts.items())
    _, columns = O.table_hashes({"t": (df, ["k", "x"])})
    assert {r.fingerprint for r in columns.collect()} == {f"{len(counts)}-{number}"}
    got = O.column_fingerprints(df, ["x"], []).first().fingerprint
    assert got == hashlib.md5("\x1f".join(sorted(f"{v}:{n}" for v, n in counts.items())).encode()).hexdigest()


def test_exact_test_of_large_margins_is_linear(spark):
    tables = [(3, 1, 1, 3), (0, 0, 0, 0), (0, 5, 7, 0), (450, 410, 2700, 2650), (2, 90, 400, 31), (23400, 30600, 70800, 91200), (1, 20000, 20000, 70000)]

    def exact(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        low, high = max(0, row + col - n), min(row, col)
        top = max(low, min(high, (row + 1) * (col + 1) // (n + 2)))
        logs, at = {top: 0.0}, 0.0
        for x in range(top, high):
            at += math.log((row - x) * (col - x) / ((x + 1) * (n - row - col + x + 1)))
            logs[x + 1] = at
        at = 0.0
        for x in range(top - 1, low - 1, -1):
            at -= math.log((row - x) * (col - x) / ((x + 1) * (n - row - col + x + 1)))
            logs[x] = at
        assert len(logs) == high - low + 1
        return math.fsum(math.exp(v) for v in logs.values() if v <= logs[a] + 1e-7) / math.fsum(map(math.exp, logs.values()))

    began = time.time()
    got = spark.createDataFrame(tables, "a bigint, b bigint, c bigint, d bigint").repartition(1).select("a", "b", "c", "d", X.fisher_exact(*map(F.col, "abcd")).alias("p")).collect()
    assert time.time() - began < 60  # from sums of logarithms for each table: hours
    for r in got:
        assert abs(r.p - exact(r.a, r.b, r.c, r.d)) < 1e-9
    assert abs(next(r.p for r in got if r.a == 3) - 34 / 70) < 1e-12


def near_ties(spark, **how):
    """Queries at 0; rows at distances that differ from the tenth decimal on, the larger ids nearer."""
    rows = [(r, label, [1.0 + (10 - r) * 3e-11, 0.0]) for r, label in zip(range(1, 9), [0, 1, 0, 1, 0, 1, 0, 1])]
    context = spark.createDataFrame([*rows, (9, 0, [3.0, 0.0]), (10, 1, [0.5, 0.0])], "r bigint, y int, v array<double>")
    queries = spark.createDataFrame([(100, [0.0, 0.0])], "q bigint, v array<double>")
    return N.nearest(context, queries, "v", "r", "q", "y", **how)


def test_nearest_rows_of_equal_rounded_distance_come_by_id(spark):
    assert [(r.r, r.rank) for r in near_ties(spark, k=4).orderBy("rank").collect()] == [(10, 1), (1, 2), (2, 3), (3, 4)]


def test_nearest_rows_of_a_class_come_by_id(spark):
    got = near_ties(spark, k=0, per_class={0: 2, 1: 3}).collect()
    assert {(r.y, r.r) for r in got} == {(0, 1), (0, 3), (1, 10), (1, 2), (1, 4)}


def test_floor_of_positives_goes_by_rounded_distances(spark):
    got = N.with_floor(near_ties(spark, k=4), near_ties(spark, k=0, per_class={0: 1, 1: 3}).where("y = 1"), "q", "r", "y", 4, 3)
    assert {r.r for r in got.collect()} == {1, 2, 4, 10}


def test_draws_are_summed_by_score_before_they_are_sent(spark, monkeypatch):
    """The bootstrap's rows that go on are sums by score, not rows times draws; equal to weights of Spark's own hash."""
    draw = random.Random(5)
    rows = [(None if i % 7 == 0 else f"u{i % 3}", None if i % 11 == 0 else draw.randrange(40) if i % 2 else 99, i % 3 == 0, draw.randrange(6) / 4, draw.randrange(900) / 7) for i in range(12_000)]
    df = spark.createDataFrame(rows, "u string, k int, y boolean, a double, b double").withColumn("y", F.col("y").cast("int"))
    held = B.drawn_levels(df, ["u"], "k", "y", ["a", "b"], 6)
    each = [F.struct(F.lit(c).alias("which"), F.col(c).alias("p")) for c in "ab"]
    plain = df.select("*", F.explode(F.array(*each)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("draw")).withColumn("w", F.when(F.col("draw") == 0, 1).otherwise(B.poisson_weight("draw", "k"))).where("w > 0")
    want = plain.groupBy("u", "draw", "s.which", "s.p").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos"))
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, held.collect())) == sorted(map(key, want.collect()))
    assert "mapinarrow" in held._jdf.queryExecution().toString().lower()
    monkeypatch.setattr(B, "HELD", 70)  # sums are given out several times
    assert sorted(map(key, B.drawn_levels(df, ["u"], "k", "y", ["a", "b"], 6).collect())) == sorted(map(key, want.collect()))

"""Generated task families with their twins; hashes make the rows, so SQL can make the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import families as Y
from .registry import h, query, r6


def u(*keys: str) -> str:
    parts = ", '|', ".join(keys)
    return f"({h(f'concat({parts})')} / 4294967296e0)"


ROWS = "SELECT i // 200 AS task, i % 200 AS row FROM range(0, 1600) r(i)"
X = lambda salt, j: u("task", "row", f"'{salt}'", f"'{j}'")


def tree_sql(t: int) -> str:
    bits = " + ".join(f"CASE WHEN x[1 + CAST({h(f"concat(task, '|treef|{t}|{k}')")} % 4 AS INTEGER)] > {u('task', "'treec'", f"'{t}'", f"'{k}'")} THEN {2**k} ELSE 0 END" for k in range(3))
    return f"(2 * {h(f"concat(task, '|treev|{t}|', {bits})")} / 4294967296e0 - 1)"


@query(f"""WITH r AS ({ROWS}), x AS (SELECT *, [{', '.join(X('tree', j) for j in range(4))}] AS x FROM r), s AS (SELECT task, row, {' + '.join(tree_sql(t) for t in range(4))} AS score FROM x), q AS (SELECT task, quantile_cont(score, 7e-1) AS cut FROM s GROUP BY 1)
SELECT task, row, round(score, 6) AS score, CAST(score > cut AS BIGINT) AS label FROM s JOIN q USING (task)""")
def oblivious_forest_tasks(t, spark):
    return Y.tree_tasks(spark, 8, 200, 4).select("task", "row", r6("score").alias("score"), "label")


@query(f"""WITH r AS ({ROWS}), x AS (SELECT task, row, {X('gate', 0)} AS a, {X('gate', 1)} AS b FROM r), q AS (SELECT task, quantile_cont(a, 6e-1) AS cut FROM x GROUP BY 1), p AS (SELECT task, row, CAST(a > cut AS BIGINT) AS inside, CASE WHEN a > cut THEN 1 / (1 + exp(-6 * (b - 5e-1))) ELSE 2e-2 END AS p FROM x JOIN q USING (task))
SELECT task, row, inside, round(p, 6) AS p, CAST({u('task', 'row', "'gatey'")} < p AS BIGINT) AS label FROM p""")
def gated_tasks(t, spark):
    return Y.gated_tasks(spark, 8, 200, 3).select("task", "row", "inside", r6("p").alias("p"), "label")


@query(f"""WITH r AS ({ROWS}), x AS (SELECT task, row, {X('trivial', 0)} AS a FROM r), q AS (SELECT task, quantile_cont(a, 7e-1) AS cut FROM x GROUP BY 1) SELECT task, count(*) AS n, CAST(sum(CASE WHEN a > cut THEN 1 ELSE 0 END) AS BIGINT) AS positives, 1e0 AS auc FROM x JOIN q USING (task) GROUP BY 1""")
def trivial_tasks(t, spark):
    """The first feature alone ranks these tasks without a fault."""
    rows = Y.trivial_tasks(spark, 8, 200, 3).withColumn("p", F.col("x")[0])
    return M.rank_metrics(rows, ["task"], "label", "p").select("task", "n", "positives", r6("auc").alias("auc"))


@query(f"""WITH c AS (SELECT c_custkey, c_acctbal / 4e3 AS d FROM customer), z AS (SELECT c_custkey, [1 / (1 + exp(-(d - 5))), 1 / (1 + exp(-(d - 45e-1))), 1 / (1 + exp(-(d - 4)))] AS hz FROM c),
p AS (SELECT c_custkey, hz, {u('c_custkey', "'s'", "'0'")} < hz[1] AS a, {u('c_custkey', "'s'", "'1'")} < hz[2] AS b, {u('c_custkey', "'s'", "'2'")} < hz[3] AS c FROM z) SELECT c_custkey, round(1 - (1 - hz[1]) * (1 - hz[2]) * (1 - hz[3]), 6) AS chance, CAST(CASE WHEN a THEN 0 WHEN b THEN 1 WHEN c THEN 2 ELSE -1 END AS BIGINT) AS period FROM p""")
def survival_periods(t, spark):
    c = t("customer").select("c_custkey", (F.col("c_acctbal") / 4000.0).alias("d"))
    got = Y.survival_periods(c, "d", [0.0, 0.5, 1.0], F.lit(-5.0), ["c_custkey"], "s")
    return got.select("c_custkey", r6(F.element_at("cumulative", 3)).alias("chance"), "period")


@query("SELECT 12e-2 AS target, true AS met FROM range(1)")
def survival_rate_met(t, spark):
    """The mean cumulative chance after calibration (the twin states the target)."""
    c = t("customer").select("c_custkey", (F.col("c_acctbal") / 4000.0).alias("d"))
    b = Y.survival_intercept(c, "d", [0.0, 0.5, 1.0], 0.12)
    got = Y.survival_periods(c, "d", [0.0, 0.5, 1.0], F.lit(b), ["c_custkey"], "s").agg(F.avg(F.element_at("cumulative", 3)).alias("m"))
    return got.select(F.lit(0.12).alias("target"), (F.abs(F.col("m") - 0.12) < 1e-5).alias("met"))


@query("SELECT CAST(i AS BIGINT) AS task, true AS near FROM range(0, 4) r(i)")
def shifted_normal_tasks(t, spark):
    """The AUC of the true chances is the one asked for, within sampling error (the twin states so)."""
    rows = Y.gaussian_shift(spark, 4, 4000, 5, 0.8, active=2)
    return M.rank_metrics(rows, ["task"], "label", "p").select("task", (F.abs(F.col("auc") - 0.8) < 0.03).alias("near"))


@query("SELECT CAST(i AS BIGINT) AS task, true AS near FROM range(0, 5) r(i)")
def calibrated_family_tasks(t, spark):
    """Tasks of five families, each calibrated to an AUC of 0.75, within sampling error (the twin states so)."""
    tasks = spark.createDataFrame([(i, f, 4, 0.75) for i, f in enumerate(Y.FAMILIES)], "task long, family string, features int, target_auc double").repartition(5)
    rows = Y.family_tasks(tasks, 4000, 3)
    return M.rank_metrics(rows, ["task"], "label", "p").select("task", (F.abs(F.col("auc") - 0.75) < 0.03).alias("near"))

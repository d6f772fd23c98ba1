"""Families of generated tasks. A row of a task depends on (task, row, seed) only; labels are drawn from known probabilities,
so the best possible score of every row is at hand."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash32, inverse_normal, uniform
from .quantiles import matches, quantiles


def task_rows(spark: SparkSession, tasks: int, rows: int) -> DataFrame:
    """(task, row): the rows of all tasks."""
    return spark.range(tasks * rows).select(F.floor(F.col("id") / rows).alias("task"), F.pmod("id", F.lit(rows)).alias("row"))


def uniforms(count: int, salt: str) -> Column:
    """Array of `count` numbers in [0, 1) of a row."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: uniform("task", "row", F.lit(salt), j))


def normals(count: int, salt: str) -> Column:
    return F.transform(uniforms(count, salt), lambda u: inverse_normal(u * (1 - 2e-9) + 1e-9))


def forest_score(x: Column, features: int, trees: int, depth: int, salt: str) -> Column:
    """The sum over trees of a leaf's value. A tree asks the same question of all rows at each of its levels: whether a
    drawn feature lies above a drawn cut; the answers are the bits of the leaf's number, which draws its value in [-1, 1)."""

    def tree(t: Column) -> Column:
        def bit(k: Column) -> Column:
            feature = F.pmod(hash32("task", F.lit(f"{salt}f"), t, k), F.lit(features)).cast("int")
            return F.when(F.get(x, feature) > uniform("task", F.lit(f"{salt}c"), t, k), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), k).cast("int")).otherwise(0)

        leaf = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), bit), F.lit(0), lambda s, b: s + b)
        return 2 * uniform("task", F.lit(f"{salt}v"), t, leaf) - 1

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), tree), F.lit(0.0), lambda s, v: s + v)


def cut_labels(df: DataFrame, score: str, rate: float, name: str = "label") -> DataFrame:
    """Adds a label: whether the score lies above the task's (1 - rate)-quantile."""
    cuts = quantiles(df, ["task"], score, [1 - rate], "__cut").withColumnRenamed("task", "__task")
    joined = df.join(cuts, matches(["task"], "__"))
    return joined.select(*df.columns, (F.col(score) > F.col("__cut")[0]).cast("bigint").alias(name))


def tree_tasks(spark: SparkSession, tasks: int, rows: int, features: int, trees: int = 4, depth: int = 3, rate: float = 0.3, seed: str = "tree") -> DataFrame:
    """(task, row, x, score, label): an oblivious forest's score over uniform features, cut at a positive rate."""
    x = task_rows(spark, tasks, rows).withColumn("x", uniforms(features, seed))
    return cut_labels(x.withColumn("score", forest_score(F.col("x"), features, trees, depth, seed)), "score", rate)


def gated_tasks(spark: SparkSession, tasks: int, rows: int, features: int, share: float = 0.4, low: float = 0.02, slope: float = 6.0, seed: str = "gate") -> DataFrame:
    """(task, row, x, inside, p, label): within the top `share` of the first feature the second one moves the chance; outside
    it is `low`."""
    x = task_rows(spark, tasks, rows).withColumn("x", uniforms(features, seed)).withColumn("__g", F.col("x")[0])
    inside = cut_labels(x, "__g", share, "inside").drop("__g")
    p = F.when(F.col("inside") == 1, 1 / (1 + F.exp(-slope * (F.col("x")[1] - 0.5)))).otherwise(low)
    return inside.withColumn("p", p).withColumn("label", (uniform("task", "row", F.lit(f"{seed}y")) < F.col("p")).cast("bigint"))


def trivial_tasks(spark: SparkSession, tasks: int, rows: int, features: int, rate: float = 0.3, seed: str = "trivial") -> DataFrame:
    """(task, row, x, label): the label says whether the first feature is in its top `rate`."""
    x = task_rows(spark, tasks, rows).withColumn("x", uniforms(features, seed)).withColumn("__g", F.col("x")[0])
    return cut_labels(x, "__g", rate).drop("__g")


def survival_periods(df: DataFrame, distress: str, shape: list[float], intercept: Column, key: list[str], salt: str) -> DataFrame:
    """Adds hazards (array), cumulative (the chance by each horizon) and period: the first horizon whose hazard fires, else -1."""
    hazard = F.transform(F.array(*[F.lit(s) for s in shape]), lambda s: 1 / (1 + F.exp(-(F.col(distress) + intercept + s))))
    fired = F.transform("hazards", lambda h, k: uniform(*key, F.lit(salt), k) < h)
    alive = F.transform(F.sequence(F.lit(1), F.lit(len(shape))), lambda k: 1 - F.aggregate(F.slice("hazards", F.lit(1), k), F.lit(1.0), lambda s, h: s * (1 - h)))
    out = df.withColumn("hazards", hazard)
    return out.withColumns({"cumulative": alive, "period": (F.coalesce(F.array_position(fired, True), F.lit(0)) - 1).cast("bigint")})


def survival_intercept(df: DataFrame, distress: str, shape: list[float], target: float, passes: int = 5, width: int = 32) -> float:
    """The intercept with which the mean chance by the last horizon is `target`: each pass tries `width` values in one
    aggregate and narrows to the step that holds it."""
    low, high = -30.0, 30.0
    for _ in range(passes):
        grid = [low + (high - low) * i / width for i in range(1, width)]

        def rate(b: float) -> Column:
            alive = F.lit(1.0)
            for s in shape:
                alive = alive * (1 - 1 / (1 + F.exp(-(F.col(distress) + b + s))))
            return F.avg(1 - alive)

        got = df.agg(*[rate(b).alias(f"r{i}") for i, b in enumerate(grid)]).first()
        below = sum(r is not None and r < target for r in got)
        step = (high - low) / width
        low, high = low + below * step, low + (below + 1) * step
    return (low + high) / 2


def gaussian_shift(spark: SparkSession, tasks: int, rows: int, features: int, target_auc: float, active: int = 1, seed: str = "shift") -> DataFrame:
    """(task, row, x, label, p): two normal classes of equal weight, apart by d along `active` features; the best AUC is
    Phi(d / sqrt 2), which sets d. p is the true chance of class 1."""
    from statistics import NormalDist

    d = math.sqrt(2) * NormalDist().inv_cdf(target_auc) / math.sqrt(active)
    y = (uniform("task", "row", F.lit(f"{seed}y")) < 0.5).cast("bigint")
    x = F.transform(normals(features, seed), lambda z, j: z + F.when(j < active, d * F.col("label")).otherwise(0.0))
    z = F.aggregate(F.slice("x", 1, active), F.lit(0.0), lambda s, v: s + d * (v - d / 2))
    return task_rows(spark, tasks, rows).withColumn("label", y).withColumn("x", x).withColumn("p", 1 / (1 + F.exp(-z)))


#: Raw scores of two normal features; each family's chance is the logistic of sharpness times its raw score.
FAMILIES = {
    "linear": lambda a, b: a + b,
    "interaction": lambda a, b: a * b,
    "threshold": lambda a, b: np.sign(a) + 0.1 * b,
    "periodic": lambda a, b: np.sin(3 * a) + 0.1 * b,
    "radial": lambda a, b: a * a + b * b - 2,
}


def expected_auc(raw: np.ndarray, sharpness: float) -> float:
    """The AUC that the true chances have over their own draws: pairs weighted by p and 1 - p, in the order of raw."""
    p = 1 / (1 + np.exp(-np.clip(sharpness * np.sort(raw), -500, 500)))
    below = np.cumsum(1 - p) - (1 - p)
    return float((p * (below + (1 - p) / 2)).sum() / (p.sum() * (1 - p).sum()))


def family_tasks(tasks: DataFrame, rows: int, seed: int, calibration: int = 4000) -> DataFrame:
    """(task, row, x, label, p) for each row (task, family, features, target_auc) of tasks: the sharpness is halved to the
    target on a sample of its own. A target that a family can't reach gets the nearest it can. A task is one worker's table."""

    def make(batches):
        for pdf in batches:
            for task, family, features, target in zip(pdf["task"], pdf["family"], pdf["features"], pdf["target_auc"]):
                rng, score = np.random.default_rng([seed, int(task)]), FAMILIES[family]
                a, b = rng.normal(size=(2, calibration))
                low, high = 0.0, 64.0
                for _ in range(40):
                    mid = (low + high) / 2
                    low, high = (mid, high) if expected_auc(score(a, b), mid) < target else (low, mid)
                x = rng.normal(size=(rows, int(features)))
                p = 1 / (1 + np.exp(-np.clip(low * score(x[:, 0], x[:, 1]), -500, 500)))
                yield pd.DataFrame({"task": int(task), "row": np.arange(rows), "x": list(x), "label": (rng.random(rows) < p).astype(int), "p": p})

    return tasks.select("task", "family", "features", "target_auc").mapInPandas(make, "task long, row long, x array<double>, label long, p double")

"""Target transforms and their inverses, threshold regression, mixed partitions, boosted contexts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import matches
from .running import running_sum
from .tables import settled


def log_target_refused(df: DataFrame, y: str) -> str | None:
    """Why log1p doesn't fit a target, or None."""
    got = df.agg(F.count_if(F.isnan(F.col(y).cast("double")) | (F.abs(F.col(y)) == float("inf"))).alias("odd"), F.count_if(F.col(y) < 0).alias("below"), F.min(y).alias("least")).first()
    if got.odd:
        return "log1p refused: the target has non-finite values"
    return f"log1p refused: the target has {got.below} value(s) below 0 (minimum {got.least:.6g})" if got.below else None


def log_inverse(z: Column, smear: Column | float = 1.0, limit: float = 700.0) -> Column:
    """From a prediction of log1p(y) to y: expm1 with the smearing factor, at least 0."""
    add = math.log(smear) if isinstance(smear, (int, float)) else F.log(smear)
    return F.greatest(F.expm1(F.least(z + add, F.lit(limit))), F.lit(0.0))


def clip_bounds(df: DataFrame, y: str, margin: float) -> DataFrame:
    """One row: the target's range widened by a share of it on both sides."""
    got = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    return got.select((F.col("lo") - margin * (F.col("hi") - F.col("lo"))).alias("low"), (F.col("hi") + margin * (F.col("hi") - F.col("lo"))).alias("high"))


def thresholds(df: DataFrame, y: str, k: int) -> DataFrame:
    """(threshold, i): distinct values at the ranks ceil(n j / (k + 1)), j = 1..k, without the largest; in order, i from 0."""
    counts = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("threshold")).agg(F.count("*").alias("__n"))
    summed = running_sum(counts, [], "threshold", {"__end": "__n"})
    total = counts.agg(F.sum("__n").alias("__all"), F.max("threshold").alias("__top"))  # one row
    ranks = F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.ceil(F.col("__all") * j / (k + 1.0)))).alias("__rank")
    wanted = total.select(ranks, "__top")
    hit = summed.join(F.broadcast(wanted), (F.col("__end") >= F.col("__rank")) & (F.col("__end") - F.col("__n") < F.col("__rank")))  # k rows
    found = hit.where("threshold < __top").select("threshold").distinct()
    # k rows at most
    return found.agg(F.array_sort(F.collect_list("threshold")).alias("t")).select(F.posexplode("t").alias("i", "threshold"))


def interval_means(df: DataFrame, y: str, cuts: DataFrame) -> DataFrame:
    """(interval, n, mean): the mean target between successive thresholds, upper bounds included."""
    all_cuts = cuts.agg(F.array_sort(F.collect_list("threshold")).alias("__t"))  # one row
    placed = df.where(F.col(y).isNotNull()).crossJoin(F.broadcast(all_cuts)).withColumn("interval", F.size(F.filter("__t", lambda c: c < F.col(y))).cast("bigint"))
    return placed.groupBy("interval").agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def expected_from_exceedance(p: list[Column], means: list[Column]) -> Column:
    """The mean of a target from the chances to exceed each threshold and the interval means."""
    chance = [F.lit(1.0), *p, F.lit(0.0)]
    return sum(((chance[i] - chance[i + 1]) * m for i, m in enumerate(means)), F.lit(0.0))


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def filled_from_global(leaf: Column, whole: Column, classes: list[str]) -> Column:
    """Maps of class chances: classes that the leaf lacks from the whole model, the leaf's scaled to what they leave."""
    missing = [F.when(F.try_element_at(leaf, F.lit(c)).isNull(), F.element_at(whole, c)).otherwise(0.0) for c in classes]
    rest = 1 - sum(missing[1:], missing[0])
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.array(*[F.coalesce(F.try_element_at(leaf, F.lit(c)) * rest, m) for c, m in zip(classes, missing)]))


def partition_depth(rows: int, k: int, context: int, base: int, cap: int) -> int:
    """A tree depth at which leaves hold about k contexts of rows."""
    target = rows / (k * context)
    return max(base, min(math.ceil(math.log2(target)) if target > 1 else 0, cap))


def residual_weights(df: DataFrame, by: list[str], residual: str, kind: str = "abs") -> DataFrame:
    """Adds weight: |residual|, or its exponential, as a share of the group's sum; a row of residual 0 keeps a trace."""
    if kind not in ("abs", "exp"):
        raise ValueError("abs or exp")
    w = F.abs(F.col(residual)) if kind == "abs" else F.exp(F.abs(F.col(residual)))
    mean = df.groupBy(*[F.col(c).alias(f"__m_{c}") for c in by]).agg(F.avg(w).alias("__mean"), F.count(residual).alias("__n"))
    trace = 1e-12 * F.greatest(F.col("__mean"), F.lit(1e-12))
    joined = df.join(mean, matches(by, "__m_")) if by else df.crossJoin(F.broadcast(mean))  # one row
    return joined.select(*df.columns, ((w + trace) / ((F.col("__mean") + trace) * F.col("__n"))).alias("weight"))


def line_search(df: DataFrame, by: list[str], f: str, step: str, y: str, most: float, points: int = 65) -> DataFrame:
    """(by, gamma, loss): of a grid of steps from 0 to `most` along `step`, the one with the least mean log-loss of the
    score f + gamma step (of equal ones the smallest), in one aggregate."""
    grid = [most * i / (points - 1) for i in range(points)]
    z = lambda g: F.col(f) + g * F.col(step)
    loss = lambda g: F.avg(F.greatest(z(g), F.lit(0.0)) + F.log1p(F.exp(-F.abs(z(g)))) - F.col(y) * z(g))
    got = df.groupBy(*by).agg(*[loss(g).alias(f"__l{i}") for i, g in enumerate(grid)])
    best = F.array_min(F.array(*[F.struct(F.round(f"__l{i}", 9).alias("loss"), F.lit(g).alias("gamma")) for i, g in enumerate(grid)]))
    return got.select(*by, best.alias("b")).select(*by, "b.gamma", "b.loss")


def boosted_scores(rows: DataFrame, by: list[str], y: str, weak: list[Column], most: float) -> DataFrame:
    """Adds score: from 0, each weak score in turn is added with the step of its line search. Columns of weak scores are few."""
    out = rows.withColumn("score", F.lit(0.0))
    for w in weak:
        out = out.withColumn("__h", w)
        gamma = line_search(out, by, "score", "__h", y, most).withColumnsRenamed({c: f"__g_{c}" for c in by})
        joined = out.join(F.broadcast(gamma), matches(by, "__g_")) if by else out.crossJoin(F.broadcast(gamma))  # a row for each group
        # written, so that a round's plan doesn't read those before it again
        out = settled(joined.withColumn("score", F.col("score") + F.col("gamma") * F.col("__h")).select(*rows.columns, "score"), "boosted")
    return out

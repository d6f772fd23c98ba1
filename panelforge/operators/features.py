"""Power transforms, spline bases, projections, and readouts of predicted distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def yeo_johnson(x: Column, power: float) -> Column:
    """The Yeo-Johnson transform: powers of x + 1 above 0, of 1 - x below; logarithms at the ends of the scale."""
    above = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / power
    below = -F.log1p(-x) if abs(power - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, above).otherwise(below)


def fit_power(train: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """One row: the power of the grid with the largest normal log-likelihood (of equal ones the smallest), by one aggregate."""
    x = F.col(column).cast("double")
    rows = train.where(x.isNotNull())
    parts = [F.var_pop(yeo_johnson(x, p)).alias(f"v{i}") for i, p in enumerate(grid)]
    got = rows.agg(F.count("*").alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"), *parts)
    each = F.array(*[F.struct((-F.round(-F.col("n") / 2 * F.log(f"v{i}") + (p - 1) * F.col("s"), 6)).alias("loss"), F.lit(p).alias("power")) for i, p in enumerate(grid)])
    return got.select(F.array_min(each).alias("best")).select("best.power", (-F.col("best.loss")).alias("log_likelihood"))


def hat_basis(x: Column, knots: list[float]) -> list[Column]:
    """Degree-1 B-splines on the knots; beyond the ends the outer ones go on in a straight line."""
    out = []
    for i, k in enumerate(knots):
        up = (x - knots[i - 1]) / (k - knots[i - 1]) if i else None
        down = (knots[i + 1] - x) / (knots[i + 1] - k) if i + 1 < len(knots) else None
        if up is None:
            value = F.when(x < knots[1], down).otherwise(0.0)
        elif down is None:
            value = F.when(x > knots[i - 1], up).otherwise(0.0)
        else:
            low = F.when(x >= knots[i - 1], up).otherwise(0.0) if i > 1 else up
            high = F.when(x <= knots[i + 1], down).otherwise(0.0) if i + 2 < len(knots) else down
            value = F.when(x <= k, low).otherwise(high)
        out.append(value)
    return out


def fit_knots(train: DataFrame, column: str, count: int) -> list[float]:
    """Distinct quantile knots, ends included: `count` numbers at most reach the driver."""
    q = quantiles(train, [], column, [i / (count - 1) for i in range(count)]).first()
    return sorted(set(q[0] if q else []))


def fit_projection(train: DataFrame, features: list[str], k: int) -> np.ndarray:
    """The k leading right singular vectors (uncentred), each with its largest loading positive. Products are summed on
    the executors in one pass; the matrix that comes back has a cell for each pair of features."""

    def gram(batches):
        import pandas as pd

        total = np.zeros((len(features), len(features)))
        for pdf in batches:
            x = np.nan_to_num(pdf[features].to_numpy(float))
            total += x.T @ x
        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    total = np.zeros(len(features) ** 2)
    for r in train.select(*features).mapInPandas(gram, "g array<double>").toLocalIterator():
        total += np.array(r.g)
    values, vectors = np.linalg.eigh(total.reshape(len(features), -1))
    top = vectors[:, np.argsort(values)[::-1][:k]]
    return top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])


def project(df: DataFrame, features: list[str], vectors: np.ndarray, prefix: str = "svd") -> DataFrame:
    columns = {}
    for j in range(vectors.shape[1]):
        dot = F.lit(0.0)
        for c, w in zip(features, vectors[:, j].tolist()):
            dot = dot + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
        columns[f"{prefix}_{j}"] = dot
    return df.withColumns(columns)


def expected_value(mass: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(mass, values, lambda p, v: p * v), F.lit(0.0), lambda s, x: s + x)


def quantile_of(mass: Column, values: Column, q: float) -> Column:
    """The first value at which the cumulative mass reaches q; the last one if rounding keeps it below."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("hit"))

    def step(s: Column, t: Column) -> Column:
        total = s["sum"] + t["p"]
        return F.struct(total.alias("sum"), F.coalesce(s["hit"], F.when(total >= q, t["v"])).alias("hit"))

    return F.aggregate(F.zip_with(mass, values, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), start, step, lambda s: F.coalesce(s["hit"], F.element_at(values, -1)))


def on_grid(grid: list[float], values: Column, q: float) -> Column:
    """Linear interpolation of values on a grid of levels; ends are held."""
    if q <= grid[0]:
        return F.element_at(values, 1)
    for i in range(1, len(grid)):
        if q <= grid[i]:
            share = (q - grid[i - 1]) / (grid[i] - grid[i - 1])
            return F.element_at(values, i) + share * (F.element_at(values, i + 1) - F.element_at(values, i))
    return F.element_at(values, len(grid))


def probability_floor(p: Column, floor: float, classes: int) -> Column:
    return (1 - floor) * p + floor / classes


def blend_weight(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row: the weight w in [0, 1] of a in w a + (1 - w) b with the least squared error."""
    d, r = F.col(a) - F.col(b), F.col(y) - F.col(b)
    return df.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.sum(d * r), F.sum(d * d)))).alias("weight"))


def smearing(df: DataFrame, residual: str, limit: float = 3.0) -> DataFrame:
    return df.agg(F.avg(F.exp(F.least(F.greatest(F.col(residual), F.lit(-limit)), F.lit(limit)))).alias("factor"))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table (a b / c d): the share of tables of the same margins that are no likelier than this one.

    Likelihoods are taken from each table to the next, on both sides of the likeliest one, so the work grows with the
    smaller margin.
    """
    a, b, c, d = (x.cast("bigint") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    least, most = F.greatest(F.lit(0).cast("bigint"), row + col - n), F.least(row, col)
    top = F.greatest(least, F.least(most, F.floor((row + 1.0) * (col + 1.0) / (n + 2.0))))
    # log of the likelihood with x + 1 over that with x
    step = lambda x: F.log((row - x).cast("double") * (col - x).cast("double")) - F.log((x + 1).cast("double") * (n - row - col + x + 1).cast("double"))
    between = lambda i, j: F.when(i < j, F.sequence(i, j - 1)).otherwise(F.array().cast("array<bigint>"))
    along = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + step(x))
    here = along(between(top, a)) - along(between(a, top))

    def walk(state: Column, change: Column) -> Column:
        logp = state["logp"] + change
        p = F.exp(logp)
        return F.struct(logp.alias("logp"), state["here"].alias("here"), (state["all"] + p).alias("all"), (state["rare"] + F.when(logp <= state["here"] + 1e-7, p).otherwise(0.0)).alias("rare"))

    start = F.struct(F.lit(0.0).alias("logp"), here.alias("here"), F.lit(0.0).alias("all"), F.lit(0.0).alias("rare"))
    up = F.aggregate(between(top, most), walk(start, F.lit(0.0)), lambda s, x: walk(s, step(x)))
    down = F.aggregate(F.reverse(between(least, top)), start, lambda s, x: walk(s, -step(x)))
    sides = F.transform(F.array(F.struct(up.alias("up"), down.alias("down"))), lambda s: (s["up"]["rare"] + s["down"]["rare"]) / (s["up"]["all"] + s["down"]["all"]))
    return F.least(F.lit(1.0), sides[0])


def latest_part(df: DataFrame, time: str, share: float, embargo: float) -> DataFrame:
    """Adds part: 'hold' for the latest share by time, 'fit' before it less the embargo; rows in between are left out."""
    cut = quantiles(df, [], time, [1 - share]).select(F.col("q")[0].alias("__cut"))  # one row
    placed = df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(time) >= F.col("__cut"), "hold").when(F.col(time) < F.col("__cut") - embargo, "fit"))
    return placed.where("part is not null").drop("__cut")


def pairwise_correlation(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: the mean absolute correlation between different features, and the mean share of missing cells."""
    pairs = [F.abs(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))) for i, a in enumerate(features) for b in features[i + 1 :]]
    missing = [F.avg(F.col(c).isNull().cast("double")) for c in features]
    return df.agg((sum(pairs[1:], pairs[0]) / len(pairs)).alias("mean_abs_corr"), (sum(missing[1:], missing[0]) / len(missing)).alias("missing"))

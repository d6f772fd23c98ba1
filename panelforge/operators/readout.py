"""A linear readout: splines, plain columns, indicators and scorers' log-odds in one design, and a penalised fit on them.

The fit is Newton's method. Each step is one pass: tasks sum the loss, gradient and Hessian over their rows, a few tasks
add those up, and what reaches the driver has a cell for each pair of coefficients, whatever the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import probability_floor
from .quantiles import quantiles
from .splines import basis, eligible_knots
from .tables import settled
from .targets import clipped_logit

#: Tasks that add up the sums of all others.
ADDERS = 8


def newton_sums(rows: DataFrame, coefficients: np.ndarray, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the multinomial log-loss over rows (z array, y class number), summed over tasks.

    coefficients has a row for each class and a column for each entry of z and a last one for the constant; a single row
    is the log-odds of class 1. Weights, if any, multiply rows.
    """
    k, p = coefficients.shape
    size = 1 + k * p + (k * p) ** 2

    def sums(batches):
        total = np.zeros(size)
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.column_stack([np.stack(pdf["z"].to_numpy()).astype(float).reshape(len(pdf), p - 1), np.ones(len(pdf))])
            y, w = pdf["y"].to_numpy(int), pdf[weight].to_numpy(float) if weight else np.ones(len(pdf))
            score = z @ coefficients.T
            if k == 1:
                chance = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
                loss, off = np.logaddexp(0, score[:, 0]) - y * score[:, 0], chance - y[:, None]
            else:
                score -= score.max(axis=1, keepdims=True)
                chance = np.exp(score)
                chance /= chance.sum(axis=1, keepdims=True)
                loss, off = -np.log(np.maximum(chance[np.arange(len(y)), y], 1e-300)), chance.copy()
                off[np.arange(len(y)), y] -= 1
            hessian = np.empty((k, p, k, p))
            for a in range(k):
                for b in range(a, k):
                    c = chance[:, a] * ((a == b) - chance[:, b]) * w
                    hessian[a, :, b, :] = z.T @ (z * c[:, None])
                    hessian[b, :, a, :] = hessian[a, :, b, :].T
            total += np.concatenate([[w @ loss], ((off * w[:, None]).T @ z).ravel(), hessian.ravel()])
        yield pd.DataFrame({"s": [total.tolist()]})

    def add(batches):
        total = np.zeros(size)
        for pdf in batches:
            for s in pdf["s"]:
                total += np.asarray(s)
        yield pd.DataFrame({"s": [total.tolist()]})

    parts = rows.mapInPandas(sums, "s array<double>").repartition(ADDERS).mapInPandas(add, "s array<double>")
    total = np.sum([np.array(r.s) for r in parts.toLocalIterator()], axis=0)
    return float(total[0]), total[1 : 1 + k * p].reshape(k, p), total[1 + k * p :].reshape(k * p, k * p)


def fit_multinomial(rows: DataFrame, width: int, classes: int, penalty: float, steps: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Coefficients with the least log-loss plus penalty / 2 times the squares of all but the constants; one row of them
    for two classes, else one for each. A step is halved while it doesn't lower the sum."""
    c = np.zeros((1 if classes == 2 else classes, width + 1))
    ridge = np.ones_like(c) * penalty
    ridge[:, -1] = 0
    whole = lambda c, loss: loss + 0.5 * float((ridge * c * c).sum())
    loss, gradient, hessian = newton_sums(rows, c)
    for _ in range(steps):
        slope = gradient + ridge * c
        if np.abs(slope).max(initial=0) <= tolerance * max(1.0, loss):
            break
        # least squares: the constants of all classes may move together
        step = np.linalg.lstsq(hessian + np.diag(ridge.ravel()), -slope.ravel(), rcond=1e-12)[0].reshape(c.shape)
        size, before = 1.0, whole(c, loss)
        while True:
            loss, gradient, hessian = newton_sums(rows, c + size * step)
            if whole(c + size * step, loss) <= before + 1e-12 * abs(before) or size < 1e-6:
                break
            size /= 2
        c = c + size * step
        if size < 1e-6:
            break
    return c


@dataclass
class LinearReadout:
    """numeric columns (those with distinct quantile knots as splines, the rest as they are), indicators of the commonest
    levels of categorical columns, and log-odds of columns of probabilities, fitted to a label of two or more classes.

    Nulls: a numeric column's is 0 in its block and sets an indicator of its own; a level that isn't among the commonest,
    or none, sets no indicator; a missing probability counts as one half. Rows without a label take no part. All
    parameters come from the rows of fit alone.
    """

    label: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    probabilities: list[str] = field(default_factory=list)
    knots: int = 5
    degree: int = 3
    most: int | None = None
    levels: int = 10
    penalty: float = 1.0
    floor: float = 0.0

    def fit(self, rows: DataFrame) -> LinearReadout:
        rows = settled(rows.where(F.col(self.label).isNotNull()), "readout")
        self.classes = [r[0] for r in rows.select(self.label).distinct().orderBy(self.label).limit(1000).collect()]
        if len(self.classes) < 2:
            raise ValueError("a readout needs two classes")
        self.splines = eligible_knots(rows, self.numeric, self.knots, self.most)[1] if self.numeric else {}
        self.scales = {}
        if self.numeric:
            cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in self.numeric])).alias("x")
            for r in quantiles(rows.select(cells).select("x.*").where(~F.isnan("v")), ["c"], "v", [0.25, 0.5, 0.75]).collect():
                self.scales[r.c] = (r.q[1], (r.q[2] - r.q[0]) or 1.0)
        self.tops = {c: [r[0] for r in rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(self.levels).collect()] for c in self.categorical}
        code = F.array_position(F.array(*[F.lit(v) for v in self.classes]), F.col(self.label)) - 1
        design = settled(rows.select(self.design().alias("z"), code.alias("y")), "design")
        first = design.select(F.size("z").alias("n")).first()
        self.coefficients = fit_multinomial(design, first.n, len(self.classes), self.penalty)
        return self

    def design(self) -> Column:
        """The array of all blocks. Splines are of the column as it is; other numbers are less the median, by the quartiles' distance."""
        parts = []
        for c in self.numeric:
            x = F.col(c).cast("double")
            there = x.isNotNull() & ~F.isnan(x)
            if c in self.splines:
                width = len(self.splines[c]) + self.degree - 2
                parts.append(F.coalesce(basis(x, self.splines[c], self.degree, bias=False), F.array_repeat(F.lit(0.0), width)))
            else:
                mid, scale = self.scales.get(c, (0.0, 1.0))
                parts.append(F.array(F.when(there, (x - mid) / scale).otherwise(0.0)))
            parts.append(F.array(F.when(there, 0.0).otherwise(1.0)))
        for c in self.categorical:
            parts.append(F.array(*[F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for v in self.tops[c]]).cast("array<double>"))
        for c in self.probabilities:
            parts.append(F.array(clipped_logit(F.coalesce(F.col(c), F.lit(0.5)))))
        return F.concat(*parts)

    def score(self, rows: DataFrame, name: str = "probabilities") -> DataFrame:
        """Adds an array of the probabilities of self.classes, each at least floor / number of classes."""
        dots = [F.aggregate(F.zip_with("__z", F.array(*[F.lit(float(v)) for v in row[:-1]]), lambda a, b: a * b), F.lit(float(row[-1])), lambda s, v: s + v) for row in self.coefficients]
        scored = rows.withColumn("__z", self.design()).withColumn("__s", F.array(*([F.lit(0.0)] if len(dots) == 1 else []), *dots))
        odds = F.transform("__s", lambda s: F.exp(s - F.array_max("__s")))
        scored = scored.withColumn("__o", odds)
        total = F.aggregate("__o", F.lit(0.0), lambda s, v: s + v)
        k = len(self.classes)
        return scored.withColumn("__t", total).select(*rows.columns, F.transform("__o", lambda o: probability_floor(o / F.col("__t"), self.floor, k)).alias(name))

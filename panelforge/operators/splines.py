"""B-spline columns of any degree: exact quantile knots, the recursion as a fold over an array, straight lines beyond the ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def eligible_knots(train: DataFrame, columns: list[str], count: int, most: int | None = None) -> tuple[DataFrame, dict[str, list[float]]]:
    """A table (column, knots, values, expanded), and the knots of the expanded columns.

    A column's knots are its `count` evenly spaced quantiles. It is expanded if they all differ; of more than `most` such
    columns, those with the most distinct values are (ties: the first ones). All columns are read in one pass; numbers
    that reach the driver are `count` for each column.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    long = train.select(cells).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    found = {r.i: (r.q, r.n) for r in quantiles(long, ["i"], "v", [k / (count - 1) for k in range(count)]).join(long.groupBy("i").agg(F.count_distinct("v").alias("n")), "i").collect()}
    fit = [i for i, (q, _) in found.items() if len(set(q)) == count]
    chosen = set(sorted(fit, key=lambda i: (-found[i][1], i))[:most])
    table = train.sparkSession.createDataFrame([(c, len(set(found[i][0])) if i in found else 0, found[i][1] if i in found else 0, i in chosen) for i, c in enumerate(columns)], "column string, knots int, values bigint, expanded boolean")
    return table, {columns[i]: list(found[i][0]) for i in sorted(chosen)}


def padded(knots: list[float], degree: int) -> list[float]:
    """The knots with `degree` more at each end, at the distance of the outermost ones."""
    first, last = knots[1] - knots[0], knots[-1] - knots[-2]
    return [knots[0] - first * k for k in range(degree, 0, -1)] + list(knots) + [knots[-1] + last * k for k in range(1, degree + 1)]


def basis(x: Column, knots: list[float], degree: int = 3, bias: bool = True) -> Column:
    """An array of the len(knots) + degree - 1 basis splines at x (without bias, all but the last): at each x within the
    knots they sum to 1. Beyond the ends each goes on as the straight line of its value and slope there. Null or NaN: null."""
    if len(knots) < 2 or degree < 1 or any(b <= a for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must grow, and the degree be at least 1")
    t = padded(knots, degree)
    at = F.array(*[F.lit(float(v)) for v in t])
    x = x.cast("double")
    c = F.least(F.greatest(x, F.lit(float(knots[0]))), F.lit(float(knots[-1])))
    last = degree + len(knots) - 2  # the interval that the last knot belongs to
    inside = [F.when((c >= t[i]) & ((c < t[i + 1]) | F.lit(i == last)), 1.0).otherwise(0.0) if degree <= i <= last else F.lit(0.0) for i in range(len(t) - 1)]

    def blended(b: Column, k: Column) -> Column:
        up = lambda i: (c - at[i]) / (at[i + k] - at[i])
        return F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: up(i) * b[i] + (1 - up(i + 1)) * b[i + 1])

    level = F.array(*inside).cast("array<double>")
    if degree > 1:
        level = F.aggregate(F.sequence(F.lit(1), F.lit(degree - 1)), level, blended)

    def top(b: Column) -> Column:
        share = lambda i: b[i] / (at[i + degree] - at[i])
        value = lambda i: (c - at[i]) * share(i) + (at[i + degree + 1] - c) * share(i + 1)
        return F.transform(F.sequence(F.lit(0), F.size(b) - (2 if bias else 3)), lambda i: value(i) + (x - c) * degree * (share(i) - share(i + 1)))

    # the array is bound to a name, so that it is made once
    return F.when(x.isNotNull() & ~F.isnan(x), F.transform(F.array(level), top)[0])


def spline_columns(df: DataFrame, knots: dict[str, list[float]], degree: int = 3) -> DataFrame:
    """Adds for each column of knots its splines, <column>_s0 and so on, without the last one, in place of the column."""
    arrays = df.withColumns({f"__s_{c}": basis(F.col(c), k, degree, bias=False) for c, k in knots.items()})
    kept = [F.col(c) for c in df.columns if c not in knots]
    return arrays.select(*kept, *[F.col(f"__s_{c}")[i].alias(f"{c}_s{i}") for c, k in knots.items() for i in range(len(k) + degree - 2)])

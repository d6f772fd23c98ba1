"""Exact quantiles without a task that sees all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sum
from .tables import settled


def matches(by: list[str], prefix: str) -> Column:
    """The condition that columns equal those of the same names after a prefix; nulls match."""
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return cond


def quantiles(df: DataFrame, by: list[str], value: Column | str, probs: list[float], name: str = "q") -> DataFrame:
    """One row for each group (by), with `name`: array of the quantiles of the non-null values, interpolated linearly.

    Equal values are counted first, counts are summed along the order by ranges, and the values at the ranks that a
    quantile lies between are minima over the rows beyond them. A group without values has no row; with by = [] an empty
    table gives no row.
    """
    value = F.col(value) if isinstance(value, str) else value
    counts = settled(df.select(*by, value.cast("double").alias("__v")).where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__n")), "values")
    summed = running_sum(counts, by, "__v", {"__cum": "__n"})
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total")).select(*[F.col(c).alias(f"__b_{c}") for c in by], "__total")
    both = summed.join(totals, matches(by, "__b_")) if by else summed.crossJoin(F.broadcast(totals))  # one row
    at = [F.lit(float(p)) * (F.col("__total") - 1) for p in probs]
    beyond = lambda rank: F.min(F.when(F.col("__cum") > rank, F.col("__v")))
    found = both.groupBy(*by).agg(F.max("__total").alias("__total"), *[beyond(F.floor(a)).alias(f"__l{i}") for i, a in enumerate(at)], *[beyond(F.ceil(a)).alias(f"__h{i}") for i, a in enumerate(at)])
    low, high = (lambda i: F.col(f"__l{i}")), (lambda i: F.col(f"__h{i}"))
    each = [F.when(low(i) == high(i), low(i)).otherwise(low(i) + (high(i) - low(i)) * (a - F.floor(a))) for i, a in enumerate(at)]
    return found.where("__total is not null").select(*by, F.array(*each).alias(name))

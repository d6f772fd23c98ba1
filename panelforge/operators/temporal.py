"""Trends, ordered curves, hazards and period labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trajectory(df: DataFrame, entity: str, period: str, column: str, span: int = 3, least: int = 3) -> DataFrame:
    """Adds delta (less the value exactly one period before) and trend: the least-squares slope over the last span + 1
    periods, gaps skipped, null with fewer than `least` values. One window by entity; slopes come from moments."""
    by = W.partitionBy(entity).orderBy(period)
    near = by.rangeBetween(-span, 0)
    t = F.when(F.col(column).isNotNull(), F.col(period).cast("double"))
    x = F.col(column).cast("double")
    n, st, sx, stx, stt = (F.sum(e).over(near) for e in (F.when(t.isNotNull(), 1), t, x, t * x, t * t))
    slope = F.try_divide(n * stx - st * sx, n * stt - st * st)
    return df.withColumns({"delta": x - F.max(x).over(by.rangeBetween(-1, -1)), "trend": F.when(n >= least, slope)})


def curve_coherence(df: DataFrame, curve: list[str], step: str, value: str) -> DataFrame:
    """(curve, steps, falls, monotone): steps that decrease along each curve; equal values aren't a fall, null pairs don't count."""
    before = F.lag(value).over(W.partitionBy(*curve).orderBy(step))
    pairs = df.withColumn("__before", before)
    both = F.col("__before").isNotNull() & F.col(value).isNotNull()
    return pairs.groupBy(*curve).agg(F.count_if(both).alias("steps"), F.count_if(both & (F.col(value) < F.col("__before"))).alias("falls")).withColumn("monotone", F.col("falls") == 0)


def cumulative_from_hazards(hazards: Column) -> Column:
    """Array of hazards -> array of 1 - prod(1 - h) up to each horizon."""
    start = F.struct(F.lit(1.0).alias("alive"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        alive = s["alive"] * (1 - h)
        return F.struct(alive.alias("alive"), F.concat(s["out"], F.array(1 - alive)).alias("out"))

    return F.aggregate(hazards, start, step, lambda s: s["out"])


def running_least(values: Column) -> Column:
    """Array -> running minimum: makes a survival curve monotone."""
    def step(s: Column, v: Column) -> Column:
        low = F.when(F.size(s) > 0, F.least(F.element_at(s, -1), v)).otherwise(v)
        return F.concat(s, F.array(low))

    return F.aggregate(values, F.array().cast("array<double>"), step)


def steps_of(survival: Column) -> Column:
    """Array of a survival curve, 1 before and 0 after -> the mass of each interval."""
    padded = F.concat(F.array(F.lit(1.0)), survival, F.array(F.lit(0.0)))
    return F.transform(F.sequence(F.lit(1), F.size(padded) - 1), lambda i: F.element_at(padded, i.cast("int")) - F.element_at(padded, (i + 1).cast("int")))


def period_labels(labels: Column) -> dict[str, Column]:
    """From cumulative labels by horizon (null: not observed): n_observed, the first positive period (from 0, or -1), whether any is positive, and falls."""
    seen = F.filter(labels, lambda x: x.isNotNull())
    return {
        "n_observed": F.size(seen).cast("bigint"),
        "period": (F.coalesce(F.array_position(labels, 1), F.lit(0)) - 1).cast("bigint"),
        "any_default": F.exists(labels, lambda x: F.coalesce(x == 1, F.lit(False))),
        "falls": F.size(F.filter(F.transform(labels, lambda x, i: (i > 0) & (x < F.try_element_at(labels, i.cast("int")))), lambda b: F.coalesce(b, F.lit(False)))).cast("bigint"),
    }


def survival_loss(hazards: Column, period: Column, observed: Column) -> Column:
    """The negative log-likelihood of one row: survived horizons up to its event, or up to what was observed."""
    end = F.when(period >= 0, period).otherwise(observed)
    alive = F.aggregate(F.transform(hazards, lambda h, i: F.when(i < end, -F.log(1 - h)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return alive + F.when(period >= 0, -F.log(F.try_element_at(hazards, (period + 1).cast("int")))).otherwise(0.0)

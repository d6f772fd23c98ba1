"""Joins, pivots, deduplication and labels of entity-by-time panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the smallest by `order` (all columns break ties). Combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    front = [c for c in order if c not in keys]
    row = F.struct(*front, *[c for c in rest if c not in front])
    best = df.groupBy(*keys).agg(F.min(row).alias("__row"))
    return best.select(*[F.col(k) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns for k in [c]])


def pivot_fixed(df: DataFrame, keys: list[str], column: str, values: list[str], aggregate: Column) -> DataFrame:
    """Long to wide with a fixed list of columns: no pass to find them, and the same schema for any data."""
    return df.groupBy(*keys).pivot(column, values).agg(aggregate)


def unique_or_fail(df: DataFrame, keys: list[str]) -> None:
    """Refuse a table in which a key repeats."""
    twice = df.groupBy(*keys).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"key repeats: {twice[0].asDict()}")


def first_event(events: DataFrame, key: str, time: str, name: str) -> DataFrame:
    """The earliest time for each key."""
    return events.groupBy(key).agg(F.min(time).alias(name))


def forward_label(rows: DataFrame, events: DataFrame, key: str, time: str, event_time: str, lag: str, horizon: str, name: str = "label") -> DataFrame:
    """rows with `name`: 1 if the key has an event in (time + lag, time + lag + horizon], else 0 (also without a time).

    Time is cut into buckets a little longer than the horizon, so the interval ends in its own bucket or the next. Both
    sides go into one sorted window by key and bucket: the next event in it decides, or else the first one of the next
    bucket, of which there is one number for each key and bucket. So a key with most of the rows is spread over its
    buckets, and there is no range join. Intervals are SQL literals such as '1 day'.
    """
    base = "timestamp_ntz'2001-01-01 00:00:00'"  # months differ: a tenth more, and a day, is longer than any such span
    width = F.expr(f"CAST(1.1 * (unix_micros(CAST({base} + INTERVAL {horizon} AS timestamp)) - unix_micros(CAST({base} AS timestamp))) AS bigint) + 86400000000L")
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    opens = F.col(time) + F.expr(f"INTERVAL {lag}")
    left = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("k"), opens.alias("t"), F.lit(1).alias("side"))
    right = events.where(F.col(event_time).isNotNull()).select(F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(event_time).alias("t"), F.lit(0).alias("side"))
    both = left.unionByName(right).withColumn("b", F.floor(micros(F.col("t")) / width))
    first = both.where("side = 0").groupBy(F.col("k").alias("__k"), (F.col("b") - 1).alias("__b")).agg(F.min("t").alias("__first"))
    # at equal times the event comes first, so it is not after the row
    order = W.partitionBy("k", "b").orderBy("t", "side")
    following = F.first(F.when(F.col("side") == 0, F.col("t")), ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    met = both.withColumn("next", following).where("side = 1").join(first, F.col("k").eqNullSafe(F.col("__k")) & (F.col("b") == F.col("__b")), "left")
    hit = F.coalesce("next", "__first") <= F.col("t") + F.expr(f"INTERVAL {horizon}")
    return met.select("row.*", F.coalesce(hit, F.lit(False)).cast("bigint").alias(name))


def exact_lag(df: DataFrame, key: str, period: str, columns: list[str], lag: int = 1) -> DataFrame:
    """Adds column_lagK: the value exactly `lag` periods before, null if that period has no row."""
    frame = W.partitionBy(key).orderBy(period).rangeBetween(-lag, -lag)
    return df.withColumns({f"{c}_lag{lag}": F.max(c).over(frame) for c in columns})


def censored_labels(panel: DataFrame, facts: DataFrame, keys: tuple[str, str], horizons: int, cut: Column) -> DataFrame:
    """labels: array over k = 1..horizons of whether the entity has a fact in period + k; null (not 0) beyond the cut."""
    entity, period = keys
    have = facts.select(entity, period).distinct().groupBy(entity).agg(F.collect_set(period).alias("__have"))  # periods of one entity
    joined = panel.join(have, entity, "left")
    label = F.transform(F.sequence(F.lit(1), F.lit(horizons)), lambda k: F.when(F.col(period) + k <= cut, F.coalesce(F.array_contains("__have", F.col(period) + k), F.lit(False)).cast("int")))
    return joined.withColumn("labels", label).drop("__have")


def anti_entities(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """rows whose entity isn't among the others'."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def shared_entities(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def refuse_leak(context: DataFrame, held_out: DataFrame, key: str) -> None:
    """Refuse two row sets that share an entity."""
    if not shared_entities(context, held_out, key).isEmpty():
        raise ValueError(f"rows on both sides share a {key}")


def aligned(df: DataFrame, entity: str, horizon: str, value: str, horizons: list[int]) -> DataFrame:
    """One row for each entity that has every horizon: its values as columns h<k>."""
    wide = df.groupBy(entity).agg(*[F.max(F.when(F.col(horizon) == h, F.col(value))).alias(f"h{h}") for h in horizons])
    return wide.dropna(subset=[f"h{h}" for h in horizons])


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Shared keys on which two runs differ by more than a tolerance; two nulls agree."""
    joined = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    apart = ~F.col("a").eqNullSafe(F.col("b")) & (F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))
    return joined.where(apart)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, columns: list[str], bucket: str = "1 day") -> DataFrame:
    """For each left row the last right row of its key at or before its time (of equal times the largest columns); nulls if
    there is none, or no time. No range join, and no window over a whole key's rows.

    Times are cut into buckets (a SQL interval of fixed length). A sorted window by key and bucket finds the last right
    row of the bucket; where there is none, it is the last one of the buckets before, carried along the key's buckets,
    of each of which there is one row.
    """
    width = F.expr(f"unix_micros(CAST(timestamp_ntz'2001-01-01 00:00:00' + INTERVAL {bucket} AS timestamp)) - unix_micros(CAST(timestamp_ntz'2001-01-01 00:00:00' AS timestamp))")
    placed = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / width)
    found = F.struct(F.col(right_time).alias("__t"), *columns).alias("found")
    a = left.select(F.struct(*left.columns).alias("row"), F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), placed(F.col(time)).alias("b"))
    r = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("k"), F.col(right_time).alias("t"), found, F.lit(0).alias("side"), placed(F.col(right_time)).alias("b"))
    both = a.unionByName(r, allowMissingColumns=True)
    by_bucket = both.groupBy("k", "b").agg(F.max("found").alias("found"))
    before = F.last("found", ignorenulls=True).over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    carried = by_bucket.select(F.col("k").alias("__k"), F.col("b").alias("__b"), before.alias("carried"))
    last = F.last("found", ignorenulls=True).over(W.partitionBy("k", "b").orderBy("t", "side", F.col("found")).rowsBetween(W.unboundedPreceding, 0))
    met = both.withColumn("own", last).where("side = 1").join(carried, F.col("k").eqNullSafe(F.col("__k")) & (F.col("b") == F.col("__b")), "left")
    return met.withColumn("found", F.coalesce("own", "carried")).select("row.*", *[F.col(f"found.{c}").alias(c) for c in columns])


def dense_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank of the column's value among its sorted distinct values, from 0. The distinct values are ranked by
    ranges: each range counts its own, and a prefix sum over ranges (one row each) is joined back."""
    from .running import running_sum

    values = df.select(column).distinct().where(F.col(column).isNotNull()).withColumn("__one", F.lit(1))
    codes = running_sum(values, [], column, {"__code": "__one"}).select(column, (F.col("__code") - 1).cast("bigint").alias(name))
    return df.join(codes, column, "left")

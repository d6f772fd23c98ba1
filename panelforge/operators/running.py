"""Running sums over a whole order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that a group's order is cut into.
RANGES = 64
#: Texts from which cuts of a text order are taken.
SAMPLE = 1000


def running_sum(df: DataFrame, by: list[str], order: str, sums: dict[str, str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds, for each name: column of sums, the sum of the column over the rows of the group up to this one in `order`.

    Rows must be distinct in (by, order). Each group's order is cut into ranges at approximate quantiles (any cuts give
    the same sums); rows are summed within (group, range), and the ranges' totals, at most `ranges` rows a group, are
    summed over the ranges. So a group with most of the rows is spread over many tasks.
    """
    value, kind = F.col(order), dict(df.dtypes)[order]
    if kind == "string":
        # the values of the least hashes are a sample, of at most SAMPLE texts
        seen = sorted(r[0] for r in df.select(order).where(value.isNotNull()).orderBy(F.xxhash64(value)).limit(SAMPLE).collect())
        cuts = F.array(*[F.lit(seen[i * len(seen) // ranges]) for i in range(1, ranges)]) if seen else F.expr("CAST(array() AS array<string>)")
        placed = df.withColumn("__range", F.size(F.filter(cuts, lambda c: c < value)))
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        raise TypeError("order by a number: use unix_micros or unix_date")
    else:
        cuts = df.groupBy(*by).agg(F.percentile_approx(value.cast("double"), [i / ranges for i in range(1, ranges)], 1000).alias("__cuts")).withColumnsRenamed({c: f"__c_{c}" for c in by})
        met = F.lit(True)
        for c in by:
            met = met & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
        joined = df.join(cuts, met) if by else df.crossJoin(F.broadcast(cuts))  # one row
        placed = joined.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < value.cast("double"))))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inner = W.partitionBy(*by, "__range").orderBy(way(order)).rowsBetween(W.unboundedPreceding, 0)
    totals = placed.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    over = W.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy(way("__range")).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__t{i}").over(over), F.lit(0)).alias(f"__before{i}") for i in range(len(sums))])
    match = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    inside = placed.withColumns({f"__in{i}": F.sum(c).over(inner) for i, c in enumerate(sums.values())})
    out = inside.join(before, match)
    return out.select(*df.columns, *[(F.col(f"__in{i}") + F.col(f"__before{i}")).alias(name) for i, name in enumerate(sums)])


def row_ranks(df: DataFrame, by: list[str], order: str, ties: list[str], name: str, descending: bool = False) -> DataFrame:
    """Adds the place of each row in its group (by), from 1, in the order of a number or text; equal ones by `ties`.

    Rows of equal values are counted, counts are summed along the order by ranges, and only rows of one value meet in a
    window. df must not have nulls in `order`.
    """
    counts = df.groupBy(*by, order).agg(F.count("*").alias("__n"))
    placed = running_sum(counts, by, order, {"__end": "__n"}, descending).withColumnsRenamed({c: f"__k_{c}" for c in [*by, order]})
    met = F.lit(True)
    for c in [*by, order]:
        met = met & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    within = F.row_number().over(W.partitionBy(*by, order).orderBy(*ties)) if ties else F.lit(1)
    return df.join(placed, met).select(*df.columns, (F.col("__end") - F.col("__n") + within).alias(name))


def mid_ranks_of(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Adds the average rank of the row's value in its group."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("__n"))
    placed = running_sum(counts, by, column, {"__end": "__n"}).withColumnsRenamed({c: f"__k_{c}" for c in [*by, column]})
    met = F.lit(True)
    for c in [*by, column]:
        met = met & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return df.join(placed, met).select(*df.columns, (F.col("__end") - (F.col("__n") - 1) / 2.0).alias(name))

"""Feature conditioning: fit_* aggregates training rows into a small table of parameters, apply_* joins it to any rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, edges_below, squash
from .quantiles import quantiles


def long_form(df: DataFrame, id_cols: list[str], features: list[str]) -> DataFrame:
    """(ids, feature, value): one pass over any number of columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    return df.select(*id_cols, F.explode(pairs).alias("f")).select(*id_cols, "f.feature", "f.value")


def fit_conditioner(train: DataFrame, features: list[str], q: float = 0.01) -> DataFrame:
    """(feature, low, high, centre, scale): winsor bounds, median, and IQR (its deviation if that is 0, 1 if both are)."""
    rows = long_form(train, [], features).where("value is not null and abs(value) < double('infinity')")
    q5 = quantiles(rows, ["feature"], "value", [q, 0.25, 0.5, 0.75, 1 - q])
    spread = rows.groupBy("feature").agg(F.stddev_pop("value").alias("sd"))
    low, first, centre, third, high = (F.col("q")[i] for i in range(5))
    got = q5.join(spread, "feature").select("feature", low.alias("low"), high.alias("high"), centre.alias("centre"), (third - first).alias("iqr"), "sd")
    return got.select("feature", "low", "high", "centre", F.when(F.col("iqr") > 0, F.col("iqr")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"))


def apply_conditioner(rows: DataFrame, params: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """(ids, feature, value): clipped to the bounds (infinities too), centred, scaled, squashed; null stays null."""
    wide = long_form(rows, ids, features).join(F.broadcast(params), "feature")  # a row for each feature
    z = (clip("value", F.col("low"), F.col("high")) - F.col("centre")) / F.col("scale")
    return wide.select(*ids, "feature", squash(z).alias("value"))


def fit_levels(train: DataFrame, column: str, y: str, smoothing: float = 10.0) -> DataFrame:
    """(level, n, total, prior): what target encoding needs; prior is the mean over all training rows."""
    got = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("total"))
    prior = train.agg(F.avg(F.col(y).cast("double")).alias("prior"))  # one row
    return got.crossJoin(F.broadcast(prior)).withColumn("value", (F.col("total") + smoothing * F.col("prior")) / (F.col("n") + smoothing))


def apply_levels(rows: DataFrame, levels: DataFrame, column: str, name: str, default: Column) -> DataFrame:
    """Adds the level's value; default (the prior) for levels that training didn't have, and for null."""
    return rows.join(levels.select(F.col("level").alias(column), F.col("value").alias(name)), column, "left").withColumn(name, F.coalesce(name, default))


def out_of_fold(train: DataFrame, column: str, y: str, fold: str, name: str, smoothing: float = 10.0) -> DataFrame:
    """Adds the smoothed mean of y over the rows of the same level in other folds; a level of one fold, or null, gets the mean of all."""
    yes = F.col(y).cast("double")
    by_fold = train.groupBy(F.col(column).alias("__l"), F.col(fold).alias("__f")).agg(F.count(y).alias("__n"), F.sum(yes).alias("__s"))
    whole = by_fold.groupBy(F.col("__l").alias("__wl")).agg(F.sum("__n").alias("__wn"), F.sum("__s").alias("__ws"))
    prior = train.agg(F.avg(yes).alias("__prior"))  # one row
    rest = by_fold.join(whole, F.col("__l") == F.col("__wl")).crossJoin(F.broadcast(prior))
    value = (F.col("__ws") - F.col("__s") + smoothing * F.col("__prior")) / (F.col("__wn") - F.col("__n") + smoothing)
    params = rest.select("__l", "__f", F.when(F.col("__wn") > F.col("__n"), value).otherwise(F.col("__prior")).alias(name))
    joined = train.join(params, (F.col(column) == F.col("__l")) & (F.col(fold) == F.col("__f")), "left").crossJoin(F.broadcast(prior))
    return joined.withColumn(name, F.coalesce(name, "__prior")).drop("__l", "__f", "__prior")


def top_levels(df: DataFrame, column: str, k: int) -> list[str]:
    """The k most frequent levels; of equally frequent ones the first in order. At most k rows reach the driver."""
    got = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k).collect()
    return [r[0] for r in got]


def one_hot(df: DataFrame, column: str, levels: list[str], prefix: str, missing_is_null: bool = True) -> DataFrame:
    """Adds an indicator for each level; a missing value is null in all, or 0."""
    flag = lambda v: (F.col(column) == v).cast("bigint")
    return df.withColumns({f"{prefix}_{i}": flag(v) if missing_is_null else F.coalesce(flag(v), F.lit(0).cast("bigint")) for i, v in enumerate(levels)})


def fit_bins(train: DataFrame, y: str, bins: int) -> DataFrame:
    """(edges, representatives): distinct inner quantiles above the minimum, and the mean of each bin (of all rows, for an empty one). One row."""
    cuts = quantiles(train, [], y, [i / bins for i in range(1, bins)]).crossJoin(train.agg(F.min(y).alias("low"), F.avg(y).alias("all")))  # one row each
    edges = cuts.select(F.filter(F.array_distinct("q"), lambda e: e > F.col("low")).alias("edges"), "all")
    placed = train.where(F.col(y).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(edges_below(F.col(y), F.col("edges")).alias("bin")).agg(F.avg(y).alias("mean"))
    means = placed.agg(F.map_from_entries(F.collect_list(F.struct("bin", "mean"))).alias("means"))  # a row for each bin
    return edges.crossJoin(means).select("edges", F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: F.coalesce(F.try_element_at("means", b), F.col("all"))).alias("representatives"))


def mid_ecdf(df: DataFrame, by: list[str], value: str, context: str) -> DataFrame:
    """Adds ecdf: the share of context rows below (ties half) mapped to [-1, 1]; 0 for a missing value."""
    from .running import running_sum

    ctx = F.col(context).cast("bigint")
    tied = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.sum(ctx).alias("__c"))
    run = running_sum(tied, by, "__v", {"__le": "__c"})
    size = tied.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum("__c").alias("__all"))
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    params = run.join(size, cond).select(*[F.col(c).alias(f"__by_{c}") for c in by], "__v", ((2 * F.col("__le") - F.col("__c")) / F.col("__all") - 1).alias("ecdf"))
    match = F.col(value) == F.col("__v")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return df.join(params, match, "left").select(*df.columns, F.coalesce("ecdf", F.lit(0.0)).alias("ecdf"))

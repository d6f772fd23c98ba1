"""Ledgers of attempted, scored and skipped units, merged runs and paired gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger(units: DataFrame, results: DataFrame, unit: list[str], status: str, by: list[str]) -> DataFrame:
    """(by, n_attempted, n_scored, n_skipped, coverage, reasons): results has a row for each resolved unit, its status null
    where the unit was scored, else the reason why not. reasons counts the skipped ones; a unit without a row is refused."""
    found = units.select(*unit).distinct().join(results.select(*unit, F.col(status).alias("__status"), F.lit(True).alias("__here")), unit, "left")
    open_units = found.where("__here is null").take(1)
    if open_units:
        raise ValueError(f"neither scored nor skipped: {open_units[0].asDict()}")
    counts = found.groupBy(*by, "__status").agg(F.count("*").alias("__n"))
    scored, skipped = F.sum(F.when(F.col("__status").isNull(), F.col("__n")).otherwise(0)), F.sum(F.when(F.col("__status").isNotNull(), F.col("__n")).otherwise(0))
    # reasons are few texts
    why = F.array_join(F.array_sort(F.collect_list(F.when(F.col("__status").isNotNull(), F.concat_ws(": ", "__status", "__n")))), "; ")
    return counts.groupBy(*by).agg(F.sum("__n").alias("n_attempted"), scored.alias("n_scored"), skipped.alias("n_skipped"), (scored / F.sum("__n")).alias("coverage"), why.alias("reasons"))


def merged_ledgers(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Ledgers of disjoint slices as one."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    total = both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_attempted", "n_scored", "n_skipped")])
    return total.withColumn("coverage", F.try_divide(F.col("n_scored"), F.col("n_attempted")))


def merged_runs(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of runs over disjoint slices; a key that two runs have is refused."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    twice = both.groupBy(*key).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"two runs have {twice[0].asDict()}")
    return both


def paired_gap(cells: DataFrame, by: list[str], seed: str, arm: str, first: str, second: str, value: str, rate: str) -> DataFrame:
    """(by, seeds, rate, gap): the mean over seeds of the first arm's value less the second's, on seeds that have both."""
    pick = lambda a, c: F.max(F.when(F.col(arm) == a, F.col(c)))
    both = cells.groupBy(*by, seed).agg((pick(first, value) - pick(second, value)).alias("__gap"), pick(first, rate).alias("__rate")).where("__gap is not null")
    return both.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg("__rate").alias("rate"), F.avg("__gap").alias("gap"))


def same_settings(control: DataFrame, arm: DataFrame, name: str, value: str, free: list[str]) -> None:
    """Refuse two runs, as (name, value) rows, that differ in a setting which isn't free."""
    a, b = control.select(name, F.col(value).alias("a")), arm.select(name, F.col(value).alias("b"))
    apart = a.join(b, name, "full").where(~F.col("a").eqNullSafe(F.col("b")) & ~F.col(name).isin(free)).orderBy(name).limit(5).collect()
    if apart:
        raise ValueError(f"settings differ: {[r.asDict() for r in apart]}")


def within_errors(share, p: float, n, sigmas: float = 4.0):
    """Whether a share of n is within so many binomial errors of p; never for n = 0."""
    return (n > 0) & (F.abs(share - p) <= sigmas * F.sqrt(F.lit(max(p * (1 - p), 1e-12)) / n))

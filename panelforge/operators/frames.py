"""Labelled panels from raw tables: annual filings, consumer loans, guaranteed loans, mortgages; and what a panel is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import divide, sum_any
from .conditioning import long_form
from .relational import dedup_first, first_event


def filing_frame(reports: DataFrame, elements: DataFrame, declared: DataFrame, entry: DataFrame, ratios: dict[str, tuple[str, str]], deleted: str, horizon_days: int, cut: Column) -> DataFrame:
    """A row for each kept report: code, year, filed, label, ratios, log_assets, log_revenue, log_age_days, form, audited.

    reports (report_id, code, year, filed, form, status, consolidated, audited): consolidated and deleted ones, and those
    without a code, year or filing date, leave; of a company's reports for a year the first filed stays. elements
    (report_id and a column each) must hold Assets. declared (code, declared): a report filed on or after its company's
    first declaration leaves, as does one whose window (filed, filed + horizon_days] ends after the cut; label tells
    whether the declaration lies in the window. entry (code, entry): the first date in the register.
    """
    kept = reports.where(~F.coalesce("consolidated", F.lit(False)) & ~F.col("status").eqNullSafe(F.lit(deleted))).dropna(subset=["code", "filed", "year"])
    first = dedup_first(kept, ["code", "year"], ["filed", "report_id"])
    rows = first.join(elements, "report_id").where("Assets is not null").join(first_event(declared, "code", "declared", "__declared"), "code", "left").join(first_event(entry, "code", "entry", "__entry"), "code", "left")
    end = F.date_add("filed", horizon_days)
    rows = rows.where(~F.coalesce(F.col("__declared") <= F.col("filed"), F.lit(False)) & (end <= cut))
    label = F.coalesce((F.col("__declared") > F.col("filed")) & (F.col("__declared") <= end), F.lit(False)).cast("bigint")
    rows = rows.withColumn("Liabilities", sum_any("CurrentLiabilities", "NonCurrentLiabilities"))
    logs = lambda c: F.log1p(F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(0.0))))
    return rows.select(
        "code", "year", "filed", label.alias("label"), *[divide(a, b).alias(name) for name, (a, b) in ratios.items()], logs(F.col("Assets")).alias("log_assets"),
        logs(F.col("Revenue")).alias("log_revenue"), logs(F.datediff("filed", "__entry")).alias("log_age_days"), "form", "audited",
    )


def default_frame(loans: DataFrame, made: str, defaulted: str, snapshot: Column, months: int) -> DataFrame:
    """Loans made at least `months` before the snapshot, with label: whether the default came within `months` of the loan."""
    open_ = loans.where(F.col(made) <= F.add_months(snapshot, -months))
    return open_.withColumn("label", F.coalesce(F.col(defaulted) <= F.add_months(made, months), F.lit(False)).cast("bigint"))


def charge_off_frame(loans: DataFrame, made: str, charged: str, status: str, known: list[str], undisbursed: list[str], charged_status: str, snapshot: Column, months: int) -> DataFrame:
    """Disbursed loans with label: whether they were charged off within `months`. Loans marked as charged off without a date
    leave. A status outside `known`, a missing date, or a window that ends after the snapshot is refused."""
    odd = loans.where(F.col(status).isNull() | ~F.col(status).isin(known)).take(1)
    if odd:
        raise ValueError(f"unknown status: {odd[0][status]}")
    kept = loans.where(~F.col(status).isin(undisbursed) & ~((F.col(status) == charged_status) & F.col(charged).isNull()))
    if kept.where(F.col(made).isNull()).take(1):
        raise ValueError("a loan has no date")
    if kept.where(F.add_months(made, months) > snapshot).take(1):
        raise ValueError("a window ends after the snapshot: its label is censored")
    return kept.withColumn("label", F.coalesce(F.col(charged) <= F.add_months(made, months), F.lit(False)).cast("bigint"))


def distress_frame(features: DataFrame, performance: DataFrame, loan: str, distressed: Column) -> DataFrame:
    """Loans that have a performance record, with label: whether any of their records is in distress."""
    labels = performance.groupBy(loan).agg(F.max(F.coalesce(distressed, F.lit(False)).cast("bigint")).alias("label"))
    return features.join(labels, loan)


def feasibility(panel: DataFrame, features: list[str], label: str, band: tuple[float, float]) -> DataFrame:
    """One row: n, positives, rate, band (inside, rarer, more common), mean share of missing cells, features that miss more
    than half, features of one value at most."""
    size = panel.agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("positives"), F.avg(F.col(label).cast("double")).alias("rate"))  # one row
    each = long_form(panel, [], features).groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("miss"), F.count_distinct("value").alias("values"))
    miss = each.agg(F.avg("miss").alias("missing"), F.count_if(F.col("miss") > 0.5).alias("mostly_missing"), F.count_if(F.col("values") <= 1).alias("constant"))  # one row
    where = F.when(F.col("rate") < band[0], "rarer").when(F.col("rate") > band[1], "more common").otherwise("inside")
    return size.crossJoin(miss).withColumn("band", where)

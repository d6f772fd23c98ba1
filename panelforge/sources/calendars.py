"""Generated calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import quarter_label


def quarter_ends(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(d): the last days of the quarters within [first, last]; none if last is before first."""
    start = F.trunc(F.lit(first).cast("date"), "quarter")
    end = F.lit(last).cast("date")
    days = F.transform(F.sequence(start, F.greatest(start, end), F.expr("INTERVAL 3 MONTHS")), lambda d: F.last_day(F.add_months(d, 2)))
    return spark.range(1).select(F.explode(days).alias("d")).where((F.col("d") >= F.lit(first).cast("date")) & (F.col("d") <= end))


def month_windows(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(start, end): calendar months cut to [first, last]."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(a, "month"), F.greatest(b, F.trunc(a, "month")), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return months.select(F.greatest("m", a).alias("start"), F.least(F.last_day("m"), b).alias("end")).where("start <= end")


def quarter_labels(spark: SparkSession, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(i, label): quarters from first to last (year, quarter), both included."""
    a, b = (y * 4 + q - 1 for y, q in (first, last))
    return spark.range(a, b + 1).select(F.col("id").alias("i"), quarter_label(F.col("id")).alias("label"))

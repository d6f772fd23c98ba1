"""Registers queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: SQL for the same hash order and uniform numbers as functions.scalars.hash32 and uniform.
HASH = "CAST(concat('0x', substr(md5(CAST({0} AS VARCHAR)), 1, 8)) AS BIGINT)"


def h(key: str) -> str:
    return HASH.format(key)


def query(sql: str | None = None):
    """Register a function (t, spark) -> DataFrame under its name; t(name) reads a table."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return wrap


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")

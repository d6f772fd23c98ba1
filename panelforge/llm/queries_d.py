"""Queries over whole tables: op11, op12 and op13."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries_a import documents


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of a tenth of the documents, by crc32 of the id: from some word on, the words go round with some period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is left without the change of words."""
    from .periods import periodic_runs

    found = periodic_runs(documents(spark, sf_dir), change=repeat_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("(1000 * b.length) div (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 100 against all; a seventh of the labels is moved on first."""
    from .negatives import hard_negatives

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 100 == 0)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against all; an index of random projections has no SQL."""
    from .forest import build, nearest

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(build(rows), rows, F.col("id") % 20 == 0)

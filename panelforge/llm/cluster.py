"""Shared-folder tables, checked broadcasts and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"panelforge-{os.getpid()}"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def write_table(df: DataFrame, name: str) -> str:
    """Write df as Parquet in the shared folder; the folder goes when the session's file system closes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def through_table(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: cuts the lineage, and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def partitions(df: DataFrame, wanted: int | None = None) -> int:
    """How many partitions an explicit repartition should make: the session's shuffle partitions, or more if asked."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted or 1)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Has the session send at most `rows` rows a time to Python: 10,000 whole texts are some 30 MB, several times over in
    the executor and its worker. A smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def broadcast_few(table: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The table, to be broadcast if it has at most `most` rows."""
    return F.broadcast(table) if table.count() <= most else table


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs without those that stand behind another one of their group. found: a row for each row of docs, with
    its doc_id, th (a hash of its text), and the group's name, of two columns, c and f.

    Of each group the row of the smallest id stays (rows without one come last, equal ids are in the order of th); of rows
    that repeat an id and a text, one.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = found.groupBy(F.col("c").alias("__c"), F.col("f").alias("__f")).agg(F.min(place).alias("best"), F.count("*").alias("n")).where("n > 1")
    met = found.join(best, F.col("__c").eqNullSafe(F.col("c")) & F.col("__f").eqNullSafe(F.col("f")))
    rows = through_table(met.groupBy("doc_id", "th").agg(F.max(place != F.col("best")).alias("gone"), F.count("*").alias("n")).where("gone or n > 1"), "not-first")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(f"`{text_col}`") == F.col("__th"))
    gone, repeated = (broadcast_few(rows.where(w).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))) for w in ("gone", "not gone"))
    left = docs.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))
    return left


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex of edges (a, b); root is the smallest vertex that can be reached.

    Alternates large-star and small-star steps until the edges are a forest of stars. Neighbourhoods are never
    gathered: each step takes a map-side combined minimum per vertex and joins it back, so a hot vertex is split by
    the engine's skew handling. Each round is cut by a table in the shared folder. Self-loops and nulls are ignored;
    an empty input gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct()
    edges = through_table(edges, "cc")
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        # Large star: from every vertex, its larger neighbours go to its smallest neighbour (or itself).
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: smaller neighbours and the vertex itself go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = through_table(small.union(least).distinct(), "cc")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())

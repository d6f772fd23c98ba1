"""Writers: append-only results, task dumps with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(rows: DataFrame, path: str, by: str) -> None:
    """Add finished rows, partitioned by data set; what was written stays if a later run stops."""
    rows.write.mode("append").partitionBy(by).parquet(path)


def write_dump(tasks: DataFrame, path: str, meta: dict, shard_size: int) -> None:
    """Tasks (with task_id) in shards of shard_size tasks, and a manifest; refuses a folder that has one."""
    spark = tasks.sparkSession
    try:
        spark.read.text(f"{path}/manifest").limit(1).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        raise FileExistsError(f"{path} has a dump")
    sharded = tasks.withColumn("shard", F.floor(F.col("task_id") / shard_size))
    sharded.repartition("shard").write.partitionBy("shard").parquet(f"{path}/tasks")
    manifest = json.dumps(meta | {"shard_size": shard_size}, sort_keys=True)
    spark.range(1).select(F.lit(manifest).alias("value")).coalesce(1).write.text(f"{path}/manifest")


def open_dump(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """The tasks of a dump whose manifest has the expected entries; others are refused."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    wrong = {k: (manifest.get(k), v) for k, v in expected.items() if manifest.get(k) != v}
    if wrong:
        raise ValueError(f"the dump doesn't match: {wrong}")
    return spark.read.parquet(f"{path}/tasks")


def dump_batch(spark: SparkSession, path: str, index: int, batch: int, shard_size: int) -> DataFrame:
    """Tasks index * batch to (index + 1) * batch: only their shards are read."""
    first, last = index * batch, (index + 1) * batch - 1
    tasks = spark.read.parquet(f"{path}/tasks").where((F.col("shard") >= first // shard_size) & (F.col("shard") <= last // shard_size))
    return tasks.where((F.col("task_id") >= first) & (F.col("task_id") <= last))

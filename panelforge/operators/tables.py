"""Tables that are written once and read again, where a plan would otherwise compute them several times."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that all executors see, from spark.checkpoint.dir; a temporary one only where the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"panelforge-{os.getpid()}"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)

"""Data sources by seed: a task depends on (seed, index) only, so any worker can make any task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash32, uniform
from .running import running_sum


def task_stream(spark: SparkSession, start: int, stop: int, world: int, seed: str) -> DataFrame:
    """(i, rank, x): item i goes to rank i mod world, and its number depends on (i, seed)."""
    return spark.range(start, stop).select(F.col("id").alias("i"), F.pmod("id", F.lit(world)).alias("rank"), uniform("id", F.lit(seed)).alias("x"))


def permuted(df: DataFrame, key: str, value: str, salt: str) -> DataFrame:
    """Adds `permuted`: the column in another order, by hashes of the keys. Positions come from prefix sums over ranges."""
    rows = df.select(key, value, F.lit(1).alias("__one"), hash32(key, F.lit(salt)).alias("__h"))
    by_key = running_sum(rows, [], key, {"__i": "__one"}).select(key, "__i")
    # equal hashes are in the order of keys: number the hashes, then the keys of each
    groups = running_sum(rows.groupBy("__h").agg(F.count("*").alias("__n"), F.array_sort(F.collect_list(F.struct(key, value))).alias("__all")), [], "__h", {"__end": "__n"})
    by_hash = groups.select(F.posexplode("__all").alias("__p", "__x"), (F.col("__end") - F.col("__n") + 1).alias("__first")).select((F.col("__first") + F.col("__p")).alias("__i"), F.col(f"__x.{value}").alias("permuted"))
    return df.join(by_key, key).join(by_hash, "__i").drop("__i")


def intercept(z: np.ndarray, rate: float) -> float:
    """b with mean(sigmoid(z + b)) = rate, by 60 halvings."""
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-np.clip(z + mid, -500, 500)))).mean() < rate else (low, mid)
    return (low + high) / 2


def scm_tables(spark: SparkSession, tasks: int, rows: int, features: int, seed: int, rate: float = 0.2) -> DataFrame:
    """(task_id, row_pos, features, label, p): tables of a random layered graph with a calibrated label rate."""

    def make(batches):
        for pdf in batches:
            out = []
            for task in pdf["id"]:
                rng = np.random.default_rng([seed, int(task)])
                x = rng.normal(size=(rows, features))
                for layer in range(2):
                    w = rng.normal(size=(features, features)) * (rng.random((features, features)) < 0.4)
                    mixed = x @ w + rng.normal(scale=0.1, size=x.shape)
                    x = np.tanh(mixed) if rng.random() < 0.5 else mixed / (1 + np.abs(mixed))
                z = x @ rng.normal(size=features) * 2
                p = 1 / (1 + np.exp(-(z + intercept(z, rate))))
                y = (rng.random(rows) < p).astype(int)
                out.append(pd.DataFrame({"task_id": int(task), "row_pos": np.arange(rows), "features": list(x.astype(float)), "label": y, "p": p}))
            yield pd.concat(out) if out else pd.DataFrame({"task_id": [], "row_pos": [], "features": [], "label": [], "p": []})

    return spark.range(tasks).mapInPandas(make, "task_id long, row_pos long, features array<double>, label long, p double")

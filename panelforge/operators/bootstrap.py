"""Paired cluster bootstrap of metric differences."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uniform


def poisson_weight(*keys: Column | str, most: int = 8) -> Column:
    """A Poisson(1) number from a hash of the keys, by the inverse of its distribution."""
    cdf, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        cdf.append(total)
    # the uniform number is bound to a name, so it is made once
    return F.transform(F.array(uniform(*keys)), lambda u: sum((F.when(u >= c, 1).otherwise(0) for c in cdf), F.lit(0)))[0]


#: Sums that a task holds at most before it gives them out, and rows whose weights are laid out at a time.
HELD, SLICE = 4_000_000, 5_000


def weights_of(keys: list[str | None], draws: int, most: int = 8) -> np.ndarray:
    """poisson_weight of (draw, key) for draws 1 to `draws` of each key, a row a key; column 0, the sample itself, is 1."""
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(most)])
    heads = [str(d).encode() for d in range(1, draws + 1)]
    found = bytearray()
    for key in keys:
        tail = b"" if key is None else b"|" + key.encode()
        for head in heads:
            found += hashlib.md5(head + tail, usedforsecurity=False).digest()[:4]
    u = np.frombuffer(found, ">u4").reshape(len(keys), draws) / 4294967296.0
    return np.concatenate([np.ones((len(keys), 1), np.int64), np.searchsorted(cdf, u, "right")], axis=1)


def drawn_levels(scores: DataFrame, by: list[str], group: str, y: str, names: list[str], draws: int) -> DataFrame:
    """(by, draw, which, p, n, pos): of each score column and draw, the weighted rows and positives at each score. Draw 0 is
    the sample itself; y and scores must not be null.

    A group's weights are made once: its rows are sent to one task, in order, which adds them up by score for all draws,
    so what goes on grows with distinct scores and not with rows.
    """
    kinds = dict(scores.dtypes)
    rows = scores.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col(group).cast("string").alias("__g"), F.col(y).cast("bigint").alias("__y"), *[F.col(c).cast("double").alias(f"__p{i}") for i, c in enumerate(names)])

    def added(batches):
        held = max(1, HELD // (draws + 1))
        at: dict[tuple, int] = {}
        n, pos = (np.zeros((0, draws + 1), np.int64) for _ in range(2))
        kinds_of = None

        def out():
            levels = list(at)
            for a in range(0, len(levels), max(1, SLICE // (draws + 1))):
                some = levels[a : a + max(1, SLICE // (draws + 1))]
                level, draw = np.nonzero(n[a : a + len(some)])
                columns = [pa.array([some[i][1 + j] for i in level.tolist()], kind) for j, kind in enumerate(kinds_of[:-1])]
                which = pa.array([names[some[i][0]] for i in level.tolist()], pa.string())
                score = pa.array([some[i][-1] for i in level.tolist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(draw.astype(np.int32)), which, score, pa.array(n[a + level, draw]), pa.array(pos[a + level, draw])], [*[f"__b{j}" for j in range(len(by))], "draw", "which", "p", "n", "pos"])

        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                kinds_of = [batch.column(i).type for i in range(len(by))] + [pa.float64()]
                keys = batch.column("__g").dictionary_encode(null_encoding="encode")
                weights = weights_of(keys.dictionary.to_pylist(), draws)[keys.indices.to_numpy()]
                positive = weights * batch.column("__y").to_numpy()[:, None]
                for i in range(len(names)):
                    parts = [batch.column(j).dictionary_encode(null_encoding="encode") for j in range(len(by))] + [batch.column(f"__p{i}").dictionary_encode()]
                    code = np.zeros(batch.num_rows, np.int64)
                    for part in parts:
                        code = code * len(part.dictionary) + part.indices.to_numpy()
                        code = np.unique(code, return_inverse=True)[1]  # dense, so that products stay small
                    order = np.argsort(code, kind="stable")
                    starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
                    values = zip(*(part.take(pa.array(order[starts])).to_pylist() for part in parts))
                    spots = np.array([at.setdefault((i, *v), len(at)) for v in values])
                    if len(at) > len(n):
                        more = np.zeros((max(len(at), 2 * len(n)) - len(n), draws + 1), np.int64)
                        n, pos = np.concatenate([n, more]), np.concatenate([pos, more])
                    n[spots] += np.add.reduceat(weights[order], starts, axis=0)
                    pos[spots] += np.add.reduceat(positive[order], starts, axis=0)
                if len(at) > held:
                    yield from out()
                    at.clear()
                    n[:], pos[:] = 0, 0
        if at:
            yield from out()

    schema = ", ".join([*[f"`__b{i}` {kinds[c]}" for i, c in enumerate(by)], "draw int, which string, p double, n bigint, pos bigint"])
    sums = rows.repartition("__g").sortWithinPartitions("__g").mapInArrow(added, schema)
    keys = [*[F.col(f"__b{i}").alias(c) for i, c in enumerate(by)], "draw", "which", "p"]
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def paired_difference(scores: DataFrame, group: str, y: str, a: str, b: str, draws: int = 200, least: int = 100) -> DataFrame:
    """One row: difference of mean squared errors (a less b), its 95 % interval and two-sided p-value by group bootstrap.

    The metric adds up over rows, so each group is reduced to its sums first; a draw weights groups by Poisson(1) numbers.
    The p-value is at least 1 / (draws + 1); with fewer than `least` usable draws the interval and p are null.
    """
    yes = F.col(y).cast("double")
    sums = scores.where(F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum((F.col(a) - yes) * (F.col(a) - yes) - (F.col(b) - yes) * (F.col(b) - yes)).alias("d"))
    drawn = sums.select(group, "n", "d", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw")).withColumn("w", F.when(F.col("draw") == 0, 1).otherwise(poisson_weight("draw", group)))
    each = drawn.groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum(F.col("w") * F.col("n"))).alias("diff"))
    real = F.col("draw") > 0
    got = each.agg(
        F.max(F.when(~real, F.col("diff"))).alias("diff"), F.count(F.when(real, F.col("diff"))).alias("drawn"),
        F.percentile(F.when(real, F.col("diff")), F.lit(0.025)).alias("low"), F.percentile(F.when(real, F.col("diff")), F.lit(0.975)).alias("high"),
        F.count_if(real & (F.col("diff") <= 0)).alias("below"), F.count_if(real & (F.col("diff") >= 0)).alias("above"),
    )
    p = F.least(F.lit(1.0), F.greatest(2.0 * F.least("below", "above") / F.col("drawn"), 1.0 / (F.col("drawn") + 1)))
    enough = F.col("drawn") >= least
    return got.select("diff", "drawn", *[F.when(enough, F.col(c)).alias(c) for c in ("low", "high")], F.when(enough, p).alias("p"))


def replicate_metric(scores: DataFrame, unit: str, metric, columns: list[str], draws: int = 50) -> DataFrame:
    """(draw, value) of any metric(pdf) -> float over Poisson-weighted resamples: each draw is one task's rows, so for samples that fit one task."""
    drawn = scores.select(unit, *columns, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", poisson_weight("draw", unit)).where("w > 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"draw": [int(pdf["draw"].iloc[0])], "value": [float(metric(pdf))]})

    return drawn.groupBy("draw").applyInPandas(run, "draw int, value double")

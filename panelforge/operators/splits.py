"""Splits, folds and quotas. Every draw is an order of hashes, so it depends on keys only, never on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bucket, hash32
from .quantiles import quantiles
from .running import row_ranks

CUTS = (1 / 2, 2 / 3, 5 / 6)
#: Classes whose counts the driver may hold.
MOST_CLASSES = 10_000


def out_of_time(panel: DataFrame, entity: str, time: str, embargo: float = 0.0, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """Adds split and part: for each cut at a quantile of time, test rows lie in [cut, next cut) (the last window is open),
    train rows before cut - embargo, less the entities of the test rows. A row appears once for each split it is part of."""
    found = quantiles(panel, [], time, list(cuts), "e").first()  # one row; none for an empty panel
    edges = [*(found.e if found else [None] * len(cuts)), float("inf")]
    window = F.array(*[F.struct(F.lit(i).cast("bigint").alias("split"), F.lit(a).cast("double").alias("start"), F.lit(b).cast("double").alias("stop")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    placed = panel.withColumn("__w", F.explode(window)).select(*panel.columns, "__w.*")  # a row for each cut
    part = F.when((F.col(time) >= F.col("start")) & (F.col(time) < F.col("stop")), "test").when(F.col(time) < F.col("start") - embargo, "train")
    placed = placed.withColumn("part", part).where("part is not null").drop("start", "stop")
    seen = placed.where("part = 'test'").select(entity, "split").distinct()
    return placed.where("part = 'train'").join(seen, [entity, "split"], "left_anti").unionByName(placed.where("part = 'test'"))


def by_time(panel: DataFrame, entity: str, time: str, train_until: Column, test_from: Column, on_overlap: str = "drop") -> DataFrame:
    """Adds part: time <= train_until trains, time >= test_from tests; entities on both sides leave the training rows, or are refused."""
    placed = panel.withColumn("part", F.when(F.col(time) <= train_until, "train").when(F.col(time) >= test_from, "test")).where("part is not null")
    train, test = placed.where("part = 'train'"), placed.where("part = 'test'")
    held = test.select(entity).distinct()
    if on_overlap == "raise" and not train.join(held, entity, "left_semi").isEmpty():
        raise ValueError("entities on both sides")
    return train.join(held, entity, "left_anti").select(*placed.columns).unionByName(test)


def dealt_folds(df: DataFrame, within: list[str], unit: list[str], n: int, name: str = "fold") -> DataFrame:
    """Adds a fold of 0..n-1: units are dealt in turn within each stratum, in the order of their hashes; rows of a unit stay together."""
    units = row_ranks(df.select(*within, *unit).distinct().withColumn("__h", hash32(*unit)), within, "__h", unit, "__place")
    placed = units.select(*within, *[c for c in unit if c not in within], F.pmod(F.col("__place") - 1, F.lit(n)).cast("bigint").alias(name))
    return df.join(placed, list(dict.fromkeys([*within, *unit])))


def roles(fold: Column, turn: int, n: int) -> Column:
    """Validation is fold `turn`, test the one after it, the rest trains."""
    return F.when(fold == turn, "val").when(fold == (turn + 1) % n, "test").otherwise("train")


def take_per_class(df: DataFrame, by: list[str], quota: Column, key: list[str]) -> DataFrame:
    """The first `quota` rows of each class in the order of their hashes."""
    order = W.partitionBy(*by).orderBy(hash32(*key), *key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= quota).drop("__r")


def cap_rows(df: DataFrame, n: int, key: list[str]) -> DataFrame:
    """n rows in the order of their hashes, or all there are: each task keeps its n first, so the last one sees few."""
    return df.orderBy(hash32(*key), *key).limit(n)


def whole_entities(df: DataFrame, entity: str, most: int) -> DataFrame:
    """Rows of whole entities, taken in hash order while their rows add up to `most` or fewer; the first one always."""
    sizes = df.groupBy(entity).agg(F.count("*").alias("__n")).withColumn("__h", hash32(entity) * 1.0)
    from .running import running_sum

    sizes = running_sum(sizes.groupBy("__h").agg(F.sum("__n").alias("__n"), F.collect_set(entity).alias("__e")), [], "__h", {"__sum": "__n"})
    chosen = sizes.where((F.col("__sum") <= most) | (F.col("__sum") == F.col("__n"))).select(F.explode("__e").alias(entity))
    return df.join(chosen, entity, "left_semi")


def largest_remainder(counts: dict[str, int], total: int) -> dict[str, int]:
    """Quotas in proportion to class counts that add up to total, by largest remainder (then by name)."""
    n = sum(counts.values())
    exact = {k: v * total / n for k, v in counts.items()} if n else {}
    quota = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (quota[k] - exact[k], k))[: total - sum(quota.values())]:
        quota[k] += 1
    return quota


def water_fill(counts: dict[str, int], total: int) -> dict[str, int]:
    """Quotas as equal as class counts allow: small classes whole, the rest shares what is left."""
    quota, left = {}, total
    for i, (k, v) in enumerate(sorted(counts.items(), key=lambda kv: (kv[1], kv[0]))):
        quota[k] = min(v, left // (len(counts) - i))
        left -= quota[k]
    return quota


def quota_sample(df: DataFrame, label: str, total: int, key: list[str], balanced: bool = False) -> DataFrame:
    """About `total` rows by class quotas (proportional or balanced). Class counts are a small table; a label of more than
    MOST_CLASSES classes is refused."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(label).limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    quota = (water_fill if balanced else largest_remainder)(counts, min(total, sum(counts.values())))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(label)) if quota else F.lit(0)
    return take_per_class(df, [label], limit, key)


def one_per_entity(df: DataFrame, entity: str, key: list[str]) -> DataFrame:
    order = W.partitionBy(entity).orderBy(hash32(*key), *key)
    return df.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def hashed_part(df: DataFrame, share: int, n: int, key: list[str], name: str = "part") -> DataFrame:
    """Adds part: 'hold' for `share` of n hash buckets of the key, else 'fit'."""
    return df.withColumn(name, F.when(bucket(n, *key) < share, "hold").otherwise("fit"))

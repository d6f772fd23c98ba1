"""Nearest rows of a context by robust distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles
from .tables import settled

#: Rows of a block.
BLOCK = 2_000
#: Distances count as equal if they are equal to so many decimals.
DECIMALS = 9
#: Blocks of queries that are sent to every task at most; a block is BLOCK vectors.
BROADCAST_BLOCKS = 32


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance_stats(context: DataFrame, vector: str, size: int) -> DataFrame:
    """One row: centre (medians) and scale (IQRs, at least 1e-6) as arrays."""
    cells = context.select(F.posexplode(F.slice(vector, 1, size)).alias("i", "v"))
    each = quantiles(cells, ["i"], "v", [0.25, 0.5, 0.75])
    # a row for each place of the vector
    got = each.agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("all"))
    return got.select(F.transform("all", lambda x: x["q"][1]).alias("centre"), F.transform("all", lambda x: F.greatest(x["q"][2] - x["q"][0], F.lit(1e-6))).alias("scale"))


def scaled(rows: DataFrame, stats: DataFrame, vector: str) -> DataFrame:
    """vector less centre over scale; a missing item is 0 (the centre)."""
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    z = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.col("centre").alias("c"), F.col("scale").alias("s")), lambda t: F.coalesce((t["x"] - t["c"]) / t["s"], F.lit(0.0)))
    return joined.withColumn(vector, z).drop("centre", "scale")


def packed(rows: DataFrame, block: int, names: dict[str, str], vector: str) -> DataFrame:
    """(block, names..., v): rows in blocks of about `block`, each column of a block as one array, vectors end to end."""
    blocks = max(1, -(-rows.count() // block))
    key = next(iter(names))
    all_of = F.collect_list(F.struct(*[F.col(c).alias(n) for c, n in names.items()], F.col(vector).alias("v"))).alias("all")
    got = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).agg(all_of)
    return got.select("block", *[F.col(f"all.{n}").alias(n) for n in names.values()], F.flatten("all.v").alias("v"))


def nearest(context: DataFrame, queries: DataFrame, vector: str, row: str, query: str, label: str, k: int, per_class: dict | None = None, but_self: bool = False) -> DataFrame:
    """(query, row, label, distance, rank): the k nearest context rows of each query, or k by class. Distances are rounded to
    DECIMALS, and rows of equal distance come by row id.

    Both sides are packed into blocks of about BLOCK rows (vectors must be of one length, without nulls); each pair of
    blocks is one row of a join, and gives the k nearest of each query within it, by differences and not by products, so
    that equal vectors are equally near. Blocks of queries are broadcast while they are at most BROADCAST_BLOCKS; more of
    them are sent by slices of the context. but_self leaves out the context row whose id is the query's.
    """
    kinds = dict(context.dtypes) | {query: dict(queries.dtypes)[query]}
    left = settled(packed(context, BLOCK, {row: "rows", label: "labels"}, vector), "context-blocks")
    right = settled(packed(queries, BLOCK, {query: "queries"}, vector).withColumnRenamed("v", "qv").withColumnRenamed("block", "qblock"), "query-blocks")
    few = right.count() <= BROADCAST_BLOCKS
    slices = 1 if few else int(context.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = right.withColumn("slice", F.explode(F.expr(f"sequence(0L, {slices - 1}L)")))
    pairs = left.withColumn("slice", F.pmod("block", F.lit(slices).cast("long"))).join(F.broadcast(sliced) if few else sliced, "slice")
    most = per_class or {None: k}

    def closest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, labels, asked = (batch.column(c)[i].values for c in ("rows", "labels", "queries"))
                x, q = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(n, -1) for c, n in (("v", len(rows)), ("qv", len(asked))))
                names, order = np.array(labels.to_pylist(), dtype=object), np.argsort(np.argsort(np.array(rows.to_pylist())))
                members = [(np.arange(len(rows)) if c is None else np.flatnonzero(names == c), n) for c, n in most.items()]
                same = pc.index_in(asked, value_set=rows).to_numpy(zero_copy_only=False) if but_self else None
                at, of, far = [], [], []
                for j in range(len(asked)):
                    d = np.floor(np.sqrt(((x - q[j]) ** 2).sum(axis=1)) * 10**DECIMALS + 0.5) / 10**DECIMALS
                    if but_self and same[j] == same[j]:
                        d[int(same[j])] = np.inf
                    for mine, n in members:
                        if n and len(mine):
                            near = mine[d[mine] <= np.partition(d[mine], min(n, len(mine)) - 1)[min(n, len(mine)) - 1]]
                            near = near[np.lexsort((order[near], d[near]))][:n]
                            near = near[d[near] < np.inf]
                            at.append(near)
                            of.append(np.full(len(near), j))
                            far.append(d[near])
                if at:
                    at, of = np.concatenate(at), np.concatenate(of)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(of)), rows.take(pa.array(at)), labels.take(pa.array(at)), pa.array(np.concatenate(far))], [query, row, label, "distance"])

    found = pairs.mapInArrow(closest, f"`{query}` {kinds[query]}, `{row}` {kinds[row]}, `{label}` {kinds[label]}, distance double")
    keys = [query] + ([label] if per_class else [])
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in per_class.items() for x in kv]), F.col(label)) if per_class else F.lit(k)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("distance", row)).cast("bigint"))
    return ranked.where((F.col("rank") <= max(most.values())) & (F.col("rank") <= limit))


def with_floor(near: DataFrame, positives: DataFrame, query: str, row: str, label: str, k: int, floor: int) -> DataFrame:
    """The k nearest with at least `floor` positives: the nearest positives not yet in take the places of the farthest negatives.

    near: the k nearest of each query; positives: its `floor` nearest positives. The size stays k.
    """
    has = near.groupBy(query).agg(F.count_if(F.col(label) == 1).alias("__have"))
    extra = positives.join(near.select(query, row), [query, row], "left_anti").join(has, query)
    order = W.partitionBy(query).orderBy("distance", row)
    extra = extra.withColumn("__e", F.row_number().over(order)).where(F.col("__e") <= F.lit(floor) - F.col("__have"))
    added = extra.groupBy(query).agg(F.count("*").alias("__added"))
    far = W.partitionBy(query, label).orderBy(F.col("distance").desc(), F.col(row).desc())
    kept = near.withColumn("__f", F.row_number().over(far)).join(added, query, "left").where((F.col(label) == 1) | (F.col("__f") > F.coalesce("__added", F.lit(0))))
    columns = [query, row, label, "distance"]
    return kept.select(*columns).unionByName(extra.select(*columns))


def base_rate_shift(context_rate: Column, true_rate: Column) -> Column:
    """logit(true) - logit(context); null where either is 0 or 1."""
    fine = lambda r: (r > 0) & (r < 1)
    return F.when(fine(context_rate) & fine(true_rate), F.log(true_rate / (1 - true_rate)) - F.log(context_rate / (1 - context_rate)))


def shifted(p: Column, delta: Column) -> Column:
    """sigmoid(logit(p) + delta), 0 and 1 stay."""
    return F.when((p <= 0) | (p >= 1), p).otherwise(1 / (1 + F.exp(-(F.log(p / (1 - p)) + delta))))

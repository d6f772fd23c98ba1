"""Hard negatives by bit-sliced integer products.

Components are whole numbers in two's complement. A product of an anchor with a row is summed plane by plane of the
row's bits, the sign first: after the planes down to bit j the score lies between the sum so far plus (2^j - 1) times the
anchor's negative components and the same with its positive ones. As planes are added the intervals shrink, thresholds
rise (a fifth best lower end is passed by none that counts), and what can't reach its threshold is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import through_table
from .vectors import NO_ID, against_all, finite, gathered, ids_of, matrices, own_rows

#: Rows and anchors of a block.
ROWS, ANCHORS = 4096, 256
#: Components are held to this size: a product of 1024 of them stays within 62 bits.
LIMIT = 1 << 25
#: Pairs are kept as a matrix while more than this share of them is left.
DENSE = 0.125
#: Pairs whose components are gathered at once.
CHUNK = 1 << 15


def components(vector: Column, scale: int) -> Column:
    """floor(scale x) of each component, x as double."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))


class Planes:
    """The bit planes of a matrix of integers, the sign first, with the weight of each and the weight of all that follow."""

    def __init__(self, rows: np.ndarray):
        bits = max(1, int(max(rows.max(initial=0), -(rows.min(initial=0) + 1))).bit_length())
        self.bits, self.rows = bits, rows

    def __iter__(self):
        yield (self.rows < 0), -(1 << self.bits), (1 << self.bits) - 1
        for j in range(self.bits - 1, -1, -1):
            yield (self.rows >> j) & 1, 1 << j, (1 << j) - 1


def nth_largest(group: np.ndarray, value: np.ndarray, groups: int, n: int) -> np.ndarray:
    """The n-th largest value of each group, or minus infinity where it has fewer."""
    out = np.full(groups, -np.inf)
    order = np.lexsort((-value, group))
    g, v = group[order], value[order]
    first = np.searchsorted(g, np.arange(groups))
    there = np.flatnonzero(first + n - 1 < len(g))
    there = there[g[first[there] + n - 1] == there]
    out[there] = v[first[there] + n - 1]
    return out


def products(anchors: np.ndarray, planes: Planes, alive: np.ndarray, narrowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs that no threshold has dropped.

    alive: which pairs count, an anchors x rows matrix. narrowed(anchor, row, low, high) tells which of the pairs given
    by their numbers may still qualify; with anchor None, low and high are matrices over all pairs, of which some have
    low = -inf (they are dead).
    """
    a = anchors.astype(np.int64)
    under, over = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    # sums are exact in the smallest type that holds the largest of them
    largest = int(max(over.max(initial=0), -under.min(initial=0))) << (planes.bits + 1)
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    slack = 4096 if kind is np.int64 else 0  # thresholds are doubles, which round such numbers
    sums, typed, pairs = np.zeros(alive.shape, dtype=kind), a.astype(kind), None
    for plane, weight, rest in planes:
        if pairs is None:
            sums += (typed @ plane.astype(kind).T) * kind(weight)
            low = np.where(alive, sums + (rest * under - slack)[:, None], -np.inf)
            alive = alive & narrowed(None, None, low, sums + (rest * over + slack)[:, None])
            if np.count_nonzero(alive) <= DENSE * alive.size:
                pairs = np.nonzero(alive)
                sums = sums[pairs].astype(np.int64)
        else:
            bits = plane.astype(np.int8)
            for at in range(0, len(sums), CHUNK):
                part = slice(at, at + CHUNK)
                sums[part] += weight * np.einsum("ij,ij->i", a[pairs[0][part]], bits[pairs[1][part]])
            keep = narrowed(pairs[0], pairs[1], sums + (rest * under - slack)[pairs[0]], sums + (rest * over + slack)[pairs[0]])
            sums, pairs = sums[keep], (pairs[0][keep], pairs[1][keep])
    if pairs is None:
        pairs = np.nonzero(alive)
        sums = sums[pairs].astype(np.int64)
    return pairs[0], pairs[1], sums


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the first n of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    return order[rank < n]


def pack(rows: DataFrame, size: int, extra: bool = False) -> DataFrame:
    """Blocks of rows (id, label, v) as single rows. With extra, rows also have aid and the scores of their positives."""

    def run(batches):
        for batch in gathered(batches, size):
            ids, labels = ids_of(batch.column("id")), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for d, at, matrix in matrices(batch, "v"):
                columns = [[int(ids[at[0]]) ^ len(at)], [d], [ids[at].tobytes()], [labels[at].tobytes()], [matrix.astype(np.int32).tobytes()]]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                if extra:
                    aids = batch.column("aid").to_numpy(zero_copy_only=False)[at]
                    scores = [batch.column("scores")[i].as_py() for i in at.tolist()] if "scores" in batch.schema.names else [[] for _ in at]
                    filled = np.full((len(at), max(map(len, scores), default=0)), np.nan)
                    for i, s in enumerate(scores):
                        filled[i, : len(s)] = s
                    columns += [[aids.astype(np.int64).tobytes()], [filled.tobytes()]]
                    kinds += [pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["block", "dim", "ids", "labels", "data", *["aids", "scores"] * extra]
    return rows.mapInArrow(run, "block bigint, dim int, ids binary, labels binary, data binary" + ", aids binary, scores binary" * extra)


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[prefix + c], dtype=np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[prefix + "data"], dtype=np.int32).reshape(len(ids), row["dim"])


def floors(known: dict, key: bytes, shape) -> np.ndarray:
    """What the task has found for a block of anchors so far: lower bounds of what may still count. Forgotten when many."""
    if key not in known:
        if len(known) >= 256:
            known.clear()
        known[key] = np.full(shape, -np.inf)
    return known[key]


def find_positives(count: int):
    """Of each pair of blocks: for each anchor the rows of its label that may be among its `count` best."""

    def run(batches):
        known: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                (ids, labels, data), (q_ids, q_labels, q_data) = unpacked(row), unpacked(row, "q_")
                aids = np.frombuffer(row["q_aids"], dtype=np.int64)
                least = floors(known, row["q_aids"], len(aids))
                found = []
                for label in np.intersect1d(labels, q_labels).tolist():
                    mine, theirs = np.flatnonzero(q_labels == label), np.flatnonzero(labels == label)
                    alive = q_ids[mine][:, None] != ids[theirs][None, :]
                    bound = least[mine]

                    def narrowed(a, c, low, high, bound=bound, mine=mine):
                        if a is None:
                            if low.shape[1] >= count:
                                np.maximum(bound, np.partition(low, -count, axis=1)[:, -count], out=bound)
                            return high >= bound[:, None]
                        np.maximum(bound, nth_largest(a, low, len(mine), count), out=bound)
                        return high >= bound[a]

                    a, c, score = products(q_data[mine], Planes(data[theirs]), alive, narrowed)
                    top = best(a, score, ids[theirs][c], count)
                    found.append((aids[mine][a[top]], ids[theirs][c[top]], score[top]))
                    least[mine] = np.maximum(bound, nth_largest(a[top], score[top].astype(float), len(mine), count))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["aid", "id", "score"])

    return run


def find_negatives(count: int, low_share: tuple[int, int]):
    """Of each pair of blocks: for each anchor and positive the rows of other labels that may be among the `count` best in its range."""
    num, den = low_share

    def run(batches):
        known: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                (ids, labels, data), (q_ids, q_labels, q_data) = unpacked(row), unpacked(row, "q_")
                aids = np.frombuffer(row["q_aids"], dtype=np.int64)
                upper = np.frombuffer(row["q_scores"]).reshape(len(aids), -1)
                if not upper.size:
                    continue
                # num * positive <= den * negative, in whole numbers; a place without a positive takes nothing
                lower = np.where(np.isnan(upper), np.inf, -(-(num * np.nan_to_num(upper).astype(np.int64)) // den))
                upper = np.where(np.isnan(upper), -np.inf, upper)
                least = floors(known, row["q_aids"], upper.shape)
                np.maximum(least, lower, out=least)
                top_upper = upper.max(axis=1)

                def narrowed(a, c, low, high):
                    if a is None:
                        return (high >= least.min(axis=1)[:, None]) & (low <= top_upper[:, None])
                    keep = np.zeros(len(a), dtype=bool)
                    for k in range(upper.shape[1]):
                        sure = (low >= lower[a, k]) & (high <= upper[a, k])
                        np.maximum(least[:, k], nth_largest(a[sure], low[sure], len(aids), count), out=least[:, k])
                        keep |= (high >= least[a, k]) & (low <= upper[a, k])
                    return keep

                a, c, score = products(q_data, Planes(data), q_labels[:, None] != labels[None, :], narrowed)
                found = []
                for k in range(upper.shape[1]):
                    into = np.flatnonzero((score >= lower[a, k]) & (score <= upper[a, k]) & (score >= least[a, k]))
                    into = into[best(a[into], score[into], ids[c[into]], count)]
                    found.append((aids[a[into]], np.full(len(into), k, dtype=np.int32), ids[c[into]], score[into]))
                    least[:, k] = np.maximum(least[:, k], nth_largest(a[into], score[into].astype(float), len(aids), count))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["aid", "k", "id", "score"])

    return run


def ranked(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n of each group with their rank; groups hold what blocks have left, and are cut before they are sent."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low_share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long but rank.

    anchors: a condition on `id`. Scores are inner products of floor(scale x); higher ones first, ties by smaller id. An
    anchor's positives are its first rows of the same label and another id; its negatives to a positive the first rows
    of other labels whose score is at most the positive's and at least low_share of it (so none to a negative one).

    Rows without label or vector, or with a component that is null or not finite, take no part. Rows that repeat id,
    label and vector count once; different rows of one id count each, but are never each other's positives. A null id
    is no anchor and comes last in ties. Vectors are compared only with those of the same length, empty ones have the
    score 0. |x| beyond 2^25 / scale counts as that. An empty table, or no anchor, gives an empty result.
    """
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).where(F.col("label").isNotNull() & finite(F.col("v")))
    own = own_rows(clean.withColumn("v", components(F.col("v"), scale)))
    blocks = through_table(pack(own, ROWS), "vectors")
    chosen = through_table(clean.where(anchors).withColumn("v", components(F.col("v"), scale)).dropDuplicates().withColumn("aid", F.monotonically_increasing_id()), "anchors")
    near = against_all(blocks, through_table(pack(chosen, ANCHORS, extra=True), "anchor-blocks"), find_positives(positives), "aid bigint, id bigint, score bigint", lambda x: ranked(x, ["aid"], positives))
    near = through_table(near, "positives")
    scores = near.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), "score"))).alias("s")).select("aid", F.col("s.score").alias("scores"))  # `positives` of them
    with_scores = through_table(pack(chosen.join(scores, "aid"), ANCHORS, extra=True), "anchor-blocks")
    far = against_all(blocks, with_scores, find_negatives(negatives, low_share), "aid bigint, k int, id bigint, score bigint", lambda x: ranked(x, ["aid", "k"], negatives))
    named = near.select("aid", (F.col("rank") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(chosen.select("aid", F.col("id").alias("anchor_id")), "aid")
    out = far.join(named, ["aid", "k"])
    none = lambda c: F.nullif(F.col(c), F.lit(int(NO_ID))).alias(c)
    return out.withColumnRenamed("id", "negative_id").select("anchor_id", none("positive_id"), "rank", none("negative_id"), "positive_score", F.col("score").alias("negative_score"))

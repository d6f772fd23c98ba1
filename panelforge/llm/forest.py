"""Nearest neighbours by largest inner product, from a forest of hash prefixes.

A tree gives each vector a string of 32 sign bits of random projections, and keeps the strings as a sorted array. A query
goes down each tree to the longest prefix that its string shares with any other, by one binary search; then all trees
go up together, a bit at a time, and the ranges of strings that share that many bits are candidates, until there are
enough. Candidates are scored on the original vectors.

Rows are dealt out by id into shards, each with a forest of its own, so an index is built and searched without any
shuffle of strings, and a lost shard is built again from its rows. Projections see a vector with one more component,
sqrt(max |x|^2 - |x|^2) of its shard (0 for queries): then the order of angles is that of inner products.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import partitions, through_table
from .vectors import NO_ID, against_all, finite, gathered, ids_of, matrices, own_rows

#: Trees, bits of a string, most and least rows of a shard (but for the last), queries of a block.
TREES, BITS, ROWS, FEW, QUERIES = 96, 32, 16384, 2048, 512
#: Candidates that are wanted of a shard, repeats over trees included: this share of its rows, and so many of all rows.
SHARE, LEAST = 0.5, 6000
#: Values of projections at once.
CHUNK = 1 << 22


@functools.lru_cache(maxsize=4)
def projections(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim + 1, trees * BITS)).astype(np.float32)


def strings(vectors: np.ndarray, last: np.ndarray, trees: int) -> np.ndarray:
    """The sign strings of vectors with one more component, a row of `trees` numbers each."""
    planes, out = projections(vectors.shape[1], trees), np.empty((len(vectors), trees), dtype=np.uint32)
    size = np.maximum(np.sqrt((vectors**2).sum(axis=1) + last**2), 1e-300)
    scaled = np.column_stack([vectors / size[:, None], last / size]).astype(np.float32)
    step = max(1, CHUNK // planes.shape[1])
    for at in range(0, len(vectors), step):
        bits = (scaled[at : at + step] @ planes > 0).reshape(-1, trees, BITS)
        out[at : at + step] = np.packbits(bits, axis=2).view(">u4")[:, :, 0]
    return out


def distinct(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """The places of rows by id, less those behind `most` equal vectors of smaller ids, which no query can have."""
    order = np.lexsort((ids,))
    kind = np.ascontiguousarray(vectors[order] + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, group = np.unique(kind, return_inverse=True)
    by = np.argsort(group, kind="stable")
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    return order[rank < most]


def shards(rows: DataFrame, k: int, trees: int) -> DataFrame:
    """A row for each shard of rows (id, v): ids, vectors, and the sorted strings of each tree with the places of their rows."""

    def run(batches):
        for batch in gathered(batches, ROWS):
            ids = ids_of(batch.column("id"))
            for d, at, vectors in matrices(batch, "v"):
                at = at[(keep := distinct(ids[at], vectors, k + 1))]
                vectors = np.ascontiguousarray(vectors[keep])
                norms = (vectors**2).sum(axis=1)
                keys = strings(vectors, np.sqrt(norms.max(initial=0) - norms), trees).T
                order = np.argsort(keys, axis=1, kind="stable")
                keys = np.take_along_axis(keys, order, axis=1)
                columns = [[int(ids[at[0]]) ^ len(at)], [d], [ids[at].tobytes()], [vectors.tobytes()], [keys.tobytes()], [order.astype(np.uint16).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.binary()] * 4])], ["block", "dim", "ids", "data", "keys", "places"])

    return rows.mapInArrow(run, "block bigint, dim int, ids binary, data binary, keys binary, places binary")


def query_blocks(rows: DataFrame, trees: int) -> DataFrame:
    """A row for each block of queries (id, v), with their strings."""

    def run(batches):
        for batch in gathered(batches, QUERIES):
            ids = ids_of(batch.column("id"))
            for d, at, vectors in matrices(batch, "v"):
                keys = strings(vectors, np.zeros(len(at)), trees)
                columns = [[int(ids[at[0]]) ^ len(at)], [d], [ids[at].tobytes()], [np.ascontiguousarray(vectors).tobytes()], [keys.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.binary()] * 3])], ["block", "dim", "ids", "data", "keys"])

    return rows.mapInArrow(run, "block bigint, dim int, ids binary, data binary, keys binary")


def longest_prefix(keys: np.ndarray, query: np.ndarray) -> np.ndarray:
    """How many leading bits each query's string shares with the nearest one of the sorted strings."""
    at = np.searchsorted(keys, query)
    shared = np.zeros(len(query), dtype=np.int64)
    for side in (np.maximum(at - 1, 0), np.minimum(at, len(keys) - 1)):
        differ = (keys[side] ^ query).astype(np.float64)  # exact: 32 bits
        shared = np.maximum(shared, BITS - np.frexp(differ)[1])
    return shared


def ranges(keys: np.ndarray, query: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings begin and end, among the sorted ones, that share the first `level` bits of each query's."""
    shift = (BITS - level).astype(np.uint64)
    prefix = query.astype(np.uint64) >> shift
    return np.searchsorted(keys, prefix << shift), np.searchsorted(keys, (prefix + np.uint64(1)) << shift)


def candidates(keys: np.ndarray, query: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end), queries x trees: the ranges at the level where all trees together have `wanted` places, or all."""
    trees = len(keys)
    wide = keys.astype(np.uint64)
    level = np.max([longest_prefix(keys[t], query[:, t]) for t in range(trees)], axis=0)
    begin, end = np.zeros((len(query), trees), dtype=np.int64), np.zeros((len(query), trees), dtype=np.int64)
    low = np.arange(len(query))
    while len(low):
        for t in range(trees):
            begin[low, t], end[low, t] = ranges(wide[t], query[low, t], level[low])
        low = low[((end[low] - begin[low]).sum(axis=1) < wanted) & (level[low] > 0)]
        level[low] -= 1
    return begin, end


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(vectors))
    for j in range(len(query)):
        out += vectors[:, j] * query[j]
    return out


def search_blocks(k: int, trees: int, share: float):
    """Of each pair of a shard and a block of queries: the k best candidates of each query."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dim"]
                ids, q_ids = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["q_ids"], dtype=np.int64)
                data, q_data = np.frombuffer(row["data"]).reshape(len(ids), d), np.frombuffer(row["q_data"]).reshape(len(q_ids), d)
                keys, places = np.frombuffer(row["keys"], dtype=np.uint32).reshape(trees, -1), np.frombuffer(row["places"], dtype=np.uint16).reshape(trees, -1)
                begin, end = candidates(keys, np.frombuffer(row["q_keys"], dtype=np.uint32).reshape(-1, trees), share * len(ids))
                largest = max(np.abs(data).max(initial=0), 1e-300)
                rough = (data / largest).astype(np.float32)
                size, found = np.sqrt((rough.astype(np.float64) ** 2).sum(axis=1).max(initial=0)), []
                for i in range(len(q_ids)):
                    met = np.zeros(len(ids), dtype=bool)
                    met[np.concatenate([places[t, a:b] for t, (a, b) in enumerate(zip(begin[i].tolist(), end[i].tolist()))])] = True
                    at = np.flatnonzero(met & (ids != q_ids[i]))
                    if len(at) > k:
                        norm = max(np.abs(q_data[i]).max(initial=0), 1e-300)
                        q = (q_data[i] / norm).astype(np.float32)
                        near = rough[at] @ q
                        # single precision errs by less than this; what is left is scored exactly
                        at = at[near >= np.partition(near, -k)[-k] - 2e-7 * (d + 8) * size * np.sqrt(float(q @ q))]
                    score = exact(data[at], q_data[i])
                    top = np.lexsort((ids[at], -score))[:k]
                    found.append((np.full(len(top), q_ids[i]), ids[at[top]], score[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["query_id", "vec_id", "score"])

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    kept = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(finite(v) & F.exists(v, lambda x: x != 0))
    return kept.withColumn("v", F.transform("v", lambda x: x.cast("double")))


def build(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = TREES) -> DataFrame:
    """The forest over all rows, as a table in the shared folder; for searches of k neighbours at most."""
    kept = usable(rows, id_col, vector_col)
    n = kept.count()
    wanted = max(1, -(-n * 4 // (ROWS * 3)), min(partitions(rows), -(-n // FEW)))  # shuffle partitions may be far more than such shards
    return through_table(shards(own_rows(kept, wanted).coalesce(wanted), k, trees), "forest")


def nearest(index: DataFrame, rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = TREES, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the largest inner product among its candidates.

    queries: a condition on `id`. Candidates of a shard are at least `share` of its rows, or its part of `least` rows of
    the whole index (so a small table is searched whole); repeats over trees count. Ties go to the smaller id.

    Vectors that are null, all zero (or empty), or have a component that is null or not finite take no part. Rows that
    repeat an id and a vector count once, also as queries; a query of an id that has several vectors answers for each,
    with the best k over them. All rows of a query's id are its own and are left out. A null id is no query, and comes
    last in ties. Vectors meet only those of their own length. An empty table, or no query, gives an empty result.
    """
    asked = through_table(query_blocks(usable(rows, id_col, vector_col).where(queries).dropDuplicates(), trees), "queries")
    total = index.select(F.sum(F.octet_length("ids") / 8)).first()[0] or 1.0
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda near: near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = against_all(index, asked, search_blocks(k, trees, max(share, least / total)), "query_id bigint, vec_id bigint, score double", best)
    return top.select("query_id", "rank", F.nullif("vec_id", F.lit(int(NO_ID))).alias("vec_id"), "score")

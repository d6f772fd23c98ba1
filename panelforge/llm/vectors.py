"""Vectors in blocks: clean rows, blocks as single rows, and the join of a stated set's blocks with all blocks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import partitions, through_table

#: Stands for a null id: the last of ties.
NO_ID = np.iinfo(np.int64).max
#: So many blocks of the stated set are broadcast at once, of a size that is bounded; more of them take turns.
BROADCAST_BLOCKS = 64


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def own_rows(rows: DataFrame, least: int = 1) -> DataFrame:
    """The rows without repetition, dealt out by id: one shuffle, of at least so many partitions."""
    return rows.repartition(partitions(rows, least), F.xxhash64("id")).dropDuplicates()


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of the vectors of a batch, one for each dimension."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[begins[at][:, None] + np.arange(d)]


def gathered(batches, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in batches of `most` rows; the last may be smaller."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - size)
            held.append(part)
            size, batch = size + part.num_rows, batch.slice(part.num_rows)
            if size == most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=most)[0]
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=most)[0]


def against_all(blocks: DataFrame, stated: DataFrame, run: Callable, schema: str, best: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """best of run over the pairs of a block of all rows and a block of the stated set; of equal dimension, in column `dim`.

    best keeps what is wanted of each stated row, also of what it kept before. Few blocks of the stated set are
    broadcast, by count. More of them take turns, some BROADCAST_BLOCKS / 2 at a time (dealt out by hash), and what is best
    of a turn's is written: no task holds more of the stated set than a turn has, nor is either side sent anywhere.
    """
    asked = stated.withColumnsRenamed({c: f"q_{c}" for c in stated.columns if c != "dim"})
    count = stated.count()
    turns = 1 if count <= BROADCAST_BLOCKS else -(-count // max(1, BROADCAST_BLOCKS // 2))

    def of(part: DataFrame) -> DataFrame:
        return blocks.join(F.broadcast(part), "dim").mapInArrow(run, schema)

    if turns == 1:
        return best(of(asked))
    turn = F.pmod(F.xxhash64("q_block"), F.lit(turns).cast("long"))
    each = [of(asked.where(turn == i)) for i in range(turns)]
    return best(functools.reduce(DataFrame.unionByName, [through_table(best(e).select(*e.columns), "turn") for e in each]))

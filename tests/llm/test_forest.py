import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import forest, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score double, dim string"


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(given, every, k):
    use = {(i, tuple(v)) for i, v, *_ in given if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in use:
        if i is not None and i % every == 0:
            best = sorted((-dot(v, w), j is None, j or 0, j) for j, w in use if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(best)]
    return sorted(out, key=str)


def rows(seed, n, dim=8):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [float(np.float32(rng.gauss(0, 1) * 1.5 ** (i % 4))) for _ in range(dim)]
        if i % 3 == 0:
            v = [1.0, 2.0, -1.0, 0.5, 0.0, 0.25, 3.0, -2.0]
        if i % 17 == 3:
            v[rng.randrange(dim)] = rng.choice([None, float("nan"), float("inf")])
        if i % 29 == 4:
            v = rng.choice([None, [], [1.0, 2.0], [0.0] * dim])
        out.append((i, v, 1, None, 0.5, ""))
    return out


def found(df, every, **how):
    return sorted(map(tuple, forest.nearest(forest.build(df), df, F.col("id") % every == 0, **how).collect()), key=str)


@pytest.mark.parametrize("blocks", [64, 0])
def test_small_tables_are_searched_whole(spark, monkeypatch, blocks):
    """Nulls, zero and non-finite vectors, hot vectors (ties), repeated rows, null ids, other lengths, clashing columns."""
    monkeypatch.setattr(vectors, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(forest, "QUERIES", 5)
    given = rows(1, 300)
    given += given[:30] + [(None, [1.0, 2.0, -1.0, 0.5, 0.0, 0.25, 3.0, -2.0], 1, 1, 1.0, "")]
    assert found(spark.createDataFrame(given, SCHEMA).repartition(3), 20) == brute(given, 20, 20)


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA), 20) == []
    assert found(spark.createDataFrame([(20, [1.0], 1, None, None, None)], SCHEMA), 20) == []


def test_recall_on_many_rows_and_norms(spark):
    """Isotropic vectors have no structure at all: the hardest case. Norms differ by a factor of three."""
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((12_000, 32)) * rng.uniform(0.5, 1.5, 12_000)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v, 0, None, None, None) for i, v in enumerate(x.tolist())], SCHEMA)
    got = found(df, 100, least=0)
    y = x.astype(float)
    s = y[::100] @ y.T
    s[np.arange(120), np.arange(0, 12_000, 100)] = -np.inf
    want = {(i * 100, int(j)) for i, t in enumerate(np.argsort(-s, axis=1)[:, :20]) for j in t}
    assert len({(r[0], r[2]) for r in got} & want) >= 0.9 * len(want)
    assert all(abs(r[3] - y[r[0]] @ y[r[2]]) < 1e-9 for r in got)


def test_ranges_go_up_together_until_there_are_enough():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 32, (7, 500), dtype=np.uint64).astype(np.uint32), axis=1)
    query = rng.integers(0, 1 << 32, (20, 7), dtype=np.uint64).astype(np.uint32)
    query[0] = keys[:, 3]
    begin, end = forest.candidates(keys, query, 60)
    for i in range(20):
        for level in range(32, -1, -1):
            same = [[int(k) >> (32 - level) == int(q) >> (32 - level) for k in row] for row, q in zip(keys, query[i])]
            if sum(map(sum, same)) >= 60:
                break
        assert [(b, e) for b, e in zip(begin[i], end[i]) if e > b] == [(s.index(True), s.index(True) + sum(s)) for s in same if any(s)]
    begin, end = forest.candidates(keys, query, 1e9)
    assert (end - begin == 500).all()


def test_many_blocks_of_queries_take_turns(spark, monkeypatch):
    """Each block meets each block of queries once, and no task is sent all of them: nothing is joined by a shuffle."""
    monkeypatch.setattr(vectors, "BROADCAST_BLOCKS", 4)
    blocks = spark.range(7).select(F.col("id").alias("block"), F.lit(2).alias("dim"))
    seen = []

    def met(batches):
        for batch in batches:
            yield batch.select(["block", "q_block"])

    def best(pairs):
        seen.append(pairs._jdf.queryExecution().executedPlan().toString())
        return pairs.distinct()

    got = vectors.against_all(blocks, blocks.limit(7).union(spark.range(7, 11).select("id", F.lit(2))), met, "block bigint, q_block bigint", best)
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in range(7) for b in range(11)]
    assert len(seen) == 7 and not any("SortMergeJoin" in plan or "Generate" in plan for plan in seen)  # six turns, and what they kept

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score long, aid string"


def rows(seed, n, dim=6, kinds=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dim)]
        if i % 5 == 0:
            v = [0.5, -0.25, 0.125, 0.5, 0.0, 0.25]
        if i % 17 == 3:
            v[rng.randrange(dim)] = rng.choice([None, float("nan"), float("inf"), float("-inf")])
        if i % 29 == 4:
            v = rng.choice([None, [], [1.0], [0.0] * dim])
        out.append((i, v, None if i % 31 == 5 else rng.randrange(kinds), None, 7, "x"))
    return out


def brute(given, every=5, scale=256, k=5):
    use = {(i, l, tuple(v)) for i, v, l, *_ in given if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(math.floor(scale * x) * math.floor(scale * y) for x, y in zip(a, b))
    out = []
    for i, l, v in use:
        if i is None or i % every:
            continue
        scored = [(-dot(v, w), last(j), j, m) for j, m, w in use if len(w) == len(v)]
        for s, _, j, _ in sorted(x for x in scored if x[3] == l and x[2] != i)[:k]:
            far = sorted(x for x in scored if x[3] != l and x[2] != i and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(i, j, r + 1, x[2], -s, -x[0]) for r, x in enumerate(far)]
    return sorted(out, key=str)


def found(df, **how):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 5 == 0, **how).collect()), key=str)


@pytest.mark.parametrize("blocks", [64, 0])
def test_equal_to_brute_force(spark, monkeypatch, blocks):
    """Nulls, non-finite components, ties, hot vectors, repeated rows, null ids, short vectors; also with dealt-out anchors."""
    monkeypatch.setattr(vectors, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(negatives, "ROWS", 23)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    given = rows(3, 160)
    given += given[:20] + [(None, [0.5, -0.25, 0.125, 0.5, 0.0, 0.25], 1, 1, 1, "")]
    assert found(spark.createDataFrame(given, SCHEMA).repartition(3)) == brute(given) != []


def test_empty_tables_and_tables_without_pairs(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1, None, None, None)], SCHEMA)) == []
    assert found(spark.createDataFrame([(5, [1.0], 1, None, None, None), (6, [1.0], 1, None, None, None)], SCHEMA)) == []


@pytest.mark.parametrize("size", [3, 100, 70_000, 1 << 25])
def test_products_are_exact_and_drop_only_what_cannot_count(size):
    rng = np.random.default_rng(size)
    a, c = rng.integers(-size, size + 1, (9, 33)), rng.integers(-size, size + 1, (400, 33))
    want, least = a @ c.T, np.full(9, -np.inf)
    seen = []

    def narrowed(i, j, low, high):
        if i is None:
            assert (low <= want).all() and (high >= want).all()
            np.maximum(least, np.partition(low, -3, axis=1)[:, -3], out=least)
            return high >= least[:, None]
        assert (low <= want[i, j]).all() and (high >= want[i, j]).all()
        seen.append(len(i))
        np.maximum(least, negatives.nth_largest(i, low.astype(float), 9, 3), out=least)
        return high >= least[i]

    i, j, score = negatives.products(a, negatives.Planes(c), np.ones(want.shape, dtype=bool), narrowed)
    assert (score == want[i, j]).all() and len(score) < 9 * 60 and (seen or size == 3)
    top = negatives.best(i, score, j, 3)
    assert [sorted(score[top][i[top] == k].tolist())[::-1] for k in range(9)] == np.sort(want, axis=1)[:, ::-1][:, :3].tolist()

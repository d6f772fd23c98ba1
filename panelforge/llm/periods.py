"""Periodic runs of words: harmonic grid probes, extended by chunks.

A stretch of words of period p and length >= 2p has p or more places i at which word i equals word i + p, one of them a
multiple of p. So equality is tested only at jp and (j+1)p: n/p tests for each p, n log n in all. What is left is
extended by chunks of growing size, never past the next grid point, where the next one goes on; places inside a run
that has been found with a divisor of p are skipped.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many words at least.
LEAST = 12
#: Probes of texts of up to so many words are kept as a table of about 10 places a word.
TABLE = 16384
#: Periods below this one are probed together; larger ones by octaves, so that runs of short ones are known first.
FIRST = 64
#: Bytes of text that are worked on at once.
SLICE = 1 << 23


@functools.lru_cache(maxsize=1)
def grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (right end, period) with period | right end <= TABLE, by right end, and how many there are before each end."""
    period = np.repeat(np.arange(1, TABLE + 1), TABLE // np.arange(1, TABLE + 1))
    right = np.concatenate([np.arange(p, TABLE + 1, p) for p in range(1, TABLE + 1)])
    order = np.argsort(right, kind="stable")
    return right[order].astype(np.int32), period[order].astype(np.int32), np.searchsorted(right[order], np.arange(TABLE + 2))


def probed(w: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid points with equal words, by growing period, in groups."""
    if n <= TABLE:
        right, period, before = grid()
        right, period = right[: before[n]], period[: before[n]]
        hit = np.flatnonzero(w[right] == w[right - period])
        i, p = right[hit] - period[hit], period[hit]
        order = np.lexsort((i, p))
        i, p = i[order].astype(np.int64), p[order].astype(np.int64)
        edges = [1, *itertools.takewhile(lambda x: x <= n // 2, (FIRST << k for k in itertools.count())), n // 2 + 1]
        cuts = np.searchsorted(p, edges)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield i[a:b], p[a:b]
        return
    low = 1
    while low <= n // 2:
        places, periods, high = [], [], min(2 * low, n // 2 + 1)
        for p in range(low, high):
            hit = np.flatnonzero(w[: n - p : p] == w[p:n:p])
            if len(hit):
                places.append(hit * p)
                periods.append(np.full(len(hit), p))
        if places:
            yield np.concatenate(places), np.concatenate(periods)
        low = high


def reach(w: np.ndarray, i: np.ndarray, p: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """For each place, how many words in a row equal those p further on, from i on (way 1) or from i - 1 back (way -1),
    `most` at most. w ends in a word that is like no other, which place -1 also means."""
    got, active, chunk, last = np.zeros(len(i), dtype=np.int64), np.flatnonzero(most > 0), 4, len(w) - 1
    while len(active):
        k = np.arange(chunk)
        at = (i[active] + got[active] * way)[:, None] + (k if way > 0 else -1 - k)
        at = np.where(at < 0, last, at)
        same = w[np.minimum(at, last)] == w[np.minimum(np.where(at == last, last - 1, at + p[active][:, None]), last)]
        count = np.where(same.all(axis=1), chunk, same.argmin(axis=1))
        got[active] += count
        full = (count == chunk) & (got[active] < most[active])
        got[active] = np.minimum(got[active], most[active])
        active, chunk = active[full], min(4 * chunk, max(4, (1 << 20) // max(1, len(active))))
    return got


def stretches(w: np.ndarray, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period): of grid points with equal words, by period and place, the maximal stretches of such places."""
    ahead = reach(w, i, p, p, 1)
    head = np.ones(len(i), dtype=bool)
    head[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1] + p[1:]) | (ahead[:-1] < p[:-1])
    first = np.flatnonzero(head)
    final = np.append(first[1:], len(i)) - 1
    i0, p0 = i[first], p[first]
    end = i[final] + ahead[final]
    # a stretch that can't be long enough even with all of the words since the grid point before it is left as it is
    wanted = np.maximum(p0, LEAST - p0)
    most = np.where(end - i0 + np.minimum(p0 - 1, i0) >= wanted, np.minimum(p0 - 1, i0), 0)
    return i0 - reach(w, i0, p0, most, -1), end, p0


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least max(LEAST, 2 period) words, by start, then period; each
    with its smallest period. ids: a number >= 0 for each word, equal for equal words."""
    n = len(ids)
    if n < LEAST:
        return []
    w = np.append(ids, -1)
    found: dict[tuple[int, int], int] = {}
    for i, p in probed(w, n):
        for (a, b), q in found.items():
            if not len(i):
                break
            inside = (i >= a) & (i + p < b) & (p % q == 0)
            if inside.any():
                i, p = i[~inside], p[~inside]
        if not len(i):
            continue
        start, end, period = stretches(w, i, p)
        keep = end - start >= np.maximum(period, LEAST - period)
        for a, b, q in zip(start[keep].tolist(), end[keep].tolist(), period[keep].tolist()):
            found.setdefault((a, b + q), q)  # periods grow: a multiple of a run's period has the same ends
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that stand in a run after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    parts, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if a > at:
            parts += words[at:a]
        at = max(at, b)
    return b" ".join(parts + words[at:])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): of each text the runs, (start, length, period) by start, and the text that is
    left if each run keeps its first period only. change: what to make of the words (id, words) of a text first.

    Words are the spans between ASCII white space. A null or empty text has no words, no runs and an empty collapsed
    text; a null id keeps its row; each repeated row has a result of its own; an empty table gives an empty one. Only
    the two named columns are read. A text is one task's work, in memory of about 40 bytes a word and n log n probes.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            size = np.cumsum([len(t or b"") for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                seen: dict = defaultdict(itertools.count().__next__)
                counts, ends, runs, left = [], [0], [], []
                for key, text in zip(batch.column(0).slice(a, b - a).to_pylist(), texts[a:b]):
                    words = (text or b"").split()
                    if change is not None:
                        words = change(key, words)
                    found = runs_of(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
                    counts.append(len(words))
                    runs += found
                    ends.append(len(runs))
                    left.append(collapsed(words, found))
                flat = np.array(runs, dtype=np.int64).reshape(-1, 3)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), lists, pa.array(left, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    out = docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))

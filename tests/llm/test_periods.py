import hashlib
import random
import zlib

import numpy as np
import pytest

from panelforge.llm import periods
from panelforge.llm.queries_d import op11_periodic_runs, repeat_tail


def brute(words):
    """Every period and every maximal stretch of equal words, each kept with its smallest period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def texts(seed, count, longest):
    rng = random.Random(seed)
    for _ in range(count):
        n, kinds = rng.randrange(longest), rng.choice([1, 2, 3, 10, 200])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n:
                a, p = rng.randrange(n), rng.randrange(1, 40)
                e = min(n, a + rng.randrange(150))
                for i in range(a + p, e):
                    w[i] = w[i - p]
        yield w


@pytest.mark.parametrize("table", [16384, 20])
def test_runs_are_those_of_brute_force(monkeypatch, table):
    """Also by the way of texts that are longer than the table of probes."""
    monkeypatch.setattr(periods, "TABLE", table)
    periods.grid.cache_clear()
    for w in texts(1, 400, 260):
        assert periods.runs_of(np.array(w, dtype=np.int64)) == brute(w), w
    periods.grid.cache_clear()


def test_square_run_of_fibonacci_words_and_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periods.runs_of(np.array(b)) == brute(b)
    assert periods.runs_of(np.zeros(100_000, dtype=np.int64)) == [(0, 100_000, 1)]
    long = np.arange(60_000) % 20_000
    assert periods.runs_of(long) == [(0, 60_000, 20_000)]


def test_collapsed_words():
    w = [b"x", *[b"a", b"b"] * 6, b"y"]
    runs = periods.runs_of(np.array([0, *[1, 2] * 6, 3]))
    assert runs == [(1, 12, 2)]
    assert periods.collapsed(w, runs) == b"x a b y"


def test_changed_words():
    for i in range(200):
        w = [b"%d" % k for k in range(37)]
        got, h = repeat_tail(i, w), zlib.crc32(str(i).encode())
        if h % 10:
            assert got == w
        else:
            a = (h // 10) % 37
            p = 1 + (37 - a) // (3 + (h // 10) % 8)
            assert got == [w[k] if k < a else w[a + (k - a) % p] for k in range(37)]
    assert repeat_tail(None, [b"a"]) == [b"a"] and repeat_tail(0, []) == []


def test_query_equals_brute_force(spark, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, null ids and clashing columns."""
    docs = docs.limit(62).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "a " * 30, None, None, None, None, None, None), (7, "\x0ba\x1cb\x0b" * 20, None, None, None, None, None, None)], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for r in docs.collect():
        words = repeat_tail(r.doc_id, (r.text or "").encode().split())
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        left = b" ".join(x for i, x in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((r.doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want, key=str)
    empty = periods.periodic_runs(docs.limit(0))
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.count() == 0

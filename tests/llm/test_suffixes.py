import hashlib
import random

import numpy as np

from panelforge.llm import suffixes


def brute(rows, length=50):
    out = []
    data = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    first: dict = {}
    for d, t in data:
        for i in range(len(t) - length + 1):
            g = t[i : i + length]
            first[g] = min(d, first.get(g, d))
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((None if d == float("inf") else d, len(t), sum(gone), (bytes([0]) + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for alphabet, n in ((b"ab", 300), (b"a", 90), (b"abcz\x00\xc3", 500), (b"abracad", 40)):
        for _ in range(10):
            text = bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, n))) + b"\xff"
            got = suffixes.suffix_array(np.frombuffer(text, np.uint8), 24)
            assert sorted(got.tolist()) == list(range(len(text)))
            cut = [(text[i:] + b"\xff" * 24)[:24] for i in got.tolist()]
            assert cut == sorted(cut)
            lcp = suffixes.common_prefixes(np.frombuffer(text, np.uint8), got, 24)
            for a, b, k in zip(cut, cut[1:], lcp[1:].tolist()):
                assert k == next((i for i in range(24) if a[i] != b[i]), 24)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_removed_equals_brute_force(spark, docs, monkeypatch):
    import panelforge.llm.suffixes as s

    for small, hot in ((False, 20_000), (True, 3)):
        if small:
            monkeypatch.setattr(s, "SLICE_BYTES", 2000)
            monkeypatch.setattr(s, "ANCHOR_BUCKET", 20_000)
            monkeypatch.setattr(s, "STRETCH_BUCKET", 8000)
        monkeypatch.setattr(s, "HOT", hot)
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in s.removed(s.repeated_spans(docs)).collect()]
        assert sorted(got) == sorted(brute(rows_of(docs)))


def test_nulls_repeats_and_no_rows(spark):
    t = "a passage that is long enough to be found, by more than fifty bytes. " * 2
    rows = [(None, t), (None, t), (3, t), (3, t), (5, "x" + t[:60]), (7, None), (8, "é" * 200), (9, "é" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (x[0] is None, *map(str, x))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.removed(suffixes.repeated_spans(docs)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert suffixes.repeated_spans(docs.limit(0)).count() == 0


def test_exchanges_stay_small(spark):
    """What is sent of texts without repeats: three times the slices, and the hashes of anchors."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioustrnlmdp") for _ in range(rng.randrange(2, 11))) for _ in range(4000)]
    rows = [(7919 * i, " ".join(rng.choice(vocabulary) for _ in range(300))) for i in range(500)]
    slices = suffixes.cut_slices(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text")
    size = sum(len(t) for _, t in rows)
    cut = sum(len(r["data"]) for r in slices.collect())
    sent = sum(len(r["packed"]) for r in slices.mapInArrow(suffixes.send_anchors(1, 50), "bucket long, slice long, packed binary").collect())
    assert 3 * cut + sent < 1.33 * size


def test_one_id_in_many_slices_removes_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 300)
    t = "a passage that is long enough to be found, by more than fifty bytes. " * 3
    rows = [(4, t + str(i)) for i in range(6)] + [(6, t), (None, t), (None, t)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.removed(suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)

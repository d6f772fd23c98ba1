import hashlib

import numpy as np

from panelforge.llm import minhash


def jaccard(a, b):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_signatures_estimate_jaccard_and_ignore_batching():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, 300)) for _ in range(12)]
    texts = base + [t[: len(t) // 2] + " " + base[(i + 1) % 12][len(t) // 2 :] for i, t in enumerate(base)] + ["", None, "one", " \n", "a b c"]
    rows = minhash.sign(texts)
    assert (rows == np.concatenate([minhash.sign([t]) for t in texts])).all()
    errors = [minhash.likeness(rows[i], rows[j]) - jaccard(texts[i], texts[j]) for i in range(len(texts)) for j in range(len(texts))]
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.01
    marks, begin = minhash.shingles([t.encode() for t in base])
    assert (minhash.signatures(marks, begin, 100) == minhash.signatures(marks, begin)).all()


def test_edited(spark, docs):
    for df in (docs, docs.coalesce(1), docs.where("doc_id = 18")):
        rows = {r.doc_id: r for r in minhash.edited_fingerprints(df).collect()}
        order = sorted(df.collect(), key=lambda r: r.doc_id)
        assert sorted(rows) == [r.doc_id for r in order]
        for r, after in zip(order, order[1:] + order[:1]):
            text, got = r.text or "", rows[r.doc_id]
            q = len(text) // 4
            edited = text[: len(text) - q] + (after.text or "")[:q]
            assert got.n_chars == len(text) and got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = minhash.sign([text, edited, after.text])
            assert got.near_edited == minhash.likeness(a, b) and got.near_next == minhash.likeness(a, c)
            assert got.fingerprint == a.astype(">u2").tobytes().hex()
    assert minhash.edited_fingerprints(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x y"), (None, None), (4, "p q r s"), (4, "p q r s"), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_chars) for r in minhash.edited_fingerprints(odd).collect()) == [(-1, 0), (-1, 3), (4, 7), (4, 7), (9, 0)]


def classes_of(rows, threshold=0.8):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a < b and jaccard(x, y) >= threshold:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in rows}


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == classes_of(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_buckets_are_cut(spark):
    # chains of edits of one text: all share bands, few are near the first one of a bucket
    rng = np.random.default_rng(4)
    words, rows = [f"w{i}" for i in rng.integers(0, 500, 120)], []
    for i in range(40):
        words = [f"x{i}-{j}" if rng.random() < 0.012 else w for j, w in enumerate(words)]
        rows.append((100 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_of(rows)
    assert len(set(want.values())) < 40
    for small in (3, 64):
        assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, small=small).collect()} == want


def test_nulls_repeats_and_links(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text), (5, text), (5, text), (7, text + " more"), (None, "alone here"), (9, None), (3, ""), (None, "two of them"), (None, "two of them")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, th int")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, -1, 0), (-1, -1, 0), (-1, -1, 0), (-1, 5, 1), (3, 3, 0), (5, 5, 1), (5, 5, 1), (7, 5, 1), (9, 3, 0)]
    kept = sorted((r.doc_id or -1, r.text) for r in minhash.keep_one(docs).collect())
    assert kept == [(-1, "alone here"), (-1, "two of them"), (3, ""), (5, text)]

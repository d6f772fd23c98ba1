import re

from pyspark.sql import functions as F

from panelforge.llm import positions

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    out = {}
    for d, t in texts:
        w = words(t)
        hit, found = set(), set()
        for i, x in items:
            v = words(x)
            for a in range(max(1, len(v) - window + 1) if v else 0):
                q = v[a : a + window]
                for p in range(len(w) - len(q) + 1):
                    if w[p : p + len(q)] == q:
                        hit.update(range(p, p + len(q)))
                        found.add(i)
        out[d] = (len(w), len(hit), sorted(x for x in found if x is not None))
    return out


def items_of(rows):
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 20]
    return [(1, " ".join(long[0].split()[3:16]).upper()), (2, long[1]), (3, "one"), (4, None), (5, "--"), (10, " ".join(long[0].split()[5:15])), (None, " ".join(long[2].split()[:11])), (6, "not there at all"), (7, "two words"), (7, "two words")]


def test_hits_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(positions, "SHARD_BYTES", 3000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = items_of(rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    for size in (1 << 20, 60):
        got = positions.contaminated(docs, benchmark, block_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r.items) == want[r.doc_id], (size, r.doc_id)
    assert positions.contaminated(docs.limit(0), benchmark).count() == 0
    assert positions.contaminated(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0
    twice = positions.contaminated(docs.union(docs).withColumn("doc_id", F.lit(None)), benchmark, block_bytes=60)
    assert twice.count() == 2 * len(rows)


def test_proximity_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    text = next(t for _, t in rows if t and len(t.split()) > 50).split()
    phrases, span = [f"{text[12]} {text[7]} {text[9]}", "one", "", "absent words"], 8
    got = {(r.doc_id, r.phrase, r.start, r.end) for r in positions.proximity(docs, phrases, span).collect()}
    want = set()
    for d, t in rows:
        w = words(t)
        for p in phrases:
            need = set(words(p))
            found = [(a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + span) + 1) if need and need <= set(w[a:b])]
            want |= {(d, p, a, b) for a, b in found if (a + 1, b) not in found and (a, b - 1) not in found}
    assert got == want


def test_proximity_of_odd_rows(spark):
    rows = [(None, "a b c"), (4, "c x a"), (4, "c x a"), (5, None), (6, ""), (7, "a a c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, phrase int")
    got = sorted((r.doc_id or -1, r.start, r.end) for r in positions.proximity(docs, ["A c"], 3).collect())
    assert got == [(-1, 0, 3), (4, 0, 3), (4, 0, 3), (7, 1, 3)]
    assert positions.proximity(docs.limit(0), ["a"], 3).count() == 0

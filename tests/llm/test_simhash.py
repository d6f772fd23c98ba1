import random

import xxhash

from panelforge.llm import simhash


def slow(text):
    w = text.lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    group = dict(prints)
    parent = {d: d for d in group}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in group:
        for b in group:
            if a < b and bin(group[a] ^ group[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in group}


def test_documents_equal_brute_force(spark, docs):
    want = {r.doc_id: slow((r.text or "").encode()) for r in docs.collect()}
    labels = components(want)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.fp & (2**64 - 1) == want[r.doc_id] and r.component_id == labels[r.doc_id]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_connect_exactly_near_fingerprints(spark):
    rng = random.Random(3)
    prints = {0, 1, 2**63}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    want = components(dict(enumerate(prints)))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    for bucket in (1024, 1):  # by pairs, and by two-wildcard keys
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        at = {x: i for i, x in enumerate(prints)}
        for r in simhash.links(df, bucket).collect():
            a, b = r.a & (2**64 - 1), r.b & (2**64 - 1)
            assert bin(a ^ b).count("1") <= 2
            x, y = find(at[a]), find(at[b])
            parent[max(x, y)] = min(x, y)
        assert {i: find(i) for i in range(len(prints))} == want


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (6, "a b c d"), (6, "a b c d"), (2, "A b C d"), (None, None), (8, ""), (None, "other words stand here alone"), (None, "other words stand here alone")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, slot int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 2), (-1, 8), (2, 2), (6, 2), (6, 2), (8, 8)]

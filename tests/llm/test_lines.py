import random

from pyspark.sql import functions as F

from panelforge.llm import lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def near(a, b):
    return a == b or min(len(a), len(b)) >= lines.LEAST_CHARS and abs(len(a) - len(b)) <= lines.EDITS and edit_distance(a, b) <= lines.EDITS


def mutated(rng, line):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(line) + 1)
        line = rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("abé日 ") + line[i:], line[:i] + "x" + line[i + 1 :]])
    return line


def make(n=45):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(14, 40))) for _ in range(25)]
    rows = [(i * 2 % (2 * n - 1), "\n".join(mutated(rng, rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", " ", "short", "ab"]) for _ in range(rng.randrange(1, 7)))) for i in range(n)]
    return [*rows, (200, None), (201, ""), (202, rows[0][1]), (203, "z" * 5000), (204, "z" * 4999 + "y")]


def test_bit_parallel_distance(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 30)))
        pairs.append((a, mutated(rng, a) if rng.random() < 0.9 else "ab"))
    for k in (1, 2, 3):
        got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.expr(lines.distance(k)).alias("d")).collect()
        for r in got:
            d = edit_distance(r.a, r.b)
            assert r.d == d if d <= k else r.d > k, (k, r, d)


def test_classes_equal_brute_force(spark):
    rows = make()
    places = sorted((d, p, x) for d, t in rows for p, x in enumerate((t or "").split("\n")) if x.strip())
    want = {}
    for d, p, x in places:
        alike = [(e, q) for e, q, y in places if near(x, y)]
        want[d, p] = (min(alike)[0], min(alike) < (d, p), len({y for _, _, y in places if y != x and near(x, y)}))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, h1 int, pos int").repartition(3)
    got = {r.doc_id: r for r in lines.classify_lines(docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        cut = (t or "").split("\n") if t is not None else []
        assert got[d].n_lines == len(cut)
        assert got[d].removed == [p for p in range(len(cut)) if want.get((d, p), (0, False))[1]], d
        assert got[d].classes == [want[d, p][0] if x.strip() else None for p, x in enumerate(cut)]
        assert got[d].n_links == sum(want[d, p][2] for p, x in enumerate(cut) if x.strip())
    kept = {r.doc_id: r.text for r in lines.remove_lines(docs).collect()}
    assert kept == {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in got[d].removed) for d, t in rows}


def test_components_lose_no_link(spark):
    # 1 ~ 2 ~ 3 is a chain of edits; 10 ~ 14 and 13 ~ 12 are two groups that 13 ~ 14 joins; 20 has an equal line only
    base, other = "a line of quite enough characters", "one more line that has 1234567890"
    texts = {1: base, 2: base + "xy", 3: base + "xyzw\n\nalone in all of the documents", 10: other, 14: other + "ab", 13: other + "abcd", 12: other + "abcdef", 20: base, 21: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.components for r in lines.line_components(docs).collect()}
    assert got == {1: [1], 2: [1], 3: [1, None, 3], 10: [10], 12: [10], 13: [10], 14: [10], 20: [1], 21: []}
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    places = sorted((d, p, x) for d, t in rows for p, x in enumerate((t or "").split("\n")) if x.strip())
    group = list(range(len(places)))
    pairs = [(i, j) for i in range(len(places)) for j in range(i) if near(places[i][2], places[j][2])]
    while True:
        before = list(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    want = {(d, p): places[g][0] for (d, p, _), g in zip(places, group)}
    for r in lines.line_components(docs).collect():
        assert r.components == [want.get((r.doc_id, p)) for p in range(r.n_lines)]


def test_nulls_repeats_and_no_rows(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line), (1, line), (1, line), (2, "x" + line), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.removed) for r in lines.classify_lines(docs).collect())
    assert got == [(False, 1, []), (False, 1, []), (False, 2, [0]), (True, 0, []), (True, 0, [0])]
    assert lines.remove_lines(docs).count() == 5 and lines.remove_lines(docs.limit(0)).count() == 0

import random

import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from panelforge.llm import token_tree  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


def test_edits_equal_counting_anew():
    counter, rng = token_tree.counter(PATH, P.PATTERN), random.Random(4)
    parts = ["the ", "don't", "  ", "\n", "'", "r", "e", "l", "x", "12", "!?", " \t ", "é", "'ll ", "word "]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        tree = token_tree.TokenTree.of(counter, text)
        for _ in range(6):
            a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
            b = min(b, a + rng.randrange(12))
            new = "".join(rng.choice(parts) for _ in range(rng.randrange(4)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.sums[0, 1] == len(text)
            assert tree.tokens == len(counter.encoding.encode_ordinary(text)), (text, a, b, new)
            assert tree.tokens_between(0, tree.width) == tree.tokens


def test_an_edit_encodes_only_what_is_near():
    counter = token_tree.counter(PATH, P.PATTERN)
    tree = token_tree.TokenTree.of(counter, "some words here " * 2000)
    tree.edit(16_000, 16_004, "other")
    assert tree.encoded < 8


def test_whole_operator(spark, docs):
    edited = docs.withColumn("edits", F.expr("array(named_struct('start', 3L, 'end', 9L, 'new', 'x y'), null, named_struct('start', 1000000L, 'end', null, 'new', ' end'))"))
    counter = token_tree.counter(PATH, P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_tree.count_edited(edited, PATH, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert r.n_tokens == len(counter.encoding.encode_ordinary(t))
        t = t[:3] + "x y" + t[9:] + " end"
        assert r.edited == t and r.n_tokens_edited == len(counter.encoding.encode_ordinary(t))
    assert token_tree.count_edited(edited.limit(0), PATH, P.PATTERN).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "some words"), (3, "some words"), (3, "some words"), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int").withColumn("edits", F.expr("array(named_struct('start', 0L, 'end', 4L, 'new', 'More'))"))
    got = sorted((r.doc_id or -1, r.edited, r.n_tokens > 0) for r in token_tree.count_edited(docs, PATH, P.PATTERN).collect())
    assert got == [(-1, "More", False), (-1, "More words", True), (3, "More words", True), (3, "More words", True), (5, "More", False)]
    plain = token_tree.count_edited(docs.withColumn("edits", F.lit(None).cast(docs.schema["edits"].dataType)), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.edited, r.n_encoded) for r in plain) == [(-1, "", 0), (-1, "some words", 0), (3, "some words", 0), (3, "some words", 0), (5, "", 0)]


def test_the_pattern_of_edits_cuts_as_whole_texts_are_cut():
    from conftest import new_points

    from panelforge.llm import pieces

    texts = new_points()
    counter = token_tree.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    joined, _, starts, ends, counts = pieces.split(texts)
    at = 0
    for t, c in zip(texts, counts.tolist()):
        assert counter.pattern.findall(t) == [joined[a:b] for a, b in zip(starts[at : at + c], ends[at : at + c])]
        at += c

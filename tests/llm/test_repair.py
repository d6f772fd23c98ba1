import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from panelforge.llm import repair  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def test_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 500, 12) for _ in range(20)]
    lists = [np.concatenate([phrases[i] for i in rng.integers(0, 20, rng.integers(0, 40))] + [np.array([7] * int(rng.integers(0, 30)))]).astype(np.uint32) for _ in range(80)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    block = repair.Block(data := repair.pack(np.concatenate(lists), first, 500))
    assert len(block.rules) and len(data) < first[-1] * 1.5
    flat, ends = block.all()
    assert flat.tolist() == np.concatenate(lists).tolist() and ends.tolist() == first.tolist()
    for i, x in enumerate(lists):
        assert block.document(i).tolist() == x.tolist()
        for _ in range(5):
            a, b = sorted(rng.integers(0, len(x) + 1, 2).tolist())
            assert block.document(i, a, b).tolist() == x[a:b].tolist()
    for empty in (np.zeros(0, np.uint32), np.array([3], np.uint32)):
        assert repair.Block(repair.pack(empty, np.array([0, len(empty)]), 500)).document(0).tolist() == empty.tolist()


def test_rules_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    often = np.tile(rng.integers(0, 500, 64), 1 << 13)
    # more rules than 16 bits have left
    many = np.tile(rng.permutation(60_000)[:40_000], (17, 1))[:, rng.permutation(40_000)].ravel()
    for ids, base in ((often, 500), (many, 60_000)):
        ids, first = ids.astype(np.uint32), np.array([0, len(ids)])
        symbols, _, rules, _ = repair.compress(ids, first, base)
        pairs, times = np.unique(symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:], return_counts=True)
        assert not len(times) or times.max() < repair.LEAST
        block = repair.Block(repair.pack(ids, first, base))
        assert block.document(0).tolist() == ids.tolist() and len(block.rules) == len(rules)
    assert base + len(rules) > 1 << 16


def test_file_of_documents(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    where = repair.write_ids(docs, PATH, block_ids=3000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.describe_file(spark, where).collect()}
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in repair.decode_file(spark, where).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        want = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert ids[r.doc_id] == want
        assert got[r.doc_id] == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert len(got) == docs.count()


def test_added_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = ["plain text", "end <|endoftext|> next", "", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "last one"]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert want[1] == [437, 220, 50256, 1306, 0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in repair.decode_file(spark, repair.write_ids(df, PATH)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in repair.describe_file(spark, repair.write_ids(df, PATH)).collect())
    assert got == [(0, None, 3), (3, 1, 1), (4, 1, 1), (5, 2, 1)]
    assert repair.describe_file(spark, repair.write_ids(df.limit(0), PATH)).count() == 0


def test_ids_equal_the_library_on_all_of_unicode():
    from conftest import new_points
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts, tokenizer = new_points(), Tokenizer.from_file(path)
    ids, counts = repair.library(path)[0].ids(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [t for t, x, e in zip(texts, parts, tokenizer.encode_batch(texts, add_special_tokens=False)) if x.tolist() != e.ids] == []

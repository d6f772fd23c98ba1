import random

import numpy as np
import pytest
import regex
import tiktoken

P = pytest.importorskip("public_tokenizers")
from panelforge.llm import bpe, pieces  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "  ", "a", "don't we'll 'tis ''s 'sx !'s ' s I'M", " a  b\n\nc \t d  ", "x\n", "12 3½² ٣4 a1b2", "éè ñ 日本語 text　wide x", "a​b\x1cc\x85d", "'", "'re", "'r", "\n\n", "$$$ %%% word***", "''ll's've", "éa", "😀😀 ok"]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def scrambled(seed, n):
    rng = random.Random(seed)
    alphabet = "ab ers't ll 'd\n\t .!1²é日 　"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_are_the_matches_of_the_pattern():
    texts = TEXTS + scrambled(1, 3000)
    joined, _, starts, ends, counts = pieces.split(texts)
    got, at = [], 0
    for c in counts:
        got.append([joined[a:b] for a, b in zip(starts[at : at + c], ends[at : at + c])])
        at += c
    pattern = regex.compile(P.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"[^\p{White_Space}\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\S", r"\P{White_Space}"))
    assert got == [pattern.findall(t) for t in texts]
    assert pieces.split([])[4].tolist() == [0]


def test_ids_equal_the_library(encoding):
    texts = TEXTS + scrambled(2, 500)
    ids, counts = bpe.encode_texts(texts, PATH)
    at = 0
    for t, c in zip(texts, counts):
        assert ids[at : at + c].tolist() == encoding.encode_ordinary(t), t
        at += c
    data, total = bpe.decode_ids(ids, PATH)
    assert data.tobytes() == "".join(texts).encode() and total[-1] == len(data)


def test_appends_and_edits_are_exact(encoding):
    coder, rng = bpe.coder(PATH)[0], random.Random(3)
    for _ in range(40):
        state = bpe.PrefixState(coder)
        for _ in range(6):
            word = bytes(rng.choice(b"thanersgoi") for _ in range(rng.randrange(30)))
            if rng.random() < 0.5:
                state.append(word)
            else:
                a = rng.randrange(len(state.piece) + 1)
                state.splice(a, min(len(state.piece), a + rng.randrange(4)), word[:5])
            assert state.last == coder.extend(state.piece, [-1])
            assert state.ids() == (encoding.encode_ordinary(state.piece.decode()) if state.piece else [])


def test_whole_operator(spark, docs):
    rows = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    for r in docs.select("doc_id", "text").collect():
        assert rows[r.doc_id] == (encoding.encode_ordinary(r.text or ""), (r.text or "").encode())
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_null_ids_and_repeated_rows(spark, encoding):
    rows = [(None, "some words"), (3, "some words"), (3, "some words"), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or -1, bytes(r.bytes).decode(), len(r.ids) // 4) for r in bpe.encode_documents(docs, PATH, decode=True).collect())
    n = len(encoding.encode_ordinary("some words"))
    assert got == [(-1, "", 0), (-1, "some words", n), (3, "some words", n), (3, "some words", n), (5, "", 0)]


def test_ids_equal_the_library_on_all_of_unicode(encoding):
    from conftest import new_points

    texts = new_points()
    ids, counts = bpe.encode_texts(texts, PATH)
    at, wrong = 0, []
    for t, c in zip(texts, counts.tolist()):
        if ids[at : at + c].tolist() != encoding.encode_ordinary(t):
            wrong.append(t)
        at += c
    assert len(texts) > 100_000 and not wrong

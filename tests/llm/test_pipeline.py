import hashlib

import pytest

P = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from test_lines import near  # noqa: E402
from test_positions import brute, items_of  # noqa: E402

import corpus_pipeline  # noqa: E402
from panelforge.llm import bpe, language, simhash  # noqa: E402


def test_run_equals_brute_force(spark, docs, tmp_path):
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").where("length(text) < 3000 or text is null")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    items = items_of(rows)[:2]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    evidence = language.Evidence(language.fit(stored))
    rows = sorted((d, t) for d, t in rows if (p := language.predict_one(t, evidence))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE)
    places = [(d, p, x) for d, t in rows for p, x in enumerate(t.split("\n")) if x.strip()]
    gone = {(d, p) for i, (d, p, x) in enumerate(places) if any(near(x, y) for _, _, y in places[:i])}
    rows = [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)) for d, t in rows]
    prints = {d: simhash.fingerprint(t.encode(), 5) & (2**64 - 1) for d, t in rows}
    group = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[rows[i][0]] ^ prints[rows[j][0]]).count("1") <= 2]
    for _ in rows:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    hits = brute(rows, items)
    rows = [r for r in rows if not hits[r[0]][1]]
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((d, len(encoding.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and 5 < len(want)


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "plain words that no one repeats here"
    rows = [(None, text, "en"), (None, "other words are quite enough for it", "en"), (4, text, "en"), (4, text, "en"), (5, None, None), (6, "", "en"), (7, "x a b c d e f g h i j y", "en")]
    for some in (rows, []):
        docs = spark.createDataFrame([(d, t, la, None, 1, 2, 3) for d, t, la in some], "doc_id long, text string, lang string, source string, n_chars long, fp int, th int")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = sorted((r.doc_id or -1, r.text) for r in docs.collect())
        # the repeated rows of id 4 lose nothing to each other; the copy without an id loses its line, and stays as an empty text
        assert kept == ([(-1, ""), (-1, "other words are quite enough for it"), (4, text)] if some else [])


def test_keep_one_repeats(spark):
    rows = [(3, "a b c"), (3, "a b c"), (None, "a b c"), (None, "q r s"), (None, "q r s"), (8, "z")]
    got = sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, "q r s"), (3, "a b c"), (8, "z")]

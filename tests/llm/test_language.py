import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import language


def corpus(spark, n=240):
    rng = random.Random(6)
    sounds = {"xx": ["the", "ing", "er", "on", "st", "ly"], "yy": ["ll", "ñ", "ción", "os", "que", "rr"], "zz": ["sch", "ung", "ü", "ein", "keit", "ver"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 40))), lang if i % 9 else None, lang, -1.0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, score double")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = language.fit(docs.where("doc_id % 5 != 0"))
    assert model.languages == ["xx", "yy", "zz"]
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "truth", "lang_pred", "score"]
    rows = out.where("doc_id % 5 = 0").collect()
    assert sum(r.lang_pred == r.truth for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_unseen_words_back_off():
    model = language.Model(["a", "b"], {"known": 0}, np.array([[0, -3]], "f4"), {1: language.Table(["q", "k"], [[-2, 0], [0, -4]]), 2: language.Table(["\x02z"], [[-1, 0]])})
    # a known word; a known pair comes before a known letter; a letter, the mean of two, nothing
    assert model.evidence(["known", "zq", "yq", "kq", "ü"]).tolist() == [[0, -3], [-1, 0], [-2, 0], [-1, -2], [0, 0]]
    # a tie: the first language in alphabetical order
    assert language.predict_one("ü", language.Evidence(model)) == ("a", 0.5)


def brute(rows, text):
    """The language and score of a text, by the definition: counts in dictionaries, logs by math."""
    languages = sorted({la for _, la in rows if la})
    words = [(w, la) for t, la in rows if t and la for w in re.findall(r"[^\W\d_]+", t.lower())]
    grams = lambda w, k: [m[i : i + k] for m in ["\x02" + w + "\x03" if k > 1 else w] for i in range(len(m) - k + 1)]
    counts = {0: Counter(words)} | {k: Counter((g, la) for w, la in words for g in grams(w, k)) for k in range(1, 6)}
    kept = {k: {x for x, _ in c if sum(c[x, la] for la in languages) >= 3} for k, c in counts.items()}
    total = {(k, la): sum(c[x, la] for x in kept[k]) for k, c in counts.items() for la in languages}

    def logs(k, x):
        raw = [math.log((counts[k][x, la] + 0.5) / (total[k, la] + 0.5 * len(kept[k]) + 0.5)) for la in languages]
        return [r - max(raw) for r in raw]

    score = [0.0] * len(languages)
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        found = [logs(0, w)] if w in kept[0] else next((some for k in range(5, 0, -1) if (some := [logs(k, g) for g in grams(w, k) if g in kept[k]])), [])
        score = [s + sum(f[i] for f in found) / max(1, len(found)) for i, s in enumerate(score)]
    best = max(range(len(languages)), key=lambda i: score[i])
    return languages[best], 1 / sum(math.exp(s - score[best]) for s in score)


def test_equals_brute_force(spark):
    docs = corpus(spark, 120)
    rows = docs.collect()
    model = language.fit(docs.where("doc_id % 5 != 0"))
    seen = [(r.text, r.lang) for r in rows if r.doc_id % 5]
    for r in language.predict(docs.withColumn("text", F.concat("text", F.lit(" unseenwörd stüng 12"))), model).collect():
        lang, score = brute(seen, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_nulls_and_no_letters(spark):
    docs = corpus(spark, 60)
    model = language.fit(docs)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 ² _ !"), (3, "日本"), (4, "ñ" * 30000), (4, "ñ" * 30000)], "doc_id long, text string")
    rows = language.predict(odd, model).collect()
    assert [r.lang_pred for r in rows][:3] == ["und"] * 3 and [r.score for r in rows][:3] == [0] * 3
    assert rows[3].lang_pred in model.languages and {r.lang_pred for r in rows[4:]} == {"yy"}
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.languages == [] and {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0
    few = language.fit(docs, fit_documents=20)
    assert few.languages

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, u long, slot int"


def make_docs():
    """Small documents with nulls, empty and long texts, copies, repeated rows and columns whose names clash with inner ones."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    texts = []
    for i in range(60):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 160))))
        elif kind == 1:
            texts.append(rng.choice(texts))
        elif kind == 2:
            w = (rng.choice(texts) or "").split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(rng.choice([None, "", " ", "one", "two words", "\n\n"]))
        elif kind == 4:
            texts.append("\n".join(" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(5)))
        else:
            t = rng.choice(texts) or ""
            texts.append(t[: len(t) // 2] + " " + " ".join(rng.choice(vocabulary) for _ in range(30)))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    texts.append("é" * 5000)
    rows = [(i * 3, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", None, i, None, 1) for i, t in enumerate(texts)]
    return rows


def new_points():
    """Texts of each code point that Python's Unicode lacks or that regex has as a letter or number, and of every 11th other
    one, between letters of several scripts and digits."""
    import sys
    import unicodedata

    import regex

    every = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    odd = {c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"}
    points = [c for i, c in enumerate(every) if c in odd or i % 11 == 0]
    sides = ["\uac00\ub098", "\u4e00\u4eba", "ab", "12", " x"]
    return [f"{sides[i % 5]}{c}{sides[(i // 5) % 5]}" for i, c in enumerate(points)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(5)

"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import through_table
from .pieces import slices
from .text import release

WORD = re.compile(r"[^\W\d_]+")
#: Documents that a model is fitted on, at most, in expectation: a sample by a hash of their ids and texts. It bounds the
#: words and n-grams of a model, all of which it keeps that occur LEAST times.
FIT_DOCUMENTS = 20_000
LONGEST, LEAST = 5, 3
#: Words of which one worker remembers the evidence.
REMEMBERED = 200_000
#: Keys that a task counts before it sends the counts on.
COUNTED = 100_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    """The n-grams of a word with its ends marked."""
    marked = f"\x02{word}\x03" if size > 1 else word
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def log_shares(counts: np.ndarray) -> np.ndarray:
    """From a row for each key and a column for each language: log of the key's smoothed share in each language, less the largest."""
    table = np.asarray(counts, dtype=np.float64)
    logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table) + 0.5))
    return (logs - logs.max(axis=1, keepdims=True)).astype(np.float32) if logs.size else logs.astype(np.float32)


class Table:
    """Rows of log shares by key. Keys are a sorted array of texts of one width, so a million take few bytes each."""

    def __init__(self, keys: list[str], logs: np.ndarray):
        held = np.array(keys, dtype=np.str_) if keys else np.zeros(0, "U1")
        order = np.argsort(held)
        self.keys, self.logs = held[order], np.asarray(logs, np.float32)[order]

    def find(self, keys: list[str]) -> np.ndarray:
        """The row of each key, or -1."""
        wanted = np.array(keys, dtype=np.str_)
        if not len(self.keys) or not len(wanted):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


class Model:
    """Log shares of words and of n-grams (by their size) in each language."""

    def __init__(self, languages: list[str], words: dict[str, int], logs: np.ndarray, grams: dict[int, Table]):
        self.languages, self.words, self.logs, self.grams = languages, words, logs, grams

    def evidence(self, words: list[str]) -> np.ndarray:
        """What each word adds to each language's score: a known word's log shares; else the mean of its known n-grams',
        from the longest size of which one is known; else nothing."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[at >= 0] = self.logs[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for size in range(LONGEST, 0, -1):
            if size in self.grams and len(left):
                each = [grams_of(words[i], size) for i in left.tolist()]
                count = np.fromiter(map(len, each), np.int64, len(each))
                at = self.grams[size].find([g for gs in each for g in gs])
                owner = np.repeat(np.arange(len(left)), count)[at >= 0]
                known = np.bincount(owner, minlength=len(left))
                total = np.zeros((len(left), len(self.languages)), np.float64)
                np.add.at(total, owner, self.grams[size].logs[at[at >= 0]])
                out[left[known > 0]] = total[known > 0] / known[known > 0][:, None]
                left = left[known == 0]
        return out


def fit(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows with a text and a language. Counting is distributed; the driver gets the words and n-grams of a
    sample that fit_documents bounds. Rows that repeat an id and a text are in it or not together; a null id counts as one."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n = docs.where(F.col(lang_col).isNotNull()).count()
    if n > fit_documents:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 40)) < int(fit_documents / n * (1 << 40)))

    def told(found: Counter, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*((*k, c) for k, c in found.items()))) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for word, c in Counter(words_of(text)).items():
                    found[lang, word] += c
                if len(found) > COUNTED:
                    yield told(found, ["lang", "word", "n"], [pa.string(), pa.string(), pa.int64()])
                    found.clear()
        yield told(found, ["lang", "word", "n"], [pa.string(), pa.string(), pa.int64()])

    def spread(batches):
        found: Counter = Counter()
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
        for batch in batches:
            for lang, word, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for size in range(1, LONGEST + 1):
                    for g in grams_of(word, size):
                        found[lang, size, g] += c
            if len(found) > COUNTED:
                yield told(found, ["lang", "size", "gram", "n"], kinds)
                found.clear()
        yield told(found, ["lang", "size", "gram", "n"], kinds)

    words = through_table(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())

    def table(df: DataFrame, key: str) -> tuple[list[str], np.ndarray]:
        by = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]
        got = df.groupBy(key).agg(*by, F.sum("n").alias("all")).where(F.col("all") >= LEAST).drop("all").toArrow()
        return got.column(0).to_pylist(), log_shares(np.stack([got.column(i + 1).to_numpy() for i in range(len(languages))], axis=1))

    if not languages:
        return Model([], {}, np.zeros((0, 0), np.float32), {})
    grams = through_table(words.mapInArrow(spread, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "language-grams")
    by_size = {size: Table(*table(grams.where(F.col("size") == size), "gram")) for size in range(1, LONGEST + 1)}
    names, logs = table(words, "word")
    return Model(languages, dict(zip(names, range(len(names)))), logs, by_size)


class Evidence:
    """Rows of evidence by word, computed for the new words of many texts at once; it starts anew when full."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.at) > REMEMBERED:
            self.clear()
        new = [w for w in words if w not in self.at]
        n = len(self.at)
        while n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if new:
            self.rows[n : n + len(new)] = self.model.evidence(new)
            self.at.update(zip(new, range(n, n + len(new))))


def predict_many(texts: list[str | None], evidence: Evidence) -> list[tuple[str, float]]:
    languages = evidence.model.languages
    split = [words_of(t or "") for t in texts]
    evidence.learn({w for words in split for w in words})
    out = []
    for words in split:
        if not languages or not any(c.isalpha() for w in words for c in w):
            out.append(("und", 0.0))
            continue
        at = np.fromiter(map(evidence.at.__getitem__, words), np.int64, len(words))
        score = evidence.rows[at].sum(axis=0, dtype=np.float64)
        best = int(score.argmax())  # of equal ones, the first in alphabetical order
        out.append((languages[best], float(1 / np.exp(np.clip(score - score[best], -700, 0)).sum())))
    return out


def predict_one(text: str | None, evidence: Evidence) -> tuple[str, float]:
    return predict_many([text], evidence)[0]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with lang_pred and score (the probability of that language) put in place of any columns of these names.

    A null text, one without a letter, or a model of no languages gives `und` and 0. Only the text is read, so repeated rows
    have one result; of languages with equal scores the first in alphabetical order is named.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's sample
    known: dict = {}
    where = docs.columns.index(text_col)

    def run(batches):
        evidence = known.setdefault("evidence", Evidence(sent.value))
        for batch in batches:
            texts = batch.column(where).to_pylist()
            done = [d for a, b in slices([t or "" for t in texts]) for d in predict_many(texts[a:b], evidence)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64())], [*batch.schema.names, "lang_pred", "score"])
        known.clear()
        del evidence
        release()  # the worker may stand idle through what follows

    fields = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")

"""Benchmark decontamination on a distributed positional inverted index.

The index is a Parquet table in the shared folder. A row is a shard: the postings of some whole documents. It holds the
64-bit hashes of the shard's distinct terms in order, how many postings each has, and the postings, the ascending word
positions of each term, counted through the shard's documents. A term's list never leaves its shard, so no word, however
common, gathers the rows of others; a query visits the shards, and each shard answers it from its lists alone.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import write_table
from .text import ALNUM, LOWER, encoded, hash_spans, join_texts, parts, release, words

WINDOW = 10
#: Bytes of text of a shard before it is closed; a longer document has a shard of its own.
SHARD_BYTES = 8_000_000
#: Bytes of benchmark text that one pass over the index answers; a larger benchmark takes several passes.
BLOCK_BYTES = 4_000_000
INDEX = "doc_ids array<long>, starts array<long>, terms binary, counts binary, postings binary"


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and where each text's words begin (with the total)."""
    data, bounds = join_texts(texts)
    data = LOWER[data]
    starts, ends = words(data, ALNUM)
    return hash_spans(data, starts, ends), np.searchsorted(starts, bounds)


def invert(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, positions): the distinct terms in order, and each one's positions, ascending."""
    if not len(hashes):
        return hashes, np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    order = np.argsort(hashes, kind="stable").astype(np.uint32)
    ranked = hashes[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    return ranked[first], np.diff(np.append(first, len(hashes))).astype(np.uint32), order


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the index of every word of every row; returns where it is. Null texts are documents of no words."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        release()
        press = zstandard.ZstdCompressor(level=1)
        ids, texts, size = [], [], 0

        def close():
            hashes, begin = terms_of(encoded(texts))
            terms, counts, positions = invert(hashes)
            gaps = np.diff(positions.astype(np.int64), prepend=0)
            heads = np.cumsum(counts, dtype=np.int64) - counts
            gaps[heads] = positions[heads]
            planes = gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # by byte, so that high ones vanish
            row = [[list(ids)], [begin.tolist()], [press.compress(terms.astype("<u8").tobytes())], [press.compress(counts.astype("<u4").tobytes())], [press.compress(planes)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()])], ["doc_ids", "starts", "terms", "counts", "postings"])

        for batch in (part for batch in batches for part in parts(batch)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size and size + len(t or "") > SHARD_BYTES:
                    yield close()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield close()

    return write_table(docs.mapInArrow(run, INDEX), "positions")


class Shard:
    """One row of the index."""

    def __init__(self, doc_ids: list, starts: list, terms: bytes, counts: bytes, postings: bytes):
        unpress = zstandard.ZstdDecompressor().decompress
        self.doc_ids, self.starts, self._postings = doc_ids, np.array(starts, dtype=np.int64), postings
        self.terms, self.counts = np.frombuffer(unpress(terms), "<u8"), np.frombuffer(unpress(counts), "<u4").astype(np.int64)
        self.ends = np.cumsum(self.counts)

    @functools.cached_property
    def positions(self) -> np.ndarray:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._postings), np.uint8)
        gaps = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        total = np.cumsum(gaps)
        heads = self.ends - self.counts
        return total - np.repeat(total[heads] - gaps[heads], self.counts) if len(total) else total

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in this shard, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def list_of(self, number: int) -> np.ndarray:
        return self.positions[self.ends[number] - self.counts[number] : self.ends[number]]

    def phrase(self, numbers: list[int]) -> np.ndarray:
        """Where the words of these numbers stand in a row within a document: from the rarest one's list on, each list less its offset is intersected."""
        order = sorted(range(len(numbers)), key=lambda i: self.counts[numbers[i]])
        found = self.list_of(numbers[order[0]]) - order[0]
        for i in order[1:]:
            if not len(found):
                return found
            here = self.list_of(numbers[i])
            at = np.minimum(np.searchsorted(here, found + i), len(here) - 1)
            found = found[here[at] == found + i]
        found = found[found >= 0]
        doc = np.searchsorted(self.starts, found, "right") - 1
        return found[found + len(numbers) <= self.starts[doc + 1]]

    def near(self, numbers: list[int], span: int) -> np.ndarray:
        """[start, end) of the shortest stretches of at most span words of one document that hold all these terms, in any order."""
        wanted = sorted(set(numbers), key=lambda n: self.counts[n])
        lists = [self.list_of(n) for n in wanted]
        anchors = lists[0]
        for here in lists[1:]:  # from the rarest on: keep the places with every other term within reach
            at = np.searchsorted(here, anchors - span + 1)
            anchors = anchors[(at < len(here)) & (here[np.minimum(at, len(here) - 1)] < anchors + span)]
        if not len(anchors):
            return np.zeros((0, 2), np.int64)
        close = [x[(np.searchsorted(anchors, x - span, "right") < np.searchsorted(anchors, x + span))] for x in lists]
        where = np.concatenate(close)
        order = np.argsort(where, kind="stable")
        where, which = where[order].tolist(), np.repeat(np.arange(len(close)), [len(x) for x in close])[order].tolist()
        last, out = [-1] * len(close), []
        for place, term in zip(where, which):
            last[term] = place
            begin = min(last)
            doc = np.searchsorted(self.starts, place, "right") - 1
            if begin >= self.starts[doc] and place - begin < span and (not out or out[-1][0] < begin):
                out.append((begin, place + 1))
        return np.array(out, np.int64).reshape(-1, 2)


class Queries:
    """The windows of a block of benchmark items, by the hashes of their words."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        hashes, begin = terms_of(encoded([t for _, t in items]))
        self.terms, inverse = np.unique(hashes, return_inverse=True)
        seen: dict[bytes, list[int]] = {}
        for (item, _), a, b in zip(items, begin[:-1].tolist(), begin[1:].tolist()):
            for i in range(a, max(a + 1, b - window + 1) if b > a else a):
                seen.setdefault(inverse[i : min(i + window, b)].astype("<u4").tobytes(), []).append(item)
        self.windows = [np.frombuffer(k, "<u4").astype(np.int64) for k in seen]
        self.items = [sorted(set(v), key=lambda x: (x is None, x)) for v in seen.values()]
        size = max(map(len, self.windows), default=0)
        self.table = np.full((len(self.windows), size), -1)  # padded by -1, for one look at all windows
        for row, w in zip(self.table, self.windows):
            row[: len(w)] = w


def answer(shard: Shard, queries: Queries) -> tuple[list, list]:
    """For each document of the shard: the stretches [start, end) of words hit, flat and apart; and the items found."""
    n = len(shard.doc_ids)
    number = shard.numbers(queries.terms)
    here = np.append(number >= 0, True)
    possible = np.flatnonzero(here[queries.table].all(axis=1)) if len(queries.windows) else []
    begins, ends, found = [], [], [set() for _ in range(n)]
    for q in possible:
        numbers = number[queries.windows[q]].tolist()
        places = shard.phrase(numbers)
        if len(places):
            begins.append(places)
            ends.append(places + len(numbers))
            for d in np.unique(np.searchsorted(shard.starts, places, "right") - 1).tolist():
                found[d].update(x for x in queries.items[q] if x is not None)
    spans: list[list[int]] = [[] for _ in range(n)]
    if begins:
        cover = np.zeros(int(shard.starts[-1]) + 1, np.int64)
        np.add.at(cover, np.concatenate(begins), 1)
        np.add.at(cover, np.concatenate(ends), -1)
        inside = np.concatenate([[False], np.cumsum(cover) > 0])
        # a document's end also ends a stretch
        change = inside[1:] != inside[:-1]
        inner = shard.starts[1:-1]
        touching = inner[(inner < len(inside) - 1)]
        touching = touching[inside[touching] & inside[touching + 1]]
        edges = np.sort(np.concatenate([np.flatnonzero(change), touching, touching]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            d = int(np.searchsorted(shard.starts, a, "right")) - 1
            spans[d] += [a - int(shard.starts[d]), b - int(shard.starts[d])]
    return spans, [sorted(f) for f in found]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int):
    """The benchmark's rows in lists of about `size` bytes of text."""
    held, total = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if held and total + len(row.t or "") > size:
            yield held
            held, total = [], 0
        held.append((row.i, row.t))
        total += len(row.t or "")
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, spans (word stretches hit, flat: start, end, ...), items (sorted).

    The benchmark is a stated query set: it goes over the whole index in blocks of at most block_bytes of text, so what
    each executor holds of it is bounded. A window is `window` consecutive words of an item, or all of a shorter item's.
    Nulls: a null text has no words and no windows; an item with a null id marks words but names no item; rows with a
    null id, and repeated rows, have results of their own (repeated rows are told apart by their place in the index).
    Empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    where = build_index(docs, id_col, text_col)
    index = spark.read.schema(INDEX).parquet(where)
    passes = []
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        passes.append(ask(spark, index, Queries(block, window)))
    if not passes:
        passes = [ask(spark, index, Queries([], window))]
    if len(passes) == 1:
        return passes[0].select("doc_id", "n_words", "spans", "items")
    # the first pass names every document; of the others only those with hits are kept; merged by place in the index
    every = functools.reduce(DataFrame.unionByName, [passes[0], *(p.where(F.size("spans") > 0) for p in passes[1:])])
    merged = every.groupBy("shard", "row", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "n_words", union_spans("s").alias("spans"), "items")


def union_spans(column: str):
    @F.pandas_udf("array<int>")
    def merge(values):
        def one(flat):
            pairs, out = sorted(zip(flat[::2], flat[1::2])), []
            for a, b in pairs:
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            return out

        return values.map(lambda v: one([int(x) for x in v]))

    return merge(column)


def ask(spark, index: DataFrame, queries: Queries) -> DataFrame:
    sent = spark.sparkContext.broadcast(queries)  # of one block, so of a bounded size
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["shard", "row", "place", "doc_id", "n_words", "spans", "items"]

    def run(batches):
        release()
        for batch in batches:
            for file, row, *held in zip(*(batch.column(i).to_pylist() for i in range(7))):
                shard = Shard(*held)
                spans, items = answer(shard, sent.value)
                n = len(spans)
                columns = [[file] * n, [row] * n, list(range(n)), shard.doc_ids, np.diff(shard.starts).tolist(), spans, items]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    keyed = index.select(F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"), "doc_ids", "starts", "terms", "counts", "postings")
    return keyed.mapInArrow(run, "shard string, row long, place int, doc_id long, n_words long, spans array<int>, items array<long>")


def proximity(docs: DataFrame, phrases: list[str], span: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, phrase, start, end): the shortest stretches of at most span words that hold every word of a phrase, in any order.

    phrases is a short list of the caller's; a phrase of no words is nowhere. A null or empty text has no stretches; rows
    with a null id, and each repeated row, have their own; an empty table gives an empty result. Of stretches of one end
    the shortest is given.
    """
    spark = docs.sparkSession
    index = spark.read.schema(INDEX).parquet(build_index(docs, id_col, text_col))
    hashes, begin = terms_of(encoded(phrases))

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                shard, out = Shard(*row), []
                for phrase, a, b in zip(phrases, begin[:-1], begin[1:]):
                    numbers = shard.numbers(hashes[a:b])
                    if b > a and (numbers >= 0).all():
                        for x, y in shard.near(numbers.tolist(), span).tolist():
                            d = int(np.searchsorted(shard.starts, x, "right")) - 1
                            out.append((shard.doc_ids[d], phrase, x - int(shard.starts[d]), y - int(shard.starts[d])))
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["doc_id", "phrase", "start", "end"])

    return index.mapInArrow(run, "doc_id long, phrase string, start long, end long")

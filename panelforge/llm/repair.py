"""Token-id files compressed by Re-Pair grammars, one grammar a block, with random-access decoding.

A file is a Parquet table in the shared folder. A row is a block of consecutive documents (ascending id): `part` and
`seq` order the blocks, `doc_ids` are the documents' ids, `n_ids` is the number of ids in the block, and `block` is
binary, all little-endian:

    magic "RPB1", uint32 base, n_docs, n_rules, n_symbols, width
    uint32 first[n_docs + 1]      where each document's symbols begin
    uint32 rules[n_rules][2]      symbol base + i stands for the two symbols of rules[i]
    uint32 lengths[n_rules]       how many ids symbol base + i expands to
    uint16 or uint32 (width) symbols[n_symbols]

No symbol crosses a document's end, so any document, and any range of ids in it, is decoded without the others: a sum
over expansion lengths finds the symbols that cover the range, and only those are expanded.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import write_table
from .pieces import PieceIds, slices

HEAD = struct.Struct("<4s5I")
#: Ids of a block before it is closed; a longer document has a block of its own.
BLOCK_IDS = 2_000_000
#: A pair becomes a rule if it occurs this often in a block; a round takes pairs within this factor of the block's most
#: frequent (Re-Pair takes the most frequent one alone).
LEAST, TIER = 16, 16
#: Slots in which pairs are counted before they are told apart.
SLOTS = 1 << 20


def slot_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slot, of 2^20, of a pair of symbols."""
    return (a * np.uint32(2654435761) ^ b * np.uint32(2246822519)) >> np.uint32(12)


def compress(ids: np.ndarray, first: np.ndarray, base: int, most_rules: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first, rules, lengths) of a grammar for ids; first: where each document begins, with the total.

    Each round counts the adjacent pairs within documents, makes rules of the most frequent ones and replaces their
    occurrences (of overlapping ones, every second from the left), until no pair is frequent.
    """
    most_rules = (1 << 32) - base if most_rules is None else most_rules
    symbols, first = ids.astype(np.uint32), first.astype(np.int64)
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    while len(symbols) >= 2 and len(rules) < most_rules:  # a round leaves fewer symbols
        # slots of a small hash table bound each pair's count from above; only pairs of frequent slots are counted
        slot = slot_of(symbols[:-1], symbols[1:])
        ends = first[1:-1]
        slot[ends[(ends > 0) & (ends < len(symbols))] - 1] = SLOTS  # pairs across the end of a document
        counts = np.bincount(slot, minlength=SLOTS + 1)
        counts[SLOTS] = 0
        for bound in dict.fromkeys((max(LEAST, int(counts.max()) // TIER), LEAST)):
            likely = np.flatnonzero((counts >= bound)[slot])
            pairs = symbols[likely].astype(np.uint64) << np.uint64(32) | symbols[likely + 1]
            unique, times = np.unique(pairs, return_counts=True)
            if len(times) and times.max() >= bound:
                break
        if not len(times) or times.max() < LEAST:
            break
        often = times >= max(LEAST, int(times.max()) // TIER)
        order = np.lexsort((unique[often], -times[often]))[: most_rules - len(rules)]
        chosen = np.sort(unique[often][order])
        # pairs whose slot holds a chosen one are few enough to look up
        marked = np.zeros(SLOTS + 1, dtype=bool)
        marked[slot_of((chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32))] = True
        some = np.flatnonzero(marked[slot[likely]])
        rank = np.minimum(np.searchsorted(chosen, pairs[some]), len(chosen) - 1)
        hit = chosen[rank] == pairs[some]
        at, rank = likely[some[hit]], rank[hit]
        # keep every second of occurrences that follow each other directly
        fresh = np.append(True, np.diff(at) > 1)
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - start) % 2 == 0
        at, rank = at[keep], rank[keep]
        new = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        size = np.concatenate([np.ones(base, np.uint32), lengths])
        symbols[at] = (base + len(rules) + rank).astype(np.uint32)
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, size[new[:, 0]] + size[new[:, 1]]])
        first = first - np.searchsorted(at + 1, first)
        symbols = symbols[stay]
    return symbols, first, rules, lengths


def pack(ids: np.ndarray, first: np.ndarray, base: int) -> bytes:
    symbols, first, rules, lengths = compress(ids, first, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = HEAD.pack(b"RPB1", base, len(first) - 1, len(rules), len(symbols), width)
    return b"".join([head, first.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes()])


class Block:
    """Reads a packed block."""

    def __init__(self, data: bytes):
        magic, self.base, docs, rules, symbols, width = HEAD.unpack_from(data)
        if magic != b"RPB1":
            raise ValueError("not a block of this format")
        at = HEAD.size
        self.first = np.frombuffer(data, "<u4", docs + 1, at).astype(np.int64)
        self.rules = np.frombuffer(data, "<u4", 2 * rules, at := at + 4 * (docs + 1)).reshape(-1, 2)
        self.lengths = np.frombuffer(data, "<u4", rules, at := at + 8 * rules)
        self.symbols = np.frombuffer(data, f"<u{width}", symbols, at + 4 * rules)

    @functools.cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every rule, one after the other, and where each rule's begin."""
        begin = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        flat = np.zeros(begin[-1], np.uint32)
        for i, pair in enumerate(self.rules.tolist()):  # a rule's parts come before it
            at = begin[i]
            for symbol in pair:
                if symbol < self.base:
                    flat[at] = symbol
                    at += 1
                else:
                    part = flat[begin[symbol - self.base] : begin[symbol - self.base + 1]]
                    flat[at : at + len(part)] = part
                    at += len(part)
        return flat, begin

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self.expansions
        size = self.sizes(symbols)
        total = np.concatenate([[0], np.cumsum(size)])
        rule = symbols >= self.base
        out = np.zeros(total[-1], np.uint32)
        out[total[:-1][~rule]] = symbols[~rule]
        size, starts = size[rule], total[:-1][rule]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(starts, size) + within] = flat[np.repeat(begin[symbols[rule].astype(np.int64) - self.base], size) + within]
        return out

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document i."""
        symbols = self.symbols[self.first[i] : self.first[i + 1]]
        ends = np.cumsum(self.sizes(symbols))
        total = int(ends[-1]) if len(ends) else 0
        start, stop, _ = slice(start, stop).indices(total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right") + 1
        skip = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skip : stop - skip]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document's begin (with the total)."""
        ends = np.concatenate([[0], np.cumsum(self.sizes(self.symbols))])
        return self.expand(self.symbols), ends[self.first]


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextIds:
    """The ids of texts: by pieces, and those of texts that hold an added token, which pieces would split, by the library."""

    def __init__(self, pieces: PieceIds, whole: Callable[[str], list[int]], added: list[str]):
        self.pieces, self.whole, self.added = pieces, whole, added

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        apart = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not apart:
            return self.pieces.ids(texts)
        found = {i: np.array(self.whole(texts[i]), np.uint32) for i in apart}
        flat, counts = self.pieces.ids(["" if i in found else t for i, t in enumerate(texts)])
        lists = np.split(flat, np.cumsum(counts)[:-1])
        lists = [found.get(i, x) for i, x in enumerate(lists)]
        return np.concatenate(lists), np.array([len(x) for x in lists])


@functools.lru_cache(maxsize=2)
def library(path: str) -> tuple[TextIds, int]:
    """The tokenizers library behind a cache of pieces; and the size of the vocabulary.

    Pieces go to the library's model, which skips its splitting; so the file must be byte-level with the usual pattern.
    Texts that hold an added token go to the library whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    config = json.loads(tokenizer.to_str())
    split = config["pre_tokenizer"] or {}
    if config["normalizer"] is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    tokenize, alphabet = tokenizer.model.tokenize, byte_alphabet()
    encode = lambda pieces: [[t.id for t in tokenize(p.encode().decode("latin-1").translate(alphabet))] for p in pieces]
    tokenizer.no_truncation()
    tokenizer.no_padding()
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    added = [t["content"] for t in config["added_tokens"]]
    return TextIds(PieceIds(encode, most=800_000), whole, added), tokenizer.get_vocab_size()


def write_ids(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> str:
    """Encode every whole text, append end_id, and write blocks in ascending id order; returns where they are.

    path: a tokenizers file with byte-level BPE. A null text is empty (only end_id); rows with a null id come first;
    repeated rows and equal ids keep a document each. An empty table gives a table of no blocks.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sorted_docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        pieces, base = library(path)
        base, part, seq = max(base, end_id + 1), TaskContext.get().partitionId(), 0
        names, parts, firsts, total = [], [], [0], 0

        def close():
            block = pack(np.concatenate(parts), np.array(firsts), base)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([list(names)], pa.list_(pa.int64())), pa.array([total], pa.int64()), pa.array([block], pa.binary())], ["part", "seq", "doc_ids", "n_ids", "block"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                flat, counts = pieces.ids(texts[a:b])
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                ends = (ends + np.arange(1, b - a + 1)).tolist()
                for name, x, y in zip(ids[a:b], [0, *ends[:-1]], ends):
                    if total and total + y - x > block_ids:
                        yield close()
                        seq, names, parts, firsts, total = seq + 1, [], [], [0], 0
                    names.append(name)
                    parts.append(flat[x:y])
                    total += y - x
                    firsts.append(total)
        if names:
            yield close()

    return write_table(sorted_docs.mapInArrow(run, "part int, seq int, doc_ids array<long>, n_ids long, block binary"), "token-ids")


def read_blocks(spark, where: str) -> DataFrame:
    return spark.read.schema("part int, seq int, doc_ids array<long>, n_ids long, block binary").parquet(where)


def documents_in(batches) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part, seq, ids, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
            flat, first = Block(block).all()
            yield part, seq, ids, flat, first


def decode_file(spark, where: str) -> DataFrame:
    """(doc_id, ids) for every document of a file; ids are little-endian unsigned 32-bit integers."""

    def run(batches):
        for _, _, ids, flat, first in documents_in(batches):
            raw = flat.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())], ["doc_id", "ids"])

    return read_blocks(spark, where).select("part", "seq", "doc_ids", "block").mapInArrow(run, "doc_id long, ids binary")


def describe_file(spark, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document of a file, from its decoded ids."""
    blocks = read_blocks(spark, where)

    def run(batches):
        for part, seq, ids, flat, first in documents_in(batches):
            raw, first = flat.astype("<u4").tobytes(), first.tolist()
            n = len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(first[:-1], pa.int64()),
                pa.array([b - a for a, b in zip(first, first[1:])], pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first, first[1:])], pa.int64()),
            ], ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    found = blocks.select("part", "seq", "doc_ids", "block").mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # Where blocks begin: a sum over the parts (one row a part), then one within each part.
    sizes = blocks.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.withColumn("ahead", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    begins = inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("ahead")).alias("begin"))
    return found.join(begins, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")

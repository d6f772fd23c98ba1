"""Exact removal of repeated byte strings by suffix arrays with two-stage sorting.

The text is cut into slices (rows of a table in the shared folder). Every string of `length` bytes is owned by its anchor,
the least hashed 16-byte word in it, so equal strings, wherever they are, have equal anchors, and the starts that one
anchor owns are a stretch. Three passes:

1. Each slice sends 32-bit hashes of its anchors, once each, to buckets; a bucket tells which occur in more than one
   document. This only narrows down; nothing is decided by hashes.
2. For those anchors, each slice sends the bytes of their stretches, equal ones once with all their places. A bucket builds
   a suffix array over its distinct stretches: suffixes smaller than their successors are sorted directly, the others are
   induced by bucket scans, and adjacent common prefixes of `length` bytes or more join suffixes into groups. A group's
   smallest document is what its members are judged by.
3. Each slice gets the stretches to remove.

An anchor that occurs very often sends each string of its stretches to a bucket of its own hash, so no key gathers more.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import through_table
from .text import encoded, splitmix, spread

LENGTH, WORD = 50, 16
#: Bytes of text of a slice, and of anchors and stretches that go to one bucket.
SLICE_BYTES, ANCHOR_BUCKET, STRETCH_BUCKET = 2_000_000, 24_000_000, 2_000_000
#: An anchor that occurs more often is split by the hash of each string.
HOT = 20_000
#: Between strings: a byte that UTF-8 never has.
SEPARATOR = 0xFF
#: A row without an id stands after all others.
LAST = np.iinfo(np.int64).max


def pack(*arrays, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def loads(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The 8 bytes at each place of data (or at the places `at`), as big-endian numbers; data has 8 bytes to spare."""
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    return (view if at is None else view[at]).astype(np.uint64)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of each anchor's stretch; bounds: where documents begin in data, with the end."""
    n = int(bounds[-1])
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none
    low = loads(np.concatenate([data[:n], np.full(24, SEPARATOR, np.uint8)]))
    mixed = low[: n - WORD + 1] * np.uint64(0x9E3779B97F4A7C15) + low[8 : n - WORD + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    del low
    least = (mixed << np.uint64(32)) | np.arange(len(mixed), dtype=np.uint64)
    window, wide = length - WORD + 1, 1
    while 2 * wide <= window:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < window:
        least = np.minimum(least[: len(least) - (window - wide)], least[window - wide :])
    where = (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    del least
    whole = np.zeros(len(where) + 1, np.int8)  # starts of strings that end in their document
    size = np.diff(bounds)
    np.add.at(whole, bounds[:-1][size >= length], 1)
    np.add.at(whole, bounds[1:][size >= length] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8) > 0)
    if not len(starts):
        return none.astype(np.uint64), none, none
    own = where[starts]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)))
    last = np.append(first[1:], len(starts)) - 1
    return splitmix(mixed[own[first]]), starts[first], starts[last]


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes of text (uint8, ended by SEPARATOR), ordered by their first `depth` bytes at least.

    Two stages. A suffix smaller than its successor is sorted by its bytes, eight at a time, where ties last. The others
    start with a byte that isn't smaller than the next one, so they stand before the directly sorted ones of their first
    byte's bucket; a scan of the buckets in order puts each such predecessor of a scanned suffix at the end of what its
    bucket has so far. A bucket's scan goes on over the ones it puts into itself.
    """
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change] < text[change + 1], True)  # by run of one byte; the last run counts as directly sorted
    direct = np.repeat(rises, np.diff(np.concatenate([[0], change + 1, [n]])))
    padded = np.concatenate([text, np.full(depth + 16, SEPARATOR, np.uint8)])
    places = np.flatnonzero(direct)
    key = loads(padded, places)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    for done in range(8, depth, 8):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(fresh)[at]
        key = loads(padded, places[at] + done)
        order = np.lexsort((key, group))
        places[at] = places[at][order]
        group, key = group[order], key[order]
        fresh[at[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
    cuts = np.searchsorted(text[places], np.arange(257))
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    out = []

    def scan(suffixes: np.ndarray, byte: int) -> np.ndarray:
        """Put the predecessors of suffixes into later buckets; returns those of the same bucket."""
        before = suffixes[suffixes > 0] - 1
        before = before[~direct[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else []
        own = before[:0]
        for a, b in zip(edges, [*edges[1:], len(first)]):
            if first[a] == byte:
                own = before[a:b]
            else:
                waiting[int(first[a])].append(before[a:b])
        return own

    for byte in range(256):
        todo = np.concatenate(waiting.pop(byte)) if byte in waiting else places[:0]
        while len(todo):
            out.append(todo)
            todo = scan(todo, byte)
        todo = places[cuts[byte] : cuts[byte + 1]]
        if len(todo):
            out.append(todo)
            scan(todo, byte)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """The common prefix of each suffix and the one before it, up to `most` bytes (0 for the first)."""
    padded = np.concatenate([text, np.full(most + 16, SEPARATOR, np.uint8)])
    out = np.zeros(len(suffixes), np.int64)
    at = np.arange(1, len(suffixes))
    for done in range(0, most, 8):
        differ = loads(padded, suffixes[at] + done) ^ loads(padded, suffixes[at - 1] + done)
        out[at[differ == 0]] = done + 8
        apart = differ != 0
        if apart.any():
            top = np.frexp(differ[apart].astype(np.float64))[1]  # bits in use; rounding up only at a full byte's edge is undone below
            top -= differ[apart] < (np.uint64(1) << np.minimum(top - 1, 63).astype(np.uint64))
            out[at[apart]] = done + (64 - top) // 8
        at = at[~apart]
    return np.minimum(out, most)


def least_documents(strings: list[bytes], documents: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string, the smallest document of any string that holds the `length` bytes at each of its starts."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(bytes([SEPARATOR]).join(strings) + bytes([SEPARATOR]), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - length + 1
    mark = np.zeros(len(text) + 1, np.int32)
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + counts, -1)
    order = suffix_array(text, length)
    order = order[np.cumsum(mark)[order] > 0]
    owner = np.searchsorted(begin, order, "right") - 1
    heads = np.flatnonzero(common_prefixes(text, order, length) < length)
    least = np.minimum.reduceat(documents[owner], heads)
    found = np.empty(len(text), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return [found[b : b + c] for b, c in zip(begin.tolist(), counts.tolist())]


SLICES = "slice long, doc_ids array<long>, starts array<long>, data binary"


def cut_slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        press = zstandard.ZstdCompressor(level=6)  # a slice is written once and exchanged up to twice
        name = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def close():
            starts = np.cumsum([0, *map(len, texts)]).tolist()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([press.compress(b"".join(texts))], pa.binary())], ["slice", "doc_ids", "starts", "data"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist())):
                if size and size + len(t) > SLICE_BYTES:
                    yield close()
                    name, ids, texts, size = name + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield close()

    return docs.mapInArrow(run, SLICES)


def open_slice(ids: list, starts: list, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = np.array([LAST if i is None else i for i in ids], np.int64)
    return names, np.array(starts, np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(edges, [*edges[1:], len(order)])]


def send_anchors(buckets: int, length: int):
    def run(batches):
        for batch in batches:
            for name, *held in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, bounds, data = open_slice(*held)
                marks, first, _ = anchors(data, bounds, length)
                doc = ids[np.searchsorted(bounds, first, "right") - 1]
                order = np.lexsort((doc, marks))
                marks, doc = marks[order], doc[order]
                head = np.flatnonzero(np.append(True, marks[1:] != marks[:-1])) if len(marks) else np.zeros(0, np.int64)
                last = np.append(head[1:], len(marks)) - 1
                marks, times = marks[head], np.minimum(last - head + 1, 65535).astype(np.uint16)
                several = doc[head] != doc[last] if len(head) else np.zeros(0, bool)
                rows = [(b, name, pack((marks[at] >> np.uint64(32)).astype(np.uint32), times[at], several[at])) for b, at in by_bucket((marks & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets)]
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary()])], ["bucket", "slice", "packed"])

    return run


def find_shared(table: pa.Table) -> pa.Table:
    """Of one bucket: for each slice, the 32-bit marks that more than one document has (or rows of one id in several slices,
    which judge_stretches tells apart), and which of them are hot."""
    bucket = table.column("bucket")[0].as_py()
    names = table.column("slice").to_pylist()
    parts = [unpack(x) for x in table.column("packed").to_pylist()]
    marks = np.concatenate([p[0] for p in parts])
    order = np.argsort(marks, kind="stable")
    ranked = marks[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    times = np.add.reduceat(np.concatenate([p[1] for p in parts]).astype(np.int64)[order], heads) if len(heads) else heads
    size = np.diff(np.append(heads, len(ranked)))
    several = np.logical_or.reduceat(np.concatenate([p[2] for p in parts])[order], heads) | (size > 1) if len(heads) else heads.astype(bool)  # a slice has a mark once
    shared = np.zeros(len(marks), bool)
    shared[order] = np.repeat(several, size)
    hot = np.zeros(len(marks), bool)
    hot[order] = np.repeat(several & (times > HOT), size)
    rows, at = [], 0
    for name, p in zip(names, parts):
        here = slice(at, at + len(p[0]))
        at += len(p[0])
        if shared[here].any():
            rows.append((name, int(p[1][shared[here]].sum()), pack(bucket, p[0][shared[here]], hot[here][shared[here]])))
    columns = list(zip(*rows)) or [()] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary()])], ["slice", "n", "packed"])


def send_stretches(buckets: int, anchor_buckets: int, length: int):
    def run(batches):
        for batch in batches:
            for name, ids, starts, data, flags in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids, bounds, data = open_slice(ids, starts, data)
                marks, first, last = anchors(data, bounds, length)
                parts = [unpack(f) for f in flags]
                wanted = np.concatenate([p[1].astype(np.uint64) * np.uint64(anchor_buckets) + np.uint64(p[0]) for p in parts])
                hot = np.concatenate([p[2] for p in parts])
                order = np.argsort(wanted)
                wanted, hot = wanted[order], hot[order]
                key = (marks >> np.uint64(32)) * np.uint64(anchor_buckets) + (marks & np.uint64(0xFFFFFFFF)) % np.uint64(anchor_buckets)
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                chosen = wanted[at] == key
                split = chosen & hot[at]
                # a hot anchor's stretch goes as single strings
                single = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[split].tolist(), last[split].tolist())] or [np.zeros(0, np.int64)])
                plain = chosen & ~split
                begin = np.concatenate([first[plain], single])
                end = np.concatenate([last[plain], single]) + length
                raw, seen = data.tobytes(), {}
                owner = ids[np.searchsorted(bounds, begin, "right") - 1]
                number = [seen.setdefault(raw[a:b], len(seen)) for a, b in zip(begin.tolist(), end.tolist())]
                strings = list(seen)
                target = np.empty(len(strings), np.int64)
                number = np.array(number, np.int64)
                target[number[: int(plain.sum())]] = (marks[plain] % np.uint64(buckets)).astype(np.int64)
                for x in set(number[int(plain.sum()) :].tolist()):
                    target[x] = int.from_bytes(hashlib.blake2b(strings[x], digest_size=8).digest(), "little") % buckets
                member = np.argsort(number, kind="stable")
                edge = np.searchsorted(number[member], np.arange(len(strings) + 1))
                rows = []
                for b, which in by_bucket(target):
                    own = [member[edge[i] : edge[i + 1]] for i in which.tolist()]
                    rows.append((b, name, pack([strings[i] for i in which.tolist()], [len(o) for o in own], begin[np.concatenate(own)], owner[np.concatenate(own)], level=3)))
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary()])], ["bucket", "slice", "packed"])

    return run


def judge_stretches(length: int):
    def run(table: pa.Table) -> pa.Table:
        names = table.column("slice").to_pylist()
        parts = [unpack(x) for x in table.column("packed").to_pylist()]
        seen: dict[bytes, int] = {}
        least: list[int] = []
        numbers = []
        for strings, counts, _, owner in parts:
            low = np.minimum.reduceat(owner, np.cumsum(counts) - counts).tolist()
            here = []
            for s, d in zip(strings, low):
                i = seen.setdefault(s, len(seen))
                if i == len(least):
                    least.append(d)
                elif d < least[i]:
                    least[i] = d
                here.append(i)
            numbers.append(here)
        found = least_documents(list(seen), np.array(least, np.int64), length)
        # of each distinct string: starts from a to b have the smallest document d
        size = np.array([len(f) for f in found], np.int64)
        flat, begins = np.concatenate(found), np.cumsum(size) - size
        fresh = np.append(True, flat[1:] != flat[:-1])
        fresh[begins] = True
        edges = np.flatnonzero(fresh)
        string = np.searchsorted(begins, edges, "right") - 1
        a, b, d = edges - begins[string], np.append(edges[1:], len(flat)) - 1 - begins[string], flat[edges]
        times = np.bincount(string, minlength=len(found))
        heads = np.cumsum(times) - times
        rows = []
        for name, here, (_, counts, begin, owner) in zip(names, numbers, parts):
            at = np.repeat(np.array(here, np.int64), counts)
            run, place = spread(heads[at], times[at]), np.repeat(np.arange(len(at)), times[at])
            run, place = run[d[run] < owner[place]], place[d[run] < owner[place]]
            if len(run):
                rows.append((name, pack(np.stack([begin[place] + a[run], begin[place] + b[run] + length], axis=1))))
        columns = list(zip(*rows)) or [()] * 2
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary()])], ["slice", "packed"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text (UTF-8), spans: the byte stretches to remove, flat (start, end, ...), apart.

    A byte goes if a string of `length` bytes covers it that also starts in a row with a smaller id. Strings never cross
    documents, and are judged on the input. A null text is empty; a row with a null id stands after all others, and rows
    with equal (or no) ids don't remove each other's; an empty table gives no rows.
    """
    if length < WORD:
        raise ValueError(f"length must be at least {WORD}")
    slices = through_table(cut_slices(docs, id_col, text_col), "slices")
    total = slices.select(F.coalesce(F.sum(F.element_at("starts", -1)), F.lit(0))).first()[0]
    first = max(1, -(-total // ANCHOR_BUCKET))
    sent = slices.mapInArrow(send_anchors(first, length), "bucket long, slice long, packed binary")
    shared = through_table(sent.groupBy("bucket").applyInArrow(find_shared, "slice long, n long, packed binary"), "shared-anchors")
    amount = shared.select(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    second = max(1, -(-amount * (length + 15) // STRETCH_BUCKET))
    flags = shared.groupBy("slice").agg(F.collect_list("packed").alias("flags"))  # of one slice, so bounded by it
    sent = slices.join(flags, "slice").select(*slices.columns, "flags").mapInArrow(send_stretches(second, first, length), "bucket long, slice long, packed binary")
    marks = through_table(sent.groupBy("bucket").applyInArrow(judge_stretches(length), "slice long, packed binary"), "repeats")
    marks = marks.groupBy("slice").agg(F.collect_list("packed").alias("marks"))

    def apply(batches):
        for batch in batches:
            for ids, starts, data, found in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                data = zstandard.ZstdDecompressor().decompress(data)
                gone = np.zeros(len(data) + 1, np.int32)
                for f in found or []:
                    pairs = unpack(f)[0]
                    np.add.at(gone, pairs[:, 0], 1)
                    np.add.at(gone, pairs[:, 1], -1)
                gone = np.cumsum(gone[:-1]) > 0
                texts, spans = [], []
                for a, b in zip(starts, starts[1:]):
                    texts.append(data[a:b])
                    spans.append(np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "text", "spans"])

    return slices.join(marks, "slice", "left").select("slice", "doc_ids", "starts", "data", "marks").mapInArrow(apply, "doc_id long, text binary, spans array<long>")


def removed(spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what repeated_spans leaves of each text."""

    def run(batches):
        for batch in batches:
            kept, gone = [], []
            for text, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                edges = [0, *flat, len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                gone.append(len(flat) // 2)
            texts = batch.column(1).to_pylist()
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return spans.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

"""Vectorised text primitives on numpy arrays: byte classes, word spans, word hashes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def release() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system, at the start of a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts(batch: pa.RecordBatch, rows: int = 256):
    """The batch in pieces, so that few of its texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, element by element."""
    x = (np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


_BYTE = splitmix(np.arange(256))
_place = splitmix(np.arange(1 << 10) + (1 << 40)) | np.uint64(1)


def places(n: int) -> np.ndarray:
    """n odd multipliers, one for each place in a word."""
    global _place
    if n > len(_place):
        _place = splitmix(np.arange(max(n, 2 * len(_place))) + (1 << 40)) | np.uint64(1)
    return _place


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lower-cased: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of the words [^\x20\x09-\x0D]+.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def join_texts(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, each followed by a gap byte, and where each starts (with the total at the end)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(gap.join(texts) + gap if texts else b"", dtype=np.uint8), starts


def words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes for which table is true."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = table[data]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order, apart or adjacent, and not empty. About `most` bytes are
    worked on at a time, as each takes some forty bytes of memory."""
    sizes = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    turns = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(starts)]):
        some = sizes[a:b]
        if not len(some):
            continue
        first = np.cumsum(some) - some
        place = np.arange(int(some.sum()), dtype=np.int64)
        place -= np.repeat(first, some)
        mixed = _BYTE[data[place + np.repeat(starts[a:b], some)]]
        mixed *= places(int(some.max()))[place]
        out[a:b] = splitmix(np.add.reduceat(mixed, first) ^ some.astype(np.uint64))
    return out


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]

"""Splitting text into the pieces of public_tokenizers.PATTERN on whole numpy batches, and a cache of what pieces become.

A match of the pattern depends on the text from its place onwards only, and its alternatives follow the classes of
characters (letters, numbers, white space, others), so piece starts can be set from runs of one class:
a run starts a piece; the last character of a run of white space before text is split off, and joins the next piece if
it is a space; a lone apostrophe takes the letters of a contraction from the run after it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex

from .text import places, splitmix

OTHER, LETTER, NUMBER, WHITE, END = range(5)
#: Between documents of a batch: a lone surrogate, which no text that came through Arrow holds.
GAP = "\ud800"
#: The contraction endings of the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points with Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def joined_by_library(first: str, points: list[int]) -> np.ndarray:
    """Whether tiktoken's reading of \\p{L} (first is a letter) or \\p{N} (a digit) has each code point: then the two make
    one piece, in which the first character and the first byte of the other are merged."""
    encoding = probe(first)
    return np.array([encoding.encode_ordinary(first + chr(p))[0] > 255 for p in points], dtype=bool)


@functools.lru_cache(maxsize=2)
def probe(first: str):
    import tiktoken

    merges = {bytes([b]): b for b in range(256)} | {first.encode() + bytes([b]): 128 + b for b in range(128, 256)}
    return tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=merges, special_tokens={})


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizer libraries have it.

    Their Unicode is newer than Python's, and older than the regex package's: code points that Python lacks and regex has
    as letters or numbers are put to the library.
    """
    table, block = np.zeros(sys.maxunicode + 1, dtype=np.uint8), 1 << 14
    for at in range(0, len(table), block):
        kinds = [unicodedata.category(chr(c)) for c in range(at, at + block)]
        every = "".join(chr(at + i) for i, k in enumerate(kinds) if k == "Cn")
        for what, first, kind in (("L", "a", LETTER), ("N", "1", NUMBER)):
            table[[at + i for i, k in enumerate(kinds) if k[0] == what]] = kind
            points = [ord(c) for c in regex.findall(rf"\p{{{what}}}", every)]
            if points:
                table[np.array(points)[joined_by_library(first, points)]] = kind
    table[WHITE_SPACE] = WHITE
    table[ord(GAP)] = END
    return table


@functools.cache
def point_hashes() -> np.ndarray:
    return splitmix(np.arange(sys.maxunicode + 1) + (1 << 50))


#: An odd number and its inverse modulo 2^64: hashes of short pieces are polynomials in it.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Longer pieces are hashed by an own multiplier for each place.
SHORT = 64
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE, and of INVERSE."""
    global _powers
    if n > len(_powers[0]):
        size = max(n, 1 << 18)
        made = []
        for b in (BASE, INVERSE):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers = made[0], made[1]
    return _powers


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined text, its code points, the start and end of each piece in it, and how many pieces each text has."""
    joined = GAP.join(texts) + GAP
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = classes()[points]
    n = len(points)
    begins = np.zeros(n + 1, dtype=bool)
    begins[0] = begins[n] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:n])
    begins[np.flatnonzero(kind == END)] = True  # also of an empty text, where two gaps touch
    run = np.flatnonzero(begins)
    first, after = run[:-1], run[1:]
    what = kind[first]
    follows = np.append(what[1:], END)
    # white space before text
    last = after[(what == WHITE) & (follows != END)] - 1
    begins[last] = True
    spaced = last[points[last] == 32] + 1
    begins[spaced] = False
    # contractions
    quote = first[(what == OTHER) & (after - first == 1) & (follows == LETTER)]
    quote = quote[(points[quote] == 39) & begins[quote]]
    if len(quote):
        one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        size = np.zeros(len(quote), dtype=np.int64)
        for ending in CONTRACTIONS:
            hit = one == ord(ending[0])
            size[hit & (two == ord(ending[1])) if len(ending) == 2 else hit] = len(ending)
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        begins[quote + 1 + size] = True
    starts = np.flatnonzero(begins)
    starts, ends = starts[:-1], starts[1:]
    real = kind[starts] != END
    starts, ends = starts[real], ends[real]
    gaps = np.flatnonzero(kind == END)
    counts = np.diff(np.searchsorted(starts, gaps), prepend=0)
    return joined, points, starts, ends, counts


def hash_pieces(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, never 0. Of short pieces: a difference of prefix sums of (point's hash) * BASE^place,
    times INVERSE^start, so that it doesn't depend on where the piece stands."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    up, down = powers(len(points) + 1)
    sums = np.empty(len(points) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(point_hashes()[points] * up[: len(points)], out=sums[1:])
    mixed = (sums[ends] - sums[starts]) * down[starts]
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        some = sizes[long]
        first = np.cumsum(some) - some
        place = np.arange(int(some.sum()), dtype=np.int64) - np.repeat(first, some)
        each = point_hashes()[points[place + np.repeat(starts[long], some)]] * places(int(some.max()))[place]
        mixed[long] = np.add.reduceat(each, first)
    return splitmix(mixed ^ sizes.astype(np.uint64)) | np.uint64(1)


class PieceIds:
    """The ids of pieces, remembered by a 64-bit hash of the piece; it starts anew when it holds `most` pieces.

    encode takes a list of pieces and returns a list of lists of ids.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 300_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.begin, self.size, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0
        # a first look: a slot holds the hash and the number of one of its pieces
        self.slots = 1 << max(4, (2 * self.most).bit_length())
        self.at, self.number = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)

    def _add(self, hashes: list[int], found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n, need = len(self.known), self.used + int(sizes.sum())
        while n + len(found) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[n : n + len(found)] = sizes
        self.begin[n : n + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : need] = np.fromiter((i for x in found for i in x), np.uint32, need - self.used)
        self.used = need
        self.known.update(zip(hashes, range(n, n + len(found))))

    def numbers(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number in this cache of each piece."""
        hashes = hash_pieces(points, starts, ends)
        slot = (hashes >> np.uint64(1)).astype(np.int64) & (self.slots - 1)
        out = self.number[slot]
        rest = np.flatnonzero(self.at[slot] != hashes)
        if not len(rest):
            return out
        codes, unique = pd.factorize(hashes[rest])
        if len(self.known) + len(unique) > self.most:
            self.clear()
            rest = np.arange(len(hashes))
            codes, unique = pd.factorize(hashes)
        keys = unique.tolist()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        where = np.empty(len(unique), np.int64)
        where[codes[::-1]] = rest[::-1]
        if missing:
            at = where[missing]
            self._add([keys[i] for i in missing], self.encode([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
        found = np.fromiter(map(self.known.__getitem__, keys), np.int32, len(keys))
        free = self.at[slot[where]] == 0
        self.at[slot[where[free]]], self.number[slot[where[free]]] = unique[free], found[free]
        # of two new pieces of one slot the later one stands in both arrays
        out[rest] = found[codes]
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        joined, points, starts, ends, counts = split(texts)
        number = self.numbers(joined, points, starts, ends)
        size = self.size[number]
        total = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(total[-1]) + np.repeat(self.begin[number] - total[:-1], size)
        return self.flat[where], np.diff(total[np.cumsum(counts)], prepend=0)


def slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)

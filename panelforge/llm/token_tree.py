"""Token counts that follow edits: a segment tree over the pieces of each document."""

from __future__ import annotations

import functools
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .pieces import LETTER, NUMBER, PieceIds, classes, slices, split

#: Fixed value: how far beyond a match's end the pattern looks (an apostrophe is tried with two letters after it).
LOOKAHEAD = 2


@functools.cache
def known(name: str, kind: int) -> str:
    """A set of the regex package, less the code points that are too new for the tokenizer libraries."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    new = [ord(c) for c in regex.findall(name, every) if classes()[ord(c)] != kind]
    ends = np.flatnonzero(np.diff([-2, *new, sys.maxunicode + 9]) != 1)
    spans = [f"\\U{new[a]:08x}-\\U{new[b - 1]:08x}" for a, b in zip(ends[:-1], ends[1:])]
    return f"[{name}--[{''.join(spans)}]]" if spans else name


class Counter:
    """Counts the tokens of pieces; pattern: as in public_tokenizers.PATTERN, with Unicode's white space."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            pattern = pattern.replace(name, known(name, kind))
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.V1)
        self.cache = PieceIds(lambda pieces: [[len(self.encoding.encode_ordinary(p))] for p in pieces])

    def count(self, piece: str) -> int:
        return len(self.encoding.encode_ordinary(piece))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and tokens of every piece, and how many pieces each text has."""
        joined, points, starts, ends, counts = split(texts)
        number = self.cache.numbers(joined, points, starts, ends)
        return ends - starts, self.cache.flat[self.cache.begin[number]].astype(np.int64), counts


class TokenTree:
    """Sums of characters and tokens over the pieces of one text, which edits keep exact.

    A leaf is a piece at first. An edit puts all new pieces into its first leaf and empties the others it covers, so
    only the sums on the way up from those leaves change.
    """

    def __init__(self, counter: Counter, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.counter, self.text, self.encoded = counter, text, 0
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.width), np.int64)
        self.sums[0, self.width : self.width + len(chars)] = chars
        self.sums[1, self.width : self.width + len(tokens)] = tokens
        self.inner: dict[int, list[tuple[int, int]]] = {}  # of the leaves that an edit filled: (characters, tokens) of each piece
        at = self.width
        while at > 1:
            self.sums[:, at // 2 : at] = self.sums[:, at : 2 * at : 2] + self.sums[:, at + 1 : 2 * at : 2]
            at //= 2

    @classmethod
    def of(cls, counter: Counter, text: str) -> TokenTree:
        chars, tokens, _ = counter.batch([text])
        return cls(counter, text, chars, tokens)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def tokens_between(self, first: int, after: int) -> int:
        """Tokens of leaves first to after."""
        total, a, b = 0, first + self.width, after + self.width
        while a < b:
            if a & 1:
                total, a = total + self.sums[1, a], a + 1
            if b & 1:
                b -= 1
                total += self.sums[1, b]
            a, b = a // 2, b // 2
        return int(total)

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that has character `place`, and the leaf's first character; beyond the text, its last filled leaf."""
        place = min(max(place, 0), max(len(self.text) - 1, 0))
        at, begin = 1, 0
        while at < self.width:
            at *= 2
            if place - begin >= (left := int(self.sums[0, at])):
                begin, at = begin + left, at + 1
        return at - self.width, begin

    def pieces(self, leaf: int) -> list[tuple[int, int]]:
        if leaf in self.inner:
            return self.inner[leaf]
        c, t = self.sums[:, leaf + self.width].tolist()
        return [(c, t)] if c else []

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]. Pieces that end LOOKAHEAD characters before it stay, as do those after it from the first common piece start on."""
        old, self.text = self.text, self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        leaf, at = self.find(start)
        while leaf and at > start - LOOKAHEAD - 1:  # whole leaves that the pattern could have looked at the edit from
            leaf -= 1
            at -= int(self.sums[0, leaf + self.width])
        kept, first = [], at
        for c, t in self.pieces(leaf):
            if at + c + LOOKAHEAD > start:
                break
            kept.append((c, t))
            at += c
        # old piece starts from the edit's end on, leaf by leaf as they are needed
        last, edge = leaf, first
        ahead = list(self.pieces(leaf))
        made, place = kept, at
        while place < len(self.text):
            while edge + shift < place or edge < end:  # go to the old piece start at or after this place
                if not ahead:
                    if last + 1 >= self.width or edge >= len(old):
                        break
                    last += 1
                    ahead = list(self.pieces(last))
                    continue
                edge += ahead.pop(0)[0]
            if edge >= end and edge + shift == place:
                break
            piece = self.counter.pattern.match(self.text, place)[0]
            made.append((len(piece), self.counter.count(piece)))
            self.encoded += 1
            place += len(piece)
        else:
            ahead, last = [], self.width - 1
        made.extend(ahead)
        for x in range(leaf, last + 1):
            self.inner.pop(x, None)
        self.inner[leaf] = made
        self.sums[:, leaf + self.width : last + self.width + 1] = 0
        self.sums[:, leaf + self.width] = np.array(made).sum(axis=0) if made else 0
        a, b = (leaf + self.width) // 2, (last + self.width) // 2
        while a:
            self.sums[:, a : b + 1] = self.sums[:, 2 * a : 2 * b + 2 : 2] + self.sums[:, 2 * a + 1 : 2 * b + 2 : 2]
            a, b = a // 2, b // 2


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_edited(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts of each whole text before and after its edits.

    edits_col: array of structs (start, end, new): characters start to end of the text as the edits before it left it
    become `new`; a place beyond the text is its end, a null place is 0 (start) or start (end), a null `new` is empty.
    A null array is no edits. Returns doc_id, n_tokens, n_pieces, n_tokens_edited, n_encoded (the pieces that the edits
    encoded anew) and edited (the text). A null or empty text has no tokens; null ids and repeated rows have results of
    their own; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))

    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            texts, edits = [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            for a, b in slices(texts):
                chars, tokens, counts = count.batch(texts[a:b])
                rows, at = [], 0
                for text, todo, n in zip(texts[a:b], edits[a:b], counts.tolist()):
                    tree = TokenTree(count, text, chars[at : at + n], tokens[at : at + n])
                    at, before = at + n, tree.tokens
                    for e in todo or []:
                        if e is not None:
                            start = min(max(e["start"] or 0, 0), len(tree.text))
                            end = min(max(e["end"] if e["end"] is not None else start, start), len(tree.text))
                            tree.edit(start, end, e["new"] or "")
                    rows.append((before, n, tree.tokens, tree.encoded, tree.text))
                done = pd.DataFrame(rows, columns=["n_tokens", "n_pieces", "n_tokens_edited", "n_encoded", "edited"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(done[c], pa.int64()) for c in done.columns[:4]), pa.array(done["edited"], pa.string())], ["doc_id", *done.columns])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_pieces long, n_tokens_edited long, n_encoded long, edited string")

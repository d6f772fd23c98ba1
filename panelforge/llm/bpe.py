"""Byte-level BPE by prefix dynamic programming, with exact appends and re-encoding near edits."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceIds, slices
from .text import parts, release

#: Characters that are encoded at a time: each takes some sixty bytes of memory.
SLICE = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PrefixBPE:
    """Encodes the bytes of one piece.

    For every prefix of the piece, the encoding of that prefix ends in exactly one token: the one whose pairing with
    the last token of the shorter prefix is itself a stable encoding. Those last tokens are all that is stored. Walking
    back from the end gives the ids; appending goes on from the last prefix; an edit keeps the prefixes before it, and
    ends as soon as as many prefixes as the longest token has bytes agree with the old ones.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self._stable: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The defining rule: join the neighbours of lowest rank, the leftmost first, until none can be joined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == len(self.tokens):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.tokens[token]) == [token]
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens gives the two tokens."""
        key = left * len(self.tokens) + right
        if (known := self._stable.get(key)) is None:
            if len(self._stable) > 400_000:
                self._stable.clear()
            known = self._stable[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def extend(self, piece: bytes, last: list[int], old: list[int] | None = None, shift: int = 0, settled: int = 0) -> list[int]:
        """last[i] is the last token of piece[:i] (last[0] is -1); adds what is missing up to the whole piece.

        old, shift: last tokens from before an edit; prefix i now is prefix i - shift then, from `settled` on.
        """
        get, same = self.ranks.get, 0
        for i in range(len(last), len(piece) + 1):
            for j in range(max(0, i - self.longest), i):
                token = get(piece[j:i])
                if token is not None and (self.stable(last[j], token) if j else self.whole(token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token for byte {piece[i - 1]}")
            if old is not None and i > settled:
                same = same + 1 if old[i - shift] == last[i] else 0
                if same >= self.longest:
                    last.extend(old[i - shift + 1 :])
                    break
        return last

    def back(self, last: list[int]) -> list[int]:
        """The ids, from the last tokens of all prefixes."""
        at, out = len(last) - 1, []
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece; a piece that is itself a token is that token, as the rank library has it."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        return self.back(self.extend(piece, [-1]))


class PrefixState:
    """A piece that can grow and change while its encoding stays exact."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, piece, bpe.extend(piece, [-1])

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def splice(self, start: int, end: int, new: bytes) -> None:
        """Replace piece[start:end] by new."""
        old, self.piece = self.last, self.piece[:start] + new + self.piece[end:]
        self.last = self.bpe.extend(self.piece, old[: start + 1], old, start + len(new) - end, start + len(new))

    def ids(self) -> list[int]:
        token = self.bpe.ranks.get(self.piece)
        return [token] if token is not None else self.bpe.back(self.last)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> tuple[PrefixBPE, PieceIds]:
    """One for each file and Python worker."""
    bpe = PrefixBPE(read_ranks(path))
    return bpe, PieceIds(lambda pieces: [bpe.encode(p.encode()) for p in pieces])


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = coder(path)[0].tokens
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(size) - size, size


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and how many each has."""
    return coder(path)[1].ids(texts)


def decode_ids(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in one array, and where each id's begin (with the total at the end)."""
    flat, begin, size = token_bytes(path)
    sizes = size[ids]
    total = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(total[-1]) + np.repeat(begin[ids] - total[:-1], sizes)], total


def cut(flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw, ends = flat.tobytes(), (ends * flat.itemsize).tolist()
    return [raw[x:y] for x, y in zip([0, *ends[:-1]], ends)]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids), and with decode the bytes that the ids stand for; ids: little-endian unsigned 32-bit integers.

    A null or empty text has no ids; a row with a null id, and each repeated row, has a result of its own; an empty
    table gives an empty result. Only the two named columns are read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        release()
        for batch in (part for batch in batches for part in parts(batch)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE):
                ids, counts = encode_texts(texts[a:b], path)
                ends = np.cumsum(counts)
                columns = [batch.column(0).slice(a, b - a), pa.array(cut(ids.astype("<u4"), ends), pa.binary())]
                if decode:
                    data, total = decode_ids(ids, path)
                    columns.append(pa.array(cut(data, total[ends]), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "bytes"][: len(columns)])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary" + ", bytes binary" * decode)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes): encoded documents with the bytes that their ids stand for; null ids stand for none."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(x or b"", dtype="<u4") for x in batch.column(1).to_pylist()]
            data, total = decode_ids(np.concatenate(lists), path) if lists else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
            out = cut(data, total[np.cumsum([len(x) for x in lists], dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids binary, bytes binary")

"""Byte-level BPE encoding and decoding by backtracking over automaton matches.

A sequence of tokens is the encoding of its bytes if and only if each pair of
neighbours is, so a piece is encoded by taking the longest token at each place
whose pairing with the token before is sound, and by stepping back where none
is.  Tokens are found with an Aho-Corasick automaton over bytes read as Latin-1;
pair soundness is decided once by the merges themselves and kept.

Defined results: null or empty text has no ids; repeated rows give repeated
rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.textbytes import chunks, column_of

#: Pieces and pairs that a worker keeps; it starts afresh beyond that.
MEMO = 1_000_000
#: Code points of the longest piece that is kept.
KEPT = 256


class Memo(dict):
    """Bounded store of a function's values."""

    def __init__(self, fn, most: int = MEMO):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.fn(key)
        if len(key) <= KEPT:
            self[key] = value
        return value


class ByteBPE:
    """Encoder for ranks of byte strings; a pair merges into the token of lowest rank."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.none = max(ranks.values(), default=0) + 1
        self.token = {i: t for t, i in ranks.items()}
        self.found = ahocorasick.Automaton()
        for t, i in ranks.items():
            if self.merged(t) == [i]:  # else only a whole piece can be it
                self.found.add_word(t.decode("latin-1"), (i, len(t)))
        self.found.make_automaton()
        self.length = {i: len(t) for t, i in ranks.items()}
        self.sound = Memo(lambda pair: self.merged(self.token[pair[0]] + self.token[pair[1]]) == [*pair], 2 * MEMO)
        self.piece = Memo(lambda piece: array("I", self.encode(piece.encode("utf-8"))).tobytes())
        size = max(self.token, default=-1) + 2
        ends = np.zeros(size, np.int64)
        for i, t in self.token.items():
            ends[i + 1] = len(t)
        self.at = np.cumsum(ends)
        self.bytes = np.frombuffer(b"".join(self.token[i] for i in sorted(self.token)), np.uint8)

    def merged(self, text: bytes) -> list[int]:
        """The merges as defined: lowest rank first, leftmost of equals."""
        parts = [text[i:i + 1] for i in range(len(text))]
        none = self.none
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank == none:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece, in time linear in its length."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, length, sound = len(piece), self.length, self.sound
        at: list[list[int]] = [[] for _ in range(n + 1)]
        for end, (i, size) in self.found.iter(piece.decode("latin-1")):
            at[end + 1 - size].append(i)  # shorter ones first
        alive = bytearray(b"\1") * (n + 1)  # False: proved to be no border between tokens
        out: list[int] = []
        tried: list[int] = []
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while k >= 0:
                i = options[k]
                if alive[pos + length[i]] and (not out or sound[out[-1], i]):
                    break
                k -= 1
            if k >= 0:
                out.append(i)
                tried.append(k)
                pos += length[i]
                k = len(at[pos]) - 1
            else:
                alive[pos] = 0
                if not out:
                    raise ValueError("the ranks lack a single byte")
                pos -= length[out.pop()]
                k = tried.pop() - 1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.at[ids + 1] - self.at[ids]
        to = np.cumsum(sizes)
        return self.bytes[np.repeat(self.at[ids] - to + sizes, sizes) + np.arange(to[-1] if len(to) else 0)].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(df: DataFrame, path: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_bytes and ids (binary: little-endian unsigned 32-bit) of each row's text.

    path: rank file; pattern: pieces of the text, each of which is encoded for itself.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("n_bytes", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import regex

        bpe, pieces = load(path), regex.compile(pattern).findall
        for whole in batches:
            for b in chunks(whole, text):
                texts = [x or "" for x in column_of(b, text).to_pylist()]
                ids = [b"".join(map(bpe.piece.__getitem__, pieces(x))) for x in texts]
                yield pa.RecordBatch.from_arrays([*(column_of(b, k) for k in keys), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for, as another column."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        bpe = load(path)
        for whole in batches:
            for b in chunks(whole, ids):
                texts = [bpe.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in column_of(b, ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)

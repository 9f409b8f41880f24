"""Token counts of every prefix, for a BPE with word ends.

For each end p of a prefix the last token of its encoding is the one token that
ends there and pairs soundly with the last token of the prefix before it, so one
pass over a word gives the count of every prefix of it.  A text's counts are kept
as differences from one code point to the next; truncation and budget questions
are answered from them, without encoding again.

Prefixes are those of the text as the vocabulary normalizes it (canonical
composition, a blank run as one space, lower case).  A special string in the raw
text is one token; prefixes that end inside it are counted as ordinary text.

Defined results: null or empty text has no tokens; repeated rows give repeated
rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.bpe import MEMO, Memo
from quarry.llm.textbytes import chunks, column_of

#: The white space of Unicode, as the vocabulary's library has it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Code points of the longest contraction that the vocabulary splits off.
CONTRACTION = 3


def one_of(points: str) -> str:
    """A character class of code points, in order, as ranges."""
    at = np.array([ord(c) for c in points], np.int64)
    cut = np.flatnonzero(np.diff(at) > 1)
    ends = zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [-1]])].tolist(), strict=True)
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends) + "]"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary file (fixed values)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordBPE:
    """Prefix counts by a vocabulary file whose tokens may end a word."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.symbols: dict[int, list[int]] = {}
        self.inside, self.ending = ahocorasick.Automaton(), ahocorasick.Automaton()
        for token, i in vocab.items():
            word = token.removesuffix(end)
            if not word or any(c not in value for c in word):
                continue
            raw = bytes(value[c] for c in word)
            last, found = (self.inner, self.inside) if word == token else (self.final, self.ending)
            self.symbols[i] = [*(self.inner[b] for b in raw[:-1]), last[raw[-1]]]
            if self.merged(self.symbols[i]) == [i]:  # else no text has it
                found.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.inside.make_automaton()
        self.ending.make_automaton()
        self.sound = Memo(lambda pair: self.merged(self.symbols[pair[0]] + self.symbols[pair[1]]) == [*pair], 2 * MEMO)
        self.piece = Memo(self.differences)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", BLANK)
        self.pieces = regex.compile(f" ?(?:{split})| ").findall
        # Code points that are newer than this Python: the splitting above may know more of them than
        # the vocabulary's library does.  Texts that hold one are normalized by the library, and
        # split with its letters and numbers.
        unassigned = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
        newer = "".join(regex.findall(r"\P{Cn}", unassigned))
        self.newer = re.compile(one_of(newer)).search if newer else lambda text: None
        classes = dict.fromkeys((r"\p{L}", r"\p{N}"))
        for name in classes:
            theirs = Split(Regex(name), "removed", invert=True).pre_tokenize_str(newer)
            known = {c for piece, _ in theirs for c in piece}
            odd = "".join(c for c in regex.findall(name, newer) if c not in known)
            classes[name] = f"[{name}--{one_of(odd)}]" if odd else name
        for name, own in classes.items():
            split = split.replace(name, own)
        self.newer_pieces = regex.compile(f"(?V1) ?(?:{split})| ").findall
        self.normalized = Tokenizer.from_file(path).normalizer.normalize_str
        self.blanks = regex.compile(f"[{BLANK}]{{2,}}|[{BLANK.replace(' ', '')}]")
        self.parts = regex.compile("(" + "|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) + ")").split

    def merged(self, ids: list[int]) -> list[int]:
        """The merges as defined: earliest in the list first, leftmost of equals."""
        ids = list(ids)
        while len(ids) > 1:
            (rank, token), i = min((self.merge.get((ids[i], ids[i + 1]), (len(self.merge), 0)), i) for i in range(len(ids) - 1))
            if rank == len(self.merge):
                break
            ids[i:i + 2] = [token]
        return ids

    def counts(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ..., each as a word of its own."""
        raw = word.encode("utf-8").decode("latin-1")
        n, sound = len(raw) + 1, self.sound
        last, used, out = [0] * n, [0] * n, [0] * n
        for p, (i, size) in self.inside.iter(raw):  # encodings of raw[:p + 1] with more to come
            if used[p]:
                continue
            if p < size:  # it starts the word
                last[p], used[p] = i, 1
            elif used[p - size] and sound[last[p - size], i]:
                last[p], used[p] = i, used[p - size] + 1
        for p, (i, size) in self.ending.iter(raw):
            if out[p]:
                continue
            if p < size:
                out[p] = 1
            elif used[p - size] and sound[last[p - size], i]:
                out[p] = used[p - size] + 1
        return out[:-1] if word.isascii() else [out[len(word[:j].encode("utf-8")) - 1] for j in range(1, len(word) + 1)]

    def differences(self, piece: str) -> bytes:
        """Tokens that each code point of a piece adds, as 16-bit numbers."""
        if piece[0] == " ":
            return b"\0\0" + (self.differences(piece[1:]) if len(piece) > 1 else b"")
        if piece[0] == "'" and 1 < len(piece) <= CONTRACTION:  # its prefixes are split otherwise
            counts = [sum(self.counts(x)[-1] for x in self.pieces(piece[:j])) for j in range(1, len(piece))] + self.counts(piece)[-1:]
        else:
            counts = self.counts(piece)
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def plain(self, text: str) -> str:
        """Text as the vocabulary normalizes it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.blanks.sub(" ", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        if not text.isascii() and self.newer(text):
            return self.newer_pieces(self.normalized(text))
        return self.pieces(self.plain(text))

    def of_text(self, text: str) -> bytes:
        parts = self.parts(text)
        out = []
        for k, part in enumerate(parts):
            if k % 2:  # a special string
                inner = b"".join(map(self.piece.__getitem__, self.split(part)))
                counts = np.cumsum(np.frombuffer(inner, "<i2").astype(np.int64))
                counts[-1] = 1
                out.append(np.diff(counts, prepend=0).astype("<i2").tobytes())
            else:
                out += map(self.piece.__getitem__, self.split(part))
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def unpack(prefix: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... code points."""
    import zstandard

    steps = np.frombuffer(zstandard.decompress(prefix), "<i2")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def tokens_at(prefix: bytes, size: int) -> int:
    """Tokens of the first ``size`` code points."""
    return int(unpack(prefix)[size])


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_counts(df: DataFrame, path: str, budget: int, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_bytes, n_tokens, prefix (the counts of every prefix, packed) and
    fits (code points of the longest prefix of at most ``budget`` tokens)."""
    added = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "fits")] + [T.StructField("prefix", T.BinaryType())]
    schema = T.StructType([df.schema[k] for k in keys] + added)

    def run(batches):
        import zstandard

        bpe, pack = load(path), zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for b in chunks(whole, text):
                rows = []
                for x in column_of(b, text).to_pylist():
                    steps = bpe.of_text(x or "")
                    counts = np.concatenate([[0], np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)])
                    fits = len(counts) - 1 if counts.max() <= budget else longest_prefix(counts, budget)
                    rows.append((len((x or "").encode()), int(counts[-1]), fits, pack(steps)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(column_of(b, k) for k in keys), *cols], names=schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)

"""Repeated-phrase automata: find word windows that occur twice, and every place they cover.

1. Anchors.  Of each window the least of its short phrases, by hash, is its
   anchor; equal windows have equal anchors.  Anchors that were seen once are
   dropped.
2. Confirm.  Windows with an anchor that was seen twice are counted by hash; those
   that start in two places or more are the recurring passages.
3. Locate.  Documents are dealt to shards.  A shard gets the anchor phrases and
   windows of the recurring passages that its documents can hold, compiles the
   phrases into an Aho-Corasick automaton, and streams its documents through it.
   Windows around each phrase found are looked up, and their words are removed.

A shard's automaton is bounded by the text of its documents, and each document is
streamed once, so that work grows with the input.  Each task sends a phrase or
window once, so that a passage in a third of all documents is a row per task.

Defined results: null text has no words; repeated rows repeat each other's
windows; documents shorter than a window keep their words; an empty table gives an
empty table; other columns are carried only if they are named in ``keys``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textbytes import Words, chunks, column_of, joined_words

#: Words of an anchor phrase.
PHRASE = 6


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least (first of equals) of values[i:i + width], for each i; the
    last width - 1 places are not meant."""
    n = len(values)
    best, span = np.arange(n), 1

    def better(a, b):
        return np.where(values[b] < values[a], b, a)

    while 2 * span <= width:
        best = better(best, best[np.minimum(np.arange(n) + span, n - 1)])
        span *= 2
    if span < width:
        best = better(best, best[np.minimum(np.arange(n) + width - span, n - 1)])
    return best


class Windows:
    """Windows of the texts of a column, their hashes and anchors."""

    def __init__(self, column: pa.Array, size: int):
        self.words = Words(column)
        hashes = self.words.hashes()
        self.hash, self.whole = self.words.grams(hashes, size)
        self.phrase, _ = self.words.grams(hashes, PHRASE)
        self.anchor = least_of(self.phrase, size - PHRASE + 1) if len(hashes) else np.zeros(0, np.int64)

    def phrase_bytes(self, at: int) -> bytes:
        return self.words.data[self.words.starts[at]:self.words.ends[at + PHRASE - 1]].tobytes()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.concatenate([np.flatnonzero(new), [n]])


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors_of(docs: DataFrame, size: int) -> DataFrame:
    """_p, h, n: how often a shard's documents have an anchor (a row per batch and shard)."""
    def run(batches):
        for whole in batches:
            for b in chunks(whole, "_text"):
                w = Windows(column_of(b, "_text"), size)
                at = np.unique(w.anchor[w.whole])
                h, p = w.phrase[at], column_of(b, "_p").to_numpy()[w.words.doc[at]]
                order = np.lexsort((h, p))
                h, p = h[order], p[order]
                r = runs(h, p)
                yield pa.RecordBatch.from_arrays([pa.array(p[r[:-1]]), signed(h[r[:-1]]), pa.array(np.diff(r))], names=["_p", "h", "n"])

    return docs.select("_p", "_text").mapInArrow(run, "_p int, h long, n long")


def packed_words(docs: DataFrame, keys: tuple[str, ...], layout: bool = False) -> DataFrame:
    """keys, _p and the words joined by one space, compressed; layout: the text as it is, null if it is null."""
    schema = T.StructType([docs.schema[k] for k in keys] + [docs.schema["_p"], T.StructField("_z", T.BinaryType())])

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for b in chunks(whole, "_text"):
                texts = column_of(b, "_text").cast(pa.large_binary()).to_pylist() if layout else joined_words(Words(column_of(b, "_text")))
                z = [None if x is None else pack(x) for x in texts]
                yield pa.RecordBatch.from_arrays([*(column_of(b, k) for k in keys), column_of(b, "_p"), pa.array(z, pa.binary())], names=schema.names)

    return docs.select(*keys, "_p", "_text").mapInArrow(run, schema)


def dealt(first: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    """Rows by shard, those of ``first`` before the documents."""
    both = first.withColumn("_doc", F.lit(False)).unionByName(docs.withColumn("_doc", F.lit(True)), allowMissingColumns=True)
    return both.repartitionById(shards, F.col("_p")).sortWithinPartitions("_doc")


def texts_of(batch: pa.RecordBatch):
    """Slices of a batch with their unpacked texts, a few MB each."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for b in chunks(batch, "_z", 1 << 20):
        yield b, pa.array([None if x is None else unpack(x) for x in column_of(b, "_z").to_pylist()], pa.large_binary())


def joined_and_packed(batch: pa.RecordBatch, layout: bool):
    """Slices of a batch with their words joined by one space, and the texts as they were packed."""
    for b, packed in texts_of(batch):
        yield b, pa.array(joined_words(Words(packed)), pa.large_binary()) if layout else packed, packed


def cut(texts: pa.Array, gone: np.ndarray) -> list[bytes | None]:
    """texts without their gone words and what is between two of them; all else stays as it is."""
    w = Words(texts)
    out = texts.to_pylist()
    at = np.flatnonzero(gone)
    if not len(at):
        return out
    first = np.ones(len(at), bool)  # of a run of gone words of one text
    first[1:] = (np.diff(at) > 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
    lo, hi = at[first], at[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(at) - 1]])]
    base = w.at[w.doc[lo]]
    parts: dict[int, list[bytes]] = {}
    end: dict[int, int] = {}
    for d, a, z in zip(w.doc[lo].tolist(), (w.starts[lo] - base).tolist(), (w.ends[hi] - base).tolist(), strict=True):
        parts.setdefault(d, []).append(out[d][end.get(d, 0):a])
        end[d] = z
    for d, x in parts.items():
        out[d] = b"".join([*x, out[d][end[d]:]])
    return out


def windows_seen(anchors: DataFrame, docs: DataFrame, shards: int, size: int, layout: bool = False) -> DataFrame:
    """_p, h, phrase and windows (hashes; twice: 1 where it starts in two places) of the
    windows with a recurring anchor, by batch of a shard's documents."""
    schema = "_p int, h long, phrase binary, windows binary, twice binary"

    def run(batches):
        known, ready = [], np.zeros(0, np.uint64)
        for whole in batches:
            is_doc = column_of(whole, "_doc").to_numpy(zero_copy_only=False)
            split = int(is_doc.argmax()) if is_doc.any() else len(is_doc)
            if split:
                known.append(column_of(whole.slice(0, split), "h").to_numpy().view(np.uint64))
            for b, texts, _ in joined_and_packed(whole.slice(split), layout) if split < len(is_doc) else ():
                if known:
                    ready, known = np.unique(np.concatenate([ready, *known])), []
                w = Windows(texts, size)
                at = np.flatnonzero(w.whole)
                at = at[member(w.phrase[w.anchor[at]], ready)]
                if not len(at):
                    continue
                h, own = w.phrase[w.anchor[at]], w.hash[at]
                order = np.lexsort((own, h))
                at, h, own = at[order], h[order], own[order]
                r = runs(h, own)
                first, many = r[:-1], (np.diff(r) > 1).astype(np.uint8)
                h, own, at = h[first], own[first], at[first]
                g = runs(h)
                hashes, flags = own.tobytes(), many.tobytes()
                lo, hi = g[:-1].tolist(), g[1:].tolist()
                p = column_of(b, "_p")[0].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lo), p, np.int32)), signed(h[g[:-1]]),
                    pa.array([w.phrase_bytes(i) for i in w.anchor[at[g[:-1]]].tolist()], pa.binary()),
                    pa.array([hashes[8 * a:8 * z] for a, z in zip(lo, hi, strict=True)], pa.binary()),
                    pa.array([flags[a:z] for a, z in zip(lo, hi, strict=True)], pa.binary())], names=["_p", "h", "phrase", "windows", "twice"])

    return dealt(anchors, docs, shards).select("_p", "h", "_z", "_doc").mapInArrow(run, schema)


def confirmed(seen: DataFrame) -> DataFrame:
    """_p, phrase, windows: of what a shard has seen, the windows that start in two places."""
    def of_groups(b: pa.Table):
        h = b.column("h").to_numpy()
        rows = [np.frombuffer(x, np.uint64) for x in b.column("windows").to_pylist()]
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in b.column("twice").to_pylist()])
        own, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        of = group[row]
        order = np.lexsort((own, of))
        r = runs(of[order], own[order])
        twice = np.add.reduceat(many[order].astype(np.int64) + 1, r[:-1]) > 1
        keep = np.zeros(len(own), bool)
        keep[order] = np.repeat(twice, np.diff(r))
        own, row = own[keep], row[keep]
        r = runs(row)
        lo, hi = r[:-1].tolist(), r[1:].tolist()
        first = np.searchsorted(group, group)  # one wording for all shards
        phrases, ps = b.column("phrase"), b.column("_p").to_numpy()
        data, of_row = own.tobytes(), row[r[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(ps[of_row]), phrases.take(pa.array(first[of_row])).combine_chunks(), pa.array([data[8 * a:8 * z] for a, z in zip(lo, hi, strict=True)], pa.binary())], names=["_p", "phrase", "windows"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows whose anchor may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            h = column_of(b, "h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut or held and column_of(held[-1], "h")[-1].as_py() != h[0]:
                if cut:
                    held.append(b.slice(0, cut))
                yield of_groups(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(cut))
        if held:
            yield of_groups(pa.Table.from_batches(held))

    return seen.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(run, "_p int, phrase binary, windows binary")


def located(passages: DataFrame, docs: DataFrame, shards: int, size: int, keys: tuple[str, ...], layout: bool = False) -> DataFrame:
    """keys, n_words, n_removed and kept (the words not covered, joined by one space; layout:
    the text without the stretches covered)."""
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")] + [T.StructField("kept", T.StringType())])

    def removed(w: Windows, texts: list[bytes], found, windows: np.ndarray) -> np.ndarray:
        starts = []
        for base, x in zip(w.words.at.tolist(), texts, strict=False):
            starts += [base + end + 1 - n for end, n in found.iter(f" {x.decode('latin-1')} ")]
        n = len(w.words.starts)
        word = np.searchsorted(w.words.starts, np.array(starts, np.int64))
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.maximum(word - (size - PHRASE), w.words.first[w.words.doc[word]]), 1)
        np.add.at(near, word + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[:n] > 0) & w.whole)
        at = at[member(w.hash[at], windows)]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        return np.cumsum(cover)[:n] > 0

    def run(batches):
        import ahocorasick

        found, phrases, hashes, windows = ahocorasick.Automaton(), False, [], np.zeros(0, np.uint64)
        for whole in batches:
            is_doc = column_of(whole, "_doc").to_numpy(zero_copy_only=False)
            split = int(is_doc.argmax()) if is_doc.any() else len(is_doc)
            for x in column_of(whole.slice(0, split), "phrase").to_pylist():
                x = f" {x.decode('latin-1')} "
                found.add_word(x, len(x))
                phrases = True
            hashes += [np.frombuffer(x, np.uint64) for x in column_of(whole.slice(0, split), "windows").to_pylist()]
            for b, texts, packed in joined_and_packed(whole.slice(split), layout) if split < len(is_doc) else ():
                if hashes:
                    windows, hashes = np.unique(np.concatenate(hashes)), []
                    found.make_automaton()
                w = Windows(texts, size)
                gone = removed(w, texts.to_pylist(), found, windows) if phrases else np.zeros(len(w.words.starts), bool)
                n_gone = np.bincount(w.words.doc[gone], minlength=b.num_rows)
                kept = pa.array(cut(packed, gone) if layout else joined_words(w.words, ~gone), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(column_of(b, k) for k in keys), pa.array(w.words.counts), pa.array(n_gone), kept], names=schema.names)

    return dealt(passages, docs, shards).select(*keys, "_p", "phrase", "windows", "_z", "_doc").mapInArrow(run, schema)


def remove_repeats(df: DataFrame, size: int = 35, keys: tuple[str, ...] = ("doc_id",), text: str = "text", layout: bool = False) -> DataFrame:
    """keys, n_words, n_removed, kept: each row's text without the words of any window of
    ``size`` words that starts anywhere else too.  kept has the other words joined by one
    space; with ``layout`` it is the text itself without the stretches from the first to the
    last word covered, so that a text without repeats (or null) stays as it is."""
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(*keys, F.col(text).alias("_text"), F.pmod(F.xxhash64(*keys, text), F.lit(shards)).cast("int").alias("_p"))
    counted = anchors_of(docs, size).repartition(F.col("h")).groupBy("h", "_p").agg(F.sum("n").alias("n"))
    often = counted.withColumn("n", F.sum("n").over(Window.partitionBy("h"))).filter("n > 1").select("_p", "h")
    words = packed_words(docs, keys, layout)
    passages = confirmed(windows_seen(often, words, shards, size, layout))
    return located(passages, words, shards, size, keys, layout)

"""SimHash near duplicates: fingerprints joined by chains of segments of a ring.

A document's fingerprint has a bit where over half of its shingles' hashes have it.
The 64 bits are a ring of RING segments.  If two fingerprints differ in at most
DIFFER bits, then from one of the segments on every chain of l consecutive segments
differs in at most ``l * DIFFER / RING`` bits (the pigeonring principle): the first
KEY segments are equal, and the sums that follow stay within their budgets.

Each distinct fingerprint is turned so that each segment stands first once, and the
turned values are sorted by range over the tasks.  Equal first segments (a bucket)
are neighbours there; their pairs are put through the budgets of the chain, whose last
is the full Hamming distance, and what is left is linked.  A bucket of more than
BUCKET fingerprints, and those that may be cut by the border of a range, are linked
another way, exact too and linear: two fingerprints differ in at most two bits if
and only if they share a value that differs in at most one bit from either, so that
each gives those 65 values and rows of equal values are linked.  A task holds a
bucket of BUCKET values at most, whatever the size of a group of copies.

Defined results: null text, or text without words, has the fingerprint zero and is
linked like any other; fewer words than a shingle are one shingle; equal rows are
linked; rows without an id are linked too, and their component's id is the least
there is (null if there is none); an empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.parity_join import components
from quarry.llm.textbytes import Words, chunks, column_of
from quarry.session import materialize

#: Words of a shingle; seed of its hash; bits in which linked fingerprints differ at most.
SHINGLE, SEED, DIFFER = 3, 42, 2
#: Segments of the ring, and how many of a chain must be equal (their budgets are below one).
RING = 7
KEY = -(-RING // DIFFER) - 1
#: Fingerprints of a bucket whose pairs are looked at; pairs and hashes that a task holds at a time.
BUCKET, PAIRS, HASHES = 4096, 1 << 20, 1 << 18

_EDGE = [i * 64 // RING for i in range(RING + 1)]
#: By first segment: bits of the chains of 1, 2 ... RING segments.
_CHAIN = np.array([[(_EDGE[(s + n) % RING] - _EDGE[s]) % 64 or 64 for n in range(1, RING + 1)] for s in range(RING)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a column in lower case, a space before each, and of each shingle its
    place there (from, to) and its row, by row."""
    w = Words(column)
    sizes = w.ends - w.starts + 1
    to = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.full(to[-1], 0x20, np.uint8)
    spread = np.arange(to[-1]) - np.repeat(to[:-1], sizes)
    inner = spread > 0
    joined[inner] = _LOWER[w.data[(np.repeat(w.starts, sizes) + spread - 1)[inner]]]
    n = len(w.starts)
    first = np.flatnonzero(w.doc[:n - SHINGLE + 1] == w.doc[SHINGLE - 1:]) if n >= SHINGLE else np.zeros(0, np.int64)
    few = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    lo = np.concatenate([first, w.first[few]])
    hi = np.concatenate([first + SHINGLE, w.first[few] + w.counts[few]])
    order = np.argsort(lo)
    lo, hi = lo[order], hi[order]
    return joined.tobytes(), to[lo] + 1, to[hi], w.doc[lo]


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """Each row's fingerprint."""
    from xxhash import xxh64_intdigest

    text, lo, hi, row = shingles(column)
    n = len(column)
    ones = np.zeros((n, 64), np.int64)
    for a in range(0, len(row), HASHES):
        part = slice(a, a + HASHES)
        spans = zip(lo[part].tolist(), hi[part].tolist(), strict=True)
        h = np.fromiter((xxh64_intdigest(text[x:y], SEED) for x, y in spans), np.uint64, len(row[part]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.flatnonzero(np.diff(row[part], prepend=-1))
        ones[row[part][at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    most = 2 * ones > np.bincount(row, minlength=n)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and _f, the fingerprint as a signed number."""
    def run(batches):
        for whole in batches:
            for b in chunks(whole, "_text"):
                found = pa.array(fingerprints_of(column_of(b, "_text")).view(np.int64))
                yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), found], names=["doc_id", "_f"])

    schema = T.StructType([T.StructField("doc_id", df.schema[key].dataType), T.StructField("_f", T.LongType())])
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def turned(f: Column) -> Column:
    """The fingerprint with each segment first: an array of (_s, _r)."""
    def turn(s):
        n = _EDGE[s]
        return f if not n else F.shiftleft(f, n).bitwiseOR(F.shiftrightunsigned(f, 64 - n))

    return F.array(*(F.struct(F.lit(s).cast("int").alias("_s"), turn(s).alias("_r")) for s in range(RING)))


def turned_back(s: np.ndarray, r: np.ndarray) -> np.ndarray:
    n = np.array(_EDGE[:RING], np.uint64)[s]
    back = (r >> n) | (r << ((np.uint64(64) - n) & np.uint64(63)))
    return np.where(n == 0, r, back).view(np.int64)


def in_budget(s: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether the sums of the chain from segment s on stay within their budgets.
    differ: XOR of values turned by s, whose first KEY segments are equal."""
    ok = np.ones(len(s), bool)
    for n in range(KEY, RING):
        ok &= np.bitwise_count(differ >> (np.uint64(64) - _CHAIN[s, n])) <= (n + 1) * DIFFER // RING
    return ok


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n places, the least that each is connected with by the links (a, b)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def links_of(s: np.ndarray, r: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of values sorted by bucket, as stars: from each but the least place of a
    connected group to that one."""
    least = np.arange(len(r))
    held, n = [], 0

    def settle():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        return least_linked(len(r), np.concatenate([a, np.arange(len(r))]), np.concatenate([b, least]))

    at, apart = np.arange(len(r)), 0
    while len(at):
        apart += 1
        at = at[:np.searchsorted(at, len(r) - apart)]
        at = at[bucket[at] == bucket[at + apart]]
        near = at[in_budget(s[at], r[at] ^ r[at + apart])]
        if len(near):
            held.append((near, near + apart))
            n += len(near)
            if n > PAIRS:
                least, held, n = settle(), [], 0
    if held:
        least = settle()
    rest = np.flatnonzero(least != np.arange(len(r)))
    return least[rest], rest


def bucket_links(prints: DataFrame, parts: int, most: int) -> DataFrame:
    """a, b: links found in buckets; with b null: a is in a bucket of more than ``most``, or in
    one that may be cut."""
    rows = prints.select(F.explode(turned(F.col("_f"))).alias("_x")).select("_x.*")
    rows = rows.repartitionByRange(parts, "_s", "_r").sortWithinPartitions("_s", "_r")

    def run(batches):
        def out(a, b=None):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], names=["a", "b"])

        s, r, passed = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for x in batches:
            if not x.num_rows:
                continue
            s = np.concatenate([s, column_of(x, "_s").to_numpy().astype(np.int64)])
            r = np.concatenate([r, column_of(x, "_r").to_numpy().view(np.uint64)])
            bucket = (s.astype(np.uint64) << np.uint64(40)) | (r >> (np.uint64(64) - _CHAIN[s, KEY - 1]))
            passed = bucket[0] if passed is None else passed  # the first may begin in the task before
            old = int(np.searchsorted(bucket != passed, True)) if bucket[0] == passed else 0
            if old:
                yield out(turned_back(s[:old], r[:old]))
            cut = max(old, int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if (bucket != bucket[-1]).any() else 0)
            size = np.diff(np.flatnonzero(np.concatenate([[True], bucket[old + 1:cut] != bucket[old:cut - 1], [True]]))) if cut > old else np.zeros(0, np.int64)
            large = np.zeros(cut, bool)
            large[old:] = np.repeat(size > most, size)
            if large.any():
                yield out(turned_back(s[:cut][large], r[:cut][large]))
            here = np.flatnonzero(~large[old:]) + old
            a, b = links_of(s[here], r[here], bucket[here])
            if len(a):
                f = turned_back(s[here], r[here])
                yield out(f[a], f[b])
            if len(r) - cut > most:
                yield out(turned_back(s[cut:], r[cut:]))
                passed, cut = bucket[-1], len(r)
            s, r = s[cut:], r[cut:]
        if len(r):  # the last may go on in the next task
            yield out(turned_back(s, r))

    return rows.mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, most: int = BUCKET) -> DataFrame:
    """a, b: links of fingerprints (for large buckets, by the values one bit away that they share)."""
    found = materialize(bucket_links(prints, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), most), "ring")
    flips = F.transform(F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))), lambda m: F.col("a").bitwiseXOR(m))
    near = found.filter("b is null").select("a").distinct().select("a", F.explode(F.concat(F.array("a"), flips)).alias("_v"))
    shared = near.groupBy("_v").agg(F.sort_array(F.collect_set("a")).alias("_all")).filter(F.size("_all") > 1)
    rest = shared.select(F.col("_all")[0].alias("a"), F.explode(F.slice("_all", 2, 65)).alias("b"))
    return found.filter("b is not null").unionByName(rest).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (least doc_id of the row's component)."""
    table = materialize(fingerprints(df, key, text), "fingerprints")
    least = materialize(table.groupBy("_f").agg(F.min("doc_id").alias("_least")), "prints")
    roots = components(near_links(least.select("_f"), most)).withColumnRenamed("_set", "_f")
    least = least.join(roots, "_f", "left").withColumn("_root", F.coalesce("_root", "_f"))
    named = least.join(least.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root").select("_f", "component_id")
    return table.join(named, "_f").select("doc_id", F.lower(F.lpad(F.hex("_f"), 16, "0")).alias("fingerprint"), "component_id")

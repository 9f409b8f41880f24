"""Near duplicates by n-gram Jaccard similarity: a join of parity sketches.

A document is the set of its shingles.  A sketch deals the shingles to parts and
keeps the XOR of the hashes in each part, so that a part differs only if the sets
differ in it: the number of parts that differ is a lower bound of the symmetric
difference.  Sets of sizes a <= b with similarity 3/4 or more differ in at most a/3
shingles, so that of any a//3 + 1 non-empty parts of the smaller set one agrees.

Bands.  Sizes from 2**c to 2**(c + 1) are a band with a number of parts of its own;
a set that can have a smaller partner in the band below is sketched for that one
too.  Each set gives its first size//3 + 1 non-empty parts as keys.  Let t be the
lesser of the places where two sets' keys end: up to there that set has more
non-empty parts than the two can differ in, so that they share a key.

Very common shingles are left out of the sketches (what is left differs no more).
A set that then has too few non-empty parts gives all it has and, besides, its
size//3 + 1 least whole shingles; two such sets share one of those.

Verify.  Sets that share keys are buckets.  Each bucket's sets are compared with
its first; then each with the likeliest of every other component in the bucket; then
all that are still not linked through others.  Buckets with the same first set are
dealt together, a row for each of their sets with the names of its buckets, so that
a sketch is sent once for them all (once a share of SHARE places in buckets, if the
first set has more).  A pair is dropped if its sizes, or the
bits in which its bit sketches (a parity bit for each of once to twice as many places
as shingles) differ, rule the similarity out; what is left is compared exactly, on the shingles of both texts.  Links that join
two parts of one component already are not looked for, as components are the result.

Defined results: null text, or text without words, has no shingles and is a
component of its own; a text with fewer words than a shingle is one shingle; rows
with equal sets are linked; rows with a null doc_id are linked like others, and their
component is named by the least id that is not null (null if there is none); an empty table gives an empty table; other columns are
not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.phrase_automata import member, runs, signed, texts_of
from quarry.llm.textbytes import Words, chunks, column_of, joined_words, mix, range_hashes
from quarry.session import materialize

#: Words of a shingle.
SHINGLE = 5
#: Shingles in so many of a batch's documents are looked at, and are very common if
#: they are in one of so many documents: at most COMMON times a mean set's size of them.
LOOKED_AT, COMMON = 4, 1000
#: Sets compared with each other at a time, within a bucket.
BLOCK = 256
#: Places in buckets, of a first set, that are dealt together.
SHARE = 1 << 14
#: Bits of the sieve that keeps texts no pair needs from being shuffled (log 2).
SIEVE = 26


def shingle_sets(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the distinct shingles of all rows: row, hash (rising in each row), and
    where each row's begin (n + 1)."""
    w = Words(column)
    h = w.hashes(lower=True)
    grams, whole = w.grams(h, SHINGLE)
    few = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    short = range_hashes(h, w.first[few], w.first[few] + w.counts[few])
    row, value = np.concatenate([w.doc[whole], few]), np.concatenate([grams[whole], short])
    bits = np.uint64(int(len(column)).bit_length())
    key = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (value >> bits)  # its order is that of (row, value)
    order = np.argsort(key)
    first = runs(key[order])[:-1]
    row, value = row[order][first], value[order][first]
    return w, row, value, np.searchsorted(row, np.arange(len(column) + 1))


def set_ids(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)))])
    return np.where(np.diff(at) > 0, mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)), 0).astype(np.uint64)


def bit_sketches(row: np.ndarray, value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each set's bit sketch: of 2**k places, once to twice the size, those that an odd
    number of shingles fall to.  Its halves' XOR is the sketch of half as many places."""
    size = np.diff(at)
    width = np.where(size > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)), 0)
    start = np.concatenate([[0], np.cumsum(width)])
    place = start[row] + (mix(value ^ np.uint64(0x2545F4914F6CDD1D)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(place, minlength=start[-1]) & 1).astype(np.uint8)).tobytes()
    return [bits[a // 8:b // 8] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def described(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, _set (hash of the set, null if empty) and, for
    the first with a set in its task, _z (words joined by one space, compressed) and _bits
    (the bit sketch).  Besides, rows of _h and _often: shingles that are frequent in a batch."""
    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        names = ["doc_id", "n_shingles", "_set", "_z", "_bits", "_h", "_often"]
        for whole in batches:
            for b in chunks(whole, "_text"):
                w, row, value, at = shingle_sets(column_of(b, "_text"))
                ids = set_ids(value, at)
                new = np.array([bool(x) and x not in seen and not seen.add(x) for x in ids.tolist()], bool)
                z = [pack(t) if n else None for t, n in zip(joined_words(w), new.tolist(), strict=True)]
                bits = [t if n else None for t, n in zip(bit_sketches(row, value, at), new.tolist(), strict=True)]
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), pa.array(np.diff(at)), pa.array(ids.view(np.int64), mask=ids == 0), pa.array(z, pa.binary()), pa.array(bits, pa.binary()), none, none], names=names)
                value = np.sort(value)
                r = runs(value)
                n = np.diff(r)
                often = n >= LOOKED_AT
                h = signed(value[r[:-1][often]])
                none = [pa.nulls(len(h), t) for t in (b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, h, pa.array(n[often])], names=names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])  # null in rows of _h
    for c, t in (("n_shingles", "long"), ("_set", "long"), ("_z", "binary"), ("_bits", "binary"), ("_h", "long"), ("_often", "long")):
        schema = schema.add(c, t)
    return docs.select("doc_id", "_text").mapInArrow(run, schema)


def common_shingles(table: DataFrame, n_docs: int) -> np.ndarray:
    """Hashes of the very common shingles, sorted: of all documents' shingles at most
    COMMON times the mean set's size."""
    found = table.filter("_h is not null").groupBy("_h").agg(F.sum("_often").alias("n"))
    rows = found.filter(F.col("n") * COMMON >= n_docs).select("_h").toArrow()
    return np.sort(rows.column("_h").to_numpy().view(np.uint64))


def sketch_keys(row: np.ndarray, value: np.ndarray, size: np.ndarray, common: np.ndarray):
    """(row, key) of the sets given; size: of each row's set."""
    out_row, out_key = [], []
    rest = ~member(value, common)
    part_row, part_value = row[rest], value[rest]
    short = np.zeros(len(size), bool)
    band = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    below = band - 1
    for level, may, differ in ((band, size > 0, size // 3), (below, (band > 0) & (3 * size < 4 << band), np.minimum(size // 3, ((1 << band) - 1) // 3))):
        parts = np.maximum(1, (6 << np.maximum(level, 0)) // 5).astype(np.uint64)
        mine = may[part_row]
        r, v = part_row[mine], part_value[mine]
        part = ((v >> np.uint64(32)) * parts[r]) >> np.uint64(32)
        order = np.argsort(r.astype(np.uint64) << np.uint64(32) | part)
        r, v, part = r[order], v[order], part[order]
        if not len(r):
            short |= may
            continue
        g = runs(r, part)[:-1]
        kept, r, part = np.bitwise_xor.reduceat(v, g), r[g], part[g]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        take = nth <= differ[r]
        short |= may & (np.bincount(r, minlength=len(size)) <= differ)
        salt = (level[r].astype(np.uint64) << np.uint64(40)) + part
        out_row.append(r[take])
        out_key.append(mix(kept + mix(salt))[take])
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    take = short[row] & (nth <= size[row] // 3)
    out_row.append(row[take])
    out_key.append(mix(value[take] ^ np.uint64(0xD1B54A32D192ED03)))
    return np.concatenate(out_row), np.concatenate(out_key)


def sketched(texts: DataFrame, common: np.ndarray, parts: int) -> DataFrame:
    """_q (the key's part of the key space), keys (32 bits each), rows (index into sets), sets:
    the keys of a batch of sets (_z) that fall to one part."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for whole in batches:
            for b, column in texts_of(whole):
                _, row, value, at = shingle_sets(column)
                ids = set_ids(value, at)
                r, key = sketch_keys(row, value, np.diff(at), shared.value)
                q = (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                order = np.argsort(q, kind="stable")
                r, key, q = r[order], key[order].astype(np.uint32), q[order]
                g = runs(q)
                cols = {"_q": [], "keys": [], "rows": [], "sets": []}
                for lo, hi in zip(g[:-1].tolist(), g[1:].tolist(), strict=True):
                    own, place = np.unique(r[lo:hi], return_inverse=True)
                    cols["_q"].append(int(q[lo]))
                    cols["keys"].append(key[lo:hi].tobytes())
                    cols["rows"].append(place.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes())
                    cols["sets"].append(ids[own].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cols["_q"], pa.int32()), *(pa.array(cols[c], pa.binary()) for c in ("keys", "rows", "sets"))], names=list(cols))

    return texts.select("_z").mapInArrow(run, "_q int, keys binary, rows binary, sets binary")


def buckets(keys: DataFrame, parts: int) -> DataFrame:
    """_a, _set, _bs: the sets that share a key (_bs: names of buckets) with others of which _a is
    the least; buckets of the same sets are one."""
    def run(batches):
        key, own = [], []
        for b in batches:
            for k, r, s in zip(*(column_of(b, c).to_pylist() for c in ("keys", "rows", "sets")), strict=True):
                s = np.frombuffer(s, np.uint64)
                key.append(np.frombuffer(k, np.uint32))
                own.append(s[np.frombuffer(r, np.uint16 if len(s) < 65536 else np.uint32)])
        if not key:
            return
        key, own = np.concatenate(key), np.concatenate(own)
        order = np.argsort(key)
        key, own = key[order], own[order]
        r = runs(key)
        n = np.diff(r)
        shared = np.repeat(n > 1, n)
        key, own = key[shared], own[shared]
        if not len(key):
            return
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        first = runs(key, own)[:-1]
        key, own = key[first], own[first]
        r = runs(key)
        n = np.diff(r)
        name = mix(np.add.reduceat(mix(own), r[:-1]) + n.astype(np.uint64))
        _, which = np.unique(name, return_index=True)
        which = which[n[which] > 1]
        keep = np.zeros(len(n), bool)
        keep[which] = True
        rows = np.repeat(keep, n)
        least = np.minimum.reduceat(own.view(np.int64), r[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(least, n)[rows]), signed(np.repeat(name, n)[rows]), signed(own[rows])], names=["_a", "_b", "_set"])

    rows = keys.repartitionById(parts, F.col("_q")).mapInArrow(run, "_a long, _b long, _set long")
    return rows.groupBy("_a", "_set").agg(F.collect_set("_b").alias("_bs"))


def sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**SIEVE bits with the ids' hashes set."""
    place = F.pmod(F.xxhash64("_set"), F.lit(1 << SIEVE))
    words = ids.select(place.alias("p")).selectExpr("p div 64 AS w", "shiftleft(1L, CAST(p % 64 AS INT)) AS x").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(1 << (SIEVE - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return out.view(np.uint64)


def sifted(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows (_set, _z) whose set's bit is there: all that are wanted and few others."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for b in batches:
            place = column_of(b, "_place").to_numpy()
            there = (shared.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            yield b.filter(pa.array(there.astype(bool))).select(["_set", "_z"])

    return texts.select("_set", "_z", F.pmod(F.xxhash64("_set"), F.lit(1 << SIEVE)).alias("_place")).mapInArrow(run, "_set long, _z binary")


def grown(side: DataFrame) -> DataFrame:
    """The side of a join with buckets, sketches or texts, to be merged and never broadcast: both
    sides grow with the input, so that the plan is the same at every size."""
    return side.hint("merge")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: of the pairs (a, b) of sets, those with similarity 3/4 or more."""
    wanted = pairs.select("a", F.col("b").alias("_set")).unionByName(pairs.select("a", F.col("a").alias("_set")).distinct())
    texts = sifted(texts, sieve(wanted.select("_set")))
    rows = grown(wanted).join(texts, "_set").withColumn("_own", F.col("a") == F.col("_set"))
    rows = rows.repartition(F.col("a")).sortWithinPartitions("a", F.col("_own").desc())

    def run(batches):
        name, mine = None, None
        for whole in batches:
            for b, column in texts_of(whole):
                _, _, value, at = shingle_sets(column)
                a, other, own = (column_of(b, c).to_pylist() for c in ("a", "_set", "_own"))
                at, out = at.tolist(), []
                for i in range(len(a)):
                    its = value[at[i]:at[i + 1]]
                    if own[i]:
                        name, mine = a[i], its
                    elif name == a[i]:
                        both = int(member(its, mine).sum())
                        if 100 * both >= 75 * (len(its) + len(mine) - both):
                            out.append((a[i], other[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """_set, _root (least set reachable) of the sets that have links (a, b)."""
    both = materialize(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("_set")).agg(F.least(F.min("b"), F.first("a")).alias("_root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("_set", "b"), "b").groupBy(F.col("a").alias("_set")).agg(F.min("_root").alias("_near"))
        least = labels.join(near, "_set").select("_set", F.least("_root", "_near").alias("_root"), F.col("_root").alias("_was"))
        jump = least.select(F.col("_set").alias("_root"), F.col("_root").alias("_far"))
        new = least.join(jump, "_root", "left").select("_set", F.least("_root", "_far").alias("_root"), "_was")
        new = materialize(new, "labels")
        if not new.filter("_root <> _was").limit(1).count():
            return new.select("_set", "_root")
        labels = new.select("_set", "_root")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with half as many places, until there are ``words`` words."""
    while bits.shape[1] > words:
        bits = bits[:, :bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2:]
    return bits


#: More than any two sketches differ in.
NEVER = 1 << 40


def apart_of(size_a, bits_a, size_b, bits_b) -> np.ndarray:
    """Bits in which sketches differ, for all pairs; NEVER where sizes or they rule a pair out."""
    words = min(bits_a.shape[1], bits_b.shape[1])
    apart = np.bitwise_count(folded(bits_a, words)[:, None, :] ^ folded(bits_b, words)[None, :, :]).sum(2, dtype=np.int64)
    a, b = size_a[:, None], size_b[None, :]
    return np.where((4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (7 * apart <= a + b), apart, NEVER)


def by_width(bits: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sketches of each length: their places, and rows of 64-bit words."""
    width = np.array([len(x) for x in bits])
    out = []
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        out.append((mine, np.frombuffer(b"".join(bits[i] for i in mine), np.uint64).reshape(len(mine), w // 8)))
    return out


def star_of(own, root, size, bits):
    """(a, root of a, b, apart) of the least set a of buckets and all others in them."""
    first = int(own.argmin())
    its = np.frombuffer(bits[first], np.uint64).reshape(1, -1)
    for mine, whole in by_width(bits):
        apart = apart_of(size[[first]], its, size[mine], whole)[0]
        j = np.flatnonzero((apart < NEVER) & (mine != first))
        yield np.full(len(j), own[first]), np.full(len(j), root[first]), own[mine[j]], apart[j]


def rest_of(own, root, size, bits):
    """(a, root of b, b, apart) of a bucket's sets of different roots; a is of the rarer one."""
    _, at, n = np.unique(root, return_inverse=True, return_counts=True)
    rarity = np.lexsort((root, n[at.reshape(-1)])).argsort()
    kinds = by_width(bits)
    for place, (mine, whole) in enumerate(kinds):
        for other, others in kinds[place:]:
            for lo in range(0, len(mine), BLOCK):
                for hi in range(lo if other is mine else 0, len(other), BLOCK):
                    x, y = mine[lo:lo + BLOCK], other[hi:hi + BLOCK]
                    if root[x].min() == root[y].max() and root[x].max() == root[y].min():
                        continue
                    apart = apart_of(size[x], whole[lo:lo + BLOCK], size[y], others[hi:hi + BLOCK])
                    i, j = np.nonzero((apart < NEVER) & (root[x][:, None] != root[y][None, :]))
                    a, b = x[i], y[j]
                    turn = rarity[a] > rarity[b]
                    a, b = np.where(turn, b, a), np.where(turn, a, b)
                    yield own[a], root[b], own[b], apart[i, j]


def rest_of_all(own, root, size, bits, bucket, at):
    """What rest_of yields for the buckets (``at``: the places of each one's sets), or for all sets at once
    if these make fewer pairs."""
    order = np.lexsort((at, bucket))
    bucket, at = bucket[order], at[order]
    g = runs(bucket)
    if len(own) ** 2 <= (np.diff(g) ** 2).sum():
        yield from rest_of(own, root, size, bits)
        return
    for lo, hi in zip(g[:-1].tolist(), g[1:].tolist(), strict=True):
        mine = at[lo:hi]
        if root[mine].min() < root[mine].max():
            yield from rest_of(own[mine], root[mine], size[mine], [bits[i] for i in mine.tolist()])


def bucket_pairs(rows: DataFrame, stars: bool) -> DataFrame:
    """a, r, bs: for a set and another component (least set r) of its bucket, the sets
    of that one that may be similar, the likeliest first.  rows: _a, _share, _set, _root,
    n_shingles, _bits, _bs; stars: pairs with the buckets' least set only (no _bs)."""
    def run(batches):
        held = None

        def flush(rows):
            g = runs(rows["_a"].to_numpy(), rows["_share"].to_numpy())
            own, root, size = (rows[c].to_numpy() for c in ("_set", "_root", "n_shingles"))
            bits = rows["_bits"].to_pylist()
            if not stars:
                lists = rows["_bs"].combine_chunks()
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                bucket = lists.flatten().to_numpy()
            found = [np.zeros((4, 0), np.int64)]
            for lo, hi in zip(g[:-1].tolist(), g[1:].tolist(), strict=True):
                group = own[lo:hi], root[lo:hi], size[lo:hi], bits[lo:hi]
                if stars:
                    found += [np.stack(x) for x in star_of(*group)]
                else:
                    at = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1]))
                    found += [np.stack(x) for x in rest_of_all(*group, bucket[ends[lo]:ends[hi]], at)]
            a, r, b, apart = np.unique(np.concatenate(found, 1), axis=1)
            order = np.lexsort((b, apart, r, a))
            a, r, b = a[order], r[order], b[order]
            g = runs(a, r)
            return pa.RecordBatch.from_arrays([pa.array(a[g[:-1]]), pa.array(r[g[:-1]]), pa.ListArray.from_arrays(pa.array(g, pa.int32()), pa.array(b))], names=["a", "r", "bs"])

        for b in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
            name, share = held["_a"].to_numpy(), held["_share"].to_numpy()
            cut = int(((name != name[-1]) | (share != share[-1])).sum()) if len(name) else 0
            if cut:
                yield flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield flush(held)

    columns = ["_a", "_share", "_set", "_root", "n_shingles", "_bits"] + ["_bs"] * (not stars)
    dealt = rows.select(columns).repartition(F.col("_a"), F.col("_share")).sortWithinPartitions("_a", "_share")
    return dealt.mapInArrow(run, "a long, r long, bs array<long>")


def unlinked(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of least sets whose buckets' sets are in different components so far, with _root, and a
    row for each _share of their buckets."""
    rows = found.join(grown(labels), "_set", "left").withColumn("_root", F.coalesce("_root", "_set"))
    of_a = Window.partitionBy("_a")
    rows = rows.withColumn("_lo", F.min("_root").over(of_a)).withColumn("_hi", F.max("_root").over(of_a)).withColumn("_n", F.sum(F.size("_bs")).over(of_a))
    shares = F.expr(f"1 + _n div {SHARE}")
    rows = rows.filter("_lo < _hi").withColumn("_of", F.transform("_bs", lambda b: F.pmod(b, shares)))
    rows = rows.withColumn("_share", F.explode(F.array_distinct("_of")))
    return rows.withColumn("_bs", F.filter("_bs", lambda b: F.pmod(b, shares) == F.col("_share"))).select("_a", "_share", "_set", "_root", "_bs")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the row's component)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    table = materialize(described(docs), "sets")
    sets, texts = table.filter("_h is null").select("doc_id", "n_shingles", "_set"), table.filter("_z is not null")
    common = common_shingles(table, sets.count())
    found = materialize(buckets(sketched(texts, common, parts), parts), "buckets")
    bits = texts.select("_set", "n_shingles", "_bits").join(grown(found.select("_set").distinct()), "_set", "left_semi").dropDuplicates(["_set"])
    bits = materialize(bits, "bits")
    firsts = found.select("_a", "_set").join(bits, "_set").withColumn("_root", F.col("_set")).withColumn("_share", F.lit(0))
    stars = materialize(bucket_pairs(firsts, True), "candidates")  # linked() reads its pairs twice
    links = materialize(linked(stars.select("a", F.explode("bs").alias("b")).distinct(), texts), "stars")
    labels = components(links)
    more = bucket_pairs(unlinked(found, labels).join(bits, "_set"), False)  # tasks have much the same lists
    more = materialize(more.groupBy("a", "r").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")), "pairs")
    links = materialize(links.union(linked(more.select("a", F.col("bs")[0].alias("b")).distinct(), texts)), "stars")
    labels = components(links)
    for c in ("a", "r"):
        more = more.join(labels.select(F.col("_set").alias(c), F.col("_root").alias(f"_{c}")), c, "left")
    apart = more.filter(F.coalesce("_a", "a") != F.coalesce("_r", "r")).filter(F.size("bs") > 1)
    labels = components(links.union(linked(apart.select("a", F.explode(F.slice("bs", 2, 1 << 30)).alias("b")), texts)))
    least = sets.filter("_set is not null").groupBy("_set").agg(F.min("doc_id").alias("_least")).join(labels, "_set", "left").withColumn("_root", F.coalesce("_root", "_set"))
    of_root = least.groupBy("_root").agg(F.min("_least").alias("_first"))
    named = least.join(of_root, "_root").select("_set", "_first")
    return sets.join(named, "_set", "left").select("doc_id", "n_shingles", F.coalesce("_first", "doc_id").alias("component_id"))

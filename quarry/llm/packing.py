"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

The plan looks at counts only: for each length, longest first, all pieces of it
go to the open sequences with the least room that is enough, whole ranges of
sequences at a time.  It is a table (length, from rank, to rank, first sequence,
offset) whose size depends on the capacity and not on the documents, at most
capacity**2 rows.  Each piece then takes its slot by its rank among the pieces
of its length; ranks come from counts by block, so that a length which most
pieces have (a full sequence) is ranked by many tasks.

Defined results: null or empty text is the end id alone; a longer document is
cut so that its first piece may be shorter; repeated rows are packed each for
itself; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textbytes import chunks, column_of
from quarry.session import materialize

#: Pieces that are ranked together.
BLOCK_ROWS = 50_000


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """Encoder of a rank file; its special strings are one id each, inside texts too."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def cut(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(df: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...], end: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32 of each document's pieces."""
    schema = T.StructType([df.schema[key], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def run(batches):
        encode = rank_encoder(path, pattern, special).encode_to_numpy
        last = np.array([end], "<u4")
        for whole in batches:
            for b in chunks(whole, text):
                at, rows = [], []
                for row, x in enumerate(column_of(b, text).to_pylist()):
                    found = np.concatenate([encode(x or "", allowed_special="all").astype("<u4"), last])
                    starts = cut(len(found), capacity)
                    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(found)], strict=True)):
                        at.append(row)
                        part = found[lo:hi]
                        rows.append((k, lo, hi - lo, crc32(part.tobytes())))
                cols = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), [pa.field("", x) for x in (pa.int32(), pa.int64(), pa.int64(), pa.int64())], strict=True)]
                yield pa.RecordBatch.from_arrays([column_of(b, key).take(pa.array(at)), *cols], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit, longest first, over counts of lengths.

    Rows (length, from rank, to rank, first sequence, offset): the piece of rank r
    goes to sequence ``first + r - from``.  Also the number of sequences.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: ranges (first sequence, how many)
    sizes: list[int] = []  # the rooms there are, in order
    made = 0

    def put(left: int, lo: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append((lo, n))

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            i = bisect_left(sizes, length)
            if i < len(sizes):
                left = sizes[i]
                lo, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[i]
            else:
                left, lo, n = capacity, made, -(-(count - rank) // (capacity // length))
                made += n
            each = left // length  # equal pieces that one of these sequences takes
            full = min(n, (count - rank) // each)
            for j in range(each if full else 0):
                rows.append((length, rank, rank + full, lo, capacity - left + j * length))
                rank += full
            put(left - each * length, lo, full)
            if full < n:
                rest = min(each - 1, count - rank)
                for j in range(rest):
                    rows.append((length, rank, rank + 1, lo + full, capacity - left + j * length))
                    rank += 1
                put(left - rest * length, lo + full, 1 if rest else 0)
                put(left, lo + full + bool(rest), n - full - bool(rest))
    return np.array(rows, np.int64).reshape(-1, 5), made


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """parts (with doc_id, piece, length, ids_crc32) with sequence_id and offset.  Rows are
    dealt to blocks by a number of their own, so that equal rows are not in one."""
    spark = parts.sparkSession
    parts = materialize(parts.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    n = parts.count()
    blocks = max(1, n // BLOCK_ROWS)
    parts = parts.withColumn("_block", F.pmod(F.col("_at"), F.lit(blocks)))
    by_block = parts.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    plan, _ = best_fit_plan({r.length: r.n for r in by_block.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_block.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    here = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32", "_at")
    ranked = parts.withColumn("_rank", F.row_number().over(here) - F.lit(1)).join(ahead, ["length", "_block"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_ahead")).drop("_block", "_ahead", "_at")
    shared = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        rows = shared.value
        key = (rows[:, 0] << 48) + rows[:, 1]
        for b in batches:
            rank = column_of(b, "_rank").to_numpy()
            i = np.searchsorted(key, (column_of(b, "length").to_numpy() << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(column_of(b, f.name) for f in kept), pa.array(rows[i, 3] + rank - rows[i, 1]), pa.array(rows[i, 4])], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...], end: int, capacity: int) -> DataFrame:
    """Tokenize, cut and pack; one row per piece."""
    parts = pieces(df, path, pattern, special, end, capacity)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(parts, capacity).select(*cols)

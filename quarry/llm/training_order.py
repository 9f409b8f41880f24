"""Training order: every sequence gets a slot by a keyed permutation and is written there.

Documents' ids, each document's with the end id after them, are cut into sequences of
``capacity`` ids as they follow each other in a task, so that only a task's last sequence
is filled up.  Sequences are numbered 0 to N - 1 (rank in the task that made them, after
the counts of the tasks before).  A Feistel network over the next power of four is a
permutation; a value beyond N - 1 is put through it again until it is one of the N
(cycle walking), so that slots are a permutation of the numbers and any slot is
known without a shuffle of all of them.  Slots are dealt by range into shards of a
fixed number of records, and every record has the same number of bytes, so that a
reader goes to slot s at byte ``(s mod shard records) * stride`` of its shard, in
order or after a break.

A record is ``capacity`` unsigned 16-bit little-endian ids, filled up with the
end id, and one newline: Spark's text writer makes the files, with its commit.
Ids are stored and travel compressed, many sequences together: a task sends the records of
each task that writes as one block.  A few shards are one task's, however many there are.

Defined results: null or empty text is the end id alone; repeated rows are
pieces of their own; an empty table writes nothing; other columns are not
looked at; an id beyond 16 bits raises an error.
"""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.packing import rank_encoder
from quarry.llm.textbytes import chunks, column_of, mix
from quarry.session import ensure_checkpoint_dir

ROUNDS = 6
#: Shards that one task writes.
SHARDS = 2
#: Bytes of records that a task holds before it sends them, and how hard they are compressed.
HELD, LEVEL = 32 << 20, 9


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the numbers x of 0 to n - 1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (2**64 - 1)))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(df: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...], end: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each part of a document in a sequence: key, piece, length, ids_crc32, offset (place
    in the sequence), _task and _pos (the sequence: its place in the task that makes it) and,
    for a sequence's first part, ids (all of the sequence)."""
    longs = ("length", "ids_crc32", "offset")
    schema = T.StructType([df.schema[key], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("_task", T.IntegerType()), T.StructField("_pos", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        encode = rank_encoder(path, pattern, special).encode_to_numpy
        task, last = TaskContext.get().partitionId(), np.array([end], "<u4")
        keys, rows, parts, room, pos = [], [], [], capacity, 0  # of the sequences that are not given yet

        def out(full):
            """The rows of the sequences before ``pos``; full: those of which ids are known."""
            n = sum(r[5] < pos for r in rows)
            cols = list(zip(*rows[:n], strict=True))
            ids = [full[r[5]] if r[3] == 0 else None for r in rows[:n]]
            made = pa.RecordBatch.from_arrays([pa.concat_arrays(keys[:n]), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)), pa.array(ids, pa.binary())], names=schema.names)
            del keys[:n], rows[:n]
            return made

        for whole in batches:
            for b in chunks(whole, text):
                full = {}
                names = column_of(b, key)
                for i, x in enumerate(column_of(b, text).to_pylist()):
                    found = np.concatenate([encode(x or "", allowed_special="all").astype("<u4"), last])
                    if found.max() > 0xFFFF:
                        raise OverflowError(f"id {found.max()} does not fit 16 bits")
                    lo = piece = 0
                    while lo < len(found):
                        part = found[lo:lo + room]
                        keys.append(names.slice(i, 1))
                        rows.append((piece, len(part), crc32(part.tobytes()), capacity - room, task, pos))
                        parts.append(part.astype("<u2"))
                        room -= len(part)
                        lo, piece = lo + len(part), piece + 1
                        if not room:
                            full[pos] = np.concatenate(parts).tobytes()
                            parts, room, pos = [], capacity, pos + 1
                if full:
                    yield out(full)
        if parts:
            full = {pos: np.concatenate([*parts, np.full(room, end, "<u2")]).tobytes()}
            pos += 1
            yield out(full)

    return df.select(key, text).mapInArrow(run, schema)


def with_slots(table: DataFrame, key: int, shard_rows: int) -> DataFrame:
    """A written table of ``sequences``, with slot, shard and row (place in the shard)."""
    spark = table.sparkSession
    tasks = table.groupBy("_task").agg((F.max("_pos") + 1).alias("_n"))  # one row per task of the scan
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    total = tasks.agg(F.sum("_n")).first()[0] or 0
    counted = table.join(F.broadcast(tasks.select("_task", "_ahead")), "_task").withColumn("_at", F.col("_ahead") + F.col("_pos")).drop("_task", "_pos", "_ahead")
    kept = [f for f in counted.schema.fields if f.name != "_at"]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("slot", "shard", "row"))])

    def run(batches):
        for b in batches:
            slot = permuted(column_of(b, "_at").to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([*(column_of(b, f.name) for f in kept), pa.array(slot), pa.array(slot // shard_rows), pa.array(slot % shard_rows)], names=schema.names)

    return counted.mapInArrow(run, schema)


def stride(capacity: int) -> int:
    return 2 * capacity + 1


def write_order(df: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...], end: int, capacity: int, shard_rows: int, key: int) -> tuple[DataFrame, str]:
    """Tokenize, cut, permute and write; the manifest (doc_id, piece, length, ids_crc32, offset,
    slot, shard, row) and the folder of the shards (``shard=<number>/part-...``)."""
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/order-{uuid.uuid4().hex[:12]}"
    sequences(df, path, pattern, special, end, capacity).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(f"{root}/sequences")
    table = spark.read.parquet(f"{root}/sequences")
    slots = with_slots(table.filter("offset = 0").select("_task", "_pos", "ids"), key, shard_rows)
    total = table.filter("offset = 0").count()
    task_rows, size = shard_rows * SHARDS, 2 * capacity

    def blocks(batches):
        """(task, its slots, their records): the records that a task sends to each of those that write."""
        import zstandard

        pack, held, n = zstandard.ZstdCompressor(level=LEVEL).compress, [], 0

        def out():
            slot = np.concatenate([s for s, _ in held])
            records = np.frombuffer(b"".join(x for _, x in held), np.uint8).reshape(-1, size)
            order = np.argsort(slot)
            slot, records = slot[order], records[order]
            cut = np.flatnonzero(np.diff(slot // task_rows, prepend=-1, append=-1))
            parts = [(int(slot[lo]) // task_rows, slot[lo:hi].tobytes(), pack(records[lo:hi].tobytes())) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["_to", "slots", "records"])

        for b in batches:
            held.append((column_of(b, "slot").to_numpy(), b"".join(column_of(b, "ids").to_pylist())))
            n += len(held[-1][1])
            if n >= HELD:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def unpacked(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for slots, records in zip(column_of(b, "slots").to_pylist(), column_of(b, "records").to_pylist(), strict=True):
                slot, whole = np.frombuffer(slots, np.int64), unpack(records)
                yield pa.RecordBatch.from_arrays([pa.array(slot // shard_rows), pa.array(slot), pa.array([whole[i:i + size] for i in range(0, len(whole), size)], pa.binary())], names=["shard", "slot", "record"])

    dealt = slots.select("slot", "ids").mapInArrow(blocks, "_to int, slots binary, records binary").repartitionById(max(1, -(-total // task_rows)), F.col("_to"))
    records = dealt.mapInArrow(unpacked, "shard long, slot long, record binary").sortWithinPartitions("shard", "slot")
    records.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(f"{root}/shards")
    return with_slots(table.drop("ids"), key, shard_rows), f"{root}/shards"


def read_slots(spark: SparkSession, folder: str, capacity: int, shard_rows: int, lo: int, hi: int) -> DataFrame:
    """slot and ids (binary) of the slots lo to hi - 1, from the shards that hold them."""
    shards = spark.read.format("binaryFile").load(folder)  # the shard is a partition: others are not read
    files = shards.filter(F.col("shard").between(lo // shard_rows, (hi - 1) // shard_rows)).withColumn("shard", F.col("shard").cast("long"))
    rows = files.select("shard", "content", F.explode(F.sequence(F.lit(0), (F.length("content") / stride(capacity)).cast("int") - 1)).alias("row"))
    slot = F.col("shard") * shard_rows + F.col("row")
    return rows.select(slot.alias("slot"), F.substring(F.col("content"), F.col("row") * stride(capacity) + 1, F.lit(2 * capacity)).alias("ids")).filter((F.col("slot") >= lo) & (F.col("slot") < hi))

"""Texts that are no UTF-8, repeated and missing ids, and shards read and written by range."""

import itertools
import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.functions.text import valid_text
from quarry.operators import tokens as TK
from quarry.sources import readers as RD
from quarry.sources import shards as SH
from quarry.sources import sinks as SK


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="quarry-test-", dir="/tmp")


def as_text(spark, rows):
    """Rows (id, bytes) with the bytes as they are for text."""
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, b binary")
    return df.select("doc_id", F.col("b").cast("string").alias("text"))


def stream_of(rows):
    """The token stream of rows in order of id (none first), then digest."""
    from hashlib import md5, sha256
    key = lambda r: (r[0] is not None, r[0] or 0, md5(sha256(b"" if r[0] is None else f"={r[0]}".encode()).hexdigest().encode() + r[1]).digest())
    out = []
    for _, b in sorted(rows, key=key):
        text = b.decode("utf-8", errors="replace")
        if text.strip():
            out += [TK.BOS_ID, *text.encode(), TK.EOS_ID, 10]
    return out


def test_bad_bytes_as_python_replaces_them(spark):
    edge = [0x00, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    rows = [bytes(x) for n in (1, 2, 3) for x in itertools.product(edge, repeat=n)]
    rows += [bytes(x) + b"\x80z" for x in itertools.product([0xF0, 0xF1, 0xF4, 0xED], edge, [0x80, 0xBF, 0x41])]
    got = as_text(spark, list(enumerate(rows))).select("doc_id", valid_text("text").alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {i: b.decode("utf-8", errors="replace") for i, b in enumerate(rows)}


ROWS = [(1, b"aa"), (1, b"bb"), (None, b"cc"), (None, b"cc"), (2, b"ab\xff\xfecd"), (2, b"ab\xff\xfecd"), (3, b" \n"), (4, b""), (5, b"\xf0\x9f\x98 cut"), (6, "é€😀".encode())]


def test_counts_offsets_and_windows_are_of_the_same_bytes(spark):
    docs, stream = as_text(spark, ROWS), stream_of(ROWS)
    offsets = TK.token_offsets(docs).collect()
    assert len(offsets) == 8 and sum(r.n_tokens for r in offsets) == len(stream)
    assert {r.doc_id: r.n_tokens for r in offsets}[2] == 10 + 3
    stats = TK.corpus_token_stats(docs, []).first()
    assert (stats.files, stats.tokens) == (8, len(stream))
    for size, seq in ((17, 5), (1000, 7), (20, 20), (8, 3)):
        shards = [stream[i:i + size] for i in range(0, len(stream), size)]
        want = {}
        for s, ids in enumerate(shards):
            for w in range(max(1, len(ids) // seq)):
                part = ids[w * seq:w * seq + seq + 1]
                padded = part + [0] * (seq + 1 - len(part))
                want[s, w] = (len(part), padded[:-1], padded[1:])
        got = TK.pack_sequences(docs, seq, size).collect()
        assert {(r.shard_id, r.seq_no): (r.n_tokens, r.input_ids, r.labels) for r in got} == want
    assert TK.pack_sequences(docs.limit(0), 5, 17).count() == 0


@pytest.mark.parametrize("dtype", ["uint32", "uint16"])
def test_shards_hold_every_row_and_are_read_by_range(spark, tmp, dtype):
    stream, path = stream_of(ROWS), f"{tmp}/tokens"
    SK.write_token_shards(as_text(spark, ROWS), path, shard_size=16, dtype=dtype)
    assert sorted(os.listdir(path)) == ["meta.json", *(f"shard_{i:04d}.bin" for i in range(-(-len(stream) // 16)))]
    meta = json.load(open(f"{path}/meta.json"))
    assert meta["total_tokens"] == len(stream) and meta["total_files"] == meta["files_processed"] == 8
    assert meta["total_characters"] == sum(len(b.decode("utf-8", errors="replace")) for _, b in ROWS if b.strip())
    np.save(f"{path}/shard_zz.npy", np.arange(10, dtype=np.int16))
    open(f"{path}/shard_zzz.bin", "wb").write(b"\1\0\0\0\2\0\0\0\3"[:9 if dtype == "uint32" else 5])  # a part of an id at the end
    back = spark.read.format(SH.registered(spark)).option("dtype", dtype).option("block_tokens", 3).option("partition_bytes", 20).load(path)
    assert back.rdd.getNumPartitions() > len(stream) // 16 + 2
    rows = back.orderBy("shard_no", "start").collect()
    assert all(r.start == 3 * r.block and len(r.tokens) <= 3 for r in rows)
    extra = [*range(10), 1, 2] if dtype == "uint32" else [*range(10), 1, 0]
    assert [t for r in rows for t in r.tokens] == stream + extra


def test_small_shards_share_tasks(spark, tmp):
    """Many small shards are written and read by few tasks, block by block; large ones have tasks of their own."""
    rows = spark.range(400).select(F.col("id").alias("shard_id"), F.lit(0).cast("bigint").alias("start_in_shard"),
                                   F.encode(F.concat(F.char(F.col("id") % 50 + 65), F.lit("b")), "UTF-16LE").alias("ids"),
                                   F.lit(1).alias("files"), F.lit(2).cast("bigint").alias("characters"))
    assert SK._dealt(rows, 400, 2).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert SK._dealt(rows, 20, SK.TASK_TOKENS).rdd.getNumPartitions() == 20
    SK._save_shards(rows, f"{tmp}/tokens", 400, 2, "uint32")
    back = spark.read.format(SH.registered(spark)).option("block_tokens", 1).option("partition_bytes", 4).load(f"{tmp}/tokens")
    assert back.rdd.getNumPartitions() <= SH.PARTITIONS
    got = [(r.shard_no, r.block, r.start, r.tokens) for r in back.orderBy("shard_no", "block").collect()]
    assert got == [(i, b, b, [i % 50 + 65 if b == 0 else 98]) for i in range(400) for b in range(2)]


def test_a_failed_write_leaves_what_was_there(spark, tmp):
    path = f"{tmp}/tokens"
    SK.write_token_shards(as_text(spark, ROWS), path, shard_size=16)
    before = {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path)}
    bad = spark.range(3).select(F.col("id").alias("shard_id"), F.lit(0).cast("bigint").alias("start_in_shard"),
                                F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"\1\0")).alias("ids"),
                                F.lit(1).alias("files"), F.lit(1).cast("bigint").alias("characters"))
    with pytest.raises(PySparkException):
        SK._save_shards(bad, path, 3, 1, "uint32")
    gap = bad.filter("id <> 2").withColumn("shard_id", F.col("shard_id") * 2)  # a shard that is not there
    with pytest.raises(PySparkException):
        SK._save_shards(gap, path, 3, 1, "uint32")
    with pytest.raises(PySparkException):  # without leave to replace
        gap.write.format(SH.registered(spark)).mode("append").option("shard_size", 1).option("vocab_size", 268).save(path)
    assert {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path)} == before


def test_shorter_writes_leave_no_old_shards(spark, tmp):
    path = f"{tmp}/tokens"
    SK.write_token_shards(as_text(spark, ROWS), path, shard_size=8)
    again = SK.write_token_shards(as_text(spark, ROWS[:1]), path, shard_size=8)
    assert [(r.shard_id, r.n_tokens) for r in again.collect()] == [(0, 5)]
    assert sorted(os.listdir(path)) == ["meta.json", "shard_0000.bin"]
    assert SK.manifest_check(spark, path).first().consistent
    with pytest.raises(PySparkException):
        RD.read_token_shards(spark, f"{tmp}/nothing").count()


def test_commit_takes_each_shard_once(tmp):
    """Two attempts of a task: the one whose message counts is moved, the other's file goes."""
    import pyarrow as pa
    writer = SH.ShardWriter({"path": tmp, "shard_size": "4", "vocab_size": "268"}, True)
    batch = pa.RecordBatch.from_pydict({"shard_id": [0, 0], "start_in_shard": [0, 2], "ids": [b"\1\0\2\0", b"\3\0"], "files": [1, 0], "characters": [5, 0]})
    killed, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, None])
    assert killed.shards[0][1] != kept.shards[0][1]
    assert sorted(os.listdir(tmp)) == ["meta.json", "shard_0000.bin"]
    assert np.fromfile(f"{tmp}/shard_0000.bin", np.uint32).tolist() == [1, 2, 3]

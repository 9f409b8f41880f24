"""Sinks: JSONL text, uint32 token shards with meta.json, metric dumps.

Token shards: the packed stream (document order, documents spanning shards)
is cut into ``shard_size`` pieces with the two-phase offsets; a task for each
shard, or for a run of small ones, gets its pieces by position and streams them to the data source of
``sources.shards``, whose commit puts the shards and ``meta.json`` in place.
"""

from __future__ import annotations

import os
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import tokens as TK
from quarry.sources.shards import registered, store


def write_jsonl(df: DataFrame, text_col: str, path: str) -> dict:
    """{"text": ...} per line (non-ASCII kept); returns samples and characters,
    measured with ``observe`` during the write (no second pass)."""
    from pyspark.sql import Observation
    obs = Observation("jsonl")
    out = df.select(F.col(text_col).alias("text")).observe(
        obs, F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    out.write.mode("overwrite").json(path)
    return obs.get


def write_text_files(lines: DataFrame, path: str, file_col: str, value_col: str, order_cols: list[str]) -> int:
    """The lines (bytes) of each file, in order, as ``path/{file_col}={file}/lines.txt``; returns how
    many files.  ``path`` is in a store that all workers reach.  A task streams its files one
    after the other under names that no reader sees, and renames each when it is whole."""
    def run(batches):
        name, out, held, n = None, None, None, 0

        def close():
            out.close()
            files.move(held, posixpath.join(folder, "lines.txt"))

        try:
            for b in batches:
                for of, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if out is None or of != name:
                        if out is not None:
                            close()
                        name, n = of, n + 1
                        files, folder = store(posixpath.join(path, f"{file_col}={of}"))
                        files.create_dir(folder, recursive=True)
                        held = posixpath.join(folder, f"_{uuid.uuid4().hex}")
                        out = files.open_output_stream(held)
                    out.write((line or b"") + b"\n")
            if out is not None:
                close()
        finally:
            if out is not None and not out.closed:
                out.close()
                files.delete_file(held)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    name = F.coalesce(F.col(file_col).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("_file")
    rows = lines.select(name, F.col(value_col).cast("binary").alias("_value"), *order_cols)
    dealt = rows.repartition("_file").sortWithinPartitions("_file", *order_cols).select("_file", "_value")
    return dealt.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


#: Ids that a task writes, about: smaller shards that follow each other share a task.
TASK_TOKENS = 1 << 25


def _dealt(rows: DataFrame, shards: int, shard_size: int) -> DataFrame:
    """The rows by shard and place, each shard in one task.  Small shards share tasks once all
    cores have one: the tasks grow with the ids, not with the shards."""
    shards = max(1, shards)
    tasks = min(shards, max(rows.sparkSession.sparkContext.defaultParallelism, -(-shards * shard_size // TASK_TOKENS)))
    each = -(-shards // tasks)
    return rows.repartitionById(-(-shards // each), F.expr(f"CAST(shard_id DIV {each} AS INT)")).sortWithinPartitions("shard_id", "start_in_shard")


def _save_shards(rows: DataFrame, path: str, shards: int, shard_size: int, dtype: str) -> None:
    """Write (shard_id, start_in_shard, ids, files, characters)."""
    (_dealt(rows, shards, shard_size).write.format(registered(rows.sparkSession)).mode("overwrite").option("dtype", dtype)
     .option("shard_size", shard_size).option("vocab_size", TK.VOCAB_SIZE).save(path))


def write_token_shards(docs: DataFrame, out_dir: str, shard_size: int = TK.DEFAULT_SHARD_SIZE,
                       id_col: str = "doc_id", text_col: str = "text", add_bos: bool = True, add_eos: bool = True,
                       separator: str = "\n", dtype: str = "uint32") -> DataFrame:
    """Write ``shard_%04d.bin`` files and meta.json; returns (shard_id, n_tokens, path).

    ``out_dir`` is in a store that all workers reach; shards that it holds are replaced."""
    spark = docs.sparkSession
    rows, offsets = TK.laid_out(docs, id_col, text_col, add_bos, add_eos, separator)
    total = offsets.agg(F.sum("n_tokens")).first()[0] or 0
    _save_shards(TK.ids_in_shards(rows, shard_size), out_dir, -(-total // shard_size), shard_size, dtype)
    from quarry.sources.readers import list_files
    files = list_files(spark, out_dir, recursive=False, glob="shard_*.bin")
    return files.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("shard_id"),
                        (F.col("length") / np.dtype(dtype).itemsize).cast("long").alias("n_tokens"), "path")


def write_token_file(spark: SparkSession, input_file: str, output_file: str, add_bos: bool = True,
                     add_eos: bool = True) -> int:
    """One text file -> one .bin of its tokens; returns the token count."""
    text = spark.read.option("wholetext", True).text(input_file)
    ids = text.select(F.lit(0).cast("bigint").alias("shard_id"), F.lit(0).cast("bigint").alias("start_in_shard"),
                      TK.token_bytes("value", add_bos, add_eos).alias("ids"), F.lit(1).alias("files"), F.length("value").cast("bigint").alias("characters"))
    folder, name = os.path.split(output_file)
    (ids.write.format(registered(spark)).mode("overwrite").option("shard_size", 1 << 40).option("vocab_size", TK.VOCAB_SIZE)
     .option("file", name).save(folder or "."))
    return text.agg(F.sum(TK.byte_token_count("value", add_bos, add_eos))).first()[0] or 0


def manifest_check(spark: SparkSession, directory: str, bytes_per_token: int = 4) -> DataFrame:
    """meta.json total against the shard files' byte lengths (no content read)."""
    from quarry.sources.readers import list_files
    files = list_files(spark, directory, recursive=False).filter(F.col("ext") == ".bin")
    on_disk = files.agg(F.coalesce(F.sum(F.floor(F.col("length") / bytes_per_token)), F.lit(0)).cast("bigint").alias("tokens_on_disk"),
                        F.count(F.lit(1)).alias("files_on_disk"))
    meta = spark.read.option("multiLine", True).json(os.path.join(directory, "meta.json"))
    from quarry.plans.layout import attach_row
    j = attach_row(on_disk, meta.select("total_tokens", "num_shards"))
    return j.withColumn("consistent", (F.col("tokens_on_disk") == F.col("total_tokens")) &
                        (F.col("files_on_disk") == F.col("num_shards")))


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """Dump logged metric events (one JSON object per line)."""
    metrics.write.mode("overwrite").json(path)


def save_vocab(spark: SparkSession, path: str) -> None:
    TK.vocab_table(spark).coalesce(1).write.mode("overwrite").json(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id int").json(path)

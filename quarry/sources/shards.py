"""Token shards as a data source: read by byte range, written with a commit.

Reading: a shard (``.bin``, flat ids; ``.npy``, one array) is cut into ranges of whole
blocks, so that neither a shard nor a share of one is ever a row.  A range is an input
partition; beyond ``partitions`` of them, small ranges that follow each other share one.  Writing: each task streams its shards into files of its own attempt; the commit
moves those of the attempts that count to ``shard_%04d.bin`` and writes ``meta.json``
last, so that a reader who sees it sees all shards, and a failed or killed attempt
leaves nothing behind.

Python workers open the files, by the path's scheme (local or mounted folders, HDFS,
S3, GCS), so the store must be one that they can reach.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "token_shards"
#: Names of the files.
EXTENSIONS = (".bin", ".npy")
META = "meta.json"
SHARD = re.compile(r"shard_\d{4,}\.bin")
#: Ids of a row, and bytes of an input partition, unless options say otherwise.
BLOCK_TOKENS, PARTITION_BYTES = 1 << 20, 64 << 20
#: Input partitions, unless an option says otherwise, before small ranges share one.
PARTITIONS = 128
#: Ids of a batch of rows, if blocks are smaller.
BATCH_TOKENS = 1 << 18
READ_SCHEMA = "path string, shard_no long, block long, start long, tokens array<long>"
WRITE_COLUMNS = ("shard_id", "start_in_shard", "ids", "files", "characters")


def store(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def shard_name(n: int) -> str:
    return f"shard_{n:04d}.bin"


@dataclass
class Range:
    """Whole blocks of a shard: bytes from ``at``, which is id ``start`` of the shard."""

    path: str
    shard_no: int
    dtype: str
    at: int
    start: int
    ids: int


@dataclass
class Ranges(InputPartition):
    """Ranges that follow each other."""

    ranges: list[Range]


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.dtype = np.dtype(options.get("dtype", "uint32")).str
        self.block = int(options.get("block_tokens", BLOCK_TOKENS))
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.few = max(1, int(options.get("partitions", PARTITIONS)))

    def layout(self, files, info) -> tuple[str, int, int]:
        """Type of a shard's ids, its first byte of ids, and how many there are."""
        if info.path.endswith(".bin"):
            return self.dtype, 0, info.size // np.dtype(self.dtype).itemsize
        with files.open_input_file(info.path) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, _, dtype = read(f)
            return dtype.str, f.tell(), shape[0] if shape else 1

    def partitions(self):
        from pyarrow import fs

        files, base = store(self.path)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        shards = sorted((i for i in found if i.is_file and i.path.endswith(EXTENSIONS)), key=lambda i: i.base_name)
        if not shards:
            raise ValueError(f"No token files found in {self.path}")
        out = []
        for no, info in enumerate(shards):
            dtype, at, n = self.layout(files, info)
            size = np.dtype(dtype).itemsize
            step = max(1, self.bytes // (size * self.block)) * self.block
            name = self.path.rstrip("/") + "/" + info.base_name
            out += [Range(name, no, dtype, at + size * lo, lo, min(step, n - lo)) for lo in range(0, n, step)]
        held = sum(r.ids * np.dtype(r.dtype).itemsize for r in out)
        each = max(1, -(-len(out) // max(self.few, -(-held // PARTITION_BYTES))))
        return [Ranges(out[i:i + each]) for i in range(0, len(out), each)]

    def read(self, part: Ranges):
        for r in part.ranges:
            yield from self.rows(r)

    def rows(self, part: Range):
        files, path = store(part.path)
        size = np.dtype(part.dtype).itemsize
        some = max(1, BATCH_TOKENS // self.block) * self.block
        with files.open_input_file(path) as f:
            f.seek(part.at)
            for lo in range(0, part.ids, some):
                n = min(some, part.ids - lo)
                ids = np.frombuffer(f.read(size * n), part.dtype).astype(np.int64)
                if len(ids) < n:
                    raise OSError(f"{part.path} ended before id {part.start + lo + n}")
                at = np.arange(0, n, self.block)
                start = part.start + lo + at
                row = {"path": pa.array([part.path] * len(at)), "shard_no": pa.array([part.shard_no] * len(at), pa.int64()), "block": pa.array(start // self.block), "start": pa.array(start)}
                yield pa.RecordBatch.from_arrays([*row.values(), pa.ListArray.from_arrays(pa.array(np.append(at, n), pa.int32()), pa.array(ids))], names=[*row, "tokens"])


@dataclass
class Written(WriterCommitMessage):
    """A task's shards, as (number, file, ids), and what they were made of."""

    shards: list[tuple[int, str, int]] = field(default_factory=list)
    files: int = 0
    characters: int = 0


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dtype = options["path"].rstrip("/"), np.dtype(options.get("dtype", "uint32")).str
        self.shard_size = int(options["shard_size"])
        self.meta = {"shard_size": self.shard_size, "vocab_size": int(options["vocab_size"]), "dtype": options.get("dtype", "uint32")}
        self.overwrite, self.file = overwrite, options.get("file")
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"  # of this job; attempts add names of their own

    def write(self, iterator):
        files, folder = store(self.temporary)
        files.create_dir(folder, recursive=True)
        attempt, done, out, held = uuid.uuid4().hex, Written(), None, None
        try:
            for b in iterator:
                cols = [b.column(b.schema.get_field_index(c)) for c in WRITE_COLUMNS]
                done.files += sum(cols[3].to_pylist())
                done.characters += sum(cols[4].to_pylist())
                for shard, start, ids in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2], strict=True):
                    if held is None or shard != held[0]:
                        if out is not None:
                            out.close()
                            done.shards.append(tuple(held))
                        held = [shard, posixpath.join(self.temporary, f"{shard_name(shard)}.{attempt}"), 0]
                        out = files.open_output_stream(store(held[1])[1])
                    if start != held[2]:
                        raise ValueError(f"shard {shard}: ids from {start} follow {held[2]} ids")
                    ids = np.frombuffer(ids.as_buffer(), "<u2")
                    out.write(ids.astype(self.dtype).tobytes())
                    held[2] += len(ids)
            if out is not None:
                out.close()
                done.shards.append(tuple(held))
                out = None
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages):
        from pyarrow import fs

        done = [m for m in messages if m is not None]
        shards = sorted(s for m in done for s in m.shards)
        full = all(n == self.shard_size for _, _, n in shards[:-1])
        if [n for n, _, _ in shards] != list(range(len(shards))) or not full:
            self.abort(messages)
            raise ValueError("shards are missing, twice there, or not full")
        files, base = store(self.path)
        files.create_dir(base, recursive=True)
        if self.file is not None:  # one file under a name of its own, without meta.json
            for _, temporary, _ in shards[:1]:
                files.move(store(temporary)[1], posixpath.join(base, self.file))
            self.abort(messages)
            if len(shards) > 1:
                raise ValueError(f"{self.file} would hold {len(shards)} shards")
            return
        old = [i.path for i in files.get_file_info(fs.FileSelector(base)) if i.base_name == META or SHARD.fullmatch(i.base_name)]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds shards")
        for path in sorted(old, key=lambda p: not p.endswith(META)):  # what says that all is there goes first
            files.delete_file(path)
        for n, temporary, _ in shards:
            files.move(store(temporary)[1], posixpath.join(base, shard_name(n)))
        total = sum(m.files for m in done)
        meta = {"total_tokens": sum(n for _, _, n in shards), "total_characters": sum(m.characters for m in done), "total_files": total, "num_shards": len(shards), **self.meta, "files_processed": total}
        folder = store(self.temporary)[1]
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(posixpath.join(folder, META)) as f:
            f.write(json.dumps(meta, indent=2).encode())
        files.move(posixpath.join(folder, META), posixpath.join(base, META))
        files.delete_dir(folder)

    def abort(self, messages):
        from pyarrow import fs

        files, folder = store(self.temporary)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class TokenShards(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return ShardReader(dict(self.options))

    def writer(self, schema, overwrite):
        missing = set(WRITE_COLUMNS) - set(schema.names)
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
        return ShardWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> str:
    """The format's name, after the session and its workers know it."""
    from quarry.session import prepare

    prepare(spark)
    spark.dataSource.register(TokenShards)
    return FORMAT

"""Tokenization, packing and corpus layout.

The token stream is the concatenation, in document order, of
``[BOS] + bytes(text) + [EOS] + bytes(separator)`` per non-blank document.
It is cut every ``shard_size`` tokens (documents span shards) and every
shard is cut into training windows of ``seq_len + 1`` tokens that overlap by
one token.

Text that is no UTF-8 is repaired as Python does it before it is counted or cut.
Rows are told apart by a digest of id and text, so that repeated ids are documents
of their own, equal rows follow each other, and rows without an id come first.

Plan shape (no step gathers a shard or the stream in one place):
  1. token counts per document from byte lengths (narrow scan),
  2. global offsets by a two-phase prefix sum (``plans.layout.running_sum``),
  3. per shard sizes from the total (all but the last are full),
  4. documents joined to their offsets by digest, tokenized once into two bytes an
     id (``token_bytes``), and cut with ``substring`` into the (shard, window) pieces
     they feed, which alone go on,
  5. ``groupBy(shard, window)`` gathers at most ``seq_len + 1`` tokens; bytes become
     arrays of ids last.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import col_, is_blank, valid_text
from quarry.plans.layout import default_parts, running_sum, segmented_fold

# The reference's special tokens, in id order (byte vocabulary
# places them at 256 + index).
SPECIAL_TOKENS = [
    "<|endoftext|>",
    "<|beginoftext|>",
    "<|reasoning|>",
    "<|verified|>",
    "<|think|>",
    "<|/think|>",
    "<|answer|>",
    "<|code|>",
    "<|/code|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
]
BYTE_BASE = 256
EOS_ID = BYTE_BASE + SPECIAL_TOKENS.index("<|endoftext|>")     # 256, also pad of the tokenizer
BOS_ID = BYTE_BASE + SPECIAL_TOKENS.index("<|beginoftext|>")   # 257
VOCAB_SIZE = BYTE_BASE + len(SPECIAL_TOKENS)
DEFAULT_SHARD_SIZE = 100_000_000


# --------------------------------------------------------------- tokenizers

def utf8_bytes(text) -> Column:
    """UTF-8 bytes of a string as ARRAY<INT> (0..255), natively.

    Bytes are re-read as ISO-8859-1 so each byte is one character whose code
    point equals the byte value.
    """
    t = valid_text(text)
    latin = F.decode(t.cast("binary"), "ISO-8859-1")
    arr = F.transform(F.split(latin, ""), lambda c: F.ascii(c))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.array().cast("array<int>")).otherwise(arr)


def byte_tokens(text, add_bos: bool = False, add_eos: bool = False, separator: str | None = None) -> Column:
    """Byte-level encode: [BOS] + utf8 + [EOS] (+ separator bytes after EOS)."""
    parts = []
    if add_bos:
        parts.append(F.array(F.lit(BOS_ID)))
    parts.append(utf8_bytes(text))
    if add_eos:
        parts.append(F.array(F.lit(EOS_ID)))
        if separator:
            parts.append(F.array(*[F.lit(b) for b in separator.encode("utf-8")]))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def byte_token_count(text, add_bos: bool = False, add_eos: bool = False, separator: str | None = None) -> Column:
    """Length of ``byte_tokens`` without building the array."""
    n = F.octet_length(valid_text(text)).cast("bigint")
    extra = int(add_bos) + (1 + len((separator or "").encode("utf-8")) if add_eos else 0)
    return n + F.lit(extra)


def token_bytes(text, add_bos: bool = False, add_eos: bool = False, separator: str | None = None) -> Column:
    """``byte_tokens`` as BINARY, two bytes (little-endian) an id: a text whose characters are
    the ids, in UTF-16."""
    parts = [F.decode(valid_text(text).cast("binary"), "ISO-8859-1")]
    if add_bos:
        parts.insert(0, F.lit(chr(BOS_ID)))
    if add_eos:
        parts.append(F.lit(chr(EOS_ID) + "".join(map(chr, (separator or "").encode("utf-8")))))
    return F.encode(F.concat(*parts), "UTF-16LE")


def _marker_regex() -> str:
    import re
    return "|".join(re.escape(m) for m in SPECIAL_TOKENS)


def encode_with_specials(text, add_bos: bool = False, add_eos: bool = False) -> Column:
    """Byte encode with special markers recognised, earliest occurrence first.

    Text is split around markers; pieces are byte-encoded and each marker is
    replaced by its id.  (The reference scans markers in list order; we take
    them in text order, which is what a reader of the text expects.)
    """
    t = valid_text(text)
    rx = _marker_regex()
    pieces = F.split(t, rx)
    markers = F.regexp_extract_all(t, F.lit(f"({rx})"), 1)
    ids = F.create_map(*[x for i, m in enumerate(SPECIAL_TOKENS) for x in (F.lit(m), F.lit(BYTE_BASE + i))])
    # pieces has one element more than markers; zip_with pads markers with a null
    body = F.flatten(F.zip_with(pieces, markers, lambda p, m: F.concat(
        utf8_bytes(p),
        F.when(m.isNull(), F.array().cast("array<int>")).otherwise(F.array(F.element_at(ids, m))))))
    body = F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.array().cast("array<int>")).otherwise(body)
    parts = ([F.array(F.lit(BOS_ID))] if add_bos else []) + [body] + ([F.array(F.lit(EOS_ID))] if add_eos else [])
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def detokenize_bytes(ids: pd.Series, skip_special: bool = True) -> pd.Series:
    """ids -> text: regular ids as bytes (invalid UTF-8 replaced), specials kept or skipped.

    A special id ends a stretch of bytes, so that no character is read across it; other
    ids outside the vocabulary are left out."""
    def text(a):
        if a is None:
            return None
        a = np.asarray(a, np.int64)
        a = a[(a >= 0) & (a < VOCAB_SIZE)]
        marks = np.flatnonzero(a >= BYTE_BASE)
        stretches = [x.astype(np.uint8).tobytes().decode("utf-8", errors="replace") for x in np.split(np.where(a < BYTE_BASE, a, 0), marks)]
        names = [] if skip_special else [SPECIAL_TOKENS[i - BYTE_BASE] for i in a[marks].tolist()]
        # each stretch but the first begins with its mark's place (a zero byte)
        rest = [x[1:] for x in stretches[1:]]
        return stretches[0] + "".join((names[i] if names else "") + x for i, x in enumerate(rest))

    return pd.Series([text(a) for a in ids], dtype=object)


@F.pandas_udf(T.StringType())
def detokenize(ids: pd.Series) -> pd.Series:
    """Arrow-batched decode (special tokens skipped)."""
    return detokenize_bytes(ids, True)


@F.pandas_udf(T.StringType())
def detokenize_keep_special(ids: pd.Series) -> pd.Series:
    """Arrow-batched decode keeping special markers as text."""
    return detokenize_bytes(ids, False)


def bpe_tokenize(text, encoding: str = "cl100k_base") -> Column:
    """BPE ids via tiktoken in an Arrow UDF (the encoder loads once per worker).

    Needs the encoding's vocabulary to be available to tiktoken offline.
    """
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _enc(s: pd.Series) -> pd.Series:
        import tiktoken
        enc = tiktoken.get_encoding(encoding)
        return pd.Series([None if x is None else enc.encode_ordinary(x) for x in s])
    return _enc(col_(text))


def vocab_table(spark) -> DataFrame:
    """Special tokens and their ids (12 rows; safe to broadcast)."""
    return spark.createDataFrame([(m, BYTE_BASE + i) for i, m in enumerate(SPECIAL_TOKENS)],
                                 "token string, id int")


def token_estimate(text) -> Column:
    """max(1, len(text) // 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(col_(text)) / 4).cast("int"))


# ----------------------------------------------------------------- layout

def _row_key(id_col: str, text_col: str) -> Column:
    """A digest of id and text: rows that differ have different ones."""
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(F.sha2(name, 256), F.col(text_col))))


def _row_offsets(docs: DataFrame, id_col: str, text_col: str, add_bos: bool, add_eos: bool, separator: str) -> DataFrame:
    """(_key, id, n_chars, n_tokens, offset) of each row that is not blank, in order of id, then key."""
    counts = (docs.filter(~is_blank(text_col))
              .select(id_col, _row_key(id_col, text_col).alias("_key"), F.length(valid_text(text_col)).cast("bigint").alias("n_chars"),
                      byte_token_count(text_col, add_bos, add_eos, separator).alias("n_tokens")))
    ends = running_sum(counts, [id_col, "_key"], "n_tokens", "_end")
    return ends.withColumn("offset", F.col("_end") - F.col("n_tokens")).drop("_end")


def token_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  add_bos: bool = True, add_eos: bool = True, separator: str = "\n") -> DataFrame:
    """(id, n_chars, n_tokens, offset): global start of each document's tokens.

    Blank documents are skipped (they produce no record when read).  Offsets
    come from the two-phase prefix sum, never a single-partition window.
    """
    return _row_offsets(docs, id_col, text_col, add_bos, add_eos, separator).select(id_col, "n_chars", "n_tokens", "offset")


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add_bos: bool = True,
             add_eos: bool = True, separator: str = "\n") -> tuple[DataFrame, DataFrame]:
    """(offset, n_tokens, n_chars, ids) of each document, ids as in ``token_bytes``, and the
    offsets that it was made with.  Equal rows are joined once and follow each other."""
    offsets = _row_offsets(docs, id_col, text_col, add_bos, add_eos, separator)
    places = offsets.groupBy("_key").agg(F.min("offset").alias("_at"), F.first("n_tokens").alias("n_tokens"),
                                         F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("_copies"))
    texts = (docs.filter(~is_blank(text_col)).select(_row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
             .groupBy("_key").agg(F.first("_text").alias("_text")))
    joined = texts.join(places, "_key").withColumn("ids", token_bytes("_text", add_bos, add_eos, separator))
    each = joined.select("n_tokens", "n_chars", "ids", "_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("_n"))
    return each.select((F.col("_at") + F.col("_n") * F.col("n_tokens")).alias("offset"), "n_tokens", "n_chars", "ids"), offsets


def cut_ids(ids, start, length) -> Column:
    """``length`` ids from ``start`` on of ids of two bytes."""
    return F.substring(col_(ids), (start * 2 + 1).cast("int"), (length * 2).cast("int"))


def shard_pieces(offsets: DataFrame, shard_size: int, id_col: str = "doc_id") -> DataFrame:
    """Cut documents at shard boundaries: (id, shard_id, start_in_shard, doc_from, length)."""
    S = F.lit(shard_size).cast("bigint")
    off, n = F.col("offset"), F.col("n_tokens")
    x = offsets.filter(n > 0).select(
        id_col, "offset", "n_tokens",
        F.explode(F.sequence(F.floor(off / S).cast("bigint"), F.floor((off + n - 1) / S).cast("bigint"))).alias("shard_id"))
    lo = F.greatest(off, F.col("shard_id") * S)
    hi = F.least(off + n, (F.col("shard_id") + 1) * S)
    return x.select(id_col, "shard_id", (lo - F.col("shard_id") * S).alias("start_in_shard"),
                    (lo - off).alias("doc_from"), (hi - lo).alias("length"))


def shard_sizes(pieces: DataFrame) -> DataFrame:
    """Tokens per shard (one row per shard)."""
    return pieces.groupBy("shard_id").agg(F.sum("length").alias("shard_tokens"))


def ids_in_shards(rows: DataFrame, shard_size: int) -> DataFrame:
    """(shard_id, start_in_shard, ids, files, characters): the pieces of the documents' ids by
    shard; a document's first piece counts it and its characters."""
    S = F.lit(shard_size).cast("bigint")
    off, n = F.col("offset"), F.col("n_tokens")

    def piece(shard):
        lo = F.greatest(off, shard * S)
        hi = F.least(off + n, (shard + 1) * S)
        first = lo == off
        return F.struct(shard.alias("shard_id"), (lo - shard * S).alias("start_in_shard"), cut_ids("ids", lo - off, hi - lo).alias("ids"),
                        first.cast("int").alias("files"), F.when(first, F.col("n_chars")).otherwise(0).alias("characters"))

    shards = F.sequence(F.floor(off / S).cast("bigint"), F.floor((off + n - 1) / S).cast("bigint"))
    return rows.select(F.explode_outer(F.transform(shards, piece)).alias("p")).filter("p IS NOT NULL").select("p.*")


def _window_pieces(rows: DataFrame, seq_len: int, shard_size: int) -> DataFrame:
    """(shard_id, window, pos, piece): each (document, shard) piece cut into the windows it feeds.

    A token at shard position p feeds window p // L, and also window
    p // L - 1 when p is a positive multiple of L (the overlap token).
    """
    L = F.lit(seq_len).cast("bigint")
    la, lb = F.col("start_in_shard"), F.col("start_in_shard") + F.length("ids") / 2
    w_lo = F.greatest(F.lit(0).cast("bigint"), F.floor((la - 1) / L).cast("bigint"))
    w_hi = F.floor((lb - 1) / L).cast("bigint")

    def piece(w):
        ws = F.greatest(w * L, la)
        we = F.least(w * L + L + 1, lb.cast("bigint"))
        return F.struct(w.alias("window"), ws.alias("pos"), cut_ids("ids", ws - la, we - ws).alias("piece"))

    cut = rows.select("shard_id", F.explode_outer(F.transform(F.sequence(w_lo, w_hi), piece)).alias("p")).filter("p IS NOT NULL")
    return cut.select("shard_id", "p.*").filter(F.length("piece") > 0)


def pack_sequences(docs: DataFrame, seq_len: int, shard_size: int = DEFAULT_SHARD_SIZE,
                   id_col: str = "doc_id", text_col: str = "text", add_bos: bool = True,
                   add_eos: bool = True, separator: str = "\n", min_tokens: int = 0) -> DataFrame:
    """Training windows (shard_id, seq_no, n_tokens, input_ids, labels).

    Per shard of n tokens: max(1, n // L) windows, window i = tokens
    [iL, iL + L] (L + 1 tokens), zero padded, input_ids = w[:-1],
    labels = w[1:].  ``min_tokens`` drops windows with fewer real tokens
    (2 for the streaming reader).
    """
    rows, offsets = laid_out(docs, id_col, text_col, add_bos, add_eos, separator)
    total = offsets.agg(F.sum("n_tokens")).first()[0] or 0
    last = total // shard_size  # the only shard that is not full
    in_last = max(1, (total - last * shard_size) // seq_len)
    pieces = _window_pieces(ids_in_shards(rows, shard_size), seq_len, shard_size)
    windows = F.when(F.col("shard_id") == last, in_last).otherwise(max(1, shard_size // seq_len))
    n = max(default_parts(docs), -(-total // IDS_A_TASK))
    grouped = (pieces.filter(F.col("window") < windows).repartition(n, "shard_id", "window").groupBy("shard_id", "window")
               .agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("_p")))
    whole = F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    flat = grouped.select("shard_id", F.col("window").alias("seq_no"), whole.alias("_w"))
    if min_tokens:
        flat = flat.filter(F.length("_w") >= 2 * min_tokens)

    def to_ids(batches):
        for b in batches:
            cells = b.column("_w").to_pylist()
            ids = np.frombuffer(b"".join(w.ljust(2 * (seq_len + 1), b"\0") for w in cells), "<u2").astype(np.int32).reshape(-1, seq_len + 1)
            at = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * seq_len)
            lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (ids[:, :-1], ids[:, 1:])]
            yield pa.RecordBatch.from_arrays([b.column("shard_id"), b.column("seq_no"), pa.array([len(w) // 2 for w in cells], pa.int32()), *lists],
                                             names=["shard_id", "seq_no", "n_tokens", "input_ids", "labels"])

    # ids stay INT (the vocabulary is far below 2^31); cast at the consumer if 64-bit ids are required
    return flat.mapInArrow(to_ids, "shard_id long, seq_no long, n_tokens int, input_ids array<int>, labels array<int>")


def seeded_key(seed: int, *cols) -> Column:
    """Deterministic shuffle key: md5 of 'seed:v1:v2...' (portable across engines)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


#: Windows that a task holds, about, while they are put in order; ids of pieces that a task gathers.
WINDOWS_A_TASK, IDS_A_TASK = 20_000, 1 << 25


def stream_order(windows: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """Seeded shard order, then seeded window order inside each shard, as a
    global position computed block-wise (``stream_pos``, 1-based).

    Windows are written once; their keys alone are put in order, and meet them again in as many tasks
    as the windows ask for."""
    from quarry.plans.layout import global_row_number
    from quarry.session import materialize
    held = materialize(windows.withColumn("_row", F.monotonically_increasing_id()), "windows")
    n = max(default_parts(held), -(-held.count() // WINDOWS_A_TASK))
    keyed = held.select("_row", "shard_id", "seq_no", seeded_key(seed * 1000 + epoch, "shard_id").alias("_a"),
                        seeded_key(seed * 1000 + epoch, "shard_id", "seq_no").alias("_b"))
    places = global_row_number(keyed, ["_a", "_b", "shard_id", "seq_no"], "stream_pos").select("_row", "stream_pos")
    return held.repartition(n, "_row").join(places, "_row").drop("_row")


def estimate_sequences(shard_tokens: DataFrame, seq_len: int) -> DataFrame:
    """Sum over shards of max(1, tokens // L) (one row)."""
    per = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("shard_tokens") / seq_len).cast("bigint"))
    return shard_tokens.agg(F.sum(per).cast("bigint").alias("num_sequences"),
                            F.count(F.lit(1)).cast("bigint").alias("num_shards"),
                            F.sum("shard_tokens").cast("bigint").alias("total_tokens"))


def corpus_token_stats(docs: DataFrame, group_cols: list[str], shard_size: int = DEFAULT_SHARD_SIZE,
                       text_col: str = "text", add_bos: bool = True, add_eos: bool = True,
                       separator: str = "\n") -> DataFrame:
    """files, characters, tokens, chars/token, shards, bytes; one pass with GROUPING SETS
    (each group column alone, plus the grand total)."""
    base = docs.filter(~is_blank(text_col)).select(
        *group_cols, F.length(valid_text(text_col)).cast("bigint").alias("_c"),
        byte_token_count(text_col, add_bos, add_eos, separator).alias("_t"))
    if group_cols:
        sets = [[F.col(c)] for c in group_cols] + [[]]
        agg = base.groupingSets(sets, *group_cols).agg(
            F.count(F.lit(1)).cast("bigint").alias("files"), F.sum("_c").cast("bigint").alias("characters"),
            F.sum("_t").cast("bigint").alias("tokens"))
    else:
        agg = base.agg(F.count(F.lit(1)).cast("bigint").alias("files"), F.sum("_c").cast("bigint").alias("characters"),
                       F.sum("_t").cast("bigint").alias("tokens"))
    return agg.select(
        *group_cols, "files", "characters", "tokens",
        F.when(F.col("tokens") == 0, F.lit(0.0)).otherwise(F.col("characters") / F.col("tokens")).alias("chars_per_token"),
        F.ceil(F.col("tokens") / shard_size).cast("bigint").alias("shards"),
        (F.col("tokens") * 4).cast("bigint").alias("bytes"))


# ----------------------------------------------------------------- batches

def pad_to_max(df: DataFrame, batch_col: str, seq_col: str, pad_id: int = 0) -> DataFrame:
    """Pad each sequence to the longest sequence of its batch."""
    w = Window.partitionBy(batch_col)
    m = F.max(F.size(seq_col)).over(w)
    seq = F.col(seq_col).cast("array<bigint>")
    return df.withColumn(seq_col, F.concat(seq, F.array_repeat(F.lit(pad_id).cast("bigint"), m - F.size(seq))))


def pad_to_length(seq, target_len: int, pad_id: int = 0) -> Column:
    """Truncate or pad a sequence to exactly ``target_len``."""
    s = F.slice(col_(seq), 1, target_len)
    return F.concat(s, F.array_repeat(F.lit(pad_id), F.lit(target_len) - F.size(s)))


def make_batches(df: DataFrame, order_cols: list[str], batch_size: int, seed: int) -> DataFrame:
    """Seeded shuffle, consecutive batches, last partial batch dropped.

    The shuffle position is a global row number over a seeded hash, computed
    block-wise (no single-partition window).
    """
    from quarry.plans.layout import global_row_number
    keyed = df.withColumn("_h", seeded_key(seed, *order_cols))
    numbered = global_row_number(keyed, ["_h", *order_cols], "_pos")
    return (numbered.withColumn("batch_id", F.floor((F.col("_pos") - 1) / batch_size).cast("bigint"))
            .withColumn("batch_pos", ((F.col("_pos") - 1) % batch_size).cast("bigint"))
            .withColumn("_bn", F.count(F.lit(1)).over(Window.partitionBy("batch_id")))
            .filter(F.col("_bn") == batch_size).drop("_bn", "_h", "_pos"))


def queue_batch_size(depth, max_batch_size: int) -> Column:
    """Batch size for a queue depth: <=1 -> 1, <=4 -> min(d,4), <=16 -> min(d,8),
    <=64 -> min(d,16), else min(d, max)."""
    d = col_(depth)
    return (F.when(d <= 1, F.lit(1))
            .when(d <= 4, F.least(d, F.lit(4)))
            .when(d <= 16, F.least(d, F.lit(8)))
            .when(d <= 64, F.least(d, F.lit(16)))
            .otherwise(F.least(d, F.lit(max_batch_size))))


def length_batch_plan(requests: DataFrame, group_col: str, id_col: str, length_col: str,
                      batch_size: int) -> DataFrame:
    """Order requests by prompt length (then id) inside a group and cut batches;
    report padding waste = max(len) * n - sum(len) per batch."""
    from quarry.plans.layout import running_sum
    # per-group row number, computed block-wise so a huge queue is not one task
    numbered = running_sum(requests.withColumn("_one", F.lit(1)), [group_col, length_col, id_col], "_one",
                           "_rn", inclusive=False, partition_cols=[group_col])
    b = numbered.withColumn("batch_no", F.floor(F.col("_rn") / batch_size).cast("bigint"))
    return (b.groupBy(group_col, "batch_no").agg(
        F.count(F.lit(1)).cast("bigint").alias("batch_size"),
        F.max(length_col).cast("bigint").alias("max_len"),
        F.sum(length_col).cast("bigint").alias("sum_len"))
        .withColumn("padding_waste", F.col("max_len") * F.col("batch_size") - F.col("sum_len")))


def batch_size_for(depth: int, max_batch_size: int) -> int:
    """``queue_batch_size`` of a number."""
    most = next((size for upto, size in ((1, 1), (4, 4), (16, 8), (64, 16)) if depth <= upto), max_batch_size)
    return min(max(depth, 1), most)


def queue_replay(requests: DataFrame, queue_col: str, id_col: str, ts_col: str, length_col: str, slot_seconds: int,
                 timeout_seconds: int, max_batch_size: int) -> DataFrame:
    """Replay a queue whose batch size depends on how many requests wait when it is looked at.

    At the end of each slot the requests that came until then and are not older than the
    timeout wait; of those as many as ``queue_batch_size`` of their number says are one
    batch: all, in order of arrival, or else the shortest.  What is left waits for the
    next slot.  Returns (id, queue, slot, depth, batch_size, place, length) of each
    request; slot to place are NULL for one that no batch took.

    What waits is a queue's state; it knows nothing any more after a gap of the timeout
    and a slot, so that a busy queue is cut at such gaps and replayed by many tasks."""
    from heapq import heappop, heappush

    slot, timeout = slot_seconds * 1_000_000, timeout_seconds * 1_000_000
    rows = requests.select(id_col, queue_col, F.unix_micros(F.col(ts_col).cast("timestamp")).alias("_t"), F.coalesce(F.col(length_col), F.lit(0)).cast("bigint").alias("length"))

    def fold(batches):
        came, waits, alive, done, now = deque(), [], {}, [], 0  # by arrival; by length; id and queue by number; results; the next slot

        def give(n, at=None, depth=None, size=None, place=None):
            name, queue, length = alive.pop(n)
            done.append((name, queue, at, depth, size, place, length))

        def look(until):
            """All slots that end before ``until`` (None: until nothing waits)."""
            nonlocal now
            while alive and (until is None or now < until):
                while came and (came[0][1] not in alive or now - came[0][0] > timeout):
                    t, n = came.popleft()
                    if n in alive:
                        give(n)
                depth = len(alive)
                size = batch_size_for(depth, max_batch_size)
                if depth <= size:
                    for place, n in enumerate(sorted(alive)):
                        give(n, now, depth, size, place)
                    waits.clear()
                else:
                    place = 0
                    while place < size:
                        n = heappop(waits)[1]
                        if n in alive:
                            give(n, now, depth, size, place)
                            place += 1
                now += slot

        def out(kinds):
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds, strict=True)], names=schema.names)
            done.clear()
            return made

        n, kinds = 0, None
        for b, new in batches:
            ids, queues, times, lengths = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (id_col, queue_col, "_t", "length"))
            kinds = [b.schema.field(id_col).type, b.schema.field(queue_col).type, *[pa.int64()] * 5]
            for name, queue, t, length, starts in zip(ids, queues, times, lengths, new.tolist(), strict=True):
                if starts:
                    look(None)
                    came.clear()
                    waits.clear()
                if t is None:
                    done.append((name, queue, None, None, None, None, length))
                    continue
                if alive:
                    look(t)
                if not alive:
                    now = -(-t // slot) * slot
                alive[n] = (name, queue, length)
                came.append((t, n))
                heappush(waits, (length, n))
                n += 1
            if done:
                yield out(kinds)
        look(None)
        if done:
            yield out(kinds)

    longs = ("slot", "depth", "batch_size", "place", "length")
    schema = T.StructType([rows.schema[id_col], rows.schema[queue_col], *(T.StructField(c, T.LongType()) for c in longs)])
    found = segmented_fold(rows, [queue_col], ["_t", id_col], "_t", timeout + slot, fold, schema)
    return found.withColumn("slot", F.timestamp_micros("slot"))


def truncate(seq, max_len: int) -> Column:
    return F.slice(col_(seq), 1, max_len)

"""Tokenization and packing query keys over ``documents`` (doc_id order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import tokens as TK
from quarry.sources import readers as RD
from quarry.sources import sinks as SK
from quarry.sources.shards import registered
from quarry.sources.tables import table
from quarry.streaming.jobs import scratch_path
from quarry.suite import sqlfrag as Q

SEQ_LEN = 300          # does not divide the shard size: tails and overlaps occur
SHARD_SIZE = 100_000
BATCH = 8
SEED = 1234
PAD_LEN = 64
SLOT_S, SLOT_TIMEOUT_S, MAX_BATCH = 21600, 50000, 32
BLOCK = 4096            # does not divide the shard size either


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def _shards(spark, sf):
    """The documents' shards, written."""
    path = f"{scratch_path(spark, 'fixtures', 'shards')}/tokens"
    SK.write_token_shards(_docs(spark, sf), path, SHARD_SIZE)
    return path


def q_write_token_shards(spark, sf):
    # what the written shards hold, whole shards at a time
    back = RD.read_token_shards(spark, _shards(spark, sf), block_tokens=SHARD_SIZE)
    return back.select(F.col("shard_no").alias("shard_id"), F.size("tokens").cast("bigint").alias("n_tokens"), _md5_arr("tokens").alias("ids_md5"))


def q_read_token_shards(spark, sf):
    # small blocks and small byte ranges: a shard is read by many tasks
    path = _shards(spark, sf)
    fmt = spark.read.format(registered(spark)).option("block_tokens", BLOCK).option("partition_bytes", 8 * 4 * BLOCK)
    return fmt.load(path).select("shard_no", "block", "start", F.size("tokens").cast("bigint").alias("n_tokens"), _md5_arr("tokens").alias("ids_md5"))


def q_manifest_check(spark, sf):
    return SK.manifest_check(spark, _shards(spark, sf))


def _md5_arr(c):
    return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))


def q_byte_tokenize(spark, sf):
    d = _docs(spark, sf).select("doc_id", TK.byte_tokens("text", True, True).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), _md5_arr("t").alias("tokens_md5"))


MARKED = ("CASE (doc_id % 4) WHEN 0 THEN '<|user|>' || text || '<|assistant|>ok<|endoftext|>' "
          "WHEN 1 THEN '<|system|>' || text WHEN 2 THEN text || '<|think|>x<|/think|><|answer|>' ELSE text END")


def _marked(spark, sf):
    d = table(spark, sf, "documents")
    m = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<|user|>"), "text", F.lit("<|assistant|>ok<|endoftext|>")))
         .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<|system|>"), "text"))
         .when(F.col("doc_id") % 4 == 2, F.concat("text", F.lit("<|think|>x<|/think|><|answer|>")))
         .otherwise(F.col("text")))
    return d.select("doc_id", m.alias("text"))


def q_special_split(spark, sf):
    d = _marked(spark, sf).select("doc_id", TK.encode_with_specials("text", True, False).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), _md5_arr("t").alias("tokens_md5"))


def q_detokenize(spark, sf):
    d = _marked(spark, sf).select("doc_id", TK.encode_with_specials("text", True, True).alias("t"))
    return d.select("doc_id", F.md5(TK.detokenize("t")).alias("text_md5"),
                    F.md5(TK.detokenize_keep_special("t")).alias("raw_md5"))


def q_token_estimate(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", TK.token_estimate("text").cast("bigint").alias("est_tokens"))


def q_corpus_token_stats(spark, sf):
    return TK.corpus_token_stats(_docs(spark, sf), ["source", "lang"], SHARD_SIZE)


def q_token_offsets(spark, sf):
    return TK.token_offsets(_docs(spark, sf))


def q_shard_assign(spark, sf):
    return TK.shard_pieces(TK.token_offsets(_docs(spark, sf)), SHARD_SIZE)


def q_pack_sequences(spark, sf):
    p = TK.pack_sequences(_docs(spark, sf), SEQ_LEN, SHARD_SIZE)
    return p.select("shard_id", "seq_no", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    _md5_arr("input_ids").alias("ids_md5"), _md5_arr("labels").alias("labels_md5"))


def q_stream_sequences(spark, sf):
    p = TK.pack_sequences(_docs(spark, sf), SEQ_LEN, SHARD_SIZE, min_tokens=2)
    numbered = TK.stream_order(p, SEED, epoch=0)
    return numbered.select(F.col("stream_pos").cast("bigint").alias("stream_pos"), "shard_id", "seq_no",
                           _md5_arr("input_ids").alias("ids_md5"))


def q_estimate_sequences(spark, sf):
    pieces = TK.shard_pieces(TK.token_offsets(_docs(spark, sf)), SHARD_SIZE)
    return TK.estimate_sequences(TK.shard_sizes(pieces), SEQ_LEN)


def q_pad_batch(spark, sf):
    # conversations: one batch per conversation, turns' byte tokens padded to the batch max
    c = table(spark, sf, "conversations").select("conv_id", "turn",
                                                  TK.byte_tokens("text").cast("array<bigint>").alias("seq"))
    p = TK.pad_to_max(c, "conv_id", "seq", pad_id=0)
    fixed = F.md5(F.array_join(TK.pad_to_length("seq", PAD_LEN).cast("array<string>"), ","))
    return p.select("conv_id", "turn", F.size("seq").cast("bigint").alias("padded_len"), _md5_arr("seq").alias("seq_md5"),
                    fixed.alias("fixed_md5"))


def q_make_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    b = TK.make_batches(d, ["doc_id"], BATCH, SEED)
    return b.select("doc_id", "batch_id", "batch_pos")


def q_length_batch_plan(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.length("props").alias("plen"),
                                         F.floor(F.col("value") * 10).cast("bigint").alias("prompt_len"))
    return TK.length_batch_plan(e, "event_type", "event_id", "prompt_len", BATCH)


def q_queue_replay(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", F.floor(F.col("value") * 10).cast("bigint").alias("prompt_len"))
    r = TK.queue_replay(e, "event_type", "event_id", "ts", "prompt_len", SLOT_S, SLOT_TIMEOUT_S, MAX_BATCH)
    return r.select("event_id", "event_type", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"), "depth", "batch_size", "place", "length")


def q_bos_eos_truncate(spark, sf):
    c = table(spark, sf, "conversations")
    t = TK.truncate(TK.byte_tokens("text", True, True), 128)
    return c.select("conv_id", "turn", F.size(t).cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join(t.cast("array<string>"), ",")).alias("tokens_md5"))


def q_synthetic_tokens(spark, sf):
    # one random sequence per document row (the fallback when a source has no shards)
    d = table(spark, sf, "documents").select("doc_id")
    vocab = TK.VOCAB_SIZE
    toks = F.transform(F.sequence(F.lit(0), F.lit(SEQ_LEN)),
                       lambda j: (F.lit(3) + F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("bigint") % F.lit(vocab - 3)))
    s = d.select("doc_id", toks.alias("w"))
    return s.select("doc_id", F.md5(F.array_join(F.slice("w", 1, SEQ_LEN).cast("array<string>"), ",")).alias("ids_md5"),
                    F.md5(F.array_join(F.slice("w", 2, SEQ_LEN).cast("array<string>"), ",")).alias("labels_md5"))


# ------------------------------------------------------------------ SQL oracle

def _bytes_sql(hexcol, v="bi"):
    return f"list_transform(range(len({hexcol}) // 2), lambda {v}: CAST(('0x' || substr({hexcol}, 2 * {v} + 1, 2)) AS INTEGER))"


_TOK = f"""
d AS (SELECT doc_id, text, hex(encode(text)) AS hx FROM documents WHERE NOT {Q.is_blank('text')}),
tk AS (SELECT doc_id, length(text) AS n_chars, [257] || {_bytes_sql('hx')} || [256, 10] AS toks FROM d),
o AS (SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(len(toks) AS BIGINT) AS n_tokens,
        CAST(sum(len(toks)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len(toks) AS BIGINT) AS "offset", toks FROM tk)
"""

_PIECES = f"""
sp AS (SELECT doc_id, "offset", n_tokens, unnest(range("offset" // {SHARD_SIZE}, ("offset" + n_tokens - 1) // {SHARD_SIZE} + 1)) AS shard_id FROM o),
pc AS (SELECT doc_id, CAST(shard_id AS BIGINT) AS shard_id,
         CAST(greatest("offset", shard_id * {SHARD_SIZE}) - shard_id * {SHARD_SIZE} AS BIGINT) AS start_in_shard,
         CAST(greatest("offset", shard_id * {SHARD_SIZE}) - "offset" AS BIGINT) AS doc_from,
         CAST(least("offset" + n_tokens, (shard_id + 1) * {SHARD_SIZE}) - greatest("offset", shard_id * {SHARD_SIZE}) AS BIGINT) AS length
       FROM sp)
"""


def _windows_sql(min_tokens=0):
    L = SEQ_LEN
    return f"""
pos AS (SELECT "offset" + i AS p, tok FROM (SELECT "offset", unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM o)),
ts AS (SELECT p // {SHARD_SIZE} AS s, p % {SHARD_SIZE} AS lp, tok FROM pos),
ssz AS (SELECT s, greatest(1, count(*) // {L}) AS nwin FROM ts GROUP BY s),
mem AS (SELECT s, lp // {L} AS w, lp, tok FROM ts
        UNION ALL SELECT s, lp // {L} - 1 AS w, lp, tok FROM ts WHERE lp % {L} = 0 AND lp > 0),
win AS (SELECT m.s, m.w, list(m.tok ORDER BY m.lp) AS toks FROM mem m JOIN ssz USING (s) WHERE m.w < ssz.nwin GROUP BY m.s, m.w
        HAVING count(*) >= {min_tokens}),
pw AS (SELECT CAST(s AS BIGINT) AS shard_id, CAST(w AS BIGINT) AS seq_no, CAST(len(toks) AS BIGINT) AS n_tokens,
         list_resize(toks, {L + 1}, 0) AS padded FROM win)
"""


def _md5_list(x):
    return f"md5(array_to_string({x}, ','))"


_SPECIAL_IDS = "MAP {" + ", ".join(f"'{m}': {TK.BYTE_BASE + i}" for i, m in enumerate(TK.SPECIAL_TOKENS)) + "}"
_MARK_RX = TK._marker_regex()

def _blocks_sql(size):
    return f"""
bp AS (SELECT "offset" + i AS p, tok FROM (SELECT "offset", unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM o)),
bl AS (SELECT p // {SHARD_SIZE} AS s, p % {SHARD_SIZE} AS lp, tok FROM bp),
bk AS (SELECT s, lp // {size} AS b, list(tok ORDER BY lp) AS toks FROM bl GROUP BY ALL)"""


SQL = {
    "write_token_shards": f"""WITH {_TOK}, {_blocks_sql(SHARD_SIZE)}
SELECT CAST(s AS BIGINT) AS shard_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ',')) AS ids_md5 FROM bk""",
    "read_token_shards": f"""WITH {_TOK}, {_blocks_sql(BLOCK)}
SELECT CAST(s AS BIGINT) AS shard_no, CAST(b AS BIGINT) AS block, CAST(b * {BLOCK} AS BIGINT) AS start, CAST(len(toks) AS BIGINT) AS n_tokens,
       md5(array_to_string(toks, ',')) AS ids_md5 FROM bk""",
    "manifest_check": f"""WITH {_TOK}, t AS (SELECT CAST(sum(n_tokens) AS BIGINT) AS n FROM o)
SELECT n AS tokens_on_disk, CAST(ceil(n / {SHARD_SIZE}) AS BIGINT) AS files_on_disk, n AS total_tokens,
       CAST(ceil(n / {SHARD_SIZE}) AS BIGINT) AS num_shards, true AS consistent FROM t""",
    "byte_tokenize": f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS hx FROM documents),
t AS (SELECT doc_id, [257] || {_bytes_sql('hx')} || [256] AS t FROM h)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, {_md5_list('t')} AS tokens_md5 FROM t""",
    "special_split": f"""WITH m AS (SELECT doc_id, {MARKED} AS text FROM documents),
pm AS (SELECT doc_id, text, regexp_split_to_array(text, '{_MARK_RX}') AS pieces,
         regexp_extract_all(text, '({_MARK_RX})', 1) AS marks FROM m),
ph AS (SELECT doc_id, text, list_transform(pieces, lambda x: hex(encode(x))) AS hx, marks FROM pm),
t AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN [257] ELSE [257] || flatten(list_transform(range(len(hx)), lambda i:
        {_bytes_sql('hx[i + 1]')} || CASE WHEN i < len(marks) THEN [{_SPECIAL_IDS}[marks[i + 1]]] ELSE []::INTEGER[] END)) END AS t FROM ph)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, {_md5_list('t')} AS tokens_md5 FROM t""",
    "detokenize": f"""WITH m AS (SELECT doc_id, {MARKED} AS text FROM documents)
SELECT doc_id, md5(regexp_replace(text, '{_MARK_RX}', '', 'g')) AS text_md5,
       md5('<|beginoftext|>' || text || '<|endoftext|>') AS raw_md5 FROM m""",
    "token_estimate": "SELECT conv_id, turn, CAST(greatest(1, length(text) // 4) AS BIGINT) AS est_tokens FROM conversations",
    "corpus_token_stats": f"""WITH b AS (SELECT source, lang, CAST(length(text) AS BIGINT) AS c, CAST(octet_length(encode(text)) + 3 AS BIGINT) AS t
  FROM documents WHERE NOT {Q.is_blank('text')}),
g AS (SELECT source, lang, CAST(count(*) AS BIGINT) AS files, CAST(sum(c) AS BIGINT) AS characters, CAST(sum(t) AS BIGINT) AS tokens
      FROM b GROUP BY GROUPING SETS ((source), (lang), ()))
SELECT source, lang, files, characters, tokens,
  CASE WHEN tokens = 0 THEN 0.0 ELSE characters / tokens END AS chars_per_token,
  CAST(ceil(tokens / {SHARD_SIZE}) AS BIGINT) AS shards, CAST(tokens * 4 AS BIGINT) AS bytes FROM g""",
    "token_offsets": f"WITH {_TOK} SELECT doc_id, n_chars, n_tokens, \"offset\" FROM o",
    "shard_assign": f"WITH {_TOK}, {_PIECES} SELECT * FROM pc",
    "pack_sequences": f"WITH {_TOK}, {_windows_sql()} SELECT shard_id, seq_no, n_tokens, "
                      f"{_md5_list(f'padded[1:{SEQ_LEN}]')} AS ids_md5, {_md5_list(f'padded[2:{SEQ_LEN + 1}]')} AS labels_md5 FROM pw",
    "stream_sequences": f"WITH {_TOK}, {_windows_sql(2)} SELECT CAST(row_number() OVER (ORDER BY "
                        f"md5('{SEED * 1000}:' || shard_id), md5('{SEED * 1000}:' || shard_id || ':' || seq_no), shard_id, seq_no) AS BIGINT) AS stream_pos, "
                        f"shard_id, seq_no, {_md5_list(f'padded[1:{SEQ_LEN}]')} AS ids_md5 FROM pw",
    "make_batches": f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS p FROM documents),
b AS (SELECT doc_id, CAST(p // {BATCH} AS BIGINT) AS batch_id, CAST(p % {BATCH} AS BIGINT) AS batch_pos FROM n)
SELECT * FROM b WHERE batch_id < (SELECT count(*) FROM documents) // {BATCH}""",
    "estimate_sequences": f"""WITH {_TOK}, {_PIECES}, ss AS (SELECT shard_id, sum(length) AS n FROM pc GROUP BY shard_id)
SELECT CAST(sum(greatest(1, n // {SEQ_LEN})) AS BIGINT) AS num_sequences, CAST(count(*) AS BIGINT) AS num_shards,
       CAST(sum(n) AS BIGINT) AS total_tokens FROM ss""",
    "pad_batch": f"""WITH h AS (SELECT conv_id, turn, hex(encode(text)) AS hx FROM conversations),
s AS (SELECT conv_id, turn, {_bytes_sql('hx')} AS seq FROM h),
m AS (SELECT *, max(len(seq)) OVER (PARTITION BY conv_id) AS ml FROM s)
SELECT conv_id, turn, CAST(ml AS BIGINT) AS padded_len, {_md5_list('list_resize(seq, ml, 0)')} AS seq_md5,
       {_md5_list(f'list_resize(seq[1:{PAD_LEN}], {PAD_LEN}, 0)')} AS fixed_md5 FROM m""",
    "length_batch_plan": f"""WITH e AS (SELECT event_id, event_type, CAST(floor(value * 10) AS BIGINT) AS prompt_len FROM events),
n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY prompt_len, event_id) - 1) // {BATCH} AS batch_no FROM e)
SELECT event_type, CAST(batch_no AS BIGINT) AS batch_no, CAST(count(*) AS BIGINT) AS batch_size,
       CAST(max(prompt_len) AS BIGINT) AS max_len, CAST(sum(prompt_len) AS BIGINT) AS sum_len,
       CAST(max(prompt_len) * count(*) - sum(prompt_len) AS BIGINT) AS padding_waste FROM n GROUP BY event_type, batch_no""",
    "bos_eos_truncate": f"""WITH h AS (SELECT conv_id, turn, hex(encode(text)) AS hx FROM conversations),
t AS (SELECT conv_id, turn, ([257] || {_bytes_sql('hx')} || [256])[1:128] AS t FROM h)
SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n_tokens, {_md5_list('t')} AS tokens_md5 FROM t""",
    "synthetic_tokens": f"""WITH s AS (SELECT doc_id, list_transform(range(0, {SEQ_LEN + 1}), lambda j:
   3 + (('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 8))::BIGINT) % {TK.VOCAB_SIZE - 3}) AS w
  FROM documents)
SELECT doc_id, {_md5_list(f'w[1:{SEQ_LEN}]')} AS ids_md5, {_md5_list(f'w[2:{SEQ_LEN + 1}]')} AS labels_md5 FROM s""",
}

SQL["queue_replay"] = f"""WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS t, coalesce(CAST(floor(value * 10) AS BIGINT), 0) AS len,
   CAST(ceil(epoch_us(ts) / {SLOT_S}e6) AS BIGINT) AS s FROM events),
a AS (SELECT event_type, s, list({{'len': len, 't': t, 'id': event_id}}) AS arr FROM e GROUP BY ALL),
lim AS (SELECT event_type, min(s) AS lo, max(s) + {SLOT_TIMEOUT_S // SLOT_S + 1} AS hi FROM e GROUP BY ALL),
r AS (SELECT event_type, lo - 1 AS s, hi, CAST([] AS STRUCT(len BIGINT, t BIGINT, id BIGINT)[]) AS rest, CAST([] AS STRUCT(len BIGINT, t BIGINT, id BIGINT)[]) AS batch, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS size FROM lim
  UNION ALL
  SELECT event_type, s, hi, list_filter(w, lambda x: NOT list_contains(chosen, x)), chosen, d, b FROM (
    SELECT *, CASE WHEN d <= b THEN w ELSE list_sort(w)[1:b] END AS chosen FROM (
      SELECT *, CASE WHEN d <= 1 THEN 1 WHEN d <= 4 THEN least(d, 4) WHEN d <= 16 THEN least(d, 8) WHEN d <= 64 THEN least(d, 16) ELSE least(d, {MAX_BATCH}) END AS b FROM (
        SELECT *, CAST(len(w) AS BIGINT) AS d FROM (
          SELECT r.event_type, r.s + 1 AS s, r.hi, list_filter(list_concat(r.rest, coalesce(a.arr, [])), lambda x: (r.s + 1) * {SLOT_S}000000 - x.t <= {SLOT_TIMEOUT_S}000000) AS w
          FROM r LEFT JOIN a ON a.event_type = r.event_type AND a.s = r.s + 1 WHERE r.s < r.hi))))),
b AS (SELECT event_type, s, depth, size, unnest(batch) AS x FROM r WHERE depth > 0),
p AS (SELECT x.id AS event_id, strftime(make_timestamp(s * {SLOT_S}000000), '%Y-%m-%d %H:%M:%S') AS slot, depth, size,
   row_number() OVER (PARTITION BY event_type, s ORDER BY CASE WHEN depth <= size THEN 0 ELSE x.len END, x.t, x.id) - 1 AS place FROM b)
SELECT e.event_id, e.event_type, slot, CAST(depth AS BIGINT) AS depth, CAST(size AS BIGINT) AS batch_size, CAST(place AS BIGINT) AS place, len AS length FROM e LEFT JOIN p USING (event_id)"""

QUERIES = {
    "queue_replay": q_queue_replay,
    "write_token_shards": q_write_token_shards,
    "read_token_shards": q_read_token_shards,
    "manifest_check": q_manifest_check,
    "byte_tokenize": q_byte_tokenize,
    "special_split": q_special_split,
    "detokenize": q_detokenize,
    "token_estimate": q_token_estimate,
    "corpus_token_stats": q_corpus_token_stats,
    "token_offsets": q_token_offsets,
    "shard_assign": q_shard_assign,
    "pack_sequences": q_pack_sequences,
    "stream_sequences": q_stream_sequences,
    "estimate_sequences": q_estimate_sequences,
    "pad_batch": q_pad_batch,
    "make_batches": q_make_batches,
    "length_batch_plan": q_length_batch_plan,
    "bos_eos_truncate": q_bos_eos_truncate,
    "synthetic_tokens": q_synthetic_tokens,
}

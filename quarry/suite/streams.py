"""Structured Streaming query keys.

Each key reads its input table as a stream (or one that Spark derives from it and
writes once), runs the streaming job with ``availableNow``, and returns the sink.  The
oracle is the batch twin's SQL: a stream must give exactly the batch answer.  Where
windows, sessions or join results must close, an event two days past the last one is
appended to a second source and the query is resumed from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.tokens import token_estimate
from quarry.sources.tables import table
from quarry.streaming import jobs as J
from quarry.suite import logs as LQ
from quarry.suite import safety as SQ

WATERMARK_S = 3600
MEMORY_MAX = 300
TRAIN_EVERY = 10
QUEUE_TIMEOUT = "2 hours"
TICK_S, DEPTH_TIMEOUT_S = 7200, 21600


def _events(spark, sf):
    """The events table as a stream (UTC session: same instants)."""
    return J.table_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _closed_events(spark, sf, name, last=2):
    """The events as a stream, and the function that adds an event of id and user -1
    ``last`` days after the last one."""
    e = table(spark, sf, "events")
    end = e.agg((F.max("ts") + F.expr(f"INTERVAL {last} DAYS")).alias("ts"))
    none = [F.lit(-1 if f.name.endswith("_id") else None).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("ts") for f in e.schema]
    closer, append = J.closing_source(end.select(*none), name)
    return _events(spark, sf).unionByName(closer.withColumn("ts", F.col("ts").cast("timestamp"))), append


def q_stream_rate_limit(spark, sf):
    out = J.stream_rate_limit(_events(spark, sf), "user_id", "ts", "event_id", LQ.RATE_PER_WINDOW, LQ.RATE_WINDOW_S, WATERMARK_S)
    return J.run_available_now(out, "rate_limit").select("event_id", "user_id", "allowed", "admitted_in_window")


def q_stream_query_cache(spark, sf):
    out = J.stream_query_cache(_events(spark, sf), ["event_type", "user_id"], "ts", "event_id", LQ.CACHE_TTL_S, WATERMARK_S)
    return J.run_available_now(out, "query_cache").select("event_id", "event_type", "user_id", "hit")


def q_stream_request_metrics(spark, sf):
    s, close = _closed_events(spark, sf, "metrics")
    out = J.stream_request_metrics(s, "ts", "event_type", "value", "1 hour", "1 hour")
    r = J.run_available_now(out, "request_metrics", closing=[close])
    return r.filter(F.col("event_type").isNotNull()).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
        F.col("count").cast("bigint").alias("count"), F.round("avg_latency_ms", 6).alias("avg_latency_ms"),
        "p95_latency_ms", "max_latency_ms")


def q_stream_sessions(spark, sf):
    s, close = _closed_events(spark, sf, "sessions")
    out = J.stream_sessions(s, "ts", "user_id", "30 minutes", "1 hour")
    r = J.run_available_now(out, "sessions", closing=[close])
    return r.filter(F.col("user_id") >= 0).select(
        "user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
        F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"),
        F.col("entries").cast("bigint").alias("entries"))


def q_stream_queue_expiry(spark, sf):
    enq, close_enq = _closed_events(spark, sf, "enqueue")
    deq, close_deq = _closed_events(spark, sf, "dequeue")
    waits = F.expr("INTERVAL 1 SECOND") * F.floor(F.coalesce("value", F.lit(0.0)) * 60).cast("int")
    deq = deq.filter(F.col("event_id") % 7 != 0).select(F.col("event_id").alias("event_id_d"), (F.col("ts") + waits).alias("deq_ts"))
    out = J.stream_queue_expiry(enq.select("event_id", "ts"), deq, "event_id", "ts", "deq_ts", QUEUE_TIMEOUT, "1 hour")
    r = J.run_available_now(out, "queue_expiry", closing=[close_enq, close_deq])
    return r.filter(F.col("event_id") >= 0).select("event_id", "expired")


def q_stream_queue_depth(spark, sf):
    # the events of each kind queue up: depth and oldest age every two hours
    s, close = _closed_events(spark, sf, "depth")
    waits = F.expr("INTERVAL 1 SECOND") * F.floor(F.coalesce("value", F.lit(0.0)) * 60).cast("int")
    went = (F.col("event_id") % 7 != 0) & (F.col("event_id") >= 0)
    both = F.when(went, F.array(F.struct(F.lit(J.ENTERED).alias("kind"), F.col("ts").alias("at")), F.struct(F.lit(J.LEFT).alias("kind"), (F.col("ts") + waits).alias("at"))))
    both = both.otherwise(F.array(F.struct(F.lit(J.ENTERED).alias("kind"), F.col("ts").alias("at"))))
    events = s.select("event_type", "event_id", F.explode(both).alias("e")).select("event_type", "event_id", "e.kind", "e.at")
    out = J.stream_queue_depth(events, "event_type", "event_id", "kind", "at", TICK_S, DEPTH_TIMEOUT_S, "1 hour")
    r = J.queue_depth(J.run_available_now(out, "queue_depth", closing=[close], conf=J.ROCKSDB))
    return r.filter(F.col("queue").isNotNull()).select("queue", F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"), "queue_depth", F.round("oldest_age_s", 6).alias("oldest_age_s"))


def q_stream_memory(spark, sf):
    c = J.table_stream(spark, f"{sf}/conversations.parquet")
    s = c.select("conv_id", "turn", token_estimate("text").cast("bigint").alias("tokens"))
    return J.run_available_now(J.stream_memory(s, "conv_id", "turn", "tokens", MEMORY_MAX), "memory")


def q_stream_audit_verify(spark, sf):
    s = J.derived_stream(LQ.tampered_chain(spark, sf).select("chain_id", "seq", "prev_hash", "hash"), "audit")
    return J.run_available_now(J.stream_audit_verify(s, "chain_id", "seq"), "audit_verify")


def q_stream_safety(spark, sf):
    s = J.derived_stream(SQ.probed_turns(spark, sf).select("conv_id", "turn", "text"), "safety")
    r = J.run_available_now(J.stream_safety(s, "text"), "safety")
    return r.select("conv_id", "turn", "blocked", "category", "reason", "score")


def q_stream_train_metrics(spark, sf):
    s = _events(spark, sf).select("user_id", "event_id", "ts", "value")
    out = J.stream_train_metrics(s, "user_id", "event_id", "value", TRAIN_EVERY, "ts", WATERMARK_S)
    r = J.run_available_now(out, "train_metrics")
    r = r.withColumn("loss_sum", F.round("loss_sum", 2))  # the oracle adds in another order
    return r.select("user_id", "event_id", "loss_sum", "steps", (F.col("loss_sum") / F.col("steps")).alias("running_loss"))


def q_stream_ingest(spark, sf):
    s = J.table_stream(spark, f"{sf}/documents.parquet").select("doc_id", "source", "text")
    out = J.run_foreach_batch(s, "ingest", lambda batch, i, to: J.stream_ingest_batch(batch, i, to, "doc_id", "text"))
    return spark.read.parquet(out).select("doc_id", "n_chars", "n_tokens")


# ------------------------------------------------------------------ SQL oracle (batch twins)

SQL = {
    "stream_rate_limit": LQ.SQL["rate_limit"],
    "stream_query_cache": LQ.SQL["query_cache_ttl"],
    "stream_request_metrics": """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
  CAST(count(*) AS BIGINT) AS count, round(avg(value), 6) AS avg_latency_ms,
  quantile_disc(value, 0.95) AS p95_latency_ms, max(value) AS max_latency_ms
FROM events GROUP BY 1, 2""",
    "stream_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
     OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000 THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end, CAST(count(*) AS BIGINT) AS entries
FROM s GROUP BY user_id, sid""",
    "stream_queue_expiry": """WITH d AS (SELECT event_id AS id, ts + INTERVAL 1 SECOND * CAST(floor(value * 60) AS INTEGER) AS deq_ts FROM events WHERE event_id % 7 <> 0)
SELECT e.event_id, d.id IS NULL AS expired FROM events e LEFT JOIN d ON d.id = e.event_id
  AND d.deq_ts >= e.ts AND d.deq_ts <= e.ts + INTERVAL 2 HOUR""",
    "stream_queue_depth": f"""WITH e AS (SELECT event_id, event_type AS queue, epoch_us(ts) AS came, CASE WHEN event_id % 7 <> 0
      THEN epoch_us(ts + INTERVAL 1 SECOND * CAST(floor(coalesce(value, 0) * 60) AS INTEGER)) END AS went FROM events),
t AS (SELECT queue, came, went, unnest(generate_series(CAST(ceil(came / {TICK_S}e6) AS BIGINT), (came + {DEPTH_TIMEOUT_S}000000) // {TICK_S}000000)) * {TICK_S}000000 AS tick FROM e)
SELECT queue, strftime(make_timestamp(tick), '%Y-%m-%d %H:%M:%S') AS tick, CAST(count(*) AS BIGINT) AS queue_depth, round((tick - min(came)) / 1e6, 6) AS oldest_age_s
FROM t WHERE went IS NULL OR went > t.tick GROUP BY queue, t.tick""",
    "stream_memory": f"""WITH c AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tk FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.turn AS s, sum(c2.tk) AS suf FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn <= a.turn
      JOIN c c2 ON c2.conv_id = a.conv_id AND c2.turn >= b.turn AND c2.turn <= a.turn GROUP BY a.conv_id, a.turn, b.turn),
w AS (SELECT conv_id, turn, min(s) FILTER (WHERE suf <= {MEMORY_MAX} OR s = turn) AS st FROM p GROUP BY conv_id, turn)
SELECT w.conv_id, w.turn, w.st AS window_start_turn, CAST(count(*) AS BIGINT) AS window_messages, CAST(sum(c.tk) AS BIGINT) AS window_tokens
FROM w JOIN c ON c.conv_id = w.conv_id AND c.turn >= w.st AND c.turn <= w.turn GROUP BY w.conv_id, w.turn, w.st""",
    "stream_audit_verify": LQ.SQL["audit_prev_link"].replace(
        "SELECT a.chain_id, CAST(a.seq AS BIGINT) AS seq, a.prev_hash, b.hash AS prev_stored_hash",
        "SELECT a.chain_id, CAST(a.seq AS BIGINT) AS seq, a.prev_hash = coalesce(b.hash, 'GENESIS') AS prev_ok"),
    "stream_safety": SQ.SQL["safety_input"],
    "stream_train_metrics": f"""WITH r AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s,
   count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)
SELECT user_id, event_id, round(s, 2) AS loss_sum, CAST(n AS BIGINT) AS steps, round(s, 2) / n AS running_loss FROM r WHERE event_id % {TRAIN_EVERY} = 0""",
    "stream_ingest": r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(octet_length(encode(text)) + 3 AS BIGINT) AS n_tokens
FROM documents WHERE regexp_matches(text, '\S')""",
}

QUERIES = {
    "stream_rate_limit": q_stream_rate_limit,
    "stream_query_cache": q_stream_query_cache,
    "stream_request_metrics": q_stream_request_metrics,
    "stream_sessions": q_stream_sessions,
    "stream_queue_expiry": q_stream_queue_expiry,
    "stream_queue_depth": q_stream_queue_depth,
    "stream_memory": q_stream_memory,
    "stream_audit_verify": q_stream_audit_verify,
    "stream_safety": q_stream_safety,
    "stream_train_metrics": q_stream_train_metrics,
    "stream_ingest": q_stream_ingest,
}

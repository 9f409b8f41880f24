"""Audit chains, access control, request logs and training-metric tables.

Sequential per-key semantics (rate limiter, TTL cache, hash chain) are
replayed by streaming each hash partition, sorted by (key, time), as Arrow
batches through a fold that keeps only the current key's state.  A key's history is
never collected into one array, one pandas frame or the driver.  The limiter and the
cache forget after an idle gap, so a hot key's segments between gaps are replayed in
parallel; a hash chain is sequential by definition.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import col_
from quarry.plans.layout import running_sum, segmented_fold, sorted_fold

GENESIS = "GENESIS"


def epoch_us(c) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ (session time zone UTC)."""
    return F.unix_micros(col_(c).cast("timestamp"))


# ------------------------------------------------------------- replays

def _columns(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(c)) for c in names]


def rate_limit_replay(events: DataFrame, key_cols: list[str], ts_col: str, id_col: str,
                      requests_per_window: int, window_seconds: float = 60.0) -> DataFrame:
    """Replay a sliding-window limiter: a request is admitted iff fewer than
    ``requests_per_window`` admitted requests of its key lie in the last
    ``window_seconds`` (strictly newer than ts - window).  Rejected requests
    leave no trace.  Ties in time are ordered by ``id_col``.  A NULL key is one key;
    a request without a time is rejected.

    Returns (id, *keys, allowed, admitted_in_window).
    """
    win_us = int(round(window_seconds * 1_000_000))
    limit = int(requests_per_window)
    prepared = events.select(id_col, *key_cols, epoch_us(F.col(ts_col)).alias("_t"))

    def fold(batches):
        admitted = deque()
        for batch, new in batches:
            allowed = np.zeros(batch.num_rows, dtype=bool)
            inwin = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (t, starts) in enumerate(zip(_columns(batch, ["_t"])[0].to_pylist(), new.tolist())):
                if starts:
                    admitted = deque()
                if t is not None:
                    while admitted and not (t - admitted[0] < win_us):
                        admitted.popleft()
                    if len(admitted) < limit:
                        admitted.append(t)
                        allowed[i] = True
                inwin[i] = len(admitted)
            yield pa.RecordBatch.from_arrays([*_columns(batch, [id_col, *key_cols]), pa.array(allowed), pa.array(inwin)],
                                             names=schema.names)

    schema = T.StructType([events.schema[id_col]] + [events.schema[k] for k in key_cols] +
                          [T.StructField("allowed", T.BooleanType()),
                           T.StructField("admitted_in_window", T.LongType())])
    return segmented_fold(prepared, key_cols, ["_t", id_col], "_t", win_us, fold, schema)


def ttl_cache_replay(events: DataFrame, key_cols: list[str], ts_col: str, ttl_seconds: float,
                     id_col: str = "event_id") -> DataFrame:
    """Replay a TTL cache refreshed only on a miss: per key in time order, a
    request hits iff ``ts - last_miss < ttl``; otherwise it misses and becomes
    the new ``last_miss``.  A NULL key is one key; a request without a time misses and is
    not remembered.  Returns (id, *keys, hit)."""
    ttl_us = int(round(ttl_seconds * 1_000_000))
    prepared = events.select(id_col, *key_cols, epoch_us(F.col(ts_col)).alias("_t"))

    def fold(batches):
        last = None
        for batch, new in batches:
            hit = np.zeros(batch.num_rows, dtype=bool)
            for i, (t, starts) in enumerate(zip(_columns(batch, ["_t"])[0].to_pylist(), new.tolist())):
                if starts:
                    last = None
                if t is None:
                    continue
                if last is not None and t - last < ttl_us:
                    hit[i] = True
                else:
                    last = t
            yield pa.RecordBatch.from_arrays([*_columns(batch, [id_col, *key_cols]), pa.array(hit)], names=schema.names)

    schema = T.StructType([events.schema[id_col]] + [events.schema[k] for k in key_cols] +
                          [T.StructField("hit", T.BooleanType())])
    return segmented_fold(prepared, key_cols, ["_t", id_col], "_t", ttl_us, fold, schema)


# ------------------------------------------------------------- audit chain

AUDIT_FIELDS = ("timestamp", "event_type", "severity", "payload", "prev_hash")


def canonical_entry(timestamp, event_type, severity, payload_json, prev_hash) -> str:
    """``json.dumps`` with sorted keys of every field but hash/signature."""
    payload = json.loads(payload_json) if payload_json else {}
    return json.dumps({"timestamp": timestamp, "event_type": event_type, "severity": severity,
                       "payload": payload, "prev_hash": prev_hash}, sort_keys=True)


def _digest(algo: str, text: str) -> str:
    return hashlib.new(algo, text.encode("utf-8")).hexdigest()


def audit_chain_build(entries: DataFrame, chain_col: str, order_cols: list[str],
                      algo: str = "sha3_512") -> DataFrame:
    """Chain entries per ``chain_col`` in ``order_cols`` order: prev_hash is
    the previous entry's hash (GENESIS first), hash = digest of the canonical
    JSON.  Returns chain, seq (0-based), the five fields and hash.

    ``entries`` columns: timestamp (string), event_type, severity, payload
    (JSON text).  Sequential inside a chain, parallel across chains.
    """
    prepared = entries.select(chain_col, *[c for c in order_cols if c != chain_col],
                              "timestamp", "event_type", "severity", "payload")

    def fold(batches):
        prev, seq = GENESIS, 0
        for batch, new in batches:
            prevs, hashes, seqs = [], [], []
            fields = _columns(batch, ["timestamp", "event_type", "severity", "payload"])
            for starts, *row in zip(new.tolist(), *(f.to_pylist() for f in fields)):
                if starts:
                    prev, seq = GENESIS, 0
                h = _digest(algo, canonical_entry(*row, prev))
                prevs.append(prev)
                hashes.append(h)
                seqs.append(seq)
                prev, seq = h, seq + 1
            yield pa.RecordBatch.from_arrays([*_columns(batch, [chain_col]), pa.array(seqs, pa.int64()), *fields,
                                              pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=schema.names)

    schema = T.StructType([entries.schema[chain_col], T.StructField("seq", T.LongType())] +
                          [T.StructField(c, T.StringType()) for c in ("timestamp", "event_type", "severity",
                                                                       "payload", "prev_hash", "hash")])
    return sorted_fold(prepared, [chain_col], [c for c in order_cols if c != chain_col], fold, schema)


def entry_hash(algo: str = "sha3_512"):
    """Arrow UDF recomputing an entry's hash from its five fields."""
    @F.pandas_udf(T.StringType())
    def _h(ts: pd.Series, et: pd.Series, sev: pd.Series, payload: pd.Series, prev: pd.Series) -> pd.Series:
        return pd.Series([_digest(algo, canonical_entry(a, b, c, d, e)) for a, b, c, d, e in zip(ts, et, sev, payload, prev)])
    return _h


def audit_prev_link(entries: DataFrame, chain_col: str = "chain_id") -> DataFrame:
    """Each entry next to its predecessor's stored hash (self equi-join on seq - 1)."""
    prev = entries.select(chain_col, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("prev_stored_hash"))
    return entries.join(prev, [chain_col, "seq"], "left")


def audit_chain_verify(entries: DataFrame, chain_col: str = "chain_id", algo: str = "sha3_512",
                       require_signature: bool = False) -> DataFrame:
    """Per entry faults: prev mismatch (expected = predecessor's *stored* hash,
    GENESIS first), hash mismatch, missing signature when required."""
    linked = audit_prev_link(entries, chain_col)
    expected_prev = F.when(F.col("seq") == 0, F.lit(GENESIS)).otherwise(F.col("prev_stored_hash"))
    recomputed = entry_hash(algo)("timestamp", "event_type", "severity", "payload", "prev_hash")
    faults = ((~F.col("prev_hash").eqNullSafe(expected_prev)).cast("int")
              + (~F.col("hash").eqNullSafe(recomputed)).cast("int"))
    if require_signature:
        sig = F.col("pqc_signature") if "pqc_signature" in entries.columns else F.lit(None).cast("string")
        faults = faults + F.when(F.coalesce(sig, F.lit("")) == "", 1).otherwise(0)
    return linked.select(chain_col, "seq", faults.alias("faults"))


def audit_verify_summary(faults: DataFrame, chain_col: str = "chain_id") -> DataFrame:
    """(chain, valid, total, invalid) per chain plus the overall row (chain NULL)."""
    g = faults.rollup(chain_col).agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                                     F.sum("faults").cast("bigint").alias("invalid"))
    return g.withColumn("valid", F.col("invalid") == 0)


def audit_resume(entries: DataFrame, chain_col: str = "chain_id") -> DataFrame:
    """Hash to continue each chain from (last entry's hash)."""
    return entries.groupBy(chain_col).agg(F.max_by("hash", "seq").alias("last_hash"),
                                          F.max("seq").alias("last_seq"))


def audit_event_rollup(entries: DataFrame) -> DataFrame:
    """Counts by event type and severity with all subtotals (CUBE)."""
    return entries.cube("event_type", "severity").agg(F.count(F.lit(1)).cast("bigint").alias("entries"))


def tokens_per_second(generated, elapsed_ms) -> Column:
    return col_(generated) / F.greatest(col_(elapsed_ms) / 1000.0, F.lit(0.001))


# ------------------------------------------------------------- access

def key_hash(plaintext) -> Column:
    return F.sha2(col_(plaintext), 256)


def auth_key_join(requests: DataFrame, keys: DataFrame, token_col: str = "token",
                  ts_col: str = "ts") -> DataFrame:
    """Request token -> key by sha256, with validity at request time.

    status: unknown (no key), revoked, expired (request after a parsable
    expiry), else valid.  Equi-join on the hash; keys are a dimension.
    """
    k = keys.select("key_id", "key_hash", "scopes", "revoked",
                    F.try_to_timestamp(F.col("expires_at")).alias("_exp"))
    j = requests.withColumn("_h", key_hash(token_col)).join(k, F.col("_h") == F.col("key_hash"), "left")
    status = (F.when(F.col("key_id").isNull(), F.lit("unknown"))
              .when(F.col("revoked"), F.lit("revoked"))
              .when(F.col("_exp").isNotNull() & (F.col(ts_col) > F.col("_exp")), F.lit("expired"))
              .otherwise(F.lit("valid")))
    return j.withColumn("auth_status", status).drop("_h", "_exp", "key_hash")


def scope_ok(scopes, required) -> Column:
    """Required scope present, or 'admin' present."""
    return F.array_contains(col_(scopes), col_(required) if not isinstance(required, str) else F.lit(required)) | \
        F.array_contains(col_(scopes), F.lit("admin"))


def access_audit(requests: DataFrame, keys: DataFrame, required_scope: Column, token_col: str = "token",
                 ts_col: str = "ts") -> DataFrame:
    """Per request: allowed / unknown / revoked / expired / missing_scope."""
    j = auth_key_join(requests, keys, token_col, ts_col)
    decision = (F.when(F.col("auth_status") != "valid", F.col("auth_status"))
                .when(~scope_ok("scopes", required_scope), F.lit("missing_scope"))
                .otherwise(F.lit("allowed")))
    return j.withColumn("decision", decision)


def key_last_used(audited: DataFrame, ts_col: str = "ts") -> DataFrame:
    return audited.filter(F.col("auth_status") == "valid").groupBy("key_id").agg(F.max(ts_col).alias("last_used"))


def key_inventory(keys: DataFrame) -> DataFrame:
    """Keys without their hashes."""
    return keys.drop("key_hash")


def key_rotation(keys: DataFrame, rotate: DataFrame, now_col: Column) -> DataFrame:
    """Revoke the listed keys and add successors with the same scopes (SCD-2 style)."""
    r = rotate.select("key_id", F.lit(True).alias("_rot"))
    marked = keys.join(r, "key_id", "left")
    old = marked.withColumn("revoked", F.col("revoked") | F.coalesce(F.col("_rot"), F.lit(False))).drop("_rot")
    new = (marked.filter(F.col("_rot")).select(
        F.concat(F.lit("ck-"), F.substring(F.sha2(F.concat(F.col("key_id"), F.lit(":rotated")), 256), 1, 24)).alias("key_id"),
        F.sha2(F.concat(F.col("key_hash"), F.lit(":next")), 256).alias("key_hash"),
        "name", "scopes", now_col.alias("created_at"), F.lit(None).cast("string").alias("expires_at"),
        F.lit(None).cast("string").alias("last_used"), F.lit(False).alias("revoked")))
    return old.unionByName(new.select(*old.columns))


# ------------------------------------------------------------- request logs

def request_metrics(log: DataFrame, endpoint_col: str = "endpoint", latency_col: str = "latency_ms",
                    id_col: str = "request_id") -> DataFrame:
    """Per endpoint and overall (endpoint NULL): count, mean (2 decimals) and
    p95 = sorted[int(n * 0.95)] (0-based nearest rank, 2 decimals).

    Ranks inside an endpoint come from the block-wise running count, so a
    dominant endpoint is ranked by many tasks; the overall row carries the
    overall mean only, as the reference reports.
    """
    base = log.select(endpoint_col, latency_col, id_col, F.lit(1).alias("_one"))
    ranked = running_sum(base, [endpoint_col, latency_col, id_col], "_one", "_rn", partition_cols=[endpoint_col])
    counts = log.groupBy(endpoint_col).agg(F.count(F.lit(1)).alias("_n"))
    pick = ranked.join(counts, endpoint_col).filter(F.col("_rn") == F.floor(F.col("_n") * F.lit(0.95)) + 1) \
                 .select(endpoint_col, F.col(latency_col).alias("_p95"))
    per = log.groupBy(endpoint_col).agg(F.count(F.lit(1)).cast("bigint").alias("count"),
                                        F.round(F.avg(latency_col), 2).alias("avg_latency_ms"))
    per = per.join(pick, endpoint_col, "left").select(endpoint_col, "count", "avg_latency_ms",
                                                      F.round("_p95", 2).alias("p95_latency_ms"))
    overall = log.agg(F.lit(None).cast("string").alias(endpoint_col), F.count(F.lit(1)).cast("bigint").alias("count"),
                      F.round(F.avg(latency_col), 2).alias("avg_latency_ms"),
                      F.lit(None).cast("double").alias("p95_latency_ms"))
    return per.unionByName(overall)


def ring_buffer_last(log: DataFrame, n: int, ts_col: str, id_col: str, key_col: str) -> DataFrame:
    """The last n log rows (newest first order), keys masked to 8 chars + '...'."""
    last = log.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(n)
    return last.withColumn(key_col, F.concat(F.substring(F.col(key_col).cast("string"), 1, 8), F.lit("...")))


def queue_stats(requests: DataFrame, group_col: str, ts_col: str, asof: Column, timeout_s: float,
                latency_col: str) -> DataFrame:
    """At an as-of time per group: depth (waiting, not expired), oldest age of
    the waiting ones, expired count, mean latency."""
    age = epoch_us(asof) / 1e6 - epoch_us(F.col(ts_col)) / 1e6
    r = requests.withColumn("_age", age)
    expired = F.col("_age") > F.lit(timeout_s)
    return r.groupBy(group_col).agg(
        F.sum((~expired).cast("int")).cast("bigint").alias("queue_depth"),
        F.max(F.when(~expired, F.col("_age"))).alias("oldest_age_s"),
        F.sum(expired.cast("int")).cast("bigint").alias("expired"),
        F.avg(latency_col).alias("avg_latency_ms"))


def is_expired(ts, now, timeout_s: float) -> Column:
    return (epoch_us(col_(now)) - epoch_us(col_(ts))) > F.lit(int(timeout_s * 1_000_000))


def is_success(exit_code, error) -> Column:
    return (col_(exit_code) == 0) & col_(error).isNull()


# ------------------------------------------------------------- training metrics

def metrics_long(df: DataFrame, id_cols: list[str], json_col: str) -> DataFrame:
    """Wide JSON metric dicts -> (id, name, value) for numeric values only
    (a JSON string such as "5" is not a number)."""
    m = F.from_json(F.col(json_col), "map<string,variant>")
    e = df.select(*id_cols, F.explode_outer(m).alias("name", "_v")).filter(F.col("name").isNotNull())
    kind = F.schema_of_variant("_v")
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    return e.filter(numeric).select(*id_cols, "name", F.variant_get("_v", "$", "double").alias("value"))


def metrics_sampled(steps: DataFrame, interval: int, step_col: str, metric_cols: list[str]) -> DataFrame:
    """Keep every interval-th step and unpivot its metrics (null metrics dropped)."""
    kept = steps.filter(F.col(step_col) % interval == 0)
    long = kept.unpivot([step_col] + [c for c in kept.columns if c not in metric_cols and c != step_col],
                        metric_cols, "metric", "value")
    return long.filter(F.col("value").isNotNull())


def running_loss(steps: DataFrame, run_col: str, step_col: str, loss_col: str, id_col: str | None = None) -> DataFrame:
    """Running mean loss per run, block-wise (a long run is not one task).  ``id_col`` orders
    the rows of a run that have the same step."""
    order = [run_col, step_col] + ([id_col] if id_col else [])
    s = running_sum(steps.withColumn("_one", F.lit(1)), order, [loss_col, "_one"], ["_sum", "_cnt"], partition_cols=[run_col])
    return (s.withColumn("running_loss", F.col("_sum") / F.col("_cnt"))
             .withColumnRenamed("_sum", "loss_sum").withColumnRenamed("_cnt", "steps").drop("_one"))


def value_histogram(df: DataFrame, name_col: str, value_col: str, bins: int) -> DataFrame:
    """Equal-width histogram of values per name over [min, max] (bins buckets); NULL values are
    in no bucket."""
    df = df.filter(F.col(value_col).isNotNull())
    rng = df.groupBy(name_col).agg(F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"))
    j = df.join(rng, name_col)
    width = (F.col("_hi") - F.col("_lo"))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value_col) - F.col("_lo")) / width * bins), F.lit(bins - 1)))
    return (j.withColumn("bucket", b.cast("bigint"))
            .groupBy(name_col, "bucket").agg(F.count(F.lit(1)).cast("bigint").alias("count"),
                                             F.min("_lo").alias("lo"), F.min("_hi").alias("hi")))


def latency_summary(df: DataFrame, group_col: str, latency_col: str, seq_len: int,
                    id_col: str | None = None) -> DataFrame:
    """mean, lower median (sorted[(n-1)//2]), p95 by linear interpolation
    (numpy/torch rule on position (n-1)*0.95), throughput seq_len / mean seconds.

    Order statistics come from block-wise ranks (no group's values are ever
    gathered into one task); only the two or three needed ranks are picked.
    """
    key = [id_col] if id_col else []
    base = df.select(group_col, latency_col, *key, F.lit(1).alias("_one"))
    ranked = running_sum(base, [group_col, latency_col, *key], "_one", "_r", inclusive=False,
                         partition_cols=[group_col])  # 0-based rank
    stats = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"), F.avg(latency_col).alias("mean_latency_ms"))
    pos = (F.col("_n") - 1) * F.lit(0.95)
    lo, hi, mid = F.floor(pos), F.ceil(pos), F.floor((F.col("_n") - 1) / 2)
    j = ranked.join(stats.select(group_col, "_n"), group_col).filter(
        (F.col("_r") == lo) | (F.col("_r") == hi) | (F.col("_r") == mid))
    picks = j.groupBy(group_col).agg(
        F.max(F.when(F.col("_r") == mid, F.col(latency_col))).alias("median_latency_ms"),
        F.max(F.when(F.col("_r") == lo, F.col(latency_col))).alias("_vlo"),
        F.max(F.when(F.col("_r") == hi, F.col(latency_col))).alias("_vhi"),
        F.max(pos - lo).alias("_frac"))
    out = stats.join(picks, group_col)
    return out.select(group_col, "mean_latency_ms", "median_latency_ms",
                      (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("p95_latency_ms"),
                      (F.lit(seq_len) / (F.col("mean_latency_ms") / 1000.0)).alias("throughput_tok_s"))


TRAIN_LINE_RX = r"([A-Za-z0-9_]+)/([A-Za-z0-9_]+)=([^ ]+)"


def parse_train_lines(df: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """``prefix/key=value`` tokens of a log line -> map prefix/key -> double; of a token that
    the line repeats, the last value."""
    parts = [F.regexp_extract_all(F.col(line_col), F.lit(TRAIN_LINE_RX), i) for i in (1, 2, 3)]
    keys = F.zip_with(parts[0], parts[1], lambda p, k: F.concat_ws("/", p, k))
    pairs = F.zip_with(keys, parts[2], lambda k, v: F.struct(k.alias("k"), v.try_cast("double").alias("v")))
    last = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1))
    return df.select(id_col, F.map_from_entries(last).alias("metrics"))


def trace_by_correlation(logs: DataFrame, cid_col: str, ts_col: str, level_col: str) -> DataFrame:
    """Per correlation id: first, last, span seconds, entries, errors."""
    return logs.groupBy(cid_col).agg(
        F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"),
        ((epoch_us(F.max(ts_col)) - epoch_us(F.min(ts_col))) / 1e6).alias("span_s"),
        F.count(F.lit(1)).cast("bigint").alias("entries"),
        F.sum((F.col(level_col) == "ERROR").cast("int")).cast("bigint").alias("errors"))


LOG_SCHEMA = ("timestamp string, level string, logger string, message string, module string, line int, "
              "correlation_id string, step bigint, loss double, lr double, exception string")


def read_json_logs(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Structured JSON log lines -> typed columns with an explicit schema
    (no inference; malformed lines give NULL fields)."""
    return lines.select("*", F.from_json(F.col(line_col), LOG_SCHEMA).alias("_l")).select("*", "_l.*").drop("_l")

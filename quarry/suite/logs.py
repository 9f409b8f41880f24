"""Audit, access, request-log and training-metric query keys over ``events``
(endpoint = event_type, key = user_id, latency = value) and ``customer``
(API keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import logs as LG
from quarry.sources.tables import table

RATE_PER_WINDOW, RATE_WINDOW_S = 3, 86_400.0
CACHE_TTL_S = 3 * 86_400.0
AUDIT_ALGO = "sha256"        # the oracle engine has sha256; the library default is sha3_512
RING = 1000
BINS = 10
QUEUE_TIMEOUT_S = 6 * 3600.0
SAMPLE_EVERY = 10


def _events(spark, sf):
    return table(spark, sf, "events")


def _audit_entries(spark, sf):
    e = _events(spark, sf)
    sev = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING")
           .otherwise("INFO"))
    return e.select(F.col("user_id").alias("chain_id"), "ts", "event_id",
                    F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp"),
                    F.upper("event_type").alias("event_type"), sev.alias("severity"), F.col("props").alias("payload"))


def built_chain(spark, sf):
    return LG.audit_chain_build(_audit_entries(spark, sf), "chain_id", ["ts", "event_id"], AUDIT_ALGO)


def tampered_chain(spark, sf):
    b = built_chain(spark, sf)
    return (b.withColumn("payload", F.when(F.col("seq") % 37 == 5, F.lit('{"k": -1}')).otherwise(F.col("payload")))
             .withColumn("prev_hash", F.when(F.col("seq") % 53 == 7, F.lit("X")).otherwise(F.col("prev_hash"))))


def _keys(spark, sf):
    c = table(spark, sf, "customer")
    scopes = (F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("read"), F.lit("admin")))
              .when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit("read"), F.lit("write")))
              .otherwise(F.array(F.lit("read"))))
    expires = (F.when(F.col("c_custkey") % 5 == 0, F.lit("2024-01-15T00:00:00+00:00"))
               .when(F.col("c_custkey") % 5 == 1, F.lit("not-a-date"))
               .when(F.col("c_custkey") % 5 == 2, F.lit(None).cast("string"))
               .otherwise(F.lit("2025-01-01T00:00:00+00:00")))
    return c.select(F.concat(F.lit("ck-"), F.col("c_custkey").cast("string")).alias("key_id"),
                    LG.key_hash(F.concat(F.lit("secret-"), F.col("c_custkey").cast("string"))).alias("key_hash"),
                    F.col("c_name").alias("name"), scopes.alias("scopes"),
                    F.lit("2023-12-01T00:00:00+00:00").alias("created_at"), expires.alias("expires_at"),
                    F.lit(None).cast("string").alias("last_used"), (F.col("c_acctbal") < 0).alias("revoked"))


def _requests(spark, sf):
    e = _events(spark, sf)
    token = F.when(F.col("event_id") % 17 == 3, F.lit("bogus")).otherwise(
        F.concat(F.lit("secret-"), F.col("user_id").cast("string")))
    required = F.when(F.col("event_type") == "purchase", F.lit("write")).otherwise(F.lit("read"))
    return e.select("event_id", "ts", "event_type", token.alias("token"), required.alias("required_scope"))


def q_rate_limit(spark, sf):
    return LG.rate_limit_replay(_events(spark, sf), ["user_id"], "ts", "event_id", RATE_PER_WINDOW, RATE_WINDOW_S)


def q_query_cache_ttl(spark, sf):
    return LG.ttl_cache_replay(_events(spark, sf), ["event_type", "user_id"], "ts", CACHE_TTL_S, "event_id")


def q_audit_chain_build(spark, sf):
    return built_chain(spark, sf).select("chain_id", "seq", "prev_hash", "hash")


def q_audit_chain_verify(spark, sf):
    f = LG.audit_chain_verify(tampered_chain(spark, sf), "chain_id", AUDIT_ALGO)
    return LG.audit_verify_summary(f, "chain_id")


def q_audit_resume(spark, sf):
    return LG.audit_resume(built_chain(spark, sf), "chain_id")


def q_audit_prev_link(spark, sf):
    return LG.audit_prev_link(tampered_chain(spark, sf), "chain_id").select("chain_id", "seq", "prev_hash",
                                                                             "prev_stored_hash")


def q_audit_event_rollup(spark, sf):
    return LG.audit_event_rollup(_audit_entries(spark, sf))


def q_request_metrics(spark, sf):
    log = _events(spark, sf).select(F.col("event_type").alias("endpoint"), F.col("value").alias("latency_ms"),
                                    F.col("event_id").alias("request_id"))
    return LG.request_metrics(log)


def q_ring_buffer_last(spark, sf):
    e = _events(spark, sf).select("event_id", "ts", F.col("event_type").alias("endpoint"),
                                  F.concat(F.lit("user-key-"), F.col("user_id").cast("string")).alias("key"),
                                  F.col("value").alias("latency_ms"))
    return LG.ring_buffer_last(e, RING, "ts", "event_id", "key")


def q_auth_key_join(spark, sf):
    j = LG.auth_key_join(_requests(spark, sf), _keys(spark, sf))
    return j.select("event_id", "key_id", "auth_status")


def q_scope_check(spark, sf):
    j = LG.auth_key_join(_requests(spark, sf), _keys(spark, sf)).filter(F.col("key_id").isNotNull())
    return j.select("event_id", "required_scope", LG.scope_ok("scopes", F.col("required_scope")).alias("scope_ok"))


def q_access_audit(spark, sf):
    a = LG.access_audit(_requests(spark, sf), _keys(spark, sf), F.col("required_scope"))
    return a.select("event_id", "key_id", "decision")


def q_key_last_used(spark, sf):
    a = LG.access_audit(_requests(spark, sf), _keys(spark, sf), F.col("required_scope"))
    return LG.key_last_used(a)


def q_key_inventory(spark, sf):
    return LG.key_inventory(_keys(spark, sf)).select("key_id", "name", F.array_join("scopes", ",").alias("scopes"),
                                                      "expires_at", "revoked")


def q_key_rotation(spark, sf):
    keys = _keys(spark, sf)
    rotate = keys.filter(F.substring("name", -1, 1) == "7").select("key_id")
    r = LG.key_rotation(keys, rotate, F.lit("2024-02-01T00:00:00+00:00"))
    return r.select("key_id", "name", F.array_join("scopes", ",").alias("scopes"), "revoked")


def q_metrics_long(spark, sf):
    e = _events(spark, sf)
    j = F.concat(F.lit('{"loss": '), F.col("value").cast("string"), F.lit(', "tag": "'), F.col("event_type"),
                 F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit(', "as_text": "7"}'))
    return LG.metrics_long(e.select("event_id", j.alias("m")), ["event_id"], "m")


def _steps(spark, sf):
    e = _events(spark, sf)
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "ts",
                    F.col("value").alias("loss"), (k / 1000.0).alias("lr"), (F.col("value") * 100).alias("tok_per_s"),
                    F.when(F.col("event_type") != "view", k / 10.0).alias("grad_norm"))


def q_metrics_sampled(spark, sf):
    s = LG.metrics_sampled(_steps(spark, sf).drop("ts", "run"), SAMPLE_EVERY, "step",
                           ["loss", "lr", "tok_per_s", "grad_norm"])
    return s.select("step", "metric", "value")


def q_running_loss(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", LG.epoch_us("ts").alias("t"), "value")
    r = LG.running_loss(e, "user_id", "t", "value", "event_id")
    # losses are in cents: the cent-rounded running sum over the step count is bit-identical across engines
    return r.select("event_id", "user_id", F.col("steps").cast("bigint").alias("steps"),
                    (F.round("loss_sum", 2) / F.col("steps")).alias("running_loss"))


def q_epoch_loss(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", LG.epoch_us("ts").alias("t"),
                                  F.to_date("ts").alias("epoch"), "value")
    r = LG.running_loss(e, "user_id", "t", "value", "event_id")
    last = r.groupBy("user_id", "epoch").agg(F.max_by(F.struct("loss_sum", "steps"), F.struct("t", "event_id")).alias("_l"))
    return last.select("user_id", F.col("epoch").cast("string").alias("epoch"),
                       (F.round("_l.loss_sum", 2) / F.col("_l.steps")).alias("epoch_loss"))


def q_value_histogram(spark, sf):
    return LG.value_histogram(_events(spark, sf), "event_type", "value", BINS)


def q_latency_summary(spark, sf):
    s = LG.latency_summary(_events(spark, sf), "event_type", "value", 512, id_col="event_id")
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in
                                    ("mean_latency_ms", "median_latency_ms", "p95_latency_ms", "throughput_tok_s")])


def q_parse_train_lines(spark, sf):
    e = _events(spark, sf)
    line = F.format_string("train/step=%d train/loss=%.4f train/tok_per_s=%d", F.col("event_id"), F.col("value"),
                           F.get_json_object("props", "$.k").cast("int"))
    p = LG.parse_train_lines(e.select("event_id", line.alias("line")), "event_id", "line")
    return p.select("event_id", F.col("metrics")["train/step"].alias("step"), F.col("metrics")["train/loss"].alias("loss"),
                    F.col("metrics")["train/tok_per_s"].alias("tok_per_s"))


def q_trace_by_correlation(spark, sf):
    e = _events(spark, sf)
    logs = e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("cid"), "ts",
                    F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"))
    t = LG.trace_by_correlation(logs, "cid", "ts", "level")
    return t.select("cid", "entries", "errors", F.round("span_s", 6).alias("span_s"))


def q_read_json_logs(spark, sf):
    e = _events(spark, sf)
    js = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
                            F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
                            F.lit("quarry.trainer").alias("logger"), F.col("event_type").alias("message"),
                            F.lit("trainer").alias("module"), (F.col("event_id") % 400).cast("int").alias("line"),
                            F.col("user_id").cast("string").alias("correlation_id"), F.col("event_id").alias("step"),
                            F.col("value").alias("loss")))
    lines = e.select("event_id", js.alias("value"))
    p = LG.read_json_logs(lines)
    return p.select("event_id", "timestamp", "level", "message", F.col("line").cast("bigint").alias("line"),
                    "correlation_id", "step", "loss", "lr")


def q_queue_stats(spark, sf):
    e = _events(spark, sf)
    asof = e.groupBy("event_type").agg(F.max("ts").alias("asof"))
    j = e.join(asof, "event_type")
    s = LG.queue_stats(j, "event_type", "ts", F.col("asof"), QUEUE_TIMEOUT_S, "value")
    return s.select("event_type", "queue_depth", "expired", F.round("oldest_age_s", 6).alias("oldest_age_s"),
                    F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


# ------------------------------------------------------------------ SQL oracle

_ENTRIES = """ent AS (SELECT user_id AS chain_id, ts, event_id,
   strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, upper(event_type) AS event_type,
   CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity,
   props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)"""


def _canon(ts, et, sev, payload, prev):
    return (f"'{{\"event_type\": \"' || {et} || '\", \"payload\": ' || {payload} || ', \"prev_hash\": \"' || {prev} "
            f"|| '\", \"severity\": \"' || {sev} || '\", \"timestamp\": \"' || {ts} || '\"}}'")


_CHAIN = f"""{_ENTRIES},
chain AS (SELECT chain_id, seq, timestamp, event_type, severity, payload, 'GENESIS' AS prev_hash,
            sha256({_canon('timestamp', 'event_type', 'severity', 'payload', "'GENESIS'")}) AS hash FROM ent WHERE seq = 0
          UNION ALL
          SELECT e.chain_id, e.seq, e.timestamp, e.event_type, e.severity, e.payload, c.hash AS prev_hash,
            sha256({_canon('e.timestamp', 'e.event_type', 'e.severity', 'e.payload', 'c.hash')}) AS hash
          FROM chain c JOIN ent e ON e.chain_id = c.chain_id AND e.seq = c.seq + 1)"""

_TAMPERED = f"""{_CHAIN},
tam AS (SELECT chain_id, seq, timestamp, event_type, severity,
          CASE WHEN seq % 37 = 5 THEN '{{"k": -1}}' ELSE payload END AS payload,
          CASE WHEN seq % 53 = 7 THEN 'X' ELSE prev_hash END AS prev_hash, hash FROM chain)"""

_KEYS = """keys AS (SELECT 'ck-' || c_custkey AS key_id, sha256('secret-' || c_custkey) AS key_hash,
   CASE WHEN c_mktsegment = 'BUILDING' THEN ['read', 'admin'] WHEN c_mktsegment = 'AUTOMOBILE' THEN ['read', 'write'] ELSE ['read'] END AS scopes,
   c_name AS name,
   CASE c_custkey % 5 WHEN 0 THEN '2024-01-15T00:00:00+00:00' WHEN 1 THEN 'not-a-date' WHEN 2 THEN NULL ELSE '2025-01-01T00:00:00+00:00' END AS expires_at,
   c_acctbal < 0 AS revoked FROM customer),
req AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 17 = 3 THEN 'bogus' ELSE 'secret-' || user_id END AS token,
   CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS required_scope FROM events),
aj AS (SELECT r.*, k.key_id, k.scopes, CASE WHEN k.key_id IS NULL THEN 'unknown' WHEN k.revoked THEN 'revoked'
          WHEN try_cast(k.expires_at AS TIMESTAMPTZ) IS NOT NULL AND r.ts > CAST(try_cast(k.expires_at AS TIMESTAMPTZ) AS TIMESTAMP) THEN 'expired'
          ELSE 'valid' END AS auth_status
       FROM req r LEFT JOIN keys k ON sha256(r.token) = k.key_hash),
aa AS (SELECT *, CASE WHEN auth_status <> 'valid' THEN auth_status
          WHEN NOT (list_contains(scopes, required_scope) OR list_contains(scopes, 'admin')) THEN 'missing_scope'
          ELSE 'allowed' END AS decision FROM aj)"""

_RUN = """r0 AS (SELECT event_id, user_id, ts, value, epoch_us(ts) AS t,
  sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) AS s,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) AS n FROM events),
r AS (SELECT *, round(s, 2) / n AS rl FROM r0)"""

SQL = {
    "rate_limit": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, rn, true AS allowed, [t] AS st FROM e WHERE rn = 1
      UNION ALL
      SELECT e.event_id, e.user_id, e.rn,
        len(list_filter(r.st, lambda x: e.t - x < {int(RATE_WINDOW_S * 1e6)})) < {RATE_PER_WINDOW} AS allowed,
        CASE WHEN len(list_filter(r.st, lambda x: e.t - x < {int(RATE_WINDOW_S * 1e6)})) < {RATE_PER_WINDOW}
             THEN list_append(list_filter(r.st, lambda x: e.t - x < {int(RATE_WINDOW_S * 1e6)}), e.t)
             ELSE list_filter(r.st, lambda x: e.t - x < {int(RATE_WINDOW_S * 1e6)}) END AS st
      FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, allowed, CAST(len(st) AS BIGINT) AS admitted_in_window FROM r""",
    "query_cache_ttl": f"""WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (SELECT event_id, event_type, user_id, rn, false AS hit, t AS last FROM e WHERE rn = 1
      UNION ALL
      SELECT e.event_id, e.event_type, e.user_id, e.rn, e.t - r.last < {int(CACHE_TTL_S * 1e6)} AS hit,
        CASE WHEN e.t - r.last < {int(CACHE_TTL_S * 1e6)} THEN r.last ELSE e.t END AS last
      FROM r JOIN e ON e.event_type = r.event_type AND e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, event_type, user_id, hit FROM r""",
    "audit_chain_build": f"WITH RECURSIVE {_CHAIN} SELECT chain_id, CAST(seq AS BIGINT) AS seq, prev_hash, hash FROM chain",
    "audit_chain_verify": f"""WITH RECURSIVE {_TAMPERED},
f AS (SELECT chain_id, seq,
   CASE WHEN prev_hash IS NOT DISTINCT FROM (CASE WHEN seq = 0 THEN 'GENESIS' ELSE lag(hash) OVER (PARTITION BY chain_id ORDER BY seq) END) THEN 0 ELSE 1 END
   + CASE WHEN hash = sha256({_canon('timestamp', 'event_type', 'severity', 'payload', 'prev_hash')}) THEN 0 ELSE 1 END AS faults FROM tam)
SELECT chain_id, CAST(count(*) AS BIGINT) AS total, CAST(sum(faults) AS BIGINT) AS invalid, sum(faults) = 0 AS valid
FROM f GROUP BY ROLLUP (chain_id)""",
    "audit_resume": f"""WITH RECURSIVE {_CHAIN}
SELECT chain_id, arg_max(hash, seq) AS last_hash, CAST(max(seq) AS BIGINT) AS last_seq FROM chain GROUP BY chain_id""",
    "audit_prev_link": f"""WITH RECURSIVE {_TAMPERED}
SELECT a.chain_id, CAST(a.seq AS BIGINT) AS seq, a.prev_hash, b.hash AS prev_stored_hash
FROM tam a LEFT JOIN tam b ON b.chain_id = a.chain_id AND b.seq = a.seq - 1""",
    "audit_event_rollup": f"""WITH {_ENTRIES}
SELECT event_type, severity, CAST(count(*) AS BIGINT) AS entries FROM ent GROUP BY CUBE (event_type, severity)""",
    "request_metrics": """WITH r AS (SELECT event_type AS endpoint, value AS latency_ms,
   row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT endpoint, CAST(count(*) AS BIGINT) AS count, round(avg(latency_ms), 2) AS avg_latency_ms,
  round(max(CASE WHEN rn = floor(n * 0.95::DOUBLE) + 1 THEN latency_ms END), 2) AS p95_latency_ms FROM r GROUP BY endpoint
UNION ALL SELECT NULL, CAST(count(*) AS BIGINT), round(avg(value), 2), NULL FROM events""",
    "ring_buffer_last": f"""SELECT event_id, ts, event_type AS endpoint, left('user-key-' || user_id, 8) || '...' AS key, value AS latency_ms
FROM events ORDER BY ts DESC, event_id DESC LIMIT {RING}""",
    "auth_key_join": f"WITH {_KEYS} SELECT event_id, key_id, auth_status FROM aj",
    "scope_check": f"""WITH {_KEYS} SELECT event_id, required_scope,
  list_contains(scopes, required_scope) OR list_contains(scopes, 'admin') AS scope_ok FROM aj WHERE key_id IS NOT NULL""",
    "access_audit": f"WITH {_KEYS} SELECT event_id, key_id, decision FROM aa",
    "key_last_used": f"WITH {_KEYS} SELECT key_id, max(ts) AS last_used FROM aa WHERE auth_status = 'valid' GROUP BY key_id",
    "key_inventory": f"WITH {_KEYS} SELECT key_id, name, array_to_string(scopes, ',') AS scopes, expires_at, revoked FROM keys",
    "key_rotation": f"""WITH {_KEYS},
rot AS (SELECT key_id FROM keys WHERE right(name, 1) = '7')
SELECT key_id, name, array_to_string(scopes, ',') AS scopes, revoked OR key_id IN (SELECT key_id FROM rot) AS revoked FROM keys
UNION ALL
SELECT 'ck-' || substr(sha256(key_id || ':rotated'), 1, 24), name, array_to_string(scopes, ','), false FROM keys
WHERE key_id IN (SELECT key_id FROM rot)""",
    "metrics_long": """SELECT event_id, 'loss' AS name, value FROM events
UNION ALL SELECT event_id, 'k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events""",
    "metrics_sampled": f"""WITH s AS (SELECT event_id AS step, value AS loss, CAST(json_extract(props, '$.k') AS DOUBLE) / 1000.0 AS lr,
   value * 100 AS tok_per_s, CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS DOUBLE) / 10.0 END AS grad_norm
   FROM events WHERE event_id % {SAMPLE_EVERY} = 0)
SELECT step, metric, value FROM (UNPIVOT s ON loss, lr, tok_per_s, grad_norm INTO NAME metric VALUE value) WHERE value IS NOT NULL""",
    "running_loss": f"WITH {_RUN} SELECT event_id, user_id, CAST(n AS BIGINT) AS steps, rl AS running_loss FROM r",
    "epoch_loss": f"""WITH {_RUN}
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS epoch, arg_max(rl, (t, event_id)) AS epoch_loss
FROM r GROUP BY user_id, CAST(ts AS DATE)""",
    "value_histogram": f"""WITH g AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
b AS (SELECT e.event_type, CAST(CASE WHEN g.hi = g.lo THEN 0 ELSE least(floor((e.value - g.lo) / (g.hi - g.lo) * {BINS}), {BINS - 1}) END AS BIGINT) AS bucket,
        g.lo, g.hi FROM events e JOIN g USING (event_type))
SELECT event_type, bucket, CAST(count(*) AS BIGINT) AS count, min(lo) AS lo, min(hi) AS hi FROM b GROUP BY event_type, bucket""",
    "latency_summary": """SELECT event_type, round(avg(value), 6) AS mean_latency_ms, round(quantile_disc(value, 0.5), 6) AS median_latency_ms,
  round(quantile_cont(value, 0.95), 6) AS p95_latency_ms, round(512 / (avg(value) / 1000.0), 6) AS throughput_tok_s
FROM events GROUP BY event_type""",
    "parse_train_lines": """SELECT event_id, CAST(event_id AS DOUBLE) AS step, CAST(printf('%.4f', value) AS DOUBLE) AS loss,
  CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS DOUBLE) AS tok_per_s FROM events""",
    "trace_by_correlation": """SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS cid, CAST(count(*) AS BIGINT) AS entries,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span_s FROM events GROUP BY 1""",
    "read_json_logs": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS message,
  CAST(event_id % 400 AS BIGINT) AS line, CAST(user_id AS VARCHAR) AS correlation_id, event_id AS step, value AS loss,
  CAST(NULL AS DOUBLE) AS lr FROM events""",
    "queue_stats": f"""WITH a AS (SELECT event_type, max(ts) AS asof FROM events GROUP BY event_type),
j AS (SELECT e.event_type, e.value, (epoch_us(a.asof) - epoch_us(e.ts)) / 1e6 AS age FROM events e JOIN a USING (event_type))
SELECT event_type, CAST(sum(CASE WHEN age > {QUEUE_TIMEOUT_S} THEN 0 ELSE 1 END) AS BIGINT) AS queue_depth,
  CAST(sum(CASE WHEN age > {QUEUE_TIMEOUT_S} THEN 1 ELSE 0 END) AS BIGINT) AS expired,
  round(max(CASE WHEN age > {QUEUE_TIMEOUT_S} THEN NULL ELSE age END), 6) AS oldest_age_s, round(avg(value), 6) AS avg_latency_ms
FROM j GROUP BY event_type""",
}

QUERIES = {
    "rate_limit": q_rate_limit,
    "query_cache_ttl": q_query_cache_ttl,
    "audit_chain_build": q_audit_chain_build,
    "audit_chain_verify": q_audit_chain_verify,
    "audit_resume": q_audit_resume,
    "audit_prev_link": q_audit_prev_link,
    "audit_event_rollup": q_audit_event_rollup,
    "request_metrics": q_request_metrics,
    "ring_buffer_last": q_ring_buffer_last,
    "auth_key_join": q_auth_key_join,
    "scope_check": q_scope_check,
    "access_audit": q_access_audit,
    "key_last_used": q_key_last_used,
    "key_inventory": q_key_inventory,
    "key_rotation": q_key_rotation,
    "metrics_long": q_metrics_long,
    "metrics_sampled": q_metrics_sampled,
    "running_loss": q_running_loss,
    "epoch_loss": q_epoch_loss,
    "value_histogram": q_value_histogram,
    "latency_summary": q_latency_summary,
    "parse_train_lines": q_parse_train_lines,
    "trace_by_correlation": q_trace_by_correlation,
    "read_json_logs": q_read_json_logs,
    "queue_stats": q_queue_stats,
}

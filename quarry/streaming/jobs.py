"""Structured Streaming jobs.

Each job is a function from a streaming DataFrame to a streaming DataFrame
(plus, for stateful ones, the per-key state schema).  ``run_available_now``
drives a job over a file source with ``trigger(availableNow=True)`` into a
parquet sink under the cluster's checkpoint folder and returns the sink as a
batch DataFrame; ``table_stream`` reads a given table as it is.

Stateful semantics (limiter, cache, memory window, chain verification,
running mean) use ``applyInPandasWithState``: rows of a key inside a
micro-batch are sorted by event time, state carries across micro-batches,
and event-time timeouts evict idle keys once the watermark passes.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.session import ensure_checkpoint_dir


# ------------------------------------------------------------------ plumbing

def scratch_path(spark: SparkSession, kind: str, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{kind}/{name}-{uuid.uuid4().hex[:10]}"


def table_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """File stream over a parquet table, a folder or a file.

    Without ``max_files`` a micro-batch takes all files that are there, in whatever
    order they were written.  With it, files come in order of modification, so a
    feed must be written in event order up to the watermark.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def derived_stream(df: DataFrame, name: str) -> DataFrame:
    """File stream over ``df``, written once as a table by all its tasks."""
    path = scratch_path(df.sparkSession, "feeds", name)
    df.write.parquet(path)
    return table_stream(df.sparkSession, path)


def closing_source(rows: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """A stream without rows, and a function that appends ``rows`` to its folder: a later
    event that moves the watermark on, so that windows, sessions and joins close."""
    path = scratch_path(rows.sparkSession, "feeds", f"{name}-closing")
    rows.limit(0).write.parquet(path)
    return table_stream(rows.sparkSession, path), lambda: rows.write.mode("append").parquet(path)


def progress_metrics(query) -> dict:
    """Micro-batches, input rows, rows dropped as late by the watermark (summed over the
    stateful operators of every progress report) and the most bytes that a state held."""
    batches = query.recentProgress
    late = sum(op.get("numRowsDroppedByWatermark", 0) for b in batches for op in b.get("stateOperators", []))
    held = max((op.get("memoryUsedBytes", 0) for b in batches for op in b.get("stateOperators", [])), default=0)
    return {"batches": len(batches), "input_rows": sum(b.get("numInputRows", 0) for b in batches),
            "late_rows_dropped": late, "state_bytes": held}


#: States that timers and map states need: kept by RocksDB, in files under the checkpoint.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextlib.contextmanager
def session_conf(spark: SparkSession, conf: dict):
    """The session's settings changed for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append",
                      metrics: dict | None = None, closing: Sequence[Callable[[], None]] = (), conf: dict | None = None) -> DataFrame:
    """Run a streaming query to completion over what is available now; return
    the sink as a batch DataFrame.  ``metrics`` (if given) receives
    ``progress_metrics`` of the first run, including late rows dropped.

    ``closing`` is called after that run; the query is then resumed from its
    checkpoint and reads what was appended to its sources.  ``conf`` holds while it runs."""
    spark = stream.sparkSession
    out = scratch_path(spark, "sinks", name)
    ckpt = scratch_path(spark, "stream-checkpoints", name)

    def run():
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode(output_mode).trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
        return q

    with session_conf(spark, conf or {}):
        first = run()
        if metrics is not None:
            metrics.update(progress_metrics(first))
        for append in closing:
            append()
        if closing:
            run()
    return spark.read.parquet(out)


def run_foreach_batch(stream: DataFrame, name: str, handler) -> str:
    """foreachBatch sink: ``handler(batch_df, batch_id, out_dir)`` must write
    idempotently per batch id (exactly-once on restart).  Returns out_dir."""
    spark = stream.sparkSession
    out = scratch_path(spark, "sinks", name)
    ckpt = scratch_path(spark, "stream-checkpoints", name)
    q = (stream.writeStream.foreachBatch(lambda b, i: handler(b, i, out))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


# ------------------------------------------------------------------ stateless

def stream_safety(stream: DataFrame, text_col: str, is_input_col: str | None = None, policy=None) -> DataFrame:
    """Moderation verdict per message; the same expression as the batch operator."""
    from quarry.operators.safety import moderate
    return moderate(stream, text_col, policy, is_input_col)


#: Size of a latency sketch: up to so many latencies it is exact, beyond that ranks are off
#: by about 2.3 / SKETCH_SIZE**0.9 of all (0.3 %), and it holds about 3 times as many.
SKETCH_SIZE = 2000


def stream_request_metrics(stream: DataFrame, ts_col: str, endpoint_col: str, latency_col: str,
                           window: str, watermark: str, slide: str | None = None, sketch_size: int = SKETCH_SIZE) -> DataFrame:
    """Per endpoint and window (tumbling, or sliding by ``slide``): count, mean, p95 (the least
    latency that 95 % do not exceed) and max latency; late rows beyond the watermark are dropped.
    Append mode emits a window once the watermark passes its end.  An open window
    keeps a quantile sketch (KLL) whose size does not depend on how many requests it
    has seen; ``latency_sketch`` is it, to be merged over windows or endpoints."""
    return (stream.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window, slide).alias("w"), endpoint_col)
            .agg(F.count(F.lit(1)).alias("count"), F.avg(latency_col).alias("avg_latency_ms"),
                 F.kll_sketch_agg_double(F.col(latency_col).cast("double"), F.lit(sketch_size)).alias("latency_sketch"),
                 F.max(latency_col).alias("max_latency_ms"))
            .select(F.col("w.start").alias("window_start"), endpoint_col, "count", "avg_latency_ms", sketched_p95("latency_sketch", latency_col),
                    "max_latency_ms", "latency_sketch"))


def sketched_p95(sketch: str, latency_col: str = "latency") -> Column:
    """p95 of a latency sketch (NULL if it has seen none)."""
    n = F.kll_sketch_get_n_double(sketch)
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(0.95))).alias("p95_latency_ms")


def stream_sessions(stream: DataFrame, ts_col: str, key_col: str, gap: str, watermark: str) -> DataFrame:
    """Traces per correlation id closed after ``gap`` of inactivity (session windows)."""
    return (stream.withWatermark(ts_col, watermark)
            .groupBy(F.session_window(ts_col, gap).alias("s"), key_col)
            .agg(F.count(F.lit(1)).alias("entries"), F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"))
            .select(key_col, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "entries", "first_ts", "last_ts"))


def stream_queue_expiry(enqueued: DataFrame, dequeued: DataFrame, id_col: str, enq_ts: str, deq_ts: str,
                        timeout: str, watermark: str) -> DataFrame:
    """Stream-stream left join: a request without a dequeue within the timeout
    is emitted with a NULL dequeue time (expired) once the watermark passes."""
    e = enqueued.withWatermark(enq_ts, watermark).alias("e")
    d = dequeued.withWatermark(deq_ts, watermark).alias("d")
    cond = (F.col(f"e.{id_col}") == F.col(f"d.{id_col}_d")) & \
           (F.col(f"d.{deq_ts}") >= F.col(f"e.{enq_ts}")) & \
           (F.col(f"d.{deq_ts}") <= F.col(f"e.{enq_ts}") + F.expr(f"INTERVAL {timeout}"))
    j = e.join(d, cond, "leftOuter")
    return j.select(F.col(f"e.{id_col}").alias(id_col), F.col(f"e.{enq_ts}").alias(enq_ts),
                    F.col(f"d.{deq_ts}").alias(deq_ts), F.col(f"d.{deq_ts}").isNull().alias("expired"))


#: Kinds of queue events.
ENTERED, LEFT = "enqueue", "dequeue"
_MICROS = 1_000_000


class QueueDepth(StatefulProcessor):
    """Requests that wait in a share of a queue, and a timer at each tick that may see one.

    State: when each request came and went (0: not known), as bytes of 64-bit integers; for each
    tick to come that sees some, how many, and since when the oldest waits; the last tick that
    went off, and the last that a request may see.  A micro-batch joins its events to the requests
    once and corrects the ticks that it changes.  An event-time timer goes off at a tick once
    the watermark has passed it, so that all that happened until then is known; it reads that
    tick alone.  Requests that no later tick can see are forgotten when the next events come, or at
    the last tick.  Shares bound the state of a queue that grows."""

    COLUMNS = ("id", "came", "went")

    def __init__(self, tick_s: int, timeout_s: int):
        self.tick, self.timeout = tick_s * _MICROS, timeout_s * _MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "ids binary, came binary, went binary")
        self.ticks = handle.getMapState("ticks", "tick long", "depth long, oldest long")
        self.clock = handle.getValueState("clock", "fired long, final long")

    def known(self, now: int) -> pd.DataFrame:
        """The requests, less those that no tick after ``now`` can see."""
        held = self.waiting.get() or (b"", b"", b"")
        rows = pd.DataFrame({c: np.frombuffer(bytes(x), np.int64) for c, x in zip(self.COLUMNS, held, strict=True)})
        gone = ((rows["went"] > 0) & (rows["went"] <= now)) | ((rows["came"] > 0) & (now - rows["came"] > self.timeout))
        return rows[~gone]

    def keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.waiting.update(tuple(rows[c].to_numpy(np.int64).tobytes() for c in self.COLUMNS))
        else:
            self.waiting.clear()

    def seen(self, rows: pd.DataFrame, now: int) -> dict[int, tuple[int, int]]:
        """Depth and arrival of the oldest at each tick after ``now`` that sees some of the requests."""
        came, went = rows["came"].to_numpy(), rows["went"].to_numpy()
        came, went = came[came > 0], went[came > 0]
        first, last = -(-came // self.tick), (came + self.timeout) // self.tick
        parts = []
        for step in range(int((last - first).max(initial=-1)) + 1):
            at = (first + step) * self.tick
            waits = (first + step <= last) & (at > now) & ((went == 0) | (went > at))
            parts.append(pd.DataFrame({"tick": at[waits], "came": came[waits]}).groupby("tick")["came"].agg(["size", "min"]))
        if not parts:
            return {}
        both = pd.concat(parts).groupby(level=0).agg({"size": "sum", "min": "min"})
        return dict(zip(both.index.tolist(), zip(both["size"].tolist(), both["min"].tolist(), strict=True), strict=True))

    def handleInputRows(self, key, rows, timerValues):
        fired, final = self.clock.get() or (0, 0)
        held = self.known(fired)
        parts = []
        for pdf in rows:
            at, enters = pdf["micros"].to_numpy(np.int64), (pdf["kind"] == ENTERED).to_numpy()
            parts.append(pd.DataFrame({"id": pdf["id"].to_numpy(np.int64), "came": np.where(enters, at, 0), "went": np.where(enters, 0, at)}))
        came = np.concatenate([p["came"].to_numpy() for p in parts])
        came = came[came > 0]
        first, last = -(-came // self.tick), (came + self.timeout) // self.tick
        timers: set[int] = set()
        for step in range(int((last - first).max(initial=-1)) + 1):
            timers.update(np.unique((first + step)[first + step <= last]).tolist())
        for at in timers:
            self.handle.registerTimer(at * self.tick // 1000)
        both = pd.concat([held, *parts]).groupby("id", as_index=False).max()
        before, after = self.seen(held, fired), self.seen(both, fired)
        for at, now in after.items():
            if before.get(at) != now:
                self.ticks.updateValue((at,), now)
        for at in before.keys() - after.keys():
            self.ticks.removeKey((at,))
        self.keep(both)
        self.clock.update((fired, max(final, max(timers, default=0) * self.tick)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        fired, final = self.clock.get()
        self.clock.update((max(fired, now), final))
        if now >= final:  # without later events, the last chance to forget
            self.keep(self.known(now))
        found = self.ticks.getValue((now,))
        if found is not None:
            self.ticks.removeKey((now,))
            yield pd.DataFrame({"queue": [key[0]], "share": [key[1]], "tick": [now], "depth": [int(found[0])], "oldest": [int(found[1])]})

    def close(self) -> None:
        pass


def stream_queue_depth(events: DataFrame, queue_col: str, id_col: str, kind_col: str, ts_col: str, tick_seconds: int,
                       timeout_seconds: int, watermark: str, shares: int = 16) -> DataFrame:
    """(queue, share, tick, depth, oldest): how many requests wait at each tick that sees some, and
    since when the oldest does (microseconds), by share of a queue.  A request waits from its
    ``ENTERED`` event until its ``LEFT`` event, for at most the timeout.  Requests are dealt to
    shares by id, so that no task holds a whole queue; ``queue_depth`` adds them up.  Events
    without an id or a time are left out."""
    src = events.withWatermark(ts_col, watermark).filter(F.col(id_col).isNotNull() & F.col(ts_col).isNotNull())
    share = F.pmod(F.xxhash64(id_col), F.lit(shares)).cast("int")
    rows = src.select(F.col(queue_col).cast("string").alias("queue"), share.alias("share"), F.col(id_col).cast("bigint").alias("id"),
                      F.col(kind_col).alias("kind"), F.unix_micros(ts_col).alias("micros"), F.col(ts_col).alias("time"))
    return rows.groupBy("queue", "share").transformWithStateInPandas(
        QueueDepth(tick_seconds, timeout_seconds), "queue string, share int, tick long, depth long, oldest long", "append", "EventTime")


def queue_depth(shares: DataFrame) -> DataFrame:
    """(queue, tick, queue_depth, oldest_age_s) of the rows of ``stream_queue_depth``."""
    both = shares.groupBy("queue", "tick").agg(F.sum("depth").alias("queue_depth"), F.min("oldest").alias("_oldest"))
    return both.select("queue", F.timestamp_micros("tick").alias("tick"), "queue_depth", ((F.col("tick") - F.col("_oldest")) / _MICROS).alias("oldest_age_s"))


# ------------------------------------------------------------------ stateful

def _timed(stream: DataFrame, ts_col: str | None, watermark_seconds: int) -> tuple[DataFrame, str]:
    """The stream with a watermark, and the kind of timeout; without an event time
    there is neither, and states stay until the query ends."""
    if ts_col is None:
        return stream, GroupStateTimeout.NoTimeout
    return stream.withWatermark(ts_col, f"{int(watermark_seconds)} seconds"), GroupStateTimeout.EventTimeTimeout


def _expire_after(state, timed: bool, seconds: float) -> None:
    """A key that stays idle until the watermark is ``seconds`` on loses its state."""
    if timed:
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int(seconds * 1000) + 1)


def _micros(s: pd.Series) -> np.ndarray:
    return s.to_numpy(dtype="int64")


def stream_rate_limit(stream: DataFrame, key_col: str, ts_col: str, id_col: str, limit: int,
                      window_seconds: float, watermark_seconds: int) -> DataFrame:
    """Sliding-window limiter with list state (admitted times of the key).

    A key's state is dropped once the watermark is a full window (plus the
    watermark delay) past the key's last batch: no later event can still see
    those admissions."""
    win = int(window_seconds * 1_000_000)
    src = stream.withColumn("_t", F.unix_micros(F.col(ts_col).cast("timestamp"))) \
                .withWatermark(ts_col, f"{int(watermark_seconds)} seconds")

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        admitted = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", id_col], kind="mergesort")
        ids, allowed, inwin = [], [], []
        for t, i in zip(_micros(pdf["_t"]), pdf[id_col].to_numpy()):
            t = int(t)
            admitted = [a for a in admitted if t - a < win]
            ok = len(admitted) < limit
            if ok:
                admitted.append(t)
            ids.append(int(i))
            allowed.append(ok)
            inwin.append(len(admitted))
        state.update((admitted,))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int((window_seconds + watermark_seconds) * 1000) + 1)
        yield pd.DataFrame({id_col: ids, key_col: key[0], "allowed": allowed, "admitted_in_window": inwin})

    out = f"{id_col} long, {key_col} long, allowed boolean, admitted_in_window long"
    return src.groupBy(key_col).applyInPandasWithState(fn, out, "admitted array<long>", "append",
                                                       GroupStateTimeout.EventTimeTimeout)


def stream_query_cache(stream: DataFrame, key_cols: list[str], ts_col: str, id_col: str, ttl_seconds: float,
                       watermark_seconds: int, shares: int = 256) -> DataFrame:
    """TTL cache: an event of a key hits if the key's last miss is less than the ttl ago.

    Keys (of atomic types) are dealt to shares, so that the calls to Python don't grow with the
    keys.  State of a share: its keys' last misses (Arrow), each kept until the watermark is the ttl past it."""
    ttl = int(ttl_seconds * 1_000_000)
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    names = [f"_k{i}" for i in range(len(key_cols))]
    keys = [F.col(k) + F.lit(0.0).cast(types[k]) if types[k] in ("float", "double") else F.col(k) for k in key_cols]  # one zero
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    src = stream.withWatermark(ts_col, f"{int(watermark_seconds)} seconds").select(
        F.pmod(F.xxhash64(*keys), F.lit(shares)).cast("int").alias("_share"), F.col(ts_col), *[k.cast("string").alias(n) for k, n in zip(keys, names)],
        # numbers without nulls stay integers in pandas
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"), F.col(id_col).isNull().alias("_no_id"),
        F.coalesce(micros, F.lit(-(1 << 63))).alias("_t"), micros.isNull().alias("_no_t"))
    held_schema = pa.schema([*[(n, pa.string()) for n in names], ("_t", pa.int64())])

    def held(state) -> pd.DataFrame:
        if not state.exists:
            return held_schema.empty_table().to_pandas()
        rows = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas()
        return rows[rows["_t"] + ttl > state.getCurrentWatermarkMs() * 1000]

    def keep(state, rows: pd.DataFrame) -> None:
        if rows.empty:
            if state.exists:
                state.remove()
            return
        table, out = pa.Table.from_pandas(rows, held_schema, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held_schema) as w:
            w.write_table(table)
        state.update((out.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + int((ttl_seconds + watermark_seconds) * 1000) + 1)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            keep(state, held(state))
            return
        known = held(state).assign(_id=0, _no_id=False, _no_t=False, _new=False)
        rows = pd.concat([known, *[p.assign(_new=True) for p in pdfs]], ignore_index=True)
        code = rows.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((rows["_id"], rows["_no_id"], rows["_t"], rows["_no_t"], rows["_new"], code))
        rows, code = rows.iloc[order], code[order]
        starts = np.append(True, code[1:] != code[:-1])
        hits, misses, last = [], [], None
        for begins, new, t in zip(starts.tolist(), rows["_new"].tolist(), rows["_t"].tolist()):
            if begins:
                last = None
            hit = new and last is not None and t - last < ttl
            if not hit:
                last = t
            hits.append(hit)
            misses.append(last)
        ends = np.append(starts[1:], True)
        keep(state, rows.assign(_t=misses)[ends][[*names, "_t"]])
        yield rows.assign(hit=hits)[rows["_new"].to_numpy(bool)][["_id", "_no_id", *names, "hit"]]

    schema = ", ".join(["_id long, _no_id boolean", *[f"{n} string" for n in names], "hit boolean"])
    found = src.groupBy("_share").applyInPandasWithState(fn, schema, "cached binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.when(~F.col("_no_id"), F.col("_id")).alias(id_col), *[F.col(n).cast(types[k]).alias(k) for k, n in zip(key_cols, names)], "hit")


def stream_memory(stream: DataFrame, conv_col: str, turn_col: str, tokens_col: str, max_tokens: int, ts_col: str | None = None,
                  watermark_seconds: int = 3600, idle_seconds: float = 86_400) -> DataFrame:
    """Per conversation, the retained window after each message: append, then
    drop the oldest while the total exceeds max_tokens and more than one
    message remains.  State: retained (turn, tokens) lists.  With ``ts_col``, a conversation that is idle
    for ``idle_seconds`` and the watermark delay of event time is forgotten."""
    src, timeout = _timed(stream, ts_col, watermark_seconds)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        turns, toks = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(turn_col, kind="mergesort")
        rows = []
        for t, n in zip(pdf[turn_col].to_numpy(), pdf[tokens_col].to_numpy()):
            turns.append(int(t))
            toks.append(int(n))
            total = sum(toks)
            while total > max_tokens and len(turns) > 1:
                total -= toks.pop(0)
                turns.pop(0)
            rows.append((int(t), turns[0], len(turns), total))
        state.update((turns, toks))
        _expire_after(state, ts_col is not None, watermark_seconds + idle_seconds)
        yield pd.DataFrame(rows, columns=[turn_col, "window_start_turn", "window_messages", "window_tokens"]).assign(
            **{conv_col: key[0]})[[conv_col, turn_col, "window_start_turn", "window_messages", "window_tokens"]]

    out = f"{conv_col} long, {turn_col} long, window_start_turn long, window_messages long, window_tokens long"
    return src.groupBy(conv_col).applyInPandasWithState(fn, out, "turns array<long>, toks array<long>", "append", timeout)


def stream_audit_verify(stream: DataFrame, chain_col: str, seq_col: str, genesis: str = "GENESIS", ts_col: str | None = None,
                        watermark_seconds: int = 3600, idle_seconds: float = 86_400) -> DataFrame:
    """Per chain: the expected prev_hash is the last *stored* hash seen; an
    entry whose prev_hash differs is emitted with ok = false.  With ``ts_col``, a chain that is idle
    for ``idle_seconds`` and the watermark delay of event time is closed: its next
    entry has to start from genesis."""
    src, timeout = _timed(stream, ts_col, watermark_seconds)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else genesis
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(seq_col, kind="mergesort")
        oks = []
        for prev, h in zip(pdf["prev_hash"], pdf["hash"]):
            oks.append(prev == last)
            last = h
        state.update((last,))
        _expire_after(state, ts_col is not None, watermark_seconds + idle_seconds)
        yield pd.DataFrame({chain_col: key[0], seq_col: pdf[seq_col].to_numpy(), "prev_ok": oks})

    out = f"{chain_col} long, {seq_col} long, prev_ok boolean"
    return src.groupBy(chain_col).applyInPandasWithState(fn, out, "last_hash string", "append", timeout)


def stream_train_metrics(stream: DataFrame, run_col: str, step_col: str, loss_col: str, every: int, ts_col: str | None = None,
                         watermark_seconds: int = 3600, idle_seconds: float = 86_400) -> DataFrame:
    """Every n-th step: the running mean loss of the run so far (all steps
    count; state = running sum and count).  With ``ts_col``, a run that is idle
    for ``idle_seconds`` and the watermark delay of event time starts afresh."""
    src, timeout = _timed(stream, ts_col, watermark_seconds)

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        s, n = (state.get[0], state.get[1]) if state.exists else (0.0, 0)
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(step_col, kind="mergesort")
        rows = []
        for st, l in zip(pdf[step_col].to_numpy(), pdf[loss_col].to_numpy()):
            s += float(l)
            n += 1
            if int(st) % every == 0:
                rows.append((int(st), s, n))
        state.update((s, n))
        _expire_after(state, ts_col is not None, watermark_seconds + idle_seconds)
        yield pd.DataFrame(rows, columns=[step_col, "loss_sum", "steps"]).assign(**{run_col: key[0]})[
            [run_col, step_col, "loss_sum", "steps"]]

    out = f"{run_col} long, {step_col} long, loss_sum double, steps long"
    return src.groupBy(run_col).applyInPandasWithState(fn, out, "s double, n long", "append", timeout)


def stream_ingest_batch(batch: DataFrame, batch_id: int, out_dir: str, key: str = "path",
                        text: str = "value", add_bos=True, add_eos=True, separator="\n"):
    """foreachBatch body: text records -> token counts per record, written under
    batch_id (overwrite of the same batch id makes a replay idempotent)."""
    from quarry.functions.text import is_blank
    from quarry.operators.tokens import byte_token_count
    res = (batch.filter(~is_blank(text))
           .select(F.col(key), F.length(text).cast("bigint").alias("n_chars"),
                   byte_token_count(text, add_bos, add_eos, separator).alias("n_tokens")))
    res.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

"""Streaming behaviour beyond the batch-twin oracle: late rows are dropped by
the watermark and counted."""

import time
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from quarry.streaming import jobs as J


def feed(df, n, name):
    """A stream that gives the rows of _slice 0, 1, ... n - 1 a micro-batch each."""
    root = J.scratch_path(df.sparkSession, "feeds", name)
    for i in range(n):  # files are taken in the order of their times, which may be whole seconds
        df.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.05)
    return J.table_stream(df.sparkSession, root, max_files=1)


def test_late_rows_dropped_and_counted(spark):
    t0 = datetime(2024, 1, 1)
    on_time = [(i, t0 + timedelta(hours=i), "view", 1.0) for i in range(6)]
    more = [(6, t0 + timedelta(hours=6), "view", 1.0)]
    late = [(100, t0, "view", 99.0)]                      # 6 hours behind the stream, watermark 1 hour
    closer = [(200, t0 + timedelta(days=2), "view", 1.0)]  # advances the watermark past every window
    schema = "event_id long, ts timestamp, event_type string, value double"
    # Spark judges lateness against the previous batch's watermark, so the late
    # row arrives two batches after the watermark moved past its window
    df = spark.createDataFrame([(*r, 0) for r in on_time] + [(*r, 1) for r in more] + [(*r, 2) for r in late]
                               + [(*r, 3) for r in closer], schema + ", _slice int")
    stream = feed(df, 4, "late")
    m = {}
    out = J.run_available_now(J.stream_request_metrics(stream, "ts", "event_type", "value", "1 hour", "1 hour"),
                              "late-test", metrics=m)
    rows = out.orderBy("window_start").collect()
    assert [r["count"] for r in rows] == [1] * 7   # the late row never reaches a window
    assert max(r.max_latency_ms for r in rows) == 1.0
    assert m["late_rows_dropped"] >= 1 and m["batches"] >= 3


def test_state_is_carried_and_expires(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, 1, t0, 1.0, 0), (1, 2, t0, 2.0, 0), (2, 3, t0, 5.0, 0), (1, 4, t0 + timedelta(minutes=5), 3.0, 1),
            (9, 5, t0 + timedelta(days=3), 0.0, 2), (9, 6, t0 + timedelta(days=3), 0.0, 3),
            (1, 7, t0 + timedelta(days=3), 7.0, 4)]
    df = spark.createDataFrame(rows, "run long, step long, ts timestamp, loss double, _slice int")

    def sums(ts_col):
        out = J.stream_train_metrics(feed(df, 5, "train"), "run", "step", "loss", 1, ts_col, 60, 600)
        return {r.step: (r.loss_sum, r.steps) for r in J.run_available_now(out, "train-test").collect()}

    got = sums("ts")
    assert got[2] == (3.0, 2) and got[3] == (5.0, 1)
    assert got[4] == (6.0, 3)   # carried from the first micro-batch
    assert got[7] == (7.0, 1)   # idle for three days: forgotten
    assert sums(None)[7] == (13.0, 4)


def test_closing_event_resumes_from_checkpoint(spark):
    t0 = datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, event_type string, value double"
    events = J.derived_stream(spark.createDataFrame([(i, t0 + timedelta(minutes=i), "view", float(i)) for i in range(20)], schema), "open")
    closer, append = J.closing_source(spark.createDataFrame([(-1, t0 + timedelta(days=2), None, None)], schema), "open")
    out = J.stream_request_metrics(events.unionByName(closer), "ts", "event_type", "value", "1 hour", "1 hour")
    assert J.run_available_now(out, "open-test").count() == 0
    rows = J.run_available_now(out, "closed-test", closing=[append]).collect()
    assert [(r["count"], r.p95_latency_ms, r.max_latency_ms) for r in rows] == [(20, 18.0, 19.0)]


def test_queue_depth_by_ticks(spark):
    """Depth and oldest age at each tick: over several micro-batches, a departure that arrives
    before its arrival, one after the timeout, a late event, and a queue without departures."""
    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    rows = [("a", 1, "enqueue", at(1), 0), ("a", 2, "enqueue", at(2), 0), ("b", 3, "enqueue", at(5), 0), ("a", 4, "dequeue", at(25), 0),
            ("a", 1, "dequeue", at(12), 1), ("a", 4, "enqueue", at(11), 1), ("a", 2, "dequeue", at(90), 1), ("a", 5, "enqueue", at(20), 1),
            ("c", 9, "enqueue", at(600), 2), ("c", 10, "enqueue", at(601), 3),
            ("a", 6, "enqueue", at(30), 4),  # ten hours behind the watermark
            ("c", 11, "enqueue", at(3000), 5), (None, 12, "enqueue", at(3001), 5), ("c", None, "enqueue", at(3001), 5)]
    df = spark.createDataFrame(rows, "queue string, id long, kind string, ts timestamp, _slice int")
    metrics = {}
    out = J.stream_queue_depth(feed(df, 6, "depth"), "queue", "id", "kind", "ts", 600, 3000, "5 minutes", shares=3)
    sink = J.run_available_now(out, "depth-test", metrics=metrics, conf=J.ROCKSDB)
    got = {(r.queue, int((r.tick - t0).total_seconds()) // 60): (r.queue_depth, r.oldest_age_s) for r in J.queue_depth(sink).collect()}
    want = {}
    stays = {("a", 1): (1, 12), ("a", 2): (2, 90), ("b", 3): (5, None), ("a", 4): (11, 25), ("a", 5): (20, None), ("c", 9): (600, None), ("c", 10): (601, None)}
    for tick in range(0, 700, 10):
        for q in "abc":
            ages = [tick - came for (name, _), (came, went) in stays.items() if name == q and came <= tick <= came + 50 and (went is None or went > tick)]
            if ages:
                want[q, tick] = (len(ages), 60.0 * max(ages))
    assert got == want
    assert metrics["late_rows_dropped"] >= 1


class _Held:
    """A state of a processor, and how often it was read."""

    def __init__(self):
        self.value, self.map, self.reads = None, {}, 0

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Held())

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, _Held())

    def registerTimer(self, ms):
        self.timers.add(ms)


class _Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_queue_depth_reads_a_tick_alone(spark):
    """A timer does not read all requests that wait: they are read when events come, and at the last tick."""
    handle, job = _Handle(), J.QueueDepth(600, 3000)
    job.init(handle)
    n, minute = 2000, 60_000_000
    came = pd.DataFrame({"id": range(n), "kind": J.ENTERED, "micros": [(i + 1) * minute for i in range(n)]})
    left = came[came["id"] % 2 == 0].assign(kind=J.LEFT, micros=lambda d: d["micros"] + 25 * minute)
    for part in (came, left):
        list(job.handleInputRows(("q", 0), iter([part]), None))
    got = {}
    for ms in sorted(handle.timers):
        for out in job.handleExpiredTimer(("q", 0), None, _Expired(ms)):
            got[ms // 60_000] = (int(out["depth"][0]), int(out["oldest"][0]) // minute)
    want = {}
    for tick in range(0, n + 51, 10):
        stay = [m for m in range(max(1, tick - 50), min(n, tick) + 1) if m % 2 == 0 or tick < m + 25]  # id is minute - 1
        if stay:
            want[tick] = (len(stay), min(stay))
    assert got == want
    assert handle.states["waiting"].reads <= 3 and not handle.states["ticks"].map


def test_query_cache_in_shares(spark):
    """Many keys in few shares, over micro-batches: a miss is known until the ttl is over, of missing
    keys and ids too, and keys are told apart."""
    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    rows = [("a", 1, 1, at(0), 0, False), ("a", None, 2, at(0), 0, False), ("b", 1, 3, at(1), 1, False), (None, 1, 4, at(1), 1, False),
            ("a", 1, 5, at(4), 2, True), ("a", None, 6, at(4), 2, True), ("a", 2, 7, at(4), 2, False), (None, 1, None, at(5), 2, True),
            ("a", 1, 8, at(5), 3, False), ("a", 1, 9, at(9), 3, True), ("b", 1, (1 << 60) + 1, at(300), 4, False), ("a", 1, 10, at(301), 5, False)]
    df = spark.createDataFrame(rows, "kind string, user long, id long, ts timestamp, _slice int, want boolean")
    out = J.stream_query_cache(feed(df.drop("want"), 6, "cache"), ["kind", "user"], "ts", "id", 300, 3600, shares=2)
    got = [tuple(r) for r in J.run_available_now(out, "cache-test").select("id", "kind", "user", "hit").collect()]
    assert sorted(got, key=str) == sorted([(i, k, u, hit) for k, u, i, _, _, hit in rows], key=str)


def test_latency_sketch_is_bounded_and_close(spark):
    """A window's state does not grow with the latencies it has seen, and the ranks stay close."""
    t0 = datetime(2024, 1, 1)

    def held(n):
        rows = spark.range(n).select(F.lit(t0).alias("ts"), F.lit("view").alias("event_type"), ((F.col("id") * 7919) % 1000003 / 1000).alias("value"))
        m = {}
        closer, append = J.closing_source(rows.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAYS")), "sketch")
        stream = J.derived_stream(rows, "sketch").unionByName(closer)
        out = J.stream_request_metrics(stream, "ts", "event_type", "value", "1 hour", "1 hour", sketch_size=200)
        got = J.run_available_now(out, "sketch-test", metrics=m, closing=[append]).first()
        exact = sorted((i * 7919) % 1000003 / 1000 for i in range(n))
        rank = sum(x <= got.p95_latency_ms for x in exact) / n
        assert got["count"] == n and abs(rank - 0.95) < 0.03
        assert got.max_latency_ms == exact[-1]
        return m["state_bytes"], len(got.latency_sketch)

    (few_state, few), (many_state, many) = held(2000), held(200_000)
    assert many < 2 * few and many_state < 2 * few_state + 10_000


def test_sliding_windows_and_merged_sketches(spark):
    t0 = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t0 + timedelta(minutes=i), "view", float(i)) for i in range(60)] + [(t0 + timedelta(minutes=3), "idle", None)], "ts timestamp, event_type string, value double")
    closer, append = J.closing_source(rows.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAYS")), "slide")
    out = J.stream_request_metrics(J.derived_stream(rows, "slide").unionByName(closer), "ts", "event_type", "value", "30 minutes", "1 hour", slide="10 minutes")
    got = J.run_available_now(out, "slide-test", closing=[append])
    view = {int((r.window_start - t0).total_seconds()) // 60: (r["count"], r.p95_latency_ms) for r in got.filter("event_type = 'view'").collect()}
    for start, (n, p95) in view.items():
        inside = [i for i in range(60) if start <= i < start + 30]
        assert n == len(inside) and p95 == inside[-(-95 * len(inside) // 100) - 1]
    assert set(view) == set(range(-20, 60, 10))
    assert all(r.p95_latency_ms is None for r in got.filter("event_type = 'idle'").collect())
    halves = got.filter("event_type = 'view' AND minute(window_start) IN (0, 30) AND hour(window_start) = 0")
    whole = halves.agg(F.kll_merge_agg_double("latency_sketch").alias("s")).select(J.sketched_p95("s")).first()
    assert whole.p95_latency_ms == 56.0

"""Folds cut at idle gaps give what one pass over each key gives, and a hot key is spread."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quarry.operators import logs as LG
from quarry.plans import layout


def limited(rows, limit, win):
    out = {}
    for key in {r[1] for r in rows}:
        admitted = deque()
        for i, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            ok = False
            if t is not None:
                while admitted and t - admitted[0] >= win:
                    admitted.popleft()
                ok = len(admitted) < limit
                if ok:
                    admitted.append(t)
            out[i] = (ok, len(admitted))
    return out


def cached(rows, ttl):
    out = {}
    for key in {r[1] for r in rows}:
        last = None
        for i, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            out[i] = t is not None and last is not None and t - last < ttl
            if t is not None and not out[i]:
                last = t
    return out


def traffic(seed):
    """One key with half of all rows, idle gaps of all kinds, keys without gaps, ties, missing keys and times."""
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1, 3, 9, 10, 11, 200]) if i % 50 else 10
        rows.append((i, 2**60, t))
    rows += [(2000 + i, rng.choice([None, 2**60 + 1, 3, 4]), None if i % 40 == 0 else rng.randint(0, 3000)) for i in range(900)]
    rows += [(4000 + i, 7, i) for i in range(600)]  # never idle: over several blocks in one segment
    rows += [(5000 + i, 100 + i, 5) for i in range(100)]
    return rows


@pytest.mark.parametrize("batch", [7, 4096])
def test_segments_are_those_of_one_pass(spark, batch):
    rows = traffic(batch)
    df = spark.createDataFrame(rows, "id long, k long, s long").select("id", "k", F.timestamp_seconds("s").alias("ts")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = LG.rate_limit_replay(df, ["k"], "ts", "id", 3, 10.0).collect()
        hits = LG.ttl_cache_replay(df, ["k"], "ts", 10.0, "id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert {r.id: (r.allowed, r.admitted_in_window) for r in got} == limited(rows, 3, 10) and len(got) == len(rows)
    assert {r.id: r.hit for r in hits} == cached(rows, 10) and len(hits) == len(rows)
    assert LG.rate_limit_replay(df.limit(0), ["k"], "ts", "id", 3, 10.0).count() == 0


def test_a_hot_key_is_folded_by_many_tasks(spark):
    df = spark.range(8000).select(F.lit(1).alias("k"), (F.col("id") * 5 + F.floor(F.col("id") / 10) * 100).alias("t"), "id")

    def fold(batches):
        from pyspark import TaskContext
        import numpy as np
        import pyarrow as pa
        for b, new in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(new), pa.array(np.full(b.num_rows, TaskContext.get().partitionId()))], names=["id", "new", "task"])

    got = layout.segmented_fold(df, ["k"], ["t", "id"], "t", 50, fold, "id long, new boolean, task long")
    tasks = {r.task: r["count"] for r in got.groupBy("task").count().collect()}
    assert len(tasks) >= 8 and max(tasks.values()) < 2000 and sum(tasks.values()) == 8000
    assert {r.id for r in got.filter("new").collect()} == set(range(0, 8000, 10))


def test_touching_segments():
    """(block, cuts, first key and time, last key and time): what goes on over a border."""
    blocks = [(0, 2, "a", 0, "b", 10), (1, 0, "b", 15, "b", 30), (2, 1, "b", 39, "c", 1), (4, 3, "c", 11, "d", 5), (5, 0, None, 7, None, None), (6, 0, None, None, None, 9), (7, 0, None, 12, None, 13)]
    owner, shared = layout._touching(blocks, 2, 10)
    assert owner == {0: 0, 1: 2, 2: 2, 4: 4 << 32, 5: 5 << 32, 6: 6 << 32, 7: 6 << 32}
    assert sorted(set(shared.tolist())) == [2, 6 << 32]


def replayed(rows, slot, timeout, most):
    """(slot, depth, size, place) by id, looking at every slot of every queue."""
    from quarry.operators.tokens import batch_size_for
    out = {}
    for queue in {r[1] for r in rows}:
        waits = sorted((t, i, n) for i, q, t, n in rows if q == queue and t is not None)
        out |= {i: (None,) * 4 for _, i, _ in waits}
        at = 0
        while waits:
            at += slot
            here = [w for w in waits if w[0] <= at and at - w[0] <= timeout]
            size = batch_size_for(len(here), most)
            batch = here if len(here) <= size else sorted(here, key=lambda w: (w[2], w[0], w[1]))[:size]
            out |= {w[1]: (at, len(here), size, place) for place, w in enumerate(batch)}
            waits = [w for w in waits if w not in batch and at - w[0] <= timeout]
        out |= {i: (None,) * 4 for i, q, t, _ in rows if q == queue and t is None}
    return out


@pytest.mark.parametrize("per_slot,timeout", [(3, 40), (30, 40), (200, 25), (200, 1000)])
def test_queue_replay_is_that_of_every_slot(spark, per_slot, timeout):
    from quarry.operators import tokens as TK
    rng = random.Random(per_slot + timeout)
    rows, t = [], 5
    for i in range(1500):
        t += rng.choice([0, 10 / per_slot, 20 / per_slot]) if rng.random() < 0.99 else timeout * rng.choice([0.9, 1.3, 3])
        rows.append((i, rng.choice(["a", "a", "b", None]), t, rng.randint(0, 9)))
    rows = [(i, q, None if i % 211 == 7 else int(t * 1_000_000), n) for i, q, t, n in rows]
    df = spark.createDataFrame(rows, "id long, q string, us long, n long").select("id", "q", F.timestamp_micros("us").alias("ts"), "n")
    got = TK.queue_replay(df, "q", "id", "ts", "n", 10, timeout, 20).select("id", "q", F.unix_micros("slot").alias("slot"), "depth", "batch_size", "place", "length").collect()
    assert len(got) == len(rows) and all(r.length == rows[r.id][3] and r.q == rows[r.id][1] for r in got)
    assert {r.id: (r.slot, r.depth, r.batch_size, r.place) for r in got} == replayed(rows, 10_000_000, timeout * 1_000_000, 20)


def test_batch_sizes(spark):
    from quarry.operators import tokens as TK
    df = spark.range(0, 200).select("id", TK.queue_batch_size("id", 50).alias("n"))
    assert {r.id: r.n for r in df.collect()} == {i: TK.batch_size_for(i, 50) for i in range(200)}

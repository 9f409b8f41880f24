"""Keys, boundaries and ranges at their edges."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import logs as LG
from quarry.operators import mixing as MX
from quarry.operators import safety as S
from quarry.plans.layout import running_sum
from quarry.session import ensure_checkpoint_dir

BIG = (1 << 53) + 1


def test_limiter_null_and_wide_keys(spark):
    rows = [(i, k, i) for i, k in enumerate([None, None, None, BIG, BIG - 1, BIG, BIG - 1])]
    df = spark.createDataFrame(rows, "id long, k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = LG.rate_limit_replay(df, ["k"], "ts", "id", 1, 60.0).collect()
    assert {r.id for r in got if r.allowed} == {0, 3, 4}
    assert {r.k for r in got} == {None, BIG, BIG - 1}
    hits = LG.ttl_cache_replay(df, ["k"], "ts", 60.0, "id").collect()
    assert {r.id for r in hits if not r.hit} == {0, 3, 4}


def test_limiter_row_without_time(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "a", 6)], "id long, k string, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id: r.allowed for r in LG.rate_limit_replay(df, ["k"], "ts", "id", 1).collect()} == {1: False, 2: True, 3: False}
    assert {r.id: r.hit for r in LG.ttl_cache_replay(df, ["k"], "ts", 9.0, "id").collect()} == {1: False, 2: False, 3: True}


def test_limiter_state_across_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(20).select("id", F.lit("k").alias("k"), F.timestamp_seconds("id").alias("ts"))
        got = LG.rate_limit_replay(df, ["k"], "ts", "id", 2, 10.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.id for r in got if r.allowed) == [0, 1, 10, 11]


def test_chain_null_key_is_one_chain(spark):
    rows = [(None, i, str(i), "E", "INFO", "{}") for i in range(3)]
    df = spark.createDataFrame(rows, "c long, o long, timestamp string, event_type string, severity string, payload string")
    built = sorted(LG.audit_chain_build(df, "c", ["o"]).collect(), key=lambda r: r.seq)
    assert [r.seq for r in built] == [0, 1, 2]
    assert [r.prev_hash for r in built] == ["GENESIS", built[0].hash, built[1].hash]


def test_running_loss_ties_and_null_run(spark):
    rows = [(i, None if i % 2 else 7, 1, float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, run long, step long, loss double")
    got = {r.id: (r.loss_sum, r.steps) for r in LG.running_loss(df, "run", "step", "loss", "id").collect()}
    assert got == {0: (0, 1), 2: (2, 2), 4: (6, 3), 6: (12, 4), 1: (1, 1), 3: (4, 2), 5: (9, 3), 7: (16, 4)}


def test_running_sum_of_two_columns(spark):
    df = spark.range(100).select("id", F.lit(2).alias("two"))
    rows = running_sum(df, ["id"], ["id", "two"], ["a", "b"], num_blocks=7).collect()
    assert all((r.a, r.b) == (r.id * (r.id + 1) // 2, 2 * r.id + 2) for r in rows) and len(rows) == 100


def test_mix_ranges_meet_and_close(spark):
    weights = [(f"s{i:02}", 0.1) for i in range(10)] + [("t", 0.0)]
    w = sorted(MX.mix_weights(spark.createDataFrame(weights, "name string, weight double")).collect(), key=lambda r: r.name)
    assert w[0].range_lo == 0.0 and w[9].range_hi == 1.0 and (w[10].range_lo, w[10].range_hi) == (1.0, 1.0)
    assert all(a.range_hi == b.range_lo for a, b in zip(w, w[1:]))


@pytest.mark.parametrize("pattern", [r"\bfoo\b", r"foo\B", r"a\bb|c", r"École", r"x\Wy", r"x[\W_]y", r"x[^\Wa]y", r"[\S]oo\d", r"x\Dy", r"x[a&&[]y"])
def test_patterns_as_python_reads_them(spark, pattern):
    texts = ["foo", "a foo b", "éfoo", "foobar", "foo_", "École", "une ÉCOLE", "x y", "x_y", "xéy", "xay", "x-y", "foo1", "foo٣", "x&y", "x[y", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.hit for r in df.select("t", S.pattern_hit(F.lower("t"), pattern).alias("hit")).collect()}
    assert got == {t: bool(re.search(pattern, t.lower(), re.IGNORECASE)) for t in texts}


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_chunks_word_for_word(spark):
    """Literal chunks: sentences gathered, a tail carried over, a long sentence cut, no overlap (the whole is carried)."""
    from quarry.operators import retrieval as R
    three = "Aaaa bbbb. Cccc dddd. Eeee ffff."
    cases = [
        (three, 20, 5, ["Aaaa bbbb. Cccc dddd.", "dddd. Eeee ffff."]),
        ("abcdefghijklmnopqrstuvwxyz0123", 20, 5, ["abcdefghijklmnopqrst", "pqrstuvwxyz0123"]),
        ("  short ", 20, 5, ["  short "]),
        (three, 20, 0, ["Aaaa bbbb. Cccc dddd.", "Aaaa bbbb. Cccc dddd. Eeee ffff."]),
        ("One!  Two?\n\nThree. Four.", 10, 3, ["One! Two?", "wo? Three.", "ee. Four."]),
    ]
    for text, size, overlap, want in cases:
        df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
        got = R.chunk_documents(df, size, overlap).orderBy("chunk_index").collect()
        assert [r.content for r in got] == want, text

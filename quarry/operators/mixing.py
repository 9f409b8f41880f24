"""Source mixing, curriculum stages and learning-rate schedules.

Source and stage tables are small dimensions (one row per source / stage);
they are broadcast after a size check.  Sample draws are deterministic per
sample index (md5 uniforms, the same expression in SQL), so a mix plan is
reproducible and checkable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import col_
from quarry.plans.layout import attach_row, bounded_broadcast, running_sum

SMALL_DIMENSION_ROWS = 100_000
RANGE_BUCKETS = 4096

# The reference's curriculum presets, (seq_len, num_steps) per stage.
CURRICULUM_PRESETS = {
    "nano": [(2048, 60_000), (4096, 30_000), (8192, 10_000)],
    "core": [(2048, 80_000), (4096, 40_000), (8192, 30_000), (16384, 20_000), (32768, 10_000)],
    "pro": [(2048, 100_000), (4096, 50_000), (8192, 40_000), (16384, 30_000), (32768, 20_000), (65536, 10_000)],
    "ultra": [(2048, 120_000), (4096, 60_000), (8192, 50_000), (16384, 40_000), (32768, 30_000),
              (65536, 20_000), (131072, 10_000)],
    "sovereign": [(2048, 200_000), (4096, 100_000), (8192, 80_000), (16384, 60_000), (32768, 50_000),
                  (65536, 40_000), (131072, 30_000), (262144, 10_000)],
}
DEFAULT_WARMUP_RATIO = 0.02


def uniform(seed: int, *parts) -> Column:
    """md5 uniform in [0, 1) of 'seed:p1:p2...', with the 52 bits that a double holds."""
    s = F.concat_ws(":", F.lit(str(seed)), *[col_(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


# ------------------------------------------------------------------ mixing

def mix_weights(sources: DataFrame, name_col: str = "name", weight_col: str | None = "weight") -> DataFrame:
    """Normalised weights (equal when no weight column), cumulative ranges and pct.  Each range
    begins where the one before ends, and the last one of any weight ends at 1."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    s = sources.withColumn("_w", w)
    tot = s.agg(F.sum("_w").alias("_tot"), F.count(F.lit(1)).alias("_cnt"))
    s = attach_row(s, tot)
    s = s.withColumn("weight_norm", F.when(F.col("_tot") > 0, F.col("_w") / F.col("_tot"))
                     .otherwise(F.lit(1.0) / F.col("_cnt")))
    order = Window.orderBy(name_col).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy(name_col).rowsBetween(1, Window.unboundedFollowing)
    closed = F.coalesce(F.sum("weight_norm").over(after), F.lit(0.0)) == 0
    s = s.withColumn("_hi", F.when(closed, F.lit(1.0)).otherwise(F.sum("weight_norm").over(order)))  # a row per source
    return s.select("*", F.lag("_hi", 1, 0.0).over(Window.orderBy(name_col)).alias("range_lo"), F.col("_hi").alias("range_hi"),
                    (F.col("weight_norm") * 100).alias("pct")).drop("_w", "_tot", "_cnt", "_hi")


def source_index(items: DataFrame, source_col: str, order_col: str) -> DataFrame:
    """0-based position of each item inside its source (block-wise running count)."""
    one = items.withColumn("_one", F.lit(1))
    r = running_sum(one, [source_col, order_col], "_one", "local_idx", inclusive=False, partition_cols=[source_col])
    return r.drop("_one")


def mix_sample(draws: DataFrame, idx_col: str, weights: DataFrame, sizes: DataFrame, seed: int,
               source_col: str = "name") -> DataFrame:
    """For each sample index: source by cumulative weight (u1), then a uniform
    local index with replacement (u2 * size).  ``weights`` from ``mix_weights``;
    ``sizes`` (source, size).  The range join is against a broadcast dimension."""
    # The unit interval is cut into RANGE_BUCKETS buckets; each source range is
    # listed under the buckets it overlaps, so a draw meets only the one or two
    # ranges of its bucket (an equi-join plus a range check, not draws x sources).
    d = draws.select(idx_col, uniform(seed, F.lit("src"), F.col(idx_col)).alias("_u1"),
                     uniform(seed, F.lit("idx"), F.col(idx_col)).alias("_u2"))
    d = d.withColumn("_bk", F.floor(F.col("_u1") * RANGE_BUCKETS).cast("bigint"))
    w = weights.select(source_col, "range_lo", "range_hi").join(sizes, source_col)
    w = w.select("*", F.explode(F.sequence(F.floor(F.col("range_lo") * RANGE_BUCKETS).cast("bigint"),
                                            F.least(F.floor(F.col("range_hi") * RANGE_BUCKETS),
                                                    F.lit(RANGE_BUCKETS - 1)).cast("bigint"))).alias("_bk"))
    w = bounded_broadcast(w, SMALL_DIMENSION_ROWS + RANGE_BUCKETS)
    j = d.join(w, (d["_bk"] == w["_bk"]) & (F.col("_u1") >= F.col("range_lo")) & (F.col("_u1") < F.col("range_hi")),
               "left")
    return j.select(idx_col, source_col, F.floor(F.col("_u2") * F.col("size")).cast("bigint").alias("local_idx"))


def mix_fetch(plan: DataFrame, items: DataFrame, source_col: str = "name") -> DataFrame:
    """(source, local_idx) -> item row, equi-join."""
    return plan.join(items, [source_col, "local_idx"], "left")


def mix_report(plan: DataFrame, weights: DataFrame, source_col: str = "name") -> DataFrame:
    """Realised share against target share per source."""
    got = plan.groupBy(source_col).agg(F.count(F.lit(1)).alias("samples"))
    tot = plan.agg(F.count(F.lit(1)).alias("_n"))
    r = attach_row(weights.select(source_col, "weight_norm").join(got, source_col, "left"), tot)
    return r.select(source_col, F.col("weight_norm").alias("target_share"),
                    F.coalesce("samples", F.lit(0)).cast("bigint").alias("samples"),
                    (F.coalesce("samples", F.lit(0)) / F.col("_n")).alias("realised_share"))


# ------------------------------------------------------------------ curriculum

def curriculum_table(spark, stages: list[tuple], warmup_ratio: float = DEFAULT_WARMUP_RATIO) -> DataFrame:
    """Stages -> (stage, seq_len, num_steps, batch_size, lr, step_lo, step_hi,
    total_steps, max_seq_len, warmup_steps); lengths must not decrease."""
    rows = [(i, *(tuple(st) + (None, None))[:4]) for i, st in enumerate(stages)]
    lengths = [r[1] for r in rows]
    if not rows or lengths != sorted(lengths):
        raise ValueError(f"a curriculum needs stages in increasing order of length, not {lengths}")
    df = spark.createDataFrame(rows, "stage int, seq_len bigint, num_steps bigint, batch_size int, lr double")
    w = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)  # a handful of stage rows
    allw = Window.partitionBy(F.lit(0))
    return (df.withColumn("step_hi", F.sum("num_steps").over(w))
              .withColumn("step_lo", F.col("step_hi") - F.col("num_steps"))
              .withColumn("total_steps", F.sum("num_steps").over(allw))
              .withColumn("max_seq_len", F.max("seq_len").over(allw))
              .withColumn("num_stages", F.count(F.lit(1)).over(allw))
              .withColumn("warmup_steps", F.floor(F.col("num_steps") * F.lit(warmup_ratio)).cast("bigint")))


def curriculum_at_step(steps: DataFrame, step_col: str, stages: DataFrame, default_batch: int = 4) -> DataFrame:
    """Range join step -> stage (step_lo <= step < step_hi; beyond the end -> last stage)."""
    st = F.broadcast(stages)
    last = stages.agg(F.max("stage").alias("_last"))
    s = attach_row(steps, last)
    cond = ((F.col(step_col) >= F.col("step_lo")) & (F.col(step_col) < F.col("step_hi"))) | \
           ((F.col(step_col) >= F.col("step_hi")) & (F.col("stage") == F.col("_last")))
    j = s.join(st, cond, "inner")
    trans = (F.col(step_col) == 0) | ((F.col(step_col) == F.col("step_lo")) & (F.col("stage") > 0))
    return j.select(*steps.columns, "stage", "seq_len", F.coalesce("batch_size", F.lit(default_batch)).alias("batch_size"),
                    trans.alias("transition"),
                    F.least(F.col(step_col) / F.greatest(F.col("total_steps"), F.lit(1)), F.lit(1.0)).alias("progress"),
                    "step_lo", "num_steps", "warmup_steps", "lr")


def curriculum_lr(at_step: DataFrame, step_col: str, base_lr: float = 3e-4) -> Column:
    """Per-stage warm-up base*(k+1)/max(w,1) for k < w, then cosine to 10 % of base."""
    base = F.coalesce(F.col("lr"), F.lit(base_lr))
    k = F.col(step_col) - F.col("step_lo")
    w = F.col("warmup_steps")
    progress = (k - w) / F.greatest(F.col("num_steps") - w, F.lit(1))
    min_lr = base * 0.1
    cos = min_lr + 0.5 * (base - min_lr) * (1.0 + F.cos(F.lit(math.pi) * progress))
    return F.when(k < w, base * (k + 1) / F.greatest(w, F.lit(1))).otherwise(cos)


def cosine_lr(step, warmup_steps: int, max_steps: int, min_lr: float = 1e-5, max_lr: float = 3e-4) -> Column:
    """Linear warm-up max*step/warmup, cosine decay, floor min_lr after max_steps."""
    s = col_(step)
    progress = (s - warmup_steps) / max(1, max_steps - warmup_steps)
    return (F.when(s < warmup_steps, F.lit(max_lr) * s / max(1, warmup_steps))
            .when(s >= max_steps, F.lit(min_lr))
            .otherwise(min_lr + 0.5 * (max_lr - min_lr) * (1.0 + F.cos(F.lit(math.pi) * progress))))


def curriculum_token_plan(stages: DataFrame, corpus_tokens: DataFrame, default_batch: int = 4) -> DataFrame:
    """Tokens and sequences each stage needs (steps x batch x seq_len) against the corpus."""
    need = stages.select("stage", "seq_len", "num_steps",
                         (F.col("num_steps") * F.coalesce("batch_size", F.lit(default_batch))).alias("sequences_needed"),
                         (F.col("num_steps") * F.coalesce("batch_size", F.lit(default_batch)) * F.col("seq_len")).alias("tokens_needed"))
    j = attach_row(need, corpus_tokens.select("tokens"))
    return j.withColumn("epochs_over_corpus", F.col("tokens_needed") / F.greatest(F.col("tokens"), F.lit(1)))

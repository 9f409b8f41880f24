"""Evaluation, alignment and generation score tables.

Inputs are tables of numbers a model run has already written (losses,
log-probs, rewards, logits); every metric is a column expression plus a
grouped aggregate, all JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import col_

LETTERS = "ABCD"


def log_sigmoid(x) -> Column:
    """Numerically stable log(sigmoid(x)) = -softplus(-x)."""
    x = col_(x)
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def eval_loss_ppl(batches: DataFrame, group_cols: list[str], loss_col: str, tokens_col: str,
                  elapsed_col: str | None = None) -> DataFrame:
    """Token-weighted mean loss, perplexity min(exp(loss), 1e6), tokens (and
    throughput when elapsed seconds are given), per group."""
    aggs = [(F.sum(F.col(loss_col) * F.col(tokens_col)) / F.greatest(F.sum(tokens_col), F.lit(1))).alias("loss"),
            F.sum(tokens_col).cast("bigint").alias("tokens_evaluated")]
    if elapsed_col:
        aggs.append((F.sum(tokens_col) / F.greatest(F.sum(elapsed_col), F.lit(0.001))).alias("tokens_per_second"))
    g = batches.groupBy(*group_cols).agg(*aggs)
    return g.withColumn("perplexity", F.least(F.exp("loss"), F.lit(1e6)))


def mc_prompt(question, choices, letter_idx) -> Column:
    """'Question: q\\nA. c1\\n...Answer: X' for choice letter_idx (0-based)."""
    body = F.array_join(F.transform(col_(choices), lambda c, i: F.concat(
        F.element_at(F.split(F.lit(LETTERS), ""), i + 1), F.lit(". "), c, F.lit("\n"))), "")
    return F.concat(F.lit("Question: "), col_(question), F.lit("\n"), body, F.lit("Answer: "),
                    F.element_at(F.split(F.lit(LETTERS), ""), col_(letter_idx) + 1))


def mc_prompts(items: DataFrame, id_col: str, question_col: str, choices_col: str) -> DataFrame:
    """One prompt row per (item, choice)."""
    e = items.select(id_col, question_col, choices_col, F.posexplode(choices_col).alias("choice_idx", "_c"))
    return e.select(id_col, "choice_idx", mc_prompt(question_col, choices_col, F.col("choice_idx")).alias("prompt"))


def mc_argmax(scores: DataFrame, id_col: str, idx_col: str, score_col: str) -> DataFrame:
    """Best choice per item (highest score, lowest index on ties) as a letter."""
    best = scores.groupBy(id_col).agg(F.max_by(F.col(idx_col), F.struct(F.col(score_col), -F.col(idx_col))).alias("_b"))
    return best.select(id_col, F.col("_b").alias("pred_idx"),
                       F.element_at(F.split(F.lit(LETTERS), ""), F.col("_b") + 1).alias("predicted"))


def mc_accuracy(results: DataFrame, subject_col: str, correct_col: str) -> DataFrame:
    """Accuracy per subject and overall (subject NULL) in one ROLLUP pass."""
    return results.rollup(subject_col).agg(F.avg(F.col(correct_col).cast("double")).alias("accuracy"),
                                           F.count(F.lit(1)).cast("bigint").alias("num_samples"))


def completion_accuracy(results: DataFrame, pred_col: str, label_col: str, group_cols=()) -> DataFrame:
    return results.groupBy(*group_cols).agg(
        F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).cast("bigint").alias("num_samples"))


def pass_at_1(results: DataFrame, passed_col: str, group_cols=()) -> DataFrame:
    return results.groupBy(*group_cols).agg(
        (F.sum(F.col(passed_col).cast("int")) / F.count(F.lit(1))).alias("pass_at_1"),
        F.sum(F.col(passed_col).cast("int")).cast("bigint").alias("num_passed"),
        F.count(F.lit(1)).cast("bigint").alias("num_total"))


def sample_items(items: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Seeded shuffle then the first n (TakeOrdered: n rows per task, not a sort)."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return items.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")


# The fenced-block pattern of the code extractor.
CODE_FENCE_PATTERN = r"```(?:python)?\s*\n(.*?)```"


def extract_code_block(text) -> Column:
    """First fenced block (stripped); else the lines from the first one whose
    stripped form starts with 'def ' or 'import '; else the text."""
    from quarry.functions.text import py_strip
    from quarry.operators.safety import python_regex_to_portable
    t = col_(text)
    rx = "(?s)" + python_regex_to_portable(CODE_FENCE_PATTERN)
    fenced = F.when(t.rlike(rx), py_strip(F.regexp_extract(t, rx, 1)))
    lines = F.split(t, "\n")
    starts = F.transform(lines, lambda l: py_strip(l).startswith("def ") | py_strip(l).startswith("import "))
    first = F.array_position(starts, F.lit(True))
    from_first = F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n")
    return F.coalesce(fenced, F.when(first > 0, from_first), t)


def seq_logprob(lp, mask) -> Column:
    """sum(lp * mask) / max(sum(mask), 1) over arrays of token log-probs and 0/1 mask."""
    num = F.aggregate(F.zip_with(col_(lp), col_(mask), lambda a, m: a * m), F.lit(0.0), lambda s, v: s + v)
    den = F.aggregate(col_(mask), F.lit(0.0), lambda s, v: s + v)
    return num / F.greatest(den, F.lit(1.0))


def dpo_metrics(pairs: DataFrame, batch_col: str, beta: float, pc: str, pr: str, rc: str, rr: str) -> DataFrame:
    """Per batch: loss = mean(-logsigmoid(margin)), mean chosen/rejected rewards
    beta * (policy - ref), mean margin, accuracy = share chosen > rejected."""
    cr = F.lit(beta) * (F.col(pc) - F.col(rc))
    rj = F.lit(beta) * (F.col(pr) - F.col(rr))
    x = pairs.select(batch_col, cr.alias("_cr"), rj.alias("_rj"))
    m = F.col("_cr") - F.col("_rj")
    return x.groupBy(batch_col).agg(
        F.avg(-log_sigmoid(m)).alias("loss"), F.avg("_cr").alias("chosen_reward"),
        F.avg("_rj").alias("rejected_reward"), F.avg(m).alias("reward_margin"),
        F.avg((F.col("_cr") > F.col("_rj")).cast("double")).alias("accuracy"))


def reward_model_loss(pairs: DataFrame, group_cols: list[str], chosen_col: str, rejected_col: str) -> DataFrame:
    """Bradley-Terry loss mean(-logsigmoid(chosen - rejected))."""
    return pairs.groupBy(*group_cols).agg(F.avg(-log_sigmoid(F.col(chosen_col) - F.col(rejected_col))).alias("loss"),
                                          F.count(F.lit(1)).cast("bigint").alias("pairs"))


def advantages(df: DataFrame, batch_col: str, reward_col: str, value_col: str, normalize: bool = True) -> DataFrame:
    """reward - value, normalised by batch mean and sample std + 1e-8; returns = reward.

    Batch statistics come from a grouped aggregate joined back (no window over a batch)."""
    a = df.withColumn("_adv", F.col(reward_col) - F.col(value_col))
    if not normalize:
        return a.withColumnRenamed("_adv", "advantage").withColumn("returns", F.col(reward_col))
    st = a.groupBy(batch_col).agg(F.avg("_adv").alias("_m"), F.stddev_samp("_adv").alias("_s"))
    return (a.join(st, batch_col).withColumn("advantage", (F.col("_adv") - F.col("_m")) / (F.col("_s") + F.lit(1e-8)))
             .withColumn("returns", F.col(reward_col)).drop("_adv", "_m", "_s"))


def ppo_diagnostics(df: DataFrame, batch_col: str, new_lp: str, old_lp: str, adv: str, value: str, ret: str,
                    clip_eps: float = 0.2) -> DataFrame:
    """Per batch: ratio exp(new - old), clipped surrogate loss, clip fraction, value MSE."""
    ratio = F.exp(F.col(new_lp) - F.col(old_lp))
    x = df.select(batch_col, ratio.alias("_r"), F.col(adv).alias("_a"), (F.col(value) - F.col(ret)).alias("_e"))
    s1 = F.col("_r") * F.col("_a")
    s2 = F.least(F.greatest(F.col("_r"), F.lit(1 - clip_eps)), F.lit(1 + clip_eps)) * F.col("_a")
    return x.groupBy(batch_col).agg(
        (-F.avg(F.least(s1, s2))).alias("policy_loss"), F.avg("_r").alias("mean_ratio"),
        F.avg((F.abs(F.col("_r") - 1) > clip_eps).cast("double")).alias("clip_fraction"),
        F.avg(F.col("_e") * F.col("_e")).alias("value_mse"))


def logit_confidence(logits, k: int = 5) -> Column:
    """Struct(confidence = clamp(1 - H / ln V), top_k_mass, entropy) from a logits array.

    Softmax with the max subtracted; every per-row scalar enters the element
    lambdas through ``map_with_scalar`` so each step is linear in V.
    """
    from quarry.functions.text import map_with_scalar
    x = F.transform(col_(logits), lambda v: v.cast("double"))
    ex = map_with_scalar(x, F.array_max(x), lambda v, m: F.exp(v - m))
    z = F.aggregate(ex, F.lit(0.0), lambda s, v: s + v)
    p = map_with_scalar(ex, z, lambda v, zz: v / zz)
    h = -F.aggregate(p, F.lit(0.0), lambda s, v: s + v * F.log(v + F.lit(1e-10)))
    conf = F.least(F.greatest(F.lit(1.0) - h / F.log(F.size(x).cast("double")), F.lit(0.0)), F.lit(1.0))
    topk = F.aggregate(F.slice(F.sort_array(p, asc=False), 1, k), F.lit(0.0), lambda s, v: s + v)
    return F.struct(conf.alias("confidence"), topk.alias("top_k_mass"), h.alias("entropy"))


def entropy_budget(steps: DataFrame, gen_col: str, step_col: str, entropy_col: str, budget: float, id_col: str | None = None) -> DataFrame:
    """Running entropy per generation; a step is permitted while the used
    budget (including the step) is below ``budget``; remaining and fraction used.
    Steps of one place in the order come in order of ``id_col``, which together must be unique."""
    from quarry.plans.layout import running_sum
    order = [gen_col, step_col, *([id_col] if id_col else [])]
    r = running_sum(steps, order, entropy_col, "used_entropy", partition_cols=[gen_col])
    return (r.withColumn("permitted", F.col("used_entropy") < F.lit(budget))
             .withColumn("remaining", F.greatest(F.lit(0.0), F.lit(budget) - F.col("used_entropy")))
             .withColumn("fraction_used", F.least(F.lit(1.0), F.col("used_entropy") / F.lit(budget))))


def speculation_rate(runs: DataFrame, run_col: str, accepted_col: str, drafted_col: str) -> DataFrame:
    return runs.groupBy(run_col).agg(
        (F.sum(accepted_col) / F.greatest(F.sum(drafted_col), F.lit(1))).alias("acceptance_rate"),
        F.sum(accepted_col).cast("bigint").alias("accepted"), F.sum(drafted_col).cast("bigint").alias("drafted"))


def cut_after_eos(tokens, eos_id: int) -> Column:
    """Generated ids up to and including the first EOS (all if none)."""
    pos = F.array_position(col_(tokens), F.lit(eos_id))
    return F.when(pos > 0, F.slice(col_(tokens), 1, pos.cast("int"))).otherwise(col_(tokens))


def batch_generation_stats(gens: DataFrame, batch_col: str, tokens_col: str, latency_col: str, eos_id: int) -> DataFrame:
    """Per batch: requests, generated tokens after EOS cut, latency sum and mean."""
    g = gens.withColumn("_n", F.size(cut_after_eos(tokens_col, eos_id)))
    return g.groupBy(batch_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"), F.sum("_n").cast("bigint").alias("tokens_generated"),
        F.sum(latency_col).alias("latency_sum_ms"), F.avg(latency_col).alias("avg_latency_ms"))

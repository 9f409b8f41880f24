"""Evaluation/alignment score tables, vector statistics, source mixing and
curriculum query keys.  Model outputs (scores, log-probs, rewards) are
md5-derived numbers over real rows, the same expression in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import mixing as MX
from quarry.operators import retrieval as R
from quarry.operators import scores as SC
from quarry.operators import tokens as TK
from quarry.operators import vectors as V
from quarry.operators.logs import epoch_us
from quarry.sources.tables import table
from quarry.suite import sqlfrag as Q

SEED = 7
BETA = 0.1
CLIP = 0.2
BUDGET = 20.0
TOPK = 5
PRESET = "core"
BASE_LR = 3e-4


def u(*parts):
    return MX.uniform(SEED, *parts)


def u_sql(*parts):
    inner = " || ':' || ".join(f"CAST({p} AS VARCHAR)" if not p.startswith("'") else p for p in parts)
    return f"(('0x' || substr(md5('{SEED}:' || {inner}), 1, 13))::BIGINT / 4503599627370496.0)"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def _choices(id_col):
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(
        F.lit("option "), i.cast("string"), F.lit(" "), F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), i.cast("string"))), 1, 6)))


def _mc_scores(spark, sf):
    d = _docs(spark, sf)
    e = d.select("doc_id", "source", F.posexplode(_choices("doc_id")).alias("choice_idx", "choice"))
    return e.withColumn("score", -(F.lit(1.0) + F.lit(4.0) * u(F.lit("mc"), F.col("doc_id"), F.col("choice_idx"))))


def _mc_results(spark, sf):
    best = SC.mc_argmax(_mc_scores(spark, sf), "doc_id", "choice_idx", "score")
    ans = F.floor(u(F.lit("ans"), F.col("doc_id")) * 4).cast("int")
    d = _docs(spark, sf).select("doc_id", "source", ans.alias("answer_idx"))
    return d.join(best, "doc_id").withColumn("correct", F.col("pred_idx") == F.col("answer_idx"))


def q_mc_prompts(spark, sf):
    items = _docs(spark, sf).select("doc_id", F.col("text").alias("question"), _choices("doc_id").alias("choices"))
    p = SC.mc_prompts(items, "doc_id", "question", "choices")
    return p.select("doc_id", F.col("choice_idx").cast("bigint").alias("choice_idx"), F.md5("prompt").alias("prompt_md5"))


def q_mc_argmax(spark, sf):
    b = SC.mc_argmax(_mc_scores(spark, sf), "doc_id", "choice_idx", "score")
    return b.select("doc_id", F.col("pred_idx").cast("bigint").alias("pred_idx"), "predicted")


def q_mc_accuracy(spark, sf):
    return SC.mc_accuracy(_mc_results(spark, sf), "source", "correct")


def _completion(spark, sf):
    d = _docs(spark, sf)
    e = d.select("doc_id", "lang", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ending"))
    e = e.withColumn("score", u(F.lit("end"), F.col("doc_id"), F.col("ending")))
    best = SC.mc_argmax(e, "doc_id", "ending", "score")
    label = F.floor(u(F.lit("label"), F.col("doc_id")) * 4).cast("int")
    return d.select("doc_id", "lang", label.alias("label")).join(best, "doc_id")


def q_completion_accuracy(spark, sf):
    return SC.completion_accuracy(_completion(spark, sf), "pred_idx", "label", ["lang"])


def _passes(spark, sf):
    return _docs(spark, sf).select("doc_id", "source", (u(F.lit("pass"), F.col("doc_id")) < 0.3).alias("passed"))


def q_pass_at_1(spark, sf):
    return SC.pass_at_1(_passes(spark, sf), "passed", ["source"])


def q_sample_items(spark, sf):
    return SC.sample_items(_docs(spark, sf).select("doc_id", "source"), "doc_id", 25, SEED)


def q_benchmark_report(spark, sf):
    mc = SC.mc_accuracy(_mc_results(spark, sf), "source", "correct").filter(F.col("source").isNull()) \
        .select(F.lit("mmlu").alias("benchmark"), F.col("accuracy").alias("score"), "num_samples")
    hs = SC.completion_accuracy(_completion(spark, sf), "pred_idx", "label") \
        .select(F.lit("hellaswag").alias("benchmark"), F.col("accuracy").alias("score"), "num_samples")
    he = SC.pass_at_1(_passes(spark, sf), "passed") \
        .select(F.lit("humaneval").alias("benchmark"), F.col("pass_at_1").alias("score"), F.col("num_total").alias("num_samples"))
    return mc.unionByName(hs).unionByName(he)


CODE_PROBES = ["\n```python\ndef f(x):\n    return x + 1\n```\ntrailing", "\nsome words\n  def g():\n    pass\nend",
               "\nimport os\nprint(1)", "\n```\nplain fence\n```", "", ""]


def q_extract_code_block(spark, sf):
    c = table(spark, sf, "conversations")
    idx = ((F.col("conv_id") * 5 + F.col("turn")) % len(CODE_PROBES) + 1).cast("int")
    t = F.concat("text", F.element_at(F.array(*[F.lit(p) for p in CODE_PROBES]), idx))
    return c.select("conv_id", "turn", F.md5(SC.extract_code_block(t)).alias("code_md5"))


def q_eval_loss_ppl(spark, sf):
    d = _docs(spark, sf).select("lang", F.octet_length("text").alias("tokens"),
                                (F.lit(1.0) + F.lit(5.0) * u(F.lit("loss"), F.col("doc_id"))).alias("loss"))
    r = SC.eval_loss_ppl(d, ["lang"], "loss", "tokens")
    return r.select("lang", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"), "tokens_evaluated")


def q_seq_logprob(spark, sf):
    e = table(spark, sf, "embeddings")
    lp = F.transform("embedding", lambda x: -F.abs(x.cast("double")) * 3)
    mask = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1),
                       lambda i: F.when((i + F.col("label")) % 3 == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    return e.select("vec_id", F.round(SC.seq_logprob(lp, mask), 9).alias("seq_logprob"))


def _pairs(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", "lang", (F.col("doc_id") % 16).alias("batch"),
                    (-5 * u(F.lit("pc"), F.col("doc_id"))).alias("pc"), (-5 * u(F.lit("pr"), F.col("doc_id"))).alias("pr"),
                    (-5 * u(F.lit("rc"), F.col("doc_id"))).alias("rc"), (-5 * u(F.lit("rr"), F.col("doc_id"))).alias("rr"))


def q_dpo_metrics(spark, sf):
    m = SC.dpo_metrics(_pairs(spark, sf), "batch", BETA, "pc", "pr", "rc", "rr")
    return m.select("batch", *[F.round(c, 6).alias(c) for c in
                               ("loss", "chosen_reward", "rejected_reward", "reward_margin", "accuracy")])


def q_reward_model_loss(spark, sf):
    p = _pairs(spark, sf).select("lang", (F.col("pc") * 0.8 + 2).alias("chosen"), (F.col("pr") * 0.8 + 2).alias("rejected"))
    r = SC.reward_model_loss(p, ["lang"], "chosen", "rejected")
    return r.select("lang", F.round("loss", 6).alias("loss"), "pairs")


def _rl(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", (F.col("user_id") % 20).alias("batch"), (u(F.lit("rw"), F.col("event_id")) * 2 - 1).alias("reward"),
                    (u(F.lit("val"), F.col("event_id")) - 0.5).alias("value"),
                    (-3 * u(F.lit("new"), F.col("event_id"))).alias("new_lp"), (-3 * u(F.lit("old"), F.col("event_id"))).alias("old_lp"))


def q_advantages(spark, sf):
    a = SC.advantages(_rl(spark, sf), "batch", "reward", "value")
    return a.select("event_id", F.round("advantage", 6).alias("advantage"), F.round("returns", 9).alias("returns"))


def q_ppo_diagnostics(spark, sf):
    a = SC.advantages(_rl(spark, sf), "batch", "reward", "value")
    p = SC.ppo_diagnostics(a, "batch", "new_lp", "old_lp", "advantage", "value", "returns", CLIP)
    return p.select("batch", *[F.round(c, 6).alias(c) for c in ("policy_loss", "mean_ratio", "clip_fraction", "value_mse")])


def q_logit_confidence(spark, sf):
    e = table(spark, sf, "embeddings")
    c = SC.logit_confidence(F.transform("embedding", lambda x: x.cast("double") * 10), 5)
    return e.select("vec_id", F.round(c["confidence"], 6).alias("confidence"), F.round(c["top_k_mass"], 6).alias("top_k_mass"))


def q_entropy_budget(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", epoch_us("ts").alias("t"),
                                          (F.col("value") / 100).alias("step_entropy"))
    b = SC.entropy_budget(e, "user_id", "t", "step_entropy", BUDGET, "event_id")
    return b.select("event_id", "permitted", F.round("remaining", 6).alias("remaining"),
                    F.round("fraction_used", 6).alias("fraction_used"))


def q_speculation_rate(spark, sf):
    e = table(spark, sf, "events")
    drafted = (F.get_json_object("props", "$.k").cast("bigint") % 6)
    acc = F.floor(drafted * u(F.lit("acc"), F.col("event_id"))).cast("bigint")
    r = SC.speculation_rate(e.select("user_id", drafted.alias("drafted"), acc.alias("accepted")), "user_id", "accepted", "drafted")
    return r.select("user_id", F.round("acceptance_rate", 9).alias("acceptance_rate"), "accepted", "drafted")


def q_batch_generation_stats(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("batch"),
                                                  TK.byte_tokens("text").alias("gen"),
                                                  (F.length("text") * 0.5).alias("latency_ms"))
    s = SC.batch_generation_stats(c, "batch", "gen", "latency_ms", 46)
    return s.select("batch", "requests", "tokens_generated", F.round("latency_sum_ms", 6).alias("latency_sum_ms"),
                    F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


# ---- vectors

def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def q_vector_normalize(spark, sf):
    v = R.vector_normalize(_emb(spark, sf), "embedding", 1e-8, "unit")
    return v.select("vec_id", F.round(R.l2_norm("embedding"), 9).alias("norm"),
                    F.round(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x), 9).alias("unit_sum"))


def q_vector_topk(spark, sf):
    e = _emb(spark, sf)
    t = R.vector_topk(e, e.select(F.col("vec_id").alias("q_id"), "embedding"), k=TOPK)
    return t.select("q_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 9).alias("score"))


def q_vector_int4(spark, sf):
    q = V.int4_quantize("embedding")
    e = _emb(spark, sf).select("vec_id", q.alias("r"))
    return e.select("vec_id", F.col("r.scale").alias("scale"),
                    F.md5(F.array_join(F.col("r.q").cast("array<string>"), ",")).alias("q_md5"),
                    F.round("r.max_abs_error", 9).alias("max_abs_error"))


def q_dim_absmax(spark, sf):
    return V.dim_absmax(_emb(spark, sf)).select(F.col("dim").cast("bigint").alias("dim"), "absmax")


def q_gram_matrix(spark, sf):
    g = V.gram_matrix(_emb(spark, sf), "embedding", 0.01)
    return g.select("i", "j", F.round("value", 9).alias("value"))


# ---- mixing

def _weights(spark, sf):
    d = _docs(spark, sf)
    lab = table(spark, sf, "labels")
    src = (d.join(lab, "doc_id", "left").groupBy(F.col("source").alias("name"))
           .agg((F.lit(1) + F.coalesce(F.sum("quality"), F.lit(0))).cast("double").alias("weight"),
                F.count(F.lit(1)).cast("bigint").alias("size")))
    return src


def _mix_plan(spark, sf):
    src = _weights(spark, sf)
    w = MX.mix_weights(src.select("name", "weight"), "name", "weight")
    draws = _docs(spark, sf).select(F.col("doc_id").alias("idx"))
    return MX.mix_sample(draws, "idx", w, src.select("name", "size"), SEED), w


def q_mix_weights(spark, sf):
    w = MX.mix_weights(_weights(spark, sf).select("name", "weight"), "name", "weight")
    return w.select("name", "weight", F.round("weight_norm", 12).alias("weight_norm"), F.round("pct", 9).alias("pct"),
                    F.round("range_lo", 12).alias("range_lo"), F.round("range_hi", 12).alias("range_hi"))


def q_mix_sample(spark, sf):
    plan, _ = _mix_plan(spark, sf)
    return plan


def q_mix_fetch(spark, sf):
    plan, _ = _mix_plan(spark, sf)
    items = MX.source_index(_docs(spark, sf).select(F.col("source").alias("name"), "doc_id"), "name", "doc_id")
    return MX.mix_fetch(plan, items).select("idx", "name", "local_idx", "doc_id")


def q_mix_report(spark, sf):
    plan, w = _mix_plan(spark, sf)
    r = MX.mix_report(plan, w)
    return r.select("name", F.round("target_share", 12).alias("target_share"), "samples",
                    F.round("realised_share", 12).alias("realised_share"))


def _stages(spark):
    return MX.curriculum_table(spark, MX.CURRICULUM_PRESETS[PRESET])


def _step_log(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("event_id") * 19).alias("step"))


def q_curriculum_table(spark, sf):
    st = _stages(spark)
    at = MX.curriculum_at_step(_step_log(spark, sf), "step", st)
    logged = at.groupBy("stage").agg(F.count(F.lit(1)).cast("bigint").alias("logged_steps"))
    return st.join(logged, "stage", "left").select(
        F.col("stage").cast("bigint").alias("stage"), "seq_len", "num_steps", "step_lo", "step_hi", "total_steps",
        "max_seq_len", "warmup_steps", F.coalesce("logged_steps", F.lit(0)).alias("logged_steps"))


def q_curriculum_at_step(spark, sf):
    at = MX.curriculum_at_step(_step_log(spark, sf), "step", _stages(spark))
    return at.select("event_id", "step", F.col("stage").cast("bigint").alias("stage"), "seq_len",
                     F.col("batch_size").cast("bigint").alias("batch_size"), "transition",
                     F.round("progress", 12).alias("progress"))


def q_curriculum_lr(spark, sf):
    at = MX.curriculum_at_step(_step_log(spark, sf), "step", _stages(spark))
    return at.select("event_id", F.round(MX.curriculum_lr(at, "step", BASE_LR), 12).alias("lr"))


def q_cosine_lr(spark, sf):
    s = _step_log(spark, sf)
    return s.select("event_id", F.round(MX.cosine_lr("step", 2000, 150_000), 12).alias("lr"))


def q_curriculum_token_plan(spark, sf):
    corpus = TK.corpus_token_stats(_docs(spark, sf), [], TK.DEFAULT_SHARD_SIZE)
    p = MX.curriculum_token_plan(_stages(spark), corpus)
    return p.select(F.col("stage").cast("bigint").alias("stage"), "sequences_needed", "tokens_needed",
                    F.round("epochs_over_corpus", 9).alias("epochs_over_corpus"))


# ------------------------------------------------------------------ SQL oracle

_CHOICES = "list_transform(range(4), lambda i: 'option ' || i || ' ' || substr(md5(doc_id || ':' || i), 1, 6))"
_MC = f"""mcs AS (SELECT doc_id, source, ci AS choice_idx, -(1.0 + 4.0 * {u_sql("'mc'", 'doc_id', 'ci')}) AS score
   FROM documents, (SELECT unnest(range(4)) AS ci)),
best AS (SELECT doc_id, arg_max(choice_idx, (score, -choice_idx)) AS pred_idx FROM mcs GROUP BY doc_id),
res AS (SELECT d.doc_id, d.source, b.pred_idx = CAST(floor({u_sql("'ans'", 'd.doc_id')} * 4) AS INTEGER) AS correct
   FROM documents d JOIN best b USING (doc_id))"""
_COMP = f"""ce AS (SELECT doc_id, lang, e AS ending, {u_sql("'end'", 'doc_id', 'e')} AS score FROM documents, (SELECT unnest(range(4)) AS e)),
cb AS (SELECT doc_id, lang, arg_max(ending, (score, -ending)) AS pred FROM ce GROUP BY doc_id, lang),
cr AS (SELECT doc_id, lang, pred = CAST(floor({u_sql("'label'", 'doc_id')} * 4) AS INTEGER) AS ok FROM cb)"""
_PASS = f"ps AS (SELECT doc_id, source, {u_sql(chr(39) + 'pass' + chr(39), 'doc_id')} < 0.3 AS passed FROM documents)"


def _logsig(x):
    return f"(CASE WHEN ({x}) >= 0 THEN -ln(1 + exp(-({x}))) ELSE ({x}) - ln(1 + exp({x})) END)"


_PAIRS = f"""pairs AS (SELECT doc_id, lang, doc_id % 16 AS batch, -5 * {u_sql("'pc'", 'doc_id')} AS pc, -5 * {u_sql("'pr'", 'doc_id')} AS pr,
   -5 * {u_sql("'rc'", 'doc_id')} AS rc, -5 * {u_sql("'rr'", 'doc_id')} AS rr FROM documents)"""
_RL = f"""rl AS (SELECT event_id, user_id % 20 AS batch, {u_sql("'rw'", 'event_id')} * 2 - 1 AS reward, {u_sql("'val'", 'event_id')} - 0.5 AS value,
   -3 * {u_sql("'new'", 'event_id')} AS new_lp, -3 * {u_sql("'old'", 'event_id')} AS old_lp FROM events),
st AS (SELECT batch, avg(reward - value) AS m, stddev_samp(reward - value) AS s FROM rl GROUP BY batch),
adv AS (SELECT rl.*, (reward - value - m) / (s + 1e-8) AS advantage, reward AS returns FROM rl JOIN st USING (batch))"""

_CODE_ARR = "[" + ", ".join("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if p else "''" for p in CODE_PROBES) + "]"


def _fence_rx():
    from quarry.operators.safety import python_regex_to_portable
    return "(?s)" + python_regex_to_portable(SC.CODE_FENCE_PATTERN)


def _ltrim_sql(x):
    return Q.strip(x)


_WEIGHTS = """src AS (SELECT d.source AS name, CAST(1 + coalesce(sum(l.quality), 0) AS DOUBLE) AS weight, CAST(count(*) AS BIGINT) AS size
   FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source),
w AS (SELECT name, weight, size, weight / sum(weight) OVER () AS wn FROM src),
wr AS (SELECT *, sum(wn) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - wn AS lo, sum(wn) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) AS hi FROM w)"""
_PLAN = f"""{_WEIGHTS},
dr AS (SELECT doc_id AS idx, {u_sql("'src'", 'doc_id')} AS u1, {u_sql("'idx'", 'doc_id')} AS u2 FROM documents),
plan AS (SELECT dr.idx, wr.name, CAST(floor(dr.u2 * wr.size) AS BIGINT) AS local_idx FROM dr LEFT JOIN wr ON dr.u1 >= wr.lo AND dr.u1 < wr.hi)"""


def _stages_sql():
    rows = ", ".join(f"({i}, {s}, {n})" for i, (s, n) in enumerate(MX.CURRICULUM_PRESETS[PRESET]))
    return f"""stg0 AS (SELECT * FROM (VALUES {rows}) v(stage, seq_len, num_steps)),
stg AS (SELECT stage, CAST(seq_len AS BIGINT) AS seq_len, CAST(num_steps AS BIGINT) AS num_steps,
   CAST(sum(num_steps) OVER (ORDER BY stage) AS BIGINT) AS step_hi, CAST(sum(num_steps) OVER (ORDER BY stage) - num_steps AS BIGINT) AS step_lo,
   CAST(sum(num_steps) OVER () AS BIGINT) AS total_steps, CAST(max(seq_len) OVER () AS BIGINT) AS max_seq_len,
   CAST(floor(num_steps * 0.02::DOUBLE) AS BIGINT) AS warmup_steps, max(stage) OVER () AS last FROM stg0),
sl AS (SELECT event_id, event_id * 19 AS step FROM events),
ats AS (SELECT sl.event_id, sl.step, stg.* FROM sl JOIN stg ON (sl.step >= stg.step_lo AND sl.step < stg.step_hi)
       OR (sl.step >= stg.step_hi AND stg.stage = stg.last))"""


_PI = "pi()"

SQL = {
    "mc_prompts": f"""WITH p AS (SELECT doc_id, text, {_CHOICES} AS ch FROM documents),
e AS (SELECT doc_id, text, ch, unnest(range(4)) AS ci FROM p)
SELECT doc_id, CAST(ci AS BIGINT) AS choice_idx, md5('Question: ' || text || chr(10) ||
  'A. ' || ch[1] || chr(10) || 'B. ' || ch[2] || chr(10) || 'C. ' || ch[3] || chr(10) || 'D. ' || ch[4] || chr(10) ||
  'Answer: ' || ['A', 'B', 'C', 'D'][ci + 1]) AS prompt_md5 FROM e""",
    "mc_argmax": f"WITH {_MC} SELECT doc_id, CAST(pred_idx AS BIGINT) AS pred_idx, ['A','B','C','D'][pred_idx + 1] AS predicted FROM best",
    "mc_accuracy": f"""WITH {_MC} SELECT source, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
  CAST(count(*) AS BIGINT) AS num_samples FROM res GROUP BY ROLLUP (source)""",
    "completion_accuracy": f"""WITH {_COMP} SELECT lang, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
  CAST(count(*) AS BIGINT) AS num_samples FROM cr GROUP BY lang""",
    "pass_at_1": f"""WITH {_PASS} SELECT source, sum(CASE WHEN passed THEN 1 ELSE 0 END) / count(*) AS pass_at_1,
  CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS num_passed, CAST(count(*) AS BIGINT) AS num_total FROM ps GROUP BY source""",
    "sample_items": f"SELECT doc_id, source FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT 25",
    "benchmark_report": f"""WITH {_MC}, {_COMP}, {_PASS}
SELECT 'mmlu' AS benchmark, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END)::DOUBLE AS score, CAST(count(*) AS BIGINT) AS num_samples FROM res
UNION ALL SELECT 'hellaswag', avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE, CAST(count(*) AS BIGINT) FROM cr
UNION ALL SELECT 'humaneval', sum(CASE WHEN passed THEN 1 ELSE 0 END) / count(*), CAST(count(*) AS BIGINT) FROM ps""",
    "extract_code_block": f"""WITH c AS (SELECT conv_id, turn, text || {_CODE_ARR}[((conv_id * 5 + turn) % {len(CODE_PROBES)}) + 1] AS t FROM conversations),
l AS (SELECT conv_id, turn, t, string_split(t, chr(10)) AS lines FROM c),
f AS (SELECT *, list_position(list_transform(lines, lambda x: starts_with({Q.strip('x')}, 'def ') OR starts_with({Q.strip('x')}, 'import ')), true) AS first FROM l)
SELECT conv_id, turn, md5(CASE WHEN regexp_matches(t, '{_fence_rx()}') THEN {Q.strip(f"regexp_extract(t, '{_fence_rx()}', 1)")}
  WHEN first IS NOT NULL AND first > 0 THEN array_to_string(lines[first:], chr(10)) ELSE t END) AS code_md5 FROM f""",
    "eval_loss_ppl": f"""WITH b AS (SELECT lang, octet_length(encode(text)) AS tokens, 1.0 + 5.0 * {u_sql("'loss'", 'doc_id')} AS loss FROM documents),
g AS (SELECT lang, sum(loss * tokens) / greatest(sum(tokens), 1) AS loss, CAST(sum(tokens) AS BIGINT) AS tokens_evaluated FROM b GROUP BY lang)
SELECT lang, round(loss, 6) AS loss, round(least(exp(loss), 1e6), 6) AS perplexity, tokens_evaluated FROM g""",
    "seq_logprob": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)) * 3) AS lp,
   list_transform(range(len(embedding)), lambda i: CASE WHEN (i + label) % 3 = 0 THEN 0.0 ELSE 1.0 END) AS m FROM embeddings)
SELECT vec_id, round(list_reduce(list_transform(range(len(lp)), lambda i: lp[i + 1] * m[i + 1]), lambda a, b: a + b, 0.0)
   / greatest(list_reduce(m, lambda a, b: a + b, 0.0), 1.0), 9) AS seq_logprob FROM e""",
    "dpo_metrics": f"""WITH {_PAIRS}, r AS (SELECT batch, {BETA} * (pc - rc) AS cr, {BETA} * (pr - rr) AS rj FROM pairs)
SELECT batch, round(avg(-{_logsig('cr - rj')}), 6) AS loss, round(avg(cr), 6) AS chosen_reward, round(avg(rj), 6) AS rejected_reward,
  round(avg(cr - rj), 6) AS reward_margin, round(avg(CASE WHEN cr > rj THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM r GROUP BY batch""",
    "reward_model_loss": f"""WITH {_PAIRS}, p AS (SELECT lang, pc * 0.8 + 2 AS chosen, pr * 0.8 + 2 AS rejected FROM pairs)
SELECT lang, round(avg(-{_logsig('chosen - rejected')}), 6) AS loss, CAST(count(*) AS BIGINT) AS pairs FROM p GROUP BY lang""",
    "advantages": f"WITH {_RL} SELECT event_id, round(advantage, 6) AS advantage, round(returns, 9) AS returns FROM adv",
    "ppo_diagnostics": f"""WITH {_RL}, x AS (SELECT batch, exp(new_lp - old_lp) AS r, advantage AS a, value - returns AS e FROM adv)
SELECT batch, round(-avg(least(r * a, least(greatest(r, {1 - CLIP}), {1 + CLIP}) * a)), 6) AS policy_loss, round(avg(r), 6) AS mean_ratio,
  round(avg(CASE WHEN abs(r - 1) > {CLIP} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS clip_fraction, round(avg(e * e), 6) AS value_mse FROM x GROUP BY batch""",
    "logit_confidence": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 10) AS l FROM embeddings),
y AS (SELECT vec_id, l, list_transform(l, lambda v: exp(v - list_max(l))) AS ex FROM x),
z AS (SELECT vec_id, l, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM y),
h AS (SELECT vec_id, l, p, -list_reduce(list_transform(p, lambda v: v * ln(v + 1e-10)), lambda a, b: a + b, 0.0) AS ent FROM z)
SELECT vec_id, round(least(greatest(1.0 - ent / ln(len(l)), 0.0), 1.0), 6) AS confidence,
  round(list_reduce(list_sort(p, 'DESC')[1:5], lambda a, b: a + b, 0.0), 6) AS top_k_mass FROM h""",
    "entropy_budget": f"""WITH r AS (SELECT event_id, sum(value / 100) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)
SELECT event_id, used < {BUDGET} AS permitted, round(greatest(0.0, {BUDGET} - used), 6) AS remaining, round(least(1.0, used / {BUDGET}), 6) AS fraction_used FROM r""",
    "speculation_rate": f"""WITH s AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 6 AS drafted, event_id FROM events),
a AS (SELECT user_id, drafted, CAST(floor(drafted * {u_sql("'acc'", 'event_id')}) AS BIGINT) AS accepted FROM s)
SELECT user_id, round(sum(accepted) / greatest(sum(drafted), 1), 9) AS acceptance_rate, CAST(sum(accepted) AS BIGINT) AS accepted,
  CAST(sum(drafted) AS BIGINT) AS drafted FROM a GROUP BY user_id""",
    "batch_generation_stats": """WITH c AS (SELECT conv_id % 10 AS batch, text, CAST(length(text) AS DOUBLE) * 0.5 AS lat,
   strpos(text, '.') AS p FROM conversations),
n AS (SELECT batch, lat, CASE WHEN p > 0 THEN octet_length(encode(substr(text, 1, p))) ELSE octet_length(encode(text)) END AS n FROM c)
SELECT batch, CAST(count(*) AS BIGINT) AS requests, CAST(sum(n) AS BIGINT) AS tokens_generated, round(sum(lat), 6) AS latency_sum_ms,
  round(avg(lat), 6) AS avg_latency_ms FROM n GROUP BY batch""",
    "vector_normalize": """WITH n AS (SELECT vec_id, embedding, sqrt(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0)) AS nrm FROM embeddings)
SELECT vec_id, round(nrm, 9) AS norm, round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (nrm + 1e-8)), lambda a, b: a + b, 0.0), 9) AS unit_sum FROM n""",
    "vector_topk": f"""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_reduce(list_transform(v, lambda y: y * y), lambda a, b: a + b, 0.0)) + 1e-8)) AS v FROM n),
s AS (SELECT q.vec_id AS q_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM u q, u c),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT q_id, CAST(rank AS BIGINT) AS rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= {TOPK}""",
    "vector_int4": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT vec_id, v, greatest(list_max(list_transform(v, lambda a: abs(a))) / 7.0, 1e-8) AS scale FROM x),
q AS (SELECT vec_id, v, scale, list_transform(v, lambda a: CAST(least(greatest(round_even(a / scale, 0), -8.0), 7.0) AS INTEGER)) AS q FROM s)
SELECT vec_id, scale, md5(array_to_string(q, ',')) AS q_md5,
  round(list_max(list_transform(range(len(v)), lambda i: abs(v[i + 1] - q[i + 1] * scale))), 9) AS max_abs_error FROM q""",
    "dim_absmax": """WITH e AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings)
SELECT CAST(dim AS BIGINT) AS dim, max(abs(CAST(x AS DOUBLE))) AS absmax FROM e GROUP BY dim""",
    "gram_matrix": """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
p AS (SELECT a.i, b.i AS j, sum(CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)) / (SELECT count(*) FROM embeddings) AS v
      FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i),
d AS (SELECT avg(v) AS md FROM p WHERE i = j)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v + CASE WHEN i = j THEN 0.01 * (SELECT md FROM d) ELSE 0.0 END, 9) AS value FROM p""",
    "mix_weights": f"""WITH {_WEIGHTS} SELECT name, weight, round(wn, 12) AS weight_norm, round(wn * 100, 9) AS pct,
  round(lo, 12) AS range_lo, round(hi, 12) AS range_hi FROM wr""",
    "mix_sample": f"WITH {_PLAN} SELECT idx, name, local_idx FROM plan",
    "mix_fetch": f"""WITH {_PLAN}, items AS (SELECT source AS name, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS local_idx FROM documents)
SELECT plan.idx, plan.name, plan.local_idx, items.doc_id FROM plan LEFT JOIN items USING (name, local_idx)""",
    "mix_report": f"""WITH {_PLAN}, got AS (SELECT name, count(*) AS n FROM plan GROUP BY name)
SELECT wr.name, round(wn, 12) AS target_share, CAST(coalesce(n, 0) AS BIGINT) AS samples,
  round(coalesce(n, 0) / (SELECT count(*) FROM plan), 12) AS realised_share FROM wr LEFT JOIN got USING (name)""",
    "curriculum_table": f"""WITH {_stages_sql()}, lg AS (SELECT stage, count(*) AS n FROM ats GROUP BY stage)
SELECT CAST(stg.stage AS BIGINT) AS stage, seq_len, num_steps, step_lo, step_hi, total_steps, max_seq_len, warmup_steps,
  CAST(coalesce(n, 0) AS BIGINT) AS logged_steps FROM stg LEFT JOIN lg USING (stage)""",
    "curriculum_at_step": f"""WITH {_stages_sql()}
SELECT event_id, step, CAST(stage AS BIGINT) AS stage, seq_len, CAST(4 AS BIGINT) AS batch_size,
  step = 0 OR (step = step_lo AND stage > 0) AS transition, round(least(step / greatest(total_steps, 1), 1.0), 12) AS progress FROM ats""",
    "curriculum_lr": f"""WITH {_stages_sql()}, k AS (SELECT event_id, step - step_lo AS k, warmup_steps AS w, num_steps FROM ats)
SELECT event_id, round(CASE WHEN k < w THEN {BASE_LR} * (k + 1) / greatest(w, 1)
  ELSE {BASE_LR} * 0.1 + 0.5 * ({BASE_LR} - {BASE_LR} * 0.1) * (1.0 + cos({_PI} * ((k - w) / greatest(num_steps - w, 1)))) END, 12) AS lr FROM k""",
    "cosine_lr": f"""SELECT event_id, round(CASE WHEN event_id * 19 < 2000 THEN 0.0003 * (event_id * 19) / 2000
  WHEN event_id * 19 >= 150000 THEN 1e-05
  ELSE 1e-05 + 0.5 * (0.0003 - 1e-05) * (1.0 + cos({_PI} * ((event_id * 19 - 2000) / 148000))) END, 12) AS lr FROM events""",
    "curriculum_token_plan": f"""WITH {_stages_sql()},
c AS (SELECT sum(octet_length(encode(text)) + 3) AS tokens FROM documents WHERE NOT {Q.is_blank('text')})
SELECT CAST(stage AS BIGINT) AS stage, CAST(num_steps * 4 AS BIGINT) AS sequences_needed, CAST(num_steps * 4 * seq_len AS BIGINT) AS tokens_needed,
  round(num_steps * 4 * seq_len / greatest(tokens, 1), 9) AS epochs_over_corpus FROM stg, c""",
}

QUERIES = {
    "mc_prompts": q_mc_prompts, "mc_argmax": q_mc_argmax, "mc_accuracy": q_mc_accuracy,
    "completion_accuracy": q_completion_accuracy, "pass_at_1": q_pass_at_1, "sample_items": q_sample_items,
    "benchmark_report": q_benchmark_report, "extract_code_block": q_extract_code_block,
    "eval_loss_ppl": q_eval_loss_ppl, "seq_logprob": q_seq_logprob, "dpo_metrics": q_dpo_metrics,
    "reward_model_loss": q_reward_model_loss, "advantages": q_advantages, "ppo_diagnostics": q_ppo_diagnostics,
    "logit_confidence": q_logit_confidence, "entropy_budget": q_entropy_budget,
    "speculation_rate": q_speculation_rate, "batch_generation_stats": q_batch_generation_stats,
    "vector_normalize": q_vector_normalize, "vector_topk": q_vector_topk, "vector_int4": q_vector_int4,
    "dim_absmax": q_dim_absmax, "gram_matrix": q_gram_matrix,
    "mix_weights": q_mix_weights, "mix_sample": q_mix_sample, "mix_fetch": q_mix_fetch, "mix_report": q_mix_report,
    "curriculum_table": q_curriculum_table, "curriculum_at_step": q_curriculum_at_step,
    "curriculum_lr": q_curriculum_lr, "cosine_lr": q_cosine_lr, "curriculum_token_plan": q_curriculum_token_plan,
}

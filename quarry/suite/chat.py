"""Chat, SFT and tool/agent query keys over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chat as C
from quarry.sources.tables import table
from quarry.suite import sqlfrag as Q

MAX_MEMORY_TOKENS = 300
MAX_SEQ_LEN = 512
# Fixed tool registry used for dispatch (name, category).
TOOL_REGISTRY = [("calc", "math"), ("search", "web"), ("read_file", "files")]

# Tool-call text appended on residue (conv_id * 3 + turn) % 9 (index); '' = untouched.
TOOL_PROBES = [
    ' {"tool": "calc", "arguments": {"expr": "1+2"}}',
    ' <tool_call><name>search</name><arguments>{"q": "spark"}</arguments></tool_call>',
    ' {"tool": "broken", "arguments": {oops}}',
    ' <tool_call> <name>read_file</name> <arguments> not json </arguments></tool_call>',
    ' {"tool":"calc","arguments":{}} and {"tool": "unknown_tool", "arguments": {"a": [1, 2]}}',
    "",
    "",
    "",
    "",
]
PLAN_PROBES = ["\n1. Gather data\n2. Clean it\n3. Report", "\n10.  Only step", "", "\n1.no space"]


def _probe(k1, k2, mult, probes):
    idx = (F.col(k1) * mult + F.col(k2)) % len(probes)
    return F.element_at(F.array(*[F.lit(p) for p in probes]), (idx + 1).cast("int"))


def _probe_sql(k1, k2, mult, probes):
    arr = "[" + ", ".join("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in probes) + "]"
    return f"{arr}[(({k1} * {mult} + {k2}) % {len(probes)}) + 1]"


def _conv(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def _tool_turns(spark, sf):
    c = _conv(spark, sf)
    return c.withColumn("text", F.concat("text", _probe("conv_id", "turn", 3, TOOL_PROBES)))


def _md5_arr(c):
    return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))


def q_render_chat(spark, sf):
    c = _conv(spark, sf)
    a = C.render_chat(c, C.NATIVE_TEMPLATE).select("conv_id", F.md5("rendered").alias("native_md5"),
                                                   F.length("rendered").cast("bigint").alias("native_len"))
    b = C.render_chat(c, C.CHATML_TEMPLATE).select("conv_id", F.md5("rendered").alias("chatml_md5"))
    return a.join(b, "conv_id")


def q_render_instruction(spark, sf):
    c = _conv(spark, sf)
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"),
                   F.col("text").alias("next_text"))
    j = c.join(nxt, ["conv_id", "turn"], "left")
    inst = F.when(F.col("role") == "user", F.col("text"))
    resp = F.when(F.col("next_role") == "assistant", F.col("next_text"))
    out = C.render_instruction(None, inst, resp, F.col("text"))
    return j.select("conv_id", "turn", F.md5(out).alias("text_md5"))


def q_sft_loss_mask(spark, sf):
    m = C.sft_loss_mask(_conv(spark, sf))
    return m.select("conv_id", F.size("input_ids").cast("bigint").alias("n_ids"), _md5_arr("input_ids").alias("ids_md5"),
                    _md5_arr("labels").alias("labels_md5"),
                    F.size(F.filter("labels", lambda x: x == C.IGNORE_INDEX)).cast("bigint").alias("n_masked"))


def q_sft_pad(spark, sf):
    m = C.sft_pad(C.sft_loss_mask(_conv(spark, sf), max_seq_len=MAX_SEQ_LEN), MAX_SEQ_LEN)
    return m.select("conv_id", _md5_arr("input_ids").alias("ids_md5"), _md5_arr("labels").alias("labels_md5"))


def q_chat_stats(spark, sf):
    return C.chat_stats(_conv(spark, sf))


def q_memory_window(spark, sf):
    return C.memory_window(_conv(spark, sf), MAX_MEMORY_TOKENS).select("conv_id", "turn", "window_tokens")


def _system_prompts(c):
    """All system turns of a conversation, in order."""
    turns = c.filter(F.col("role") == "system").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("system_prompt"))


def q_prompt_from_memory(spark, sf):
    c = _conv(spark, sf)
    system = _system_prompts(c)
    window = C.memory_window(c.filter(F.col("role") != "system"), MAX_MEMORY_TOKENS)
    p = C.prompt_from_memory(system, window)
    return p.select("conv_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_len"))


def q_prompt_from_request(spark, sf):
    p = C.prompt_from_request(_conv(spark, sf))
    return p.select("conv_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_len"))


def q_parse_tool_calls(spark, sf):
    return C.parse_tool_calls(_tool_turns(spark, sf), ["conv_id", "turn"]).drop("call_id")


def q_has_tool_calls(spark, sf):
    return _tool_turns(spark, sf).select("conv_id", "turn", C.has_tool_calls("text").alias("has_calls"))


def q_tool_dispatch_join(spark, sf):
    calls = C.parse_tool_calls(_tool_turns(spark, sf), ["conv_id", "turn"])
    reg = spark.createDataFrame(TOOL_REGISTRY, "name string, category string")
    d = C.tool_dispatch(calls, reg)
    return d.select("conv_id", "turn", "call_index", "name", "category", "dispatched", "result")


def q_plan_steps(spark, sf):
    c = _conv(spark, sf).filter(F.col("role") == "assistant")
    c = c.withColumn("text", F.concat("text", _probe("conv_id", "turn", 5, PLAN_PROBES)))
    c = c.withColumn("task", F.concat(F.lit("task "), F.col("conv_id").cast("string")))
    s = C.plan_steps(c, ["conv_id", "turn"], "text", "task")
    return s.select("conv_id", "turn", F.col("step_no").cast("bigint").alias("step_no"), "step")


def q_conversation_json(spark, sf):
    n = F.col("conv_id") + F.col("turn")
    c = _conv(spark, sf).withColumns({
        "tool_calls": F.when(n % 4 == 1, F.concat(F.lit('[{"id":"c'), F.col("turn").cast("string"), F.lit('","args":{"q":[1,"x"]}}]'))),
        "tool_call_id": F.when(n % 3 == 0, F.concat(F.lit("call-"), n.cast("string"))).when(n % 3 == 1, F.lit("")),
        "name": F.when(n % 5 == 0, F.concat(F.lit('tool "'), F.col("role"), F.lit('"')))})
    j = C.conversation_json(c.filter(F.col("role") != "system"), _system_prompts(c), MAX_MEMORY_TOKENS)
    back = C.conversation_from_json(j)
    said = F.concat_ws("|", "role", "text", F.coalesce("tool_calls", F.lit("-")), F.coalesce("tool_call_id", F.lit("-")), F.coalesce("name", F.lit("-")))
    agg = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("m"))
    agg = agg.select("conv_id", F.size("m").cast("bigint").alias("restored_messages"), F.md5(F.array_join(F.transform("m", lambda x: x["said"]), "\n")).alias("restored_md5"))
    found = j.select("conv_id", F.md5("json").alias("json_md5")).join(agg, "conv_id", "left")
    return found.select("conv_id", "json_md5", F.coalesce("restored_messages", F.lit(0)).alias("restored_messages"), F.coalesce("restored_md5", F.md5(F.lit(""))).alias("restored_md5"))


# ------------------------------------------------------------------ SQL oracle

def _fmt_sql(tmpl, role, text):
    cases = []
    for k, v in tmpl.items():
        if k in ("bos", "eos"):
            continue
        pre, _, post = v.partition("{content}")
        cases.append(f"WHEN {role} = '{k}' THEN {_lit(pre)} || {text} || {_lit(post)}")
    pre, _, post = tmpl["user"].partition("{content}")
    return f"CASE {' '.join(cases)} ELSE {_lit(pre)} || {text} || {_lit(post)} END"


def _lit(s):
    if s == "":
        return "''"
    parts = s.split("\n")
    return " || chr(10) || ".join(f"'{p}'" if p else "''" for p in parts)


def _bytes_sql(hexcol, v="bi"):
    return f"list_transform(range(len({hexcol}) // 2), lambda {v}: CAST(('0x' || substr({hexcol}, 2 * {v} + 1, 2)) AS INTEGER))"


_TOOLTURNS = f"t AS (SELECT conv_id, turn, role, text || {_probe_sql('conv_id', 'turn', 3, TOOL_PROBES)} AS text FROM conversations)"
_JRX = C.python_regex_to_portable(C.TOOL_JSON_PATTERN)
_XRX = "(?s)" + C.python_regex_to_portable(C.TOOL_XML_PATTERN)
_CALLS = f"""{_TOOLTURNS},
js AS (SELECT conv_id, turn, list_filter(list_zip(regexp_extract_all(text, '{_JRX}', 1), regexp_extract_all(text, '{_JRX}', 2)),
         lambda z: json_valid(z[2])) AS j,
       list_zip(regexp_extract_all(text, '{_XRX}', 1), regexp_extract_all(text, '{_XRX}', 2)) AS x FROM t),
al AS (SELECT conv_id, turn,
         list_transform(j, lambda z: {{'name': z[1], 'arguments': z[2], 'args_is_json': true, 'style': 'json'}}) ||
         list_transform(x, lambda z: {{'name': {Q.strip('z[1]')}, 'arguments': {Q.strip('z[2]')},
                                      'args_is_json': coalesce(json_valid({Q.strip('z[2]')}), false), 'style': 'xml'}}) AS calls FROM js),
calls AS (SELECT conv_id, turn, CAST(unnest(range(len(calls))) AS BIGINT) AS call_index, unnest(calls) AS c FROM al),
cf AS (SELECT conv_id, turn, call_index, c.name AS name, c.arguments AS arguments, c.args_is_json AS args_is_json, c.style AS style FROM calls)
"""

_REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in TOOL_REGISTRY) + ") v(name, category))"

SQL = {
    "render_chat": f"""WITH m AS (SELECT conv_id, turn, {_fmt_sql(C.NATIVE_TEMPLATE, 'role', 'text')} AS a,
        {_fmt_sql(C.CHATML_TEMPLATE, 'role', 'text')} AS b FROM conversations),
r AS (SELECT conv_id, '<|beginoftext|>' || string_agg(a, '' ORDER BY turn) || '<|endoftext|>' AS native,
         string_agg(b, '' ORDER BY turn) AS chatml FROM m GROUP BY conv_id)
SELECT conv_id, md5(native) AS native_md5, CAST(length(native) AS BIGINT) AS native_len, md5(chatml) AS chatml_md5 FROM r""",
    "render_instruction": """SELECT c.conv_id, c.turn, md5(CASE WHEN c.role = 'user' AND n.role = 'assistant'
  THEN '### Instruction:' || chr(10) || c.text || chr(10) || chr(10) || '### Response:' || chr(10) || n.text ELSE c.text END) AS text_md5
FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""",
    "sft_loss_mask": f"""WITH m AS (SELECT conv_id, turn, role, hex(encode({_fmt_sql(C.NATIVE_TEMPLATE, 'role', 'text')})) AS hx FROM conversations),
tk AS (SELECT conv_id, turn, role, {_bytes_sql('hx')} AS t FROM m),
g AS (SELECT conv_id, {_bytes_sql("hex(encode('<|beginoftext|>'))", 'b1')} || flatten(list(t ORDER BY turn)) || {_bytes_sql("hex(encode('<|endoftext|>'))", 'b2')} AS ids,
        list_transform(range(15), lambda q: -100) || flatten(list(CASE WHEN role = 'assistant' THEN t ELSE list_transform(t, lambda q: -100) END ORDER BY turn))
        || list_transform(range(13), lambda q: -100) AS labels FROM tk GROUP BY conv_id)
SELECT conv_id, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5,
       md5(array_to_string(labels, ',')) AS labels_md5, CAST(len(list_filter(labels, lambda q: q = -100)) AS BIGINT) AS n_masked FROM g""",
    "sft_pad": f"""WITH m AS (SELECT conv_id, turn, role, hex(encode({_fmt_sql(C.NATIVE_TEMPLATE, 'role', 'text')})) AS hx FROM conversations),
tk AS (SELECT conv_id, turn, role, {_bytes_sql('hx')} AS t FROM m),
g AS (SELECT conv_id, {_bytes_sql("hex(encode('<|beginoftext|>'))", 'b1')} || flatten(list(t ORDER BY turn)) || {_bytes_sql("hex(encode('<|endoftext|>'))", 'b2')} AS ids,
        list_transform(range(15), lambda q: -100) || flatten(list(CASE WHEN role = 'assistant' THEN t ELSE list_transform(t, lambda q: -100) END ORDER BY turn))
        || list_transform(range(13), lambda q: -100) AS labels FROM tk GROUP BY conv_id)
SELECT conv_id, md5(array_to_string(list_resize(ids[1:{MAX_SEQ_LEN}], {MAX_SEQ_LEN}, 0), ',')) AS ids_md5,
       md5(array_to_string(list_resize(labels[1:{MAX_SEQ_LEN}], {MAX_SEQ_LEN}, -100), ',')) AS labels_md5 FROM g""",
    "chat_stats": """SELECT role, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(text)) AS BIGINT) AS characters,
  CAST(count(DISTINCT conv_id) AS BIGINT) AS conversations, count(*) / greatest(count(DISTINCT conv_id), 1) AS avg_turns
FROM conversations GROUP BY ROLLUP (role)""",
    "memory_window": f"""WITH b AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tk FROM conversations),
s AS (SELECT conv_id, turn, sum(tk) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS suf,
        max(turn) OVER (PARTITION BY conv_id) AS last FROM b)
SELECT conv_id, turn, CAST(suf AS BIGINT) AS window_tokens FROM s WHERE suf <= {MAX_MEMORY_TOKENS} OR turn = last""",
    "prompt_from_memory": f"""WITH sys AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS sp FROM conversations WHERE role = 'system' GROUP BY conv_id),
b AS (SELECT conv_id, turn, role, text, greatest(1, length(text) // 4) AS tk FROM conversations WHERE role <> 'system'),
s AS (SELECT *, sum(tk) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS suf,
        max(turn) OVER (PARTITION BY conv_id) AS last FROM b),
w AS (SELECT * FROM s WHERE suf <= {MAX_MEMORY_TOKENS} OR turn = last),
j AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '<|user|>' || chr(10) || text || chr(10)
        WHEN role = 'assistant' THEN '<|assistant|>' || chr(10) || text || chr(10)
        WHEN role = 'tool' THEN '<|tool|>' || chr(10) || text || chr(10) ELSE '' END, '' ORDER BY turn) AS body FROM w GROUP BY conv_id),
p AS (SELECT conv_id, CASE WHEN coalesce(sys.sp, '') <> '' THEN '<|system|>' || chr(10) || sys.sp || chr(10) ELSE '' END
        || coalesce(body, '') || '<|assistant|>' || chr(10) AS prompt FROM j FULL JOIN sys USING (conv_id))
SELECT conv_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_len FROM p""",
    "prompt_from_request": """WITH p AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn)
  || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_len FROM p""",
    "parse_tool_calls": f"WITH {_CALLS} SELECT * FROM cf",
    "has_tool_calls": f"WITH {_TOOLTURNS} SELECT conv_id, turn, regexp_matches(text, '{_JRX}') OR regexp_matches(text, '{_XRX}') AS has_calls FROM t",
    "tool_dispatch_join": f"""WITH {_CALLS}, {_REG}
SELECT cf.conv_id, cf.turn, cf.call_index, cf.name, reg.category, reg.name IS NOT NULL AS dispatched,
  CASE WHEN reg.name IS NULL THEN 'Error: Tool not found: ' || cf.name END AS result
FROM cf LEFT JOIN reg ON cf.name = reg.name""",
    "plan_steps": f"""WITH a AS (SELECT conv_id, turn, text || {_probe_sql('conv_id', 'turn', 5, PLAN_PROBES)} AS text FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, regexp_extract_all(text, '(?m){C.python_regex_to_portable(C.PLAN_LINE_PATTERN)}', 1) AS st FROM a),
s2 AS (SELECT conv_id, turn, CASE WHEN len(st) = 0 THEN ['task ' || conv_id] ELSE st END AS st FROM s)
SELECT conv_id, turn, CAST(unnest(range(len(st))) AS BIGINT) AS step_no, unnest(st) AS step FROM s2""",
    "conversation_json": """WITH sys AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS sp FROM conversations WHERE role = 'system' GROUP BY conv_id),
t AS (SELECT conv_id, turn, role, text, CASE WHEN (conv_id + turn) % 4 = 1 THEN '[{"id":"c' || turn || '","args":{"q":[1,"x"]}}]' END AS tc,
      CASE WHEN (conv_id + turn) % 3 = 0 THEN 'call-' || (conv_id + turn) END AS ti, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'tool "' || role || '"' END AS nm
      FROM conversations WHERE role <> 'system'),
m AS (SELECT conv_id, count(*) AS n, string_agg('{"role":' || to_json(role)::VARCHAR || ',"content":' || to_json(text)::VARCHAR || coalesce(',"tool_calls":' || tc, '')
        || coalesce(',"tool_call_id":' || to_json(ti)::VARCHAR, '') || coalesce(',"name":' || to_json(nm)::VARCHAR, '') || '}', ',' ORDER BY turn) AS msgs,
      md5(string_agg(role || '|' || text || '|' || coalesce(tc, '-') || '|' || coalesce(ti, '-') || '|' || coalesce(nm, '-'), chr(10) ORDER BY turn)) AS r FROM t GROUP BY conv_id)
SELECT conv_id, md5('{"system_prompt":' || coalesce(to_json(sp)::VARCHAR, 'null') || ',"max_tokens":300,"messages":[' || coalesce(msgs, '') || ']}') AS json_md5,
       CAST(coalesce(n, 0) AS BIGINT) AS restored_messages, coalesce(r, md5('')) AS restored_md5 FROM m FULL JOIN sys USING (conv_id)""",
}

QUERIES = {
    "render_chat": q_render_chat,
    "render_instruction": q_render_instruction,
    "sft_loss_mask": q_sft_loss_mask,
    "sft_pad": q_sft_pad,
    "chat_stats": q_chat_stats,
    "memory_window": q_memory_window,
    "prompt_from_memory": q_prompt_from_memory,
    "prompt_from_request": q_prompt_from_request,
    "parse_tool_calls": q_parse_tool_calls,
    "has_tool_calls": q_has_tool_calls,
    "tool_dispatch_join": q_tool_dispatch_join,
    "plan_steps": q_plan_steps,
    "conversation_json": q_conversation_json,
}

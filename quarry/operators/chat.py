"""Chat, SFT and agent-trace operators over long-form conversations
``(conv_id, turn, role, text)``.

Per-message work is a column expression; per-conversation results gather
the ordered per-message pieces with ``array_sort(collect_list(struct))``.
Running/suffix sums inside a conversation use the block-wise running sum so
a conversation with a huge history is not one task.
"""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import col_, py_strip
from quarry.operators.tokens import byte_tokens, token_estimate
from quarry.operators.safety import python_regex_to_portable
from quarry.plans.layout import running_sum
from quarry.sources.jsonfiles import strict_json

# The reference's chat templates.
NATIVE_TEMPLATE = {
    "system": "<|system|>\n{content}\n",
    "user": "<|user|>\n{content}\n",
    "assistant": "<|assistant|>\n{content}\n",
    "tool": "<|tool|>\n{content}\n",
    "bos": "<|beginoftext|>",
    "eos": "<|endoftext|>",
}
CHATML_TEMPLATE = {
    "system": "<|im_start|>system\n{content}\n<|im_end|>\n",
    "user": "<|im_start|>user\n{content}\n<|im_end|>\n",
    "assistant": "<|im_start|>assistant\n{content}\n<|im_end|>\n",
    "tool": "<|im_start|>tool\n{content}\n<|im_end|>\n",
    "bos": "",
    "eos": "",
}
ALPACA_TEMPLATE = {
    "instruction": "### Instruction:\n{content}\n\n",
    "input": "### Input:\n{content}\n\n",
    "response": "### Response:\n{content}\n",
    "bos": "",
    "eos": "\n\n",
}
# ShareGPT speaker names and their roles (unknown -> user).
SHAREGPT_ROLES = {"human": "user", "gpt": "assistant", "system": "system",
                  "observation": "tool", "function_call": "assistant"}
# Tool-call patterns (JSON block, then XML tags).
TOOL_JSON_PATTERN = r'\{\s*"tool"\s*:\s*"(\w+)"\s*,\s*"arguments"\s*:\s*(\{[^}]*\})\s*\}'
TOOL_XML_PATTERN = r'<tool_call>\s*<name>(\w+)</name>\s*<arguments>(.*?)</arguments>\s*'
PLAN_LINE_PATTERN = r"^\d+\.\s+(.+)$"
IGNORE_INDEX = -100


def _fmt(template_text: str, content: Column) -> Column:
    pre, _, post = template_text.partition("{content}")
    return F.concat(F.lit(pre), content, F.lit(post))


def format_message(role, content, template: dict | None = None) -> Column:
    """Template for the role; unknown roles use the user template (or raw content)."""
    template = template or NATIVE_TEMPLATE
    r, c = col_(role), col_(content)
    fallback = template.get("user")
    default = _fmt(fallback, c) if fallback is not None else c
    expr = None
    for k, v in template.items():
        if k in ("bos", "eos"):
            continue
        expr = F.when(r == k, _fmt(v, c)) if expr is None else expr.when(r == k, _fmt(v, c))
    return default if expr is None else expr.otherwise(default)


def _ordered_join(df: DataFrame, group_col: str, order_col: str, piece: Column, sep: str = "") -> DataFrame:
    g = df.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), piece.alias("p")))).alias("_x"))
    return g.select(group_col, F.array_join(F.transform("_x", lambda x: x["p"]), sep).alias("_joined"))


def render_chat(conv: DataFrame, template: dict | None = None, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One training string per conversation: bos + messages in turn order + eos."""
    template = template or NATIVE_TEMPLATE
    j = _ordered_join(conv, conv_col, turn_col, format_message(role_col, text_col, template))
    return j.select(conv_col, F.concat(F.lit(template.get("bos", "")), "_joined",
                                       F.lit(template.get("eos", ""))).alias("rendered"))


def render_instruction(messages_text: Column | None, instruction: Column, response: Column,
                       text: Column) -> Column:
    """messages -> chat template text; instruction+response -> '### Instruction ...'; else text."""
    inst = F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Response:\n"), response)
    out = F.when(instruction.isNotNull() & response.isNotNull(), inst).otherwise(text)
    if messages_text is not None:
        out = F.when(messages_text.isNotNull(), messages_text).otherwise(out)
    return out


def sft_loss_mask(conv: DataFrame, template: dict | None = None, conv_col: str = "conv_id",
                  turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  max_seq_len: int | None = None) -> DataFrame:
    """Per conversation: input_ids over bos + messages + eos (byte tokens of the
    rendered pieces) and labels equal to the ids on assistant messages, -100
    elsewhere (bos and eos included).

    With ``max_seq_len`` only messages that start inside the first
    ``max_seq_len`` tokens are gathered (start offsets from a block-wise
    running sum), so a conversation with a huge history is never assembled
    whole; the truncated ids equal the full ids cut to ``max_seq_len``.
    """
    template = template or NATIVE_TEMPLATE
    if max_seq_len is not None:
        bos_len = len(template.get("bos", "").encode("utf-8"))
        n = F.octet_length(format_message(role_col, text_col, template)).cast("bigint")
        sized = conv.withColumn("_n", n)
        starts = running_sum(sized, [conv_col, turn_col], "_n", "_start", inclusive=False, partition_cols=[conv_col])
        conv = starts.filter(F.col("_start") + F.lit(bos_len) < F.lit(max_seq_len)).drop("_n", "_start")
    toks = byte_tokens(format_message(role_col, text_col, template))
    lab = F.when(F.col(role_col) == "assistant", toks).otherwise(F.transform(toks, lambda _: F.lit(IGNORE_INDEX)))
    g = conv.groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("o"), toks.alias("t"), lab.alias("l")))).alias("_x"))
    bos_ids = [b for b in template.get("bos", "").encode("utf-8")]
    eos_ids = [b for b in template.get("eos", "").encode("utf-8")]

    def lit_arr(v):
        return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")
    ids = F.concat(lit_arr(bos_ids), F.flatten(F.transform("_x", lambda x: x["t"])), lit_arr(eos_ids))
    labels = F.concat(lit_arr([IGNORE_INDEX] * len(bos_ids)), F.flatten(F.transform("_x", lambda x: x["l"])),
                      lit_arr([IGNORE_INDEX] * len(eos_ids)))
    return g.select(conv_col, ids.alias("input_ids"), labels.alias("labels"))


def sft_pad(df: DataFrame, max_seq_len: int) -> DataFrame:
    """Truncate to max_seq_len; pad ids with 0 and labels with -100."""
    ids = F.slice("input_ids", 1, max_seq_len)
    lab = F.slice("labels", 1, max_seq_len)
    return df.withColumn("input_ids", F.concat(ids, F.array_repeat(F.lit(0), F.lit(max_seq_len) - F.size(ids)))) \
             .withColumn("labels", F.concat(lab, F.array_repeat(F.lit(IGNORE_INDEX), F.lit(max_seq_len) - F.size(lab))))


def chat_stats(conv: DataFrame, conv_col: str = "conv_id", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Messages and characters per role, plus the all-roles row (role NULL) with
    conversations and average turns; one pass with ROLLUP."""
    r = conv.rollup(role_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("messages"),
        F.sum(F.length(text_col)).cast("bigint").alias("characters"),
        F.countDistinct(conv_col).cast("bigint").alias("conversations"))
    return r.withColumn("avg_turns", F.col("messages") / F.greatest(F.col("conversations"), F.lit(1)))


def memory_window(conv: DataFrame, max_tokens: int, conv_col: str = "conv_id", turn_col: str = "turn",
                  text_col: str = "text") -> DataFrame:
    """Messages retained by the sliding context after the last append.

    Closed form of "after each append, drop the oldest while the total exceeds
    max_tokens and more than one message remains": keep a message iff the sum
    of estimated tokens from it to the end is <= max_tokens, or it is the last.
    Suffix sums come from a block-wise running sum and a per-conversation total.
    """
    base = conv.withColumn("_tok", token_estimate(text_col).cast("bigint"))
    pref = running_sum(base, [conv_col, turn_col], "_tok", "_pre", inclusive=False, partition_cols=[conv_col])
    tot = base.groupBy(conv_col).agg(F.sum("_tok").alias("_tot"), F.max(turn_col).alias("_last"))
    j = pref.join(tot, conv_col)
    suffix = F.col("_tot") - F.col("_pre")
    return (j.filter((suffix <= max_tokens) | (F.col(turn_col) == F.col("_last")))
            .withColumn("window_tokens", suffix).drop("_tok", "_pre", "_tot", "_last"))


def prompt_from_memory(system_prompt: DataFrame | None, messages: DataFrame, conv_col: str = "conv_id",
                       turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """System block + user/assistant/tool turns (others omitted) + open assistant marker."""
    piece = (F.when(F.col(role_col) == "user", F.concat(F.lit("<|user|>\n"), text_col, F.lit("\n")))
             .when(F.col(role_col) == "assistant", F.concat(F.lit("<|assistant|>\n"), text_col, F.lit("\n")))
             .when(F.col(role_col) == "tool", F.concat(F.lit("<|tool|>\n"), text_col, F.lit("\n")))
             .otherwise(F.lit("")))
    j = _ordered_join(messages, conv_col, turn_col, piece)
    if system_prompt is not None:
        j = j.join(system_prompt, conv_col, "full")  # a conversation may have a system prompt alone
        sys = F.when(F.coalesce(F.col("system_prompt"), F.lit("")) != "",
                     F.concat(F.lit("<|system|>\n"), F.col("system_prompt"), F.lit("\n"))).otherwise(F.lit(""))
    else:
        sys = F.lit("")
    return j.select(conv_col, F.concat(sys, F.coalesce("_joined", F.lit("")), F.lit("<|assistant|>\n")).alias("prompt"))


def prompt_from_request(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every role rendered as ``<|role|>`` + open assistant marker."""
    piece = F.concat(F.lit("<|"), F.col(role_col), F.lit("|>\n"), F.col(text_col), F.lit("\n"))
    j = _ordered_join(messages, conv_col, turn_col, piece)
    return j.select(conv_col, F.concat("_joined", F.lit("<|assistant|>\n")).alias("prompt"))


# ------------------------------------------------------------------ tools

def _tool_rx():
    return python_regex_to_portable(TOOL_JSON_PATTERN), "(?s)" + python_regex_to_portable(TOOL_XML_PATTERN)


def parse_tool_calls(df: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """All tool calls in a text: JSON-style (arguments must be valid JSON,
    else skipped) then XML-style (invalid JSON kept as raw).  One row per call:
    keys, call_index, call_id, name, arguments (text), args_is_json, style."""
    jrx, xrx = _tool_rx()
    t = F.col(text_col)
    js = F.arrays_zip(F.regexp_extract_all(t, F.lit(jrx), 1).alias("name"),
                      F.regexp_extract_all(t, F.lit(jrx), 2).alias("args"))
    js = F.filter(js, lambda c: strict_json(c["args"]).isNotNull())
    js = F.transform(js, lambda c: F.struct(c["name"].alias("name"), c["args"].alias("arguments"),
                                            F.lit(True).alias("args_is_json"), F.lit("json").alias("style")))
    xs = F.arrays_zip(F.regexp_extract_all(t, F.lit(xrx), 1).alias("name"),
                      F.regexp_extract_all(t, F.lit(xrx), 2).alias("args"))
    xs = F.transform(xs, lambda c: F.struct(py_strip(c["name"]).alias("name"), py_strip(c["args"]).alias("arguments"),
                                            strict_json(py_strip(c["args"])).isNotNull().alias("args_is_json"),
                                            F.lit("xml").alias("style")))
    calls = F.concat(js, xs)
    out = df.select(*key_cols, F.posexplode_outer(calls).alias("call_index", "c")).filter(F.col("call_index").isNotNull())
    call_id = F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols],
                                            F.col("call_index").cast("string"))), 1, 12)
    return out.select(*key_cols, F.col("call_index").cast("bigint").alias("call_index"), call_id.alias("call_id"),
                      "c.name", "c.arguments", "c.args_is_json", "c.style")


def has_tool_calls(text) -> Column:
    jrx, xrx = _tool_rx()
    return col_(text).rlike(jrx) | col_(text).rlike(xrx)


def tool_dispatch(calls: DataFrame, registry: DataFrame, name_col: str = "name") -> DataFrame:
    """Left join calls to registered tools; unknown tools become error rows.
    The registry is a small dimension (broadcast)."""
    r = registry.select(F.col("name").alias("_tool"), "category")
    j = calls.join(F.broadcast(r), calls[name_col] == F.col("_tool"), "left")
    found = F.col("_tool").isNotNull()
    return j.withColumn("dispatched", found).withColumn(
        "result", F.when(found, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Error: Tool not found: "), F.col(name_col)))
    ).drop("_tool")


def tool_result_link(results: DataFrame, calls: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Link tool results to their calls through tool_call_id inside a conversation."""
    return results.join(calls.withColumnRenamed("call_id", "tool_call_id"), [conv_col, "tool_call_id"], "left")


def tool_schema(params: DataFrame, tool_col: str = "tool", desc_col: str = "description") -> DataFrame:
    """Tool/parameter rows -> JSON schema and prompt line (required params only).

    ``params`` rows: tool, description, param, type, param_description, required,
    position (declaration order).
    """
    g = params.groupBy(tool_col, desc_col).agg(
        F.array_sort(F.collect_list(F.struct("position", "param", "type", "param_description", "required"))).alias("_p"))
    props = F.map_from_entries(F.transform("_p", lambda p: F.struct(p["param"], F.struct(
        p["type"].alias("type"), p["param_description"].alias("description")))))
    required = F.transform(F.filter("_p", lambda p: p["required"]), lambda p: p["param"])
    schema = F.to_json(F.struct(F.lit("function").alias("type"), F.struct(
        F.col(tool_col).alias("name"), F.col(desc_col).alias("description"),
        F.struct(F.lit("object").alias("type"), props.alias("properties"), required.alias("required")).alias("parameters")
    ).alias("function")))
    prompt = F.concat(F.lit("- "), F.col(tool_col), F.lit("("),
                      F.array_join(F.transform(F.filter("_p", lambda p: p["required"]),
                                               lambda p: F.concat(p["param"], F.lit(": "), p["type"])), ", "),
                      F.lit("): "), F.col(desc_col))
    return g.select(tool_col, schema.alias("json_schema"), prompt.alias("prompt_line"))


# Python annotation -> JSON schema type (missing -> string).
PY_TYPE_NAMES = {str: "string", int: "integer", float: "number", bool: "boolean"}
SPARK_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def register_function(spark, func, description: str = ""):
    """Register a Python function as a SQL function and return its parameter rows.

    Same signature rule as the tool registry: annotation str/int/float/bool ->
    string/integer/number/boolean, anything else or missing -> string; no
    default -> required.
    """
    sig = inspect.signature(func)
    params = [p for p in sig.parameters.values() if p.name not in ("self", "cls")]
    about = description or func.__doc__ or ""
    rows = [(func.__name__, about, p.name, PY_TYPE_NAMES.get(p.annotation, "string"), f"Parameter {p.name}", p.default is p.empty, i)
            for i, p in enumerate(params)]
    rtype = SPARK_TYPES[PY_TYPE_NAMES.get(sig.return_annotation, "string")]
    known = set(PY_TYPE_NAMES)
    arg_conv = [p.annotation if p.annotation in known else None for p in params]
    out_conv = sig.return_annotation if sig.return_annotation in known else str

    def call(*args):
        # SQL literals arrive as Decimal/str/etc.; coerce by the annotations, as a JSON-schema caller would
        conv = [c(a) if (c is not None and a is not None) else a for c, a in zip(arg_conv, args)]
        res = func(*conv)
        return None if res is None else out_conv(res)
    spark.udf.register(func.__name__, call, rtype)
    return spark.createDataFrame(rows, "tool string, description string, param string, type string, "
                                       "param_description string, required boolean, position int")


# ------------------------------------------------------------------ agents

def plan_steps(df: DataFrame, key_cols: list[str], text_col: str, task_col: str) -> DataFrame:
    """Numbered lines ``N. step`` become steps; none -> the task itself."""
    # (?d): only \n ends a line, as in Python's re.MULTILINE
    rx = "(?md)" + python_regex_to_portable(PLAN_LINE_PATTERN)
    steps = F.regexp_extract_all(F.col(text_col), F.lit(rx), 1)
    steps = F.when(F.size(steps) == 0, F.array(F.col(task_col))).otherwise(steps)
    return df.select(*key_cols, F.posexplode_outer(steps).alias("step_no", "step")).filter(F.col("step_no").isNotNull())


def agent_trace_summary(steps: DataFrame, trace_col: str, order_col: str, action_col: str,
                        obs_col: str, success_col: str, retry_col: str, total_col: str,
                        obs_chars: int | None = None) -> DataFrame:
    """Per trace: steps, retries, success share, progress = done/total (1 if no
    planned steps), summary lines ``Step i: action -> observation``; ``obs_chars``
    shows so many characters of each observation only."""
    seen = F.col(obs_col) if obs_chars is None else F.substring(F.col(obs_col), 1, obs_chars)
    line = F.concat(F.col(action_col), F.lit(" -> "), seen)
    g = steps.groupBy(trace_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("steps"),
        F.sum(F.col(retry_col).cast("int")).cast("bigint").alias("retries"),
        F.avg(F.col(success_col).cast("double")).alias("success_share"),
        F.max(total_col).alias("_total"),
        F.sum((~F.col(retry_col)).cast("int")).alias("_done"),
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), line.alias("l")))).alias("_x"))
    summary = F.array_join(F.transform(F.sequence(F.lit(1), F.size("_x")),
                                       lambda i: F.concat(F.lit("Step "), i.cast("string"), F.lit(": "),
                                                          F.element_at("_x", i)["l"])), "\n")
    prog = F.when(F.coalesce(F.col("_total"), F.lit(0)) == 0, F.lit(1.0)).otherwise(
        F.least(F.col("_done"), F.col("_total")) / F.col("_total"))
    return g.select(trace_col, "steps", "retries", "success_share", prog.alias("progress"),
                    summary.alias("summary"))


def conversation_json(conv: DataFrame, system_prompt: DataFrame | None, max_tokens: int,
                      conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """Serialise {system_prompt, max_tokens, messages} per conversation.  A message has role and
    content and, where ``conv`` has columns of these names and they are set, tool_calls (JSON
    text), tool_call_id and name.  A conversation may have a system prompt alone."""
    only_set = {"ignoreNullFields": "true"}
    said = F.to_json(F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("content")), only_set)
    calls = F.lit("")
    if "tool_calls" in conv.columns:  # JSON text goes in as it is
        calls = F.when(strict_json("tool_calls").isNotNull(), F.concat(F.lit(',"tool_calls":'), "tool_calls")).otherwise("")
    more = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("tool_call_id", "name") if c in conv.columns]
    rest = F.regexp_replace(F.to_json(F.struct(*more), only_set), r"^\{(.)", r",$1") if more else F.lit("}")
    message = F.concat(F.regexp_replace(said, r"\}$", ""), calls, F.when(rest == ",}", "}").otherwise(rest))
    g = conv.select(conv_col, F.struct(F.col(turn_col).alias("o"), message.alias("m")).alias("_x"))
    g = g.groupBy(conv_col).agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    g = g.select(conv_col, F.array_join(F.transform("_x", lambda x: x["m"]), ",").alias("_messages"))
    if system_prompt is not None:
        g = g.join(system_prompt, conv_col, "full")
    else:
        g = g.withColumn("system_prompt", F.lit(None).cast("string"))
    # top-level keys are always present (system_prompt may be null)
    head = F.to_json(F.struct("system_prompt", F.lit(max_tokens).alias("max_tokens")), {"ignoreNullFields": "false"})
    return g.select(conv_col, F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"messages":['), F.coalesce("_messages", F.lit("")), F.lit("]}")).alias("json"))


MEMORY_SCHEMA = "struct<system_prompt:string,max_tokens:int,messages:array<struct<role:string,content:string,tool_calls:string,tool_call_id:string,name:string>>>"


def conversation_from_json(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Restore messages (role default user, content default ''; tool_calls as JSON text) without trimming."""
    p = df.select("*", F.from_json(F.col(json_col), MEMORY_SCHEMA).alias("_m"))
    e = p.select("*", F.posexplode(F.coalesce(F.col("_m.messages"), F.array())).alias("turn", "_msg"))
    return e.select(*[c for c in df.columns if c != json_col], F.col("_m.system_prompt").alias("system_prompt"),
                    F.coalesce(F.col("_m.max_tokens"), F.lit(7000)).alias("max_tokens"), "turn",
                    F.coalesce(F.col("_msg.role"), F.lit("user")).alias("role"),
                    F.coalesce(F.col("_msg.content"), F.lit("")).alias("text"), "_msg.tool_calls", "_msg.tool_call_id", "_msg.name")

"""Readers: file inventory, raw text/JSON corpora, chat formats, preference
and benchmark files, token shards, search-provider JSON.

JSON is parsed once into VARIANT and projected with explicit types; schema
inference is never run on user JSON.  "The first field that is a string"
rules are ``CASE`` chains over ``schema_of_variant``.  File listings never
read file content (``binaryFile`` with ``content`` pruned).
"""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import col_, is_blank, valid_text
from quarry.sources.jsonfiles import elements, strict_json

# Extensions and field priority lists of the reference readers.
TEXT_EXTENSIONS = [".txt", ".jsonl", ".json", ".md", ".csv", ".tsv", ".rst"]
TOKEN_EXTENSIONS = [".bin", ".npy"]
JSONL_TEXT_FIELDS = ["text", "content", "body", "input", "prompt", "message"]
JSON_ARRAY_TEXT_FIELDS = ["text", "content", "body", "input"]
JSON_OBJECT_TEXT_FIELDS = ["text", "content", "body"]
SAMPLE_TEXT_FIELDS = ["text", "content", "body", "input", "prompt", "message"]


# ------------------------------------------------------------------ variant helpers

def vget(v, path: str) -> Column:
    """Sub-variant at a JSON path (NULL when missing)."""
    return F.try_variant_get(col_(v), path, "variant")


def vtype(v) -> Column:
    return F.schema_of_variant(col_(v))


def vstring(v, path: str) -> Column:
    """The value at ``path`` only if it is a JSON string (numbers are not text)."""
    sub = vget(v, path)
    return F.when(vtype(sub) == "STRING", F.variant_get(sub, "$", "string"))


def first_string(v, fields: list[str]) -> Column:
    return F.coalesce(*[vstring(v, f"$.{f}") for f in fields])


def _ext(path_col: Column) -> Column:
    return F.regexp_extract(path_col, r"(\.[^./]*)$", 1)


# ------------------------------------------------------------------ listings

#: Conf: tasks that list folders, at most; otherwise each of up to 10,000 folders is a task of its own.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def shared_listing(spark: SparkSession):
    """Folders read in this block share listing tasks, four for each core: starting a task takes
    longer than listing a folder."""
    before, cores = spark.conf.get(LISTING_TASKS), spark.sparkContext.defaultParallelism
    spark.conf.set(LISTING_TASKS, min(int(before), 4 * cores))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def list_files(spark: SparkSession, base: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, name, ext, length, modificationTime) without reading content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    try:
        with shared_listing(spark):
            df = r.load(base)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # a missing directory has no files
        return spark.createDataFrame([], "path string, name string, ext string, length long, modificationTime timestamp")
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                     _ext(F.col("path")).alias("ext"), "length", "modificationTime")


def file_inventory(spark: SparkSession, base_dir: str) -> DataFrame:
    """One row: token files directly in tokens/ (case-sensitive .bin/.npy),
    text files anywhere under raw/ (lower-cased extension), loose text files
    in the root only when raw/ has none, and the status
    (empty / raw / pretokenized / mixed).  The file lists themselves stay
    DataFrames (``list_files``), never arrays in one row."""
    base = base_dir.rstrip("/")
    toks = list_files(spark, f"{base}/tokens", recursive=False).filter(F.col("ext").isin(TOKEN_EXTENSIONS))
    raw = list_files(spark, f"{base}/raw", recursive=True).filter(F.lower("ext").isin(TEXT_EXTENSIONS))
    loose = list_files(spark, base, recursive=False).filter(F.lower("ext").isin(TEXT_EXTENSIONS))
    t = toks.agg(F.count(F.lit(1)).alias("n_tok"))
    r = raw.agg(F.count(F.lit(1)).alias("n_raw"))
    lo = loose.agg(F.count(F.lit(1)).alias("n_loose"))
    from quarry.plans.layout import attach_row
    j = attach_row(attach_row(t, r), lo)
    has_tok = F.col("n_tok") > 0
    use_loose = (F.col("n_raw") == 0) & (F.col("n_loose") > 0)
    has_raw = (F.col("n_raw") > 0) | use_loose
    return j.select(
        has_tok.alias("has_pretokenized"), F.when(has_tok, F.lit(f"{base}/tokens")).alias("pretokenized_dir"),
        F.col("n_tok").alias("total_pretokenized_files"), has_raw.alias("has_raw_text"),
        F.when(F.col("n_raw") > 0, F.lit(f"{base}/raw")).when(use_loose, F.lit(base)).alias("raw_text_dir"),
        F.when(F.col("n_raw") > 0, F.col("n_raw")).when(use_loose, F.col("n_loose")).otherwise(F.lit(0)).alias("total_raw_files"),
        F.when(has_tok & has_raw, "mixed").when(has_tok, "pretokenized").when(has_raw, "raw").otherwise("empty").alias("status"))


def choose_data_path(inventory: DataFrame, prefer_pretokenized: bool = True) -> Column:
    """Pretokenized if preferred and present, else raw, else pretokenized, else NULL."""
    pre = F.col("has_pretokenized") & F.lit(prefer_pretokenized)
    return (F.when(F.col("status") == "empty", F.lit(None).cast("string"))
            .when(pre, F.col("pretokenized_dir"))
            .when(F.col("has_raw_text"), F.col("raw_text_dir"))
            .when(F.col("has_pretokenized"), F.col("pretokenized_dir")))


def glob_search(spark: SparkSession, directory: str, pattern: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Recursive glob: the first ``limit`` paths in sorted order and the total count."""
    files = list_files(spark, directory, recursive=True, glob=pattern)
    return files.select("path").orderBy("path").limit(limit), files.agg(F.count(F.lit(1)).alias("matches"))


# ------------------------------------------------------------------ text corpora

def _jsonl_records(lines: DataFrame) -> DataFrame:
    """(path, line) -> (path, text): first string text field, then the joined
    ``conversations`` values as a second record; malformed lines skipped."""
    from quarry.functions.text import py_strip
    s = lines.select("path", py_strip("value").alias("line")).filter(F.col("line") != "")
    v = s.select("path", strict_json("line").alias("v")).filter(F.col("v").isNotNull())
    first = first_string("v", JSONL_TEXT_FIELDS)
    conv = F.try_variant_get(F.col("v"), "$.conversations", "array<variant>")
    parts = F.filter(F.transform(conv, lambda m: F.when(vtype(m) == "STRING", F.variant_get(m, "$", "string"))
                                 .otherwise(F.try_variant_get(m, "$.value", "string"))), lambda x: x.isNotNull())
    joined = F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
    recs = v.select("path", F.filter(F.array(first, joined), lambda x: x.isNotNull()).alias("_r"))
    return recs.select("path", F.explode_outer("_r").alias("text")).filter(F.col("text").isNotNull())


def read_jsonl_text(spark: SparkSession, paths, **options) -> DataFrame:
    lines = spark.read.options(**options).text(paths).select(F.col("_metadata.file_path").alias("path"), valid_text("value").alias("value"))
    return _jsonl_records(lines)


def read_json_text(spark: SparkSession, paths, **options) -> DataFrame:
    """JSON files: array -> each string item or first string of text/content/body/input;
    object -> first of text/content/body.  An array is read by many tasks (``jsonfiles``);
    a file that is not one JSON value gives nothing."""
    v = elements(spark, paths, **options).select("path", "is_array", strict_json("text").alias("v"))
    item = F.when(vtype("v") == "STRING", F.variant_get("v", "$", "string")).otherwise(first_string("v", JSON_ARRAY_TEXT_FIELDS))
    text = F.when(F.col("is_array"), item).otherwise(first_string("v", JSON_OBJECT_TEXT_FIELDS))
    return v.select("path", text.alias("text")).filter(F.col("text").isNotNull())


def read_plain_text(spark: SparkSession, paths, **options) -> DataFrame:
    """One record per file: bad bytes replaced, line ends as ``\\n``, blank files left out."""
    whole = spark.read.options(**options).text(paths, wholetext=True)
    some = whole.select(F.col("_metadata.file_path").alias("path"), valid_text("value").alias("value")).filter(~is_blank("value"))
    return some.select("path", F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def _any_case(extensions) -> str:
    """Glob of files with one of the extensions, in either case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in extensions) + "}"


def qualified(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it names it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(hadoop)


def in_folder(path_col: Column, folder: str) -> Column:
    """Whether a file lies directly in a folder (a qualified name)."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^(\\w+):/+", "$1:/"), "/+$", "")
    return plain(F.regexp_extract(path_col, "^(.*/)[^/]+$", 1)) == plain(F.lit(folder))


def read_text_corpus(spark: SparkSession, input_dir: str | None = None, files: list[str] | None = None,
                     recursive: bool = True) -> DataFrame:
    """(path, text): folder scans keep supported extensions, explicit files are taken as given
    if they are there; .jsonl/.json parsed, everything else (CSV included) is one record
    per file, dropped when blank; bad bytes replaced.

    A folder is scanned by one read for each kind of file, so that its listing stays Spark's own."""
    kinds = {".jsonl": read_jsonl_text, ".json": read_json_text, "": read_plain_text}
    parts = []
    if input_dir:
        fs, folder = qualified(spark, input_dir)
        if fs.exists(folder) and fs.getFileStatus(folder).isDirectory():
            for kind, read in kinds.items():
                own = [kind] if kind else [e for e in TEXT_EXTENSIONS if e not in kinds]
                with shared_listing(spark):
                    found = read(spark, input_dir, recursiveFileLookup=True, pathGlobFilter=_any_case(own))
                parts.append(found if recursive else found.filter(in_folder(F.col("path"), folder.toString())))
    there = [f for f in files or [] for fs, p in [qualified(spark, f)] if fs.exists(p) and fs.getFileStatus(p).isFile()]
    for kind, read in kinds.items():
        own = [f for f in there if (os.path.splitext(f)[1].lower() if os.path.splitext(f)[1].lower() in kinds else "") == kind]
        if own:
            parts.append(read(spark, own))
    out = spark.createDataFrame([], "path string, text string")
    for p in parts:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ raw samples

def flatten_sample(v, text_field: str = "text") -> Column:
    """Raw dataset sample (VARIANT) -> training text, in the reference order:
    instruction+response (instruction may be JSON {"messages": [...]}) ->
    conversations (role|from, content|value) -> messages -> configured field ->
    common fields.  Blank results become NULL (dropped by the caller)."""
    instr = vget(v, "$.instruction")
    resp = vget(v, "$.response")
    has_ir = instr.isNotNull() & resp.isNotNull()
    instr_s = F.variant_get(instr, "$", "string")
    resp_s = F.variant_get(resp, "$", "string")
    inner = strict_json(instr_s)
    msgs = F.try_variant_get(inner, "$.messages", "array<variant>")

    def role_lines(arr, role_paths, content_paths):
        def one(m):
            role = F.coalesce(*[F.try_variant_get(m, p, "string") for p in role_paths], F.lit(""))
            content = F.coalesce(*[F.try_variant_get(m, p, "string") for p in content_paths], F.lit(""))
            return F.when(vtype(m).startswith("OBJECT") & (content != ""), F.concat(role, F.lit(": "), content))
        return F.filter(F.transform(arr, one), lambda x: x.isNotNull())

    inner_lines = role_lines(msgs, ["$.role"], ["$.content"])
    ir_text = F.when(msgs.isNotNull() & vtype(inner).startswith("OBJECT"),
                     F.array_join(F.concat(inner_lines, F.array(F.concat(F.lit("assistant: "), resp_s))), "\n"))
    ir_text = F.when(has_ir, F.coalesce(F.when(ir_text != "", ir_text), F.concat(instr_s, F.lit("\n"), resp_s)))
    conv = F.try_variant_get(col_(v), "$.conversations", "array<variant>")
    conv_lines = role_lines(conv, ["$.role", "$.from"], ["$.content", "$.value"])
    conv_text = F.when(F.size(conv_lines) > 0, F.array_join(conv_lines, "\n"))
    mess = F.try_variant_get(col_(v), "$.messages", "array<variant>")
    mess_lines = role_lines(mess, ["$.role"], ["$.content"])
    mess_text = F.when(F.size(mess_lines) > 0, F.array_join(mess_lines, "\n"))
    text = F.coalesce(F.when(ir_text != "", ir_text), conv_text, mess_text, vstring(v, f"$.{text_field}"),
                      first_string(v, SAMPLE_TEXT_FIELDS))
    return F.when(~is_blank(text), text)


def limit_samples(samples: DataFrame, order_cols: list[str], n: int | None, before_filter: bool,
                  text_col: str = "text") -> DataFrame:
    """``max_samples`` cap: after dropping empty samples (streaming mode) or on
    the raw rows before dropping (slice mode).  A TakeOrdered, n rows per task."""
    if not n:
        return samples.filter(F.col(text_col).isNotNull())
    if before_filter:
        return samples.orderBy(*order_cols).limit(n).filter(F.col(text_col).isNotNull())
    return samples.filter(F.col(text_col).isNotNull()).orderBy(*order_cols).limit(n)


# ------------------------------------------------------------------ chat formats

OPENAI_SCHEMA = "messages array<struct<role:string, content:string, tool_calls:string, tool_call_id:string, name:string>>"
# Speakers of the format and their roles.
SHAREGPT_ROLES = {"human": "user", "gpt": "assistant", "system": "system",
                  "observation": "tool", "function_call": "assistant"}


def _line_key() -> Column:
    """Key of a line of a text scan: equal lines of one file have different ones."""
    return F.md5(F.concat_ws(":", F.col("_metadata.file_path"), F.monotonically_increasing_id().cast("string")))


def _json_records(spark: SparkSession, paths) -> DataFrame:
    """(conv_key, v): the records of JSONL files (by line, so that files are split) and of JSON
    files (an array, an object, or lines); records that are not JSON are left out."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(paths)
    lines = lines.select(_line_key().alias("conv_key"), strict_json("value").alias("v"))
    other = ",".join([f"*[!{c}]{'jsonl'[i:]}" for i, c in enumerate(".jsonl")] + ["jsonl"[i:] for i in range(5)])
    whole = spark.read.option("pathGlobFilter", "{" + other + "}").text(paths, wholetext=True)
    whole = whole.select(F.col("_metadata.file_path").alias("path"), "value", strict_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get(F.col("v"), "$", "array<variant>"), F.when(F.col("v").isNotNull(), F.array("v")),
                       F.transform(F.split("value", "\n"), strict_json))
    whole = whole.select("path", F.posexplode(items).alias("item_no", "v"))
    whole = whole.select(F.md5(F.concat_ws(":", "path", F.col("item_no").cast("string"))).alias("conv_key"), "v")
    return lines.unionByName(whole).filter(F.col("v").isNotNull())


def read_openai_chat(spark: SparkSession, paths) -> DataFrame:
    """JSONL {"messages": [...], "metadata": {...}} -> long form
    (conv_key, turn, role, content, tool_calls, tool_call_id, name); role defaults to
    user, content to ''; tool calls are JSON text as it stands; lines that are not JSON
    and conversations without messages are left out."""
    lines = spark.read.text(paths).select(_line_key().alias("conv_key"), F.btrim(valid_text("value")).alias("line"))
    p = lines.filter(strict_json("line").isNotNull()).select("conv_key", F.from_json("line", OPENAI_SCHEMA).alias("o"))
    e = p.select("conv_key", F.posexplode(F.col("o.messages")).alias("turn", "m"))
    return e.select("conv_key", "turn", F.coalesce("m.role", F.lit("user")).alias("role"),
                    F.coalesce("m.content", F.lit("")).alias("content"), "m.tool_calls", "m.tool_call_id", "m.name")


def sharegpt_role(speaker) -> Column:
    m = F.create_map(*[x for k, v in SHAREGPT_ROLES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.coalesce(col_(speaker), F.lit("user"))), F.lit("user"))


def read_sharegpt_chat(spark: SparkSession, paths) -> DataFrame:
    """JSON array / object / JSONL of {"conversations": [{from, value}]}."""
    turns = _json_records(spark, paths).select("conv_key", F.posexplode(F.try_variant_get(F.col("v"), "$.conversations", "array<variant>")).alias("turn", "t"))
    return turns.select("conv_key", "turn", sharegpt_role(F.try_variant_get(F.col("t"), "$.from", "string")).alias("role"),
                        F.coalesce(F.try_variant_get(F.col("t"), "$.value", "string"), F.lit("")).alias("content"))


def alpaca_turns(instruction, inp, output) -> Column:
    """instruction (+ blank line + input) -> user turn; output -> assistant; empty parts omitted."""
    ins, i2, out = col_(instruction), col_(inp), col_(output)
    user = F.when(F.coalesce(ins, F.lit("")) != "",
                  F.when(F.coalesce(i2, F.lit("")) != "", F.concat(ins, F.lit("\n\n"), i2)).otherwise(ins))
    asst = F.when(F.coalesce(out, F.lit("")) != "", out)
    return F.filter(F.array(F.struct(F.lit("user").alias("role"), user.alias("content")),
                            F.struct(F.lit("assistant").alias("role"), asst.alias("content"))),
                    lambda t: t["content"].isNotNull())


def read_alpaca(spark: SparkSession, paths) -> DataFrame:
    """JSON array / object / JSONL of {"instruction", "input", "output"}; equal records stay apart."""
    fields = [F.try_variant_get(F.col("v"), f"$.{c}", "string").alias(c) for c in ("instruction", "input", "output")]
    recs = _json_records(spark, paths).select("conv_key", *fields)
    e = recs.select("conv_key", F.posexplode(alpaca_turns("instruction", "input", "output")).alias("turn", "t"))
    return e.select("conv_key", "turn", "t.role", "t.content")


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """JSONL prompt/chosen/rejected (missing -> ''); lines that are not JSON objects are left
    out; no sample at all is an error."""
    fields = "prompt string, chosen string, rejected string, _bad string"
    lines = spark.read.text(path).filter(F.btrim("value") != "")
    rows = lines.select(F.from_json("value", fields, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    df = rows.filter(F.col("_bad").isNull()).drop("_bad").na.fill("")
    if df.limit(1).count() == 0:
        raise ValueError(f"No preference samples found in {path}")
    return df


def read_benchmark_items(spark: SparkSession, directory: str, subjects: list[str] | None = None) -> DataFrame:
    """Multiple-choice items from *.jsonl; subject = file stem.  A subject
    filter prunes files before any byte is read (glob per subject)."""
    schema = "question string, choices array<string>, answer string, choice_A string, choice_B string, choice_C string, choice_D string"
    paths = [f"{directory.rstrip('/')}/{s}.jsonl" for s in subjects] if subjects else [f"{directory.rstrip('/')}/*.jsonl"]
    df = spark.read.schema(schema).json(paths)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    choices = F.coalesce(F.col("choices"), F.filter(F.array("choice_A", "choice_B", "choice_C", "choice_D"), lambda x: x.isNotNull()))
    letter = F.when(F.col("answer").rlike("^[0-3]$"), F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), F.col("answer").cast("int") + 1)) \
        .otherwise(F.col("answer"))
    return df.select("question", stem.alias("subject"), choices.alias("choices"), letter.alias("answer"))


# ------------------------------------------------------------------ token shards

def read_token_shards(spark: SparkSession, directory: str, dtype: str = "uint32", block_tokens: int = 1 << 20) -> DataFrame:
    """.bin (flat ``dtype``) and .npy shards in name order -> rows
    (path, shard_no, block, start, tokens) of at most ``block_tokens`` ids; ranges of
    bytes of a shard are read by tasks of their own.  No shard at all is an error."""
    from quarry.sources.shards import registered
    return (spark.read.format(registered(spark)).option("dtype", dtype).option("block_tokens", block_tokens).load(directory))


# ------------------------------------------------------------------ search provider JSON

def parse_search_json(df: DataFrame, json_col: str, max_results: int) -> DataFrame:
    """Provider JSON -> ranked results: ``organic_results[].{title, link,
    snippet}`` or ``web.results[].{title, url, description}``; missing fields
    ''; capped at max_results; score 1 / (i + 1)."""
    v = F.try_parse_json(F.col(json_col))
    org = F.try_variant_get(v, "$.organic_results", "array<variant>")
    web = F.try_variant_get(v, "$.web.results", "array<variant>")

    def norm(arr, url_key, snip_key):
        return F.transform(arr, lambda it: F.struct(
            F.coalesce(F.try_variant_get(it, "$.title", "string"), F.lit("")).alias("title"),
            F.coalesce(F.try_variant_get(it, f"$.{url_key}", "string"), F.lit("")).alias("url"),
            F.coalesce(F.try_variant_get(it, f"$.{snip_key}", "string"), F.lit("")).alias("snippet")))
    items = F.coalesce(norm(org, "link", "snippet"), norm(web, "url", "description"), F.array())
    items = F.slice(items, 1, max_results)
    keep = [c for c in df.columns if c != json_col]
    e = df.select(*keep, F.posexplode_outer(items).alias("position0", "r")).filter(F.col("position0").isNotNull())
    return e.select(*keep, (F.col("position0") + 1).alias("position"), "r.title", "r.url", "r.snippet",
                    (F.lit(1.0) / (F.col("position0") + 1)).alias("score"))


def discover_sources(spark: SparkSession, base_dir: str, weight: float = 1.0) -> DataFrame:
    """Every sub-directory holding .bin shards becomes a mix source (name = the
    folder name), sorted by name, with a default weight and its shard count."""
    files = list_files(spark, base_dir, recursive=True).filter(F.col("ext") == ".bin")
    d = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"))
    d = d.filter(in_folder(F.col("dir"), qualified(spark, base_dir)[1].toString()))
    return (d.groupBy("dir").agg(F.count(F.lit(1)).alias("shards"))
            .select(F.regexp_extract("dir", r"([^/]+)$", 1).alias("name"), "dir", F.lit(weight).alias("weight"), "shards")
            .orderBy("name"))


def union_sources(spark: SparkSession, sources: list[tuple[str, str]], cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Load several named JSONL text sources with a per-source cap.  A source
    that cannot be read yields an error row in the status table; the others
    continue.  Returns (records(source, path, text), status(source, ok, error))."""
    parts, status = [], []
    for name, path in sources:
        try:
            df = read_jsonl_text(spark, path)
            df.schema  # resolves the path now
            if cap:
                df = df.orderBy("path", "text").limit(cap)
            parts.append(df.select(F.lit(name).alias("source"), "path", "text"))
            status.append((name, True, None))
        except Exception as e:  # noqa: BLE001 - a failing source is reported, not fatal
            status.append((name, False, str(e).splitlines()[0]))
    empty = spark.createDataFrame([], "source string, path string, text string")
    out = empty
    for p in parts:
        out = out.unionByName(p)
    return out, spark.createDataFrame(status, "source string, ok boolean, error string")

"""Secret scans with a ledger of blobs: a text is scanned once for each rule version.

A blob is a text by its SHA-256, whatever documents or versions hold it.  The
ledger is a table with one row per scanned blob and batch: which rule versions it
was scanned for, and its matches as (gap before, length).  A scan takes the blobs
and rule versions that the ledger lacks, appends one batch, and joins findings
back to all documents.  Everything is DataFrame and SQL functions.

Defined results: null text is empty and has no findings; repeated rows share a
blob and each get its findings; an empty table gives an empty table; other columns
are not looked at.  A batch that fails leaves no rows, as its files are committed
together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """kind; version; pattern; a match counts if its group ``part`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    part: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values.  A run of enough characters is found as one match, as the run without a
#: limit would be; for assignments a short value also uses up its text, so it is dropped after.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", 1, r"[Bb]earer [A-Za-z0-9._~+/=-]{20,}"),
)
BASE = 3

#: A private key from its BEGIN line through its END line.  If the next line of dashes is no
#: END line, through the header and base64 lines after it, long runs of base64 that follow
#: blanks, and runs after escaped line ends.  No step of it goes back (possessive), so a
#: header without an end costs one look at what follows it.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:[\x20\t]*+[\r\n])++[\x20\t]*+(?:(?:Proc-Type|DEK-Info):[^\r\n]*+|[A-Za-z0-9+/]++={0,2}+(?=[\x20\t]*+(?:[\r\n]|\z)))"
    r"|(?:\\[nr])++[A-Za-z0-9+/]++={0,2}+|\s*+[A-Za-z0-9+/]{16,}+={0,2}+)*+)"
)
#: The rules whose findings are cut out of texts.  pem@1 marks where a key begins, as the SQL of
#: op6_secret_scans does; pem@2 covers all of it.
REDACTED = (*RULES[:3], Rule("pem", 2, PRIVATE_KEY), *RULES[4:])
LEDGER = "blob string, batch string, rules array<string>, matches array<struct<kind:string,gap:int,size:int,keep:boolean>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def matches(text: Column, rule: Rule) -> Column:
    """Matches of a rule in order, each with the code points since the one before."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part)) if rule.part else found
    both = F.zip_with(found, parts, lambda m, p: F.struct(F.length(m).alias("size"), (F.length(p) >= rule.least).alias("keep")))
    rows = F.zip_with(gaps, both, lambda g, m: F.struct(F.lit(rule.kind).alias("kind"), F.length(g).alias("gap"), m.size.alias("size"), m.keep.alias("keep")))
    return F.when(F.size(found) > 0, rows)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; without rows if there is none yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger at path lacks and append it; the ledger then."""
    spark = docs.sparkSession
    blobs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    seen = read_ledger(spark, path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    every = F.array(*(F.lit(r.name) for r in rules))
    todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    todo = todo.filter(F.size("rules") > 0)
    none = F.array().cast("array<struct<kind:string,gap:int,size:int,keep:boolean>>")
    found = [F.when(F.array_contains("rules", r.name), F.coalesce(matches(F.col("text"), r), none)).otherwise(none) for r in rules]
    batch = todo.select("blob", F.lit(uuid.uuid4().hex).alias("batch"), "rules", F.concat(*found).alias("matches"))
    batch.write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, nth (the kind's place among the rules), start, end of the findings of these rule versions."""
    of_kind = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("nth")))))
    rows = ledger.filter(F.size("matches") > 0).select("blob", "batch", "rules", F.posexplode("matches").alias("pos", "m"))
    rows = rows.withColumn("is", of_kind[F.col("m.kind")]).filter(F.array_contains("rules", F.col("is.rule")))
    before = Window.partitionBy("blob", "batch", "m.kind").orderBy("pos")
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(before)
    rows = rows.select("blob", F.col("m.kind").alias("kind"), F.col("is.nth").alias("nth"), (end - F.col("m.size")).alias("start"), end.alias("end"), F.col("m.keep").alias("keep"))
    return rows.filter("keep").drop("keep").distinct()  # two scans at once may both have had a blob


def spans_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its spans (start, nth, kind, end) in order."""
    found = findings(ledger, rules)
    return found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "nth", "kind", "end"))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def new_ledger(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex[:12]}"


def with_spans(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with their spans (an empty list where there are none); a column ``spans`` of theirs gives way."""
    by_blob = spans_by_blob(scan(docs, path, rules, text), rules).select(F.struct("blob", "spans").alias("found"))
    whole = docs.select(F.struct("*").alias("row"), blob_of(F.col(text)).alias("blob"))
    joined = whole.join(by_blob, F.col("blob") == F.col("found.blob"), "left")
    none = F.array().cast("array<struct<start:bigint,nth:int,kind:string,end:bigint>>")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "spans"]
    return joined.select(*kept, F.coalesce("found.spans", none).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """text with each stretch covered by spans replaced by the mark."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s, x):
        apart = F.concat(s.out, F.substring(text, (s.at + 1).cast("int"), (x.start - s.at).cast("int")), F.lit(mark))
        return F.struct(F.greatest(s.at, x.end).alias("at"), F.when(x.start >= s.at, apart).otherwise(s.out).alias("out"))

    whole = F.aggregate(spans, state, step, lambda s: F.concat(s.out, F.substring(text, (s.at + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)

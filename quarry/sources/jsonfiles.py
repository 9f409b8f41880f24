"""Large JSON files: their top-level elements, found by many tasks at once.

A file is read as fragments between commas, which Spark splits by byte range, and a range into
runs of fragments (blocks).
Whether a comma stands between two elements hangs on all that comes before: whether
a string is open there, and how many brackets are.  For a block both are functions
that compose: quotes change the first by their parity, and the brackets to count are
known for either state at its start.  So

1. each block gives its number of quotes and the brackets it opens, for both states,
2. a running sum over a file's blocks gives each block's true start,
3. from there each block counts the commas between elements, and a running sum
   numbers the elements over all blocks,
4. fragments of an element meet and are parsed.

No task reads more than some blocks or elements, whatever the size of the file: blocks are bounded,
and the partitions they are dealt to grow with the bytes.  A file is
one JSON value or it has no elements: what doesn't parse, or stands after the end,
rejects the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import col_, valid_text
from quarry.plans.layout import bounded_broadcast
from quarry.session import materialize

#: White space of JSON.
SPACE = " \t\n\r"
#: Rejected files whose names are sent to all tasks; more are joined.
REJECTED_BROADCAST = 100_000
#: Fragments of a block, at most; bytes of a partition, about, with so many for a row besides its text.
BLOCK_FRAGMENTS, PARTITION_BYTES, ROW_BYTES = 1 << 14, 64 << 20, 256
#: Blocks whose states are sent to all tasks; more are joined.
STATES_BROADCAST = 100_000
_KEY = ("path", "_blk")


def strict_json(text) -> Column:
    """VARIANT of a text that is one JSON value and nothing else; NULL otherwise.  (The parser
    stops after the first value.  Inside brackets what follows it is an error, unless the
    text closes them itself; it can't close those of an array and those of an object.)"""
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), col_(text), F.lit("]"))), "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"v":'), col_(text), F.lit("}")))
    return F.when((F.size(items) == 1) & member.isNotNull(), items[0])


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _opened(text: Column) -> Column:
    """Brackets opened less those closed, outside of strings."""
    outside = F.regexp_replace(text, r'"[^"]*+"?', "")
    return _count(outside, "[{") - _count(outside, "]}")


def fragments(spark: SparkSession, paths, **options) -> DataFrame:
    """path, _blk (where its byte range begins, and the block's number, rising), _id (rising in a range),
    value (what stands between two commas), _bytes, _code (its first character's code point, white space
    left out), _quotes, and the brackets opened if a string is closed (_out) or open (_in) at its start."""
    raw = spark.read.options(**options, lineSep=",").text(paths)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), valid_text("value").alias("value"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    raw = raw.withColumn("_bare", bare)
    block = F.struct("_at", F.expr(f"_id div {BLOCK_FRAGMENTS}").alias("no"))
    counted = raw.select("path", block.alias("_blk"), "_id", "value", F.octet_length("value").alias("_bytes"),
                         F.ascii(F.ltrim(F.col("value"), F.lit(SPACE))).alias("_code"), _count(F.col("_bare"), '"').alias("_quotes"), _opened(F.col("_bare")).alias("_out"),
                         _opened(F.concat(F.lit('"'), "_bare")).alias("_in"))
    return materialize(counted, "fragments")


def _partitions(rows: DataFrame) -> int:
    """Partitions of about PARTITION_BYTES for the fragments; the session's at least."""
    size = rows.agg(F.sum(F.col("_bytes").cast("long") + ROW_BYTES)).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def _in_block() -> Window:
    return Window.partitionBy(*_KEY).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _with_state(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows with _open (whether a string is open after the fragment), _depth (open brackets there) and
    _cut (whether the comma after it stands between two elements).  starts: by block, _odd and _level."""
    w = _in_block()
    starts = bounded_broadcast(starts, STATES_BROADCAST)
    known = rows.join(starts.withColumnRenamed("path", "_p").withColumnRenamed("_blk", "_b"), (F.col("path") == F.col("_p")) & (F.col("_blk") == F.col("_b"))).drop("_p", "_b")
    known = known.withColumn("_seen", F.col("_odd") + F.sum("_quotes").over(w))
    inside = (F.col("_seen") - F.col("_quotes")) % 2 == 1
    known = known.withColumn("_depth", F.col("_level") + F.sum(F.when(inside, F.col("_in")).otherwise(F.col("_out"))).over(w))
    known = known.withColumn("_open", F.col("_seen") % 2 == 1)
    return known.withColumn("_cut", ~F.col("_open") & (F.col("_depth") == 1) & (F.col("_root") == "["))


def elements(spark: SparkSession, paths, **options) -> DataFrame:
    """(path, is_array, element_no, text): the elements of arrays, or whole objects, of the files that are
    one JSON value.  ``text`` is the element's JSON."""
    rows = fragments(spark, paths, **options)
    n = _partitions(rows)
    slim = rows.select("path", "_blk", "_id", "_quotes", "_out", "_in").repartition(n, *_KEY)
    odd = F.sum("_quotes").over(_in_block()) - F.col("_quotes")
    states = slim.withColumn("_odd", odd % 2)
    blocks = states.groupBy(*_KEY).agg(F.sum("_quotes").alias("_quotes"),
                                       F.sum(F.when(F.col("_odd") == 0, F.col("_out")).otherwise(F.col("_in"))).alias("_out"),
                                       F.sum(F.when(F.col("_odd") == 1, F.col("_out")).otherwise(F.col("_in"))).alias("_in"))
    before = Window.partitionBy("path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_odd", F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2)
    starts = starts.withColumn("_gain", F.when(F.col("_odd") == 0, F.col("_out")).otherwise(F.col("_in")))
    starts = starts.withColumn("_level", F.coalesce(F.sum("_gain").over(before), F.lit(0)))
    roots = rows.filter("_blk._at = 0").groupBy("path").agg(F.min_by("_code", "_id").alias("_root"))
    roots = roots.withColumn("_root", F.when(F.col("_root") == ord("["), "[").when(F.col("_root") == ord("{"), "{").otherwise(""))
    starts = materialize(starts.join(roots, "path").select("path", "_blk", "_odd", "_level", "_root"), "blocks")

    counts = _with_state(slim, starts).groupBy(*_KEY).agg(F.count_if("_cut").alias("_cuts"), F.max_by("_open", "_id").alias("_open"), F.max_by("_depth", "_id").alias("_depth"))
    counts = counts.withColumn("_first", F.coalesce(F.sum("_cuts").over(before), F.lit(0)))
    counts = materialize(counts.join(starts, list(_KEY)), "elements")
    files = counts.groupBy("path").agg(F.max(F.col("_first") + F.col("_cuts")).alias("_last"), F.max_by(F.col("_open") | (F.col("_depth") != 0), "_blk").alias("_torn"))

    numbered = _with_state(rows.drop("_bytes", "_code").repartition(n, *_KEY), counts.select("path", "_blk", "_odd", "_level", "_root", "_first"))
    number = F.col("_first") + F.sum(F.col("_cut").cast("long")).over(_in_block()) - F.col("_cut").cast("long")
    parts = numbered.select("path", number.alias("element_no"), F.struct("_blk", "_id", "value").alias("_f"), "_root")
    whole = parts.repartition(n, "path", "element_no").groupBy("path", "element_no").agg(F.sort_array(F.collect_list("_f")).alias("_f"), F.first("_root").alias("_root"))
    whole = whole.select("path", "element_no", "_root", F.btrim(F.array_join(F.transform("_f", lambda f: f["value"]), ","), F.lit(SPACE)).alias("text"))
    whole = whole.join(bounded_broadcast(files, REJECTED_BROADCAST), "path")
    is_array, first, last = F.col("_root") == "[", F.col("element_no") == 0, F.col("element_no") == F.col("_last")
    ends = ~is_array | ((~first | F.startswith("text", F.lit("["))) & (~last | F.endswith("text", F.lit("]"))))
    bare = F.when(is_array & first, F.substr("text", F.lit(2))).otherwise(F.col("text"))
    whole = whole.withColumn("_ends", ends).withColumn("_t", bare)
    whole = whole.withColumn("_t", F.btrim(F.when(is_array & last, F.expr("left(_t, length(_t) - 1)")).otherwise(F.col("_t")), F.lit(SPACE)))
    none = is_array & (F.col("_last") == 0) & (F.col("_t") == "")
    good = F.col("_ends") & ~F.col("_torn") & F.col("_root").isin("[", "{") & (none | strict_json("_t").isNotNull())
    found = materialize(whole.select("path", is_array.alias("is_array"), "element_no", F.col("_t").alias("text"), good.alias("_good"), none.alias("_none")), "json")
    bad = found.filter("NOT _good").select("path").distinct()
    kept = found.filter("NOT _none").join(bounded_broadcast(bad, REJECTED_BROADCAST), "path", "left_anti")
    return kept.select("path", "is_array", "element_no", "text")

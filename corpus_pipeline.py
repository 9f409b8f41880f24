"""A training corpus from ``documents``: quality, near duplicates, repeats, secrets, packing.

Each stage works on all that the stage before kept, is written as Parquet and read
again.  The last returns the packed pieces; the others return documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import blob_ledger, crf_quality, packing, parity_join, phrase_automata, suite
from quarry.session import materialize, prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field over lines holds to be good (score 0.5 or more)."""
    prepare(spark)
    model = crf_quality.train(docs, suite.table(spark, sf_dir, "labels"), ~suite.held_out())
    kept = crf_quality.scored(docs, model, COLUMNS)
    return kept.filter("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the least by id and then by digest of its text, of each component of linked
    rows; rows without an id come last.  Rows without words are linked to none and all stay.

    A row is known by its values, so that nothing hangs on which task read it; rows equal in
    all of them are one text and count once."""
    prepare(spark)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", digest.alias("digest"), "lang", "source", "n_chars")
    rows = docs.filter(worded).select(*COLUMNS, row.alias("_row"))
    found = parity_join.near_duplicates(rows, "_row")
    stay = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_row")).distinct()
    kept = rows.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)
    return kept.unionByName(docs.filter(~worded).select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur twice, otherwise as they are."""
    prepare(spark)
    kept = phrase_automata.remove_repeats(docs, keys=("doc_id", "lang", "source"), layout=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret, private keys from begin to end, replaced by a mark."""
    prepare(spark)
    found = blob_ledger.with_spans(docs.select(*COLUMNS), blob_ledger.new_ledger(spark), blob_ledger.REDACTED)
    text = blob_ledger.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    prepare(spark)
    return packing.pack_documents(docs, suite.ranks(), suite.public_tokenizers.PATTERN, suite.END_OF_TEXT, suite.END, suite.CAPACITY)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeats),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: The classifier is trained by iteration, which SQL has no words for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    prepare(spark)
    docs = suite.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

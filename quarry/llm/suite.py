"""Queries of the operators over the given tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import blob_ledger, bpe, crf_quality, hnsw, packing, parity_join, phrase_automata, pigeonring, prefix_counts, tiled_topk, training_order, turn_repair, whitening

#: Fixed values of the byte-level vocabulary.
END_OF_TEXT = (("<|endoftext|>", 50256),)
CAPACITY, END = 1024, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 1024 tokens.  The ids are those of
    the byte-level vocabulary; its rank file gives them faster than its .json file does."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN, END_OF_TEXT, END, CAPACITY)


def held_out(key: str = "doc_id"):
    """Rows that the classifier learns nothing from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = crf_quality.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = crf_quality.scored(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 nearest vectors of every hundredth, by graphs."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word windows that occur twice."""
    kept = phrase_automata.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, scanned by blob into a new ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = blob_ledger.with_spans(docs, blob_ledger.new_ledger(spark))
    base = F.filter("spans", lambda s: s.nth < blob_ledger.BASE)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in blob_ledger.RULES[:blob_ledger.BASE]]
    return found.select("doc_id", *counts, F.sha2(blob_ledger.written(base), 256).alias("base_sha256"), blob_ledger.written(F.col("spans")).alias("spans"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and how much of each fits 2048 tokens."""
    counts = prefix_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fits")


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 5-word shingles have a similarity of 0.75 or more."""
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN)
    both = bpe.decode(ids, ranks())
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 largest integer inner products of every twentieth vector."""
    return tiled_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64.0)


def order_and_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sequences of 512 ids written in training order; the manifest."""
    manifest, _ = training_order.write_order(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN, END_OF_TEXT, END, 512, 8192, 20240229)
    return manifest


def simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 64-bit fingerprints differ in two bits or fewer."""
    return pigeonring.near_duplicates(table(spark, sf_dir, "documents"))


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 4 whitened components of most variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 4)


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after damage."""
    rows = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.digests(turn_repair.repaired(rows))


QUERIES = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_quality_classifier": quality_classifier,
    "op3_nearest_neighbours": nearest_neighbours,
    "op4_substring_dedup": substring_dedup,
    "op5_token_counts": token_counts,
    "op6_secret_scans": secret_scans,
    "op7_ngram_jaccard_join": ngram_jaccard_join,
    "op8_byte_bpe": byte_bpe,
    "op9_exact_topk": exact_topk,
    "op10_training_order": order_and_write,
    "op11_simhash_pigeonring": simhash_pigeonring,
    "op12_embedding_whitening": embedding_whitening,
    "op13_conversation_repair": conversation_repair,
}
SQL = {
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS passage FROM d, unnest(generate_series(1, len(w) - 34)) AS t(i)),
        r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY passage) > 1),
        g AS (SELECT DISTINCT doc_id, j FROM r, unnest(generate_series(i, i + 34)) AS t(j)),
        p AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(generate_series(1, len(w))) AS t(j)),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM p ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op6_secret_scans": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        rules(nth, kind, pattern, part, least) AS (VALUES
            (0, 'assign', '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
            (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24),
            (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1), (4, 'bearer', '[Bb]earer [A-Za-z0-9._~+/=-]{20,}', 0, 1)),
        assign AS (SELECT doc_id, 0 AS nth, 'assign' AS kind, 6 AS least, string_split_regex(t, r.pattern) AS gaps, regexp_extract_all(t, r.pattern) AS found, regexp_extract_all(t, r.pattern, 2) AS parts FROM d, rules r WHERE r.nth = 0),
        others AS (SELECT doc_id, r.nth, r.kind, r.least, string_split_regex(t, r.pattern) AS gaps, regexp_extract_all(t, r.pattern) AS found, found AS parts FROM d, rules r WHERE r.nth > 0),
        m AS (SELECT doc_id, nth, kind, least, i, length(gaps[i]) AS gap, length(found[i]) AS size, length(parts[i]) AS part
              FROM (SELECT * FROM assign UNION ALL SELECT * FROM others), unnest(generate_series(1, len(found))) AS u(i)),
        s AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, nth ORDER BY i) AS stop FROM m),
        k AS (SELECT doc_id, nth, kind, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM s WHERE part >= least),
        a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     string_agg(span, ',' ORDER BY start, nth) FILTER (nth < 3) AS base, string_agg(span, ',' ORDER BY start, nth) AS spans FROM k GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (doc_id)""",
    "op9_exact_topk": """
        WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
}

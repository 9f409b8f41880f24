"""Retrieval query keys over the benchmark tables (Spark side and SQL oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.sources.tables import table
from quarry.suite import sqlfrag as Q

SIZE, OVERLAP = R.DEFAULT_CHUNK_SIZE, R.DEFAULT_OVERLAP


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source")


def _queries(spark, sf):
    # every benchmark item, whole text, is one query
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("query"))


def chunks(spark, sf):
    return R.chunk_documents(_docs(spark, sf), SIZE, OVERLAP)


def q_doc_id(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", R.doc_key("text").alias("doc_key"))


def q_chunk_documents(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_index", "content",
                                    F.length("content").cast("bigint").alias("n_chars"))


def _colliding(spark, sf):
    # every third document begins a family: the next two begin with its first characters
    d = _docs(spark, sf)
    head = d.filter(F.col("doc_id") % 3 == 0).select(F.col("doc_id").alias("_head"), F.rpad(F.substring("text", 1, R.INDEX_KEY_CHARS), R.INDEX_KEY_CHARS, ".").alias("_start"))
    both = d.join(head, F.col("doc_id") - F.col("doc_id") % 3 == F.col("_head"))
    return both.select("doc_id", F.concat("_start", F.lit(" "), "text").alias("text"), "source")


def q_index_documents(spark, sf):
    documents, chunks = R.index_documents(_colliding(spark, sf), "doc_id")
    n = chunks.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("chunked_versions"))
    return documents.join(n, "doc_key").select("doc_key", "versions", "doc_id", "source", F.md5("text").alias("text_md5"), "n_chunks", "chunked_versions")


def q_index_stats(spark, sf):
    return R.index_stats(chunks(spark, sf))


def chunk_index(spark, sf):
    """The chunk table, built once and written as a parquet table in the shared
    checkpoint folder (scoring reads keys + content, the join-back reads it
    again; the chunker does not run twice)."""
    from quarry.session import materialize
    return materialize(chunks(spark, sf), "chunks")


def search_results(spark, sf):
    return R.lexical_search(chunk_index(spark, sf), _queries(spark, sf), k=R.DEFAULT_TOP_K,
                            threshold=R.DEFAULT_THRESHOLD)


def q_lexical_search(spark, sf):
    return search_results(spark, sf).select(
        "q_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "chunk_index", "score", "source")


def q_build_context_prompt(spark, sf):
    p = R.build_context_prompt(search_results(spark, sf), _queries(spark, sf))
    return p.select("q_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_len"))


def q_answer_sources(spark, sf):
    a = R.answer_sources(search_results(spark, sf), _queries(spark, sf))
    return a.select("q_id", F.array_join("sources", "|").alias("sources"), "num_chunks")


# ------------------------------------------------------------------ SQL oracle

_CHUNKS = Q.chunk_ctes("documents", "doc_id, source", SIZE, OVERLAP)

_SEARCH = f"""
WITH {_CHUNKS},
ct AS (SELECT doc_id, chunk_index, unnest({Q.term_set('content')}) AS term FROM chunks),
q AS (SELECT item_id AS q_id, text AS query, {Q.term_set('text')} AS terms FROM benchmark),
qt AS (SELECT q_id, greatest(len(terms), 1) AS nq, unnest(terms) AS term FROM q),
hits AS (SELECT q_id, nq, doc_id, chunk_index, count(*) AS h FROM qt JOIN ct USING (term)
         GROUP BY q_id, nq, doc_id, chunk_index),
scored AS (SELECT q_id, doc_id, chunk_index, CAST(h AS DOUBLE) / nq AS score FROM hits
           WHERE CAST(h AS DOUBLE) / nq >= {R.DEFAULT_THRESHOLD}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id, chunk_index) AS rank
           FROM scored),
res AS (SELECT r.q_id, CAST(r.rank AS BIGINT) AS rank, r.doc_id, r.chunk_index, r.score, c.source, c.content
        FROM ranked r JOIN chunks c USING (doc_id, chunk_index) WHERE r.rank <= {R.DEFAULT_TOP_K})
"""

SQL = {
    "index_documents": f"""WITH h AS (SELECT doc_id AS head, rpad(substr(text, 1, {R.INDEX_KEY_CHARS}), {R.INDEX_KEY_CHARS}, '.') AS start FROM documents WHERE doc_id % 3 = 0),
cd AS (SELECT d.doc_id, start || ' ' || d.text AS text, d.source, substr(md5(start), 1, 12) AS doc_key FROM documents d JOIN h ON d.doc_id - d.doc_id % 3 = h.head),
{Q.chunk_ctes("cd", "doc_id, doc_key", SIZE, OVERLAP)},
n AS (SELECT doc_key, count(*) AS n_chunks, count(DISTINCT doc_id) AS chunked_versions FROM chunks GROUP BY doc_key)
SELECT doc_key, CAST(count(*) AS BIGINT) AS versions, max(cd.doc_id) AS doc_id, arg_max(cd.source, cd.doc_id) AS source, md5(arg_max(cd.text, cd.doc_id)) AS text_md5,
       CAST(any_value(n_chunks) AS BIGINT) AS n_chunks, CAST(any_value(chunked_versions) AS BIGINT) AS chunked_versions FROM cd JOIN n USING (doc_key) GROUP BY doc_key""",
    "doc_id": "SELECT doc_id, substr(md5(text), 1, 12) AS doc_key FROM documents",
    "chunk_documents": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, content, "
                       f"CAST(length(content) AS BIGINT) AS n_chars FROM chunks",
    "index_stats": f"WITH {_CHUNKS} SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS num_documents, "
                   f"CAST(count(*) AS BIGINT) AS num_chunks FROM chunks",
    "lexical_search": _SEARCH + "SELECT q_id, rank, doc_id, chunk_index, score, source FROM res",
    "build_context_prompt": _SEARCH + """,
ctx AS (SELECT q_id, string_agg('[Context ' || rank || ']' ||
          CASE WHEN coalesce(source, '') <> '' THEN ' (Source: ' || source || ')' ELSE '' END ||
          chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS c FROM res GROUP BY q_id),
p AS (SELECT q.q_id, CASE WHEN ctx.c IS NULL THEN q.query ELSE
        'Use the following context to answer the question.' || chr(10) ||
        'Cite sources using [1], [2], etc.' || chr(10) || chr(10) || 'Context:' || chr(10) || ctx.c ||
        chr(10) || chr(10) || 'Question: ' || q.query || chr(10) || chr(10) || 'Answer:' END AS prompt
      FROM q LEFT JOIN ctx USING (q_id))
SELECT q_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_len FROM p""",
    "answer_sources": _SEARCH + """,
a AS (SELECT q_id, array_to_string(list_sort(list_distinct(list(source) FILTER (WHERE source <> ''))), '|') AS sources,
        count(*) AS n FROM res GROUP BY q_id)
SELECT q.q_id, coalesce(a.sources, '') AS sources, CAST(coalesce(a.n, 0) AS BIGINT) AS num_chunks
FROM q LEFT JOIN a USING (q_id)""",
}

QUERIES = {
    "index_documents": q_index_documents,
    "doc_id": q_doc_id,
    "chunk_documents": q_chunk_documents,
    "index_stats": q_index_stats,
    "lexical_search": q_lexical_search,
    "build_context_prompt": q_build_context_prompt,
    "answer_sources": q_answer_sources,
}


def flagship(spark, sf):
    """documents -> chunks -> term search (benchmark queries) -> context prompts."""
    p = R.build_context_prompt(search_results(spark, sf), _queries(spark, sf))
    return p.select("q_id", "prompt")

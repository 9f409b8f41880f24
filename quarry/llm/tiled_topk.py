"""Exact top-k by integer inner product: a grid of matrix products.

Queries and vectors are dealt to blocks of bounded size; each pair of blocks is
one cell of a grid, whose task multiplies tile by tile and keeps k of each tile.
The lists of a query's cells are merged in a tree.

Defined results: vectors that are null or hold null or non-finite components take
no part, nor do rows whose vec_id is null; vectors of different length are not compared;
a vec_id that queries repeat is asked once for each length (with its least vector), and
each row of a repeated vec_id is a candidate except to itself; ties go to the smaller vec_id; an empty table gives an empty table;
other columns are not looked at.  A score beyond 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

#: Rows of a cell's sides, and of a tile of vectors.
QUERY_ROWS, VECTOR_ROWS, TILE_ROWS = 4096, 8192, 2048
#: Lists merged by one task of the tree.
FAN_IN = 64


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def blocks_for(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """Rows of a list column as doubles."""
    values = table.column(column).combine_chunks()
    values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def vectors(df: DataFrame, is_query: Column, id_col: str, vector: str, name: str) -> DataFrame:
    """vec_id, _v, _d (length), _q (whether it is a query), _at (a number that deals rows, equal ones
    too): the rows that take part, written, so that a row keeps its number."""
    data = df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    data = data.filter(F.col("vec_id").isNotNull() & usable(F.col("_v"))).withColumn("_d", F.size("_v"))
    return materialize(data.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())), name)


def asked_once(data: DataFrame) -> DataFrame:
    """vec_id, _d, _v of the queries, each once."""
    return data.filter("_q").groupBy("vec_id", "_d").agg(F.min("_v").alias("_v"))


def grid(data: DataFrame, n_queries: int, n_vectors: int) -> tuple[DataFrame, int]:
    """data (as from ``vectors``) dealt to cells: _i and _j say which block of queries and of
    vectors a cell is of, _asks whether the row is there as a query."""
    rows, cols = blocks_for(n_queries, QUERY_ROWS), blocks_for(n_vectors, VECTOR_ROWS)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(by: str, n: int) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(n)).cast("int")

    asks = asked_once(data).select("vec_id", "_v", "_d", F.lit(True).alias("_asks"), block("vec_id", rows).alias("_i"), every(cols).alias("_j"))
    found = data.select("vec_id", "_v", "_d", F.lit(False).alias("_asks"), every(rows).alias("_i"), block("_at", cols).alias("_j"))
    return asks.unionByName(found), cols


def merge_lists(lists: DataFrame, groups: int, k: int, order: list[Column]) -> DataFrame:
    """The k first of each query_id's lists (one per _j), by a tree of merges; adds rank."""
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        lists = lists.withColumn("_j", F.floor(F.col("_j") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_j").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return lists.withColumn("rank", last).filter(F.col("rank") <= k)


def tile_lists(query_ids, queries, vec_ids, vectors, k: int):
    """k best (query row, vec_id, score) of a tile; vec_ids in rising order."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    n = len(vec_ids)
    if bound * n >= 2**62 or bound >= 2**53:  # beyond exact doubles
        scores = np.array([[int(x) for x in row] for row in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in row] for row in vectors], object).reshape(vectors.shape).T
        for a, qid in enumerate(query_ids):
            order = sorted((j for j in range(n) if vec_ids[j] != qid), key=lambda j: (-scores[a, j], vec_ids[j]))[:k]
            yield a, vec_ids[order], [int(scores[a, j]) for j in order]
        return
    scores = np.rint(queries @ vectors.T).astype(np.int64)
    keyed = scores * n + np.arange(n - 1, -1, -1)  # distinct, and ties fall to the smaller id
    keyed[query_ids[:, None] == vec_ids[None, :]] = np.iinfo(np.int64).min
    top = min(k + 1, n)
    best = np.argpartition(keyed, n - top, axis=1)[:, n - top:] if top < n else np.broadcast_to(np.arange(n), keyed.shape)
    for a in range(len(query_ids)):
        j = best[a]
        j = j[keyed[a, j] > np.iinfo(np.int64).min]
        j = j[np.argsort(-keyed[a, j])][:k]
        yield a, vec_ids[j], scores[a, j]


def top_k(df: DataFrame, is_query: Column, k: int, scale: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k vectors with the largest inner product of floor(scale * x)."""
    data = vectors(df, is_query, id_col, vector, "vectors")
    n = data.agg(F.count("*").alias("v"), F.count(F.when(F.col("_q"), 1)).alias("q")).first()
    cells, cols = grid(data, n.q, n.v)

    def cell(key, rows):
        asks = rows.column("_asks").to_numpy()
        vec_ids, vecs = rows.column("vec_id").to_numpy(), np.floor(scale * matrix(rows, "_v"))
        ids, asked = vec_ids[asks], vecs[asks]
        vec_ids, vecs = vec_ids[~asks], vecs[~asks]
        order = np.argsort(vec_ids, kind="stable")
        best = [np.zeros((3, 0), np.int64)]  # query, vec_id, score
        for lo in range(0, len(order) if len(ids) else 0, TILE_ROWS):
            tile = order[lo:lo + TILE_ROWS]
            for a, found, scores in tile_lists(ids, asked, vec_ids[tile], vecs[tile], k):
                best.append(np.stack([np.full(len(found), a), found, np.asarray(scores, np.int64)]))
        a, found, scores = np.concatenate(best, 1)
        order = np.lexsort((found, -scores, a))  # the tiles' lists of a query become one
        a, found, scores = a[order], found[order], scores[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, found, scores = a[keep], found[keep], scores[keep]
        return pa.table({"query_id": pa.array(ids[a]), "_j": pa.array([key[2].as_py()] * len(a), pa.int32()), "vec_id": pa.array(found), "score": pa.array(scores)})

    lists = cells.groupBy("_d", "_i", "_j").applyInArrow(cell, "query_id long, _j int, vec_id long, score long")
    return merge_lists(lists, cols, k, [F.col("score").desc(), F.col("vec_id")]).select("query_id", "rank", "vec_id", "score")

"""Exact and approximate vector searches against brute force."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import hnsw, suite, tiled_topk
from tests.conftest import SMALL


def brute(rows, asked, score, k):
    want = Counter()
    for qid, q in {i: v for i, v in rows if asked(i)}.items():
        found = sorted((score(q, v), vid) for vid, v in rows if vid != qid and len(v) == len(q))[:k]
        want.update((qid, n + 1, vid, s) for n, (s, vid) in enumerate(found))
    return want


def edge(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(2).tolist(), "x") for i in range(60)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0], "tie") for i in range(30)]
    rows += [(200, None, "n"), (201, [1.0, None, 0.0, 0.0], "n"), (202, [float("nan")] * 4, "n"), (203, [float("inf")] * 4, "n"), (204, [1.0, 2.0], "two"), (205, [0.0] * 4, "zero")]
    rows += [(None, [1.0, 0.0, 0.0, 0.0], "null id"), (2**60, [0.9, 0.1, 0.0, 0.0], "beyond doubles"), (2**60 + 20, [0.9, 0.2, 0.0, 0.0], "beyond doubles")]
    rows += [(40, rows[40][1], "again")] * 3
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def usable(df, zero=True):
    return [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None and r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and (zero or any(r.embedding))]


def test_topk_edge_rows(spark):
    df = edge(spark)
    rows = [(i, np.floor(64 * v).astype(int)) for i, v in usable(df)]
    got = Counter((r.query_id, r.rank, r.vec_id, -r.score) for r in tiled_topk.top_k(df, F.col("vec_id") % 20 == 0, 5, 64.0).collect())
    assert got == brute(rows, lambda i: i % 20 == 0, lambda a, b: -int(a @ b), 5)
    assert tiled_topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 5, 64.0).count() == 0


def test_topk_of_large_components(spark):
    df = spark.createDataFrame([(i, [float(2.0**30 + i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in tiled_topk.top_k(df, F.col("vec_id") == 0, 2, 1.0).orderBy("rank").collect()]
    assert got == [(0, 4), (0, 3)]


def test_graph_edge_rows(spark):
    df = edge(spark)
    want = Counter((q, n, v) for q, n, v, _ in brute(usable(df, zero=False), lambda i: i % 20 == 0, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), 5))
    got = Counter((r.query_id, r.rank, r.vec_id) for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0, 5).collect())
    assert got == want  # a graph this small is searched whole
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_graph_recall(spark):
    """Recall on the largest graph that the tables give, and exact scores."""
    sf = SMALL.replace("sf0.001", "sf0.1")
    rows = usable(spark.read.parquet(f"{sf}/embeddings.parquet"), zero=False)
    ids, v = np.array([i for i, _ in rows]), np.stack([x for _, x in rows])
    got = {}
    for r in suite.nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    at = {i: n for n, i in enumerate(ids.tolist())}
    for qid, found in got.items():
        d = np.sqrt(((v - v[at[qid]]) ** 2).sum(1))
        d[at[qid]] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {i for i, _ in found})
        total += 10
        assert all(abs(s - d[at[i]]) < 1e-12 for i, s in found)
    assert total == 10 * sum(i % 100 == 0 for i in ids.tolist()) and hit >= 0.9 * total


def test_one_id_in_most_rows_is_dealt_apart(spark):
    """A vec_id, and a vector, that most rows have: no block of vectors holds them all."""
    rows = [(7, [1.0, 2.0])] * 20000 + [(i, [float(i), 1.0]) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    data = tiled_topk.vectors(df, F.col("vec_id") % 100 == 0, "vec_id", "embedding", "hot")
    cells, cols = tiled_topk.grid(data, 1, 20100)
    sizes = [r.n for r in cells.filter("NOT _asks").groupBy("_j").agg(F.count("*").alias("n")).collect()]
    assert cols == 3 and len(sizes) == 3 and max(sizes) < 8192

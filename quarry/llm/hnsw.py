"""Approximate nearest neighbours: one small-world graph per shard of vectors.

A shard is a bounded number of vectors.  Its graph has levels; a vector's highest
level is drawn from a hash of its id.  On each level, nodes are joined in hash
order to a diverse choice of the nearest of the nodes before them, and back; the
nearest are found with matrix products, a block of nodes at a time.  Neighbours
are kept as one flat array with offsets.  Equal vectors are one node.  A search
descends the levels of each shard and the shards' lists are merged.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part, nor do rows whose vec_id is null; vectors of different length are not
compared; a vec_id that queries repeat is asked once for each length (with its least
vector); ties go to the smaller vec_id; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.textbytes import mix
from quarry.llm.tiled_topk import QUERY_ROWS, asked_once, blocks_for, matrix, merge_lists, vectors
from quarry.session import materialize

SHARD_ROWS = 8192
#: Links a node makes, links it may hold (twice as many on the lowest level),
#: candidates looked at when it is joined, and candidates held in a search.
LINKS, JOIN_WIDTH, SEARCH_WIDTH = 16, 64, 160


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0)


def diverse(v: np.ndarray, found: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of distance, those nearer to the node than to one chosen
    before; filled up with the nearest others."""
    if len(found) <= most:
        return found
    between = squares(v[found], v[found])
    out, open_ = [], np.ones(len(found), bool)
    while len(out) < most and open_.any():
        i = int(open_.argmax())
        out.append(i)
        open_[i] = False
        open_ &= between[i] >= far
    if len(out) < most:
        rest = np.ones(len(found), bool)
        rest[out] = False
        out += np.flatnonzero(rest)[:most - len(out)].tolist()
    return found[out]


def join_nodes(v: np.ndarray, links: int, most: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and neighbours of the graph over the rows of v, joined in row order."""
    near: list[list[int]] = [[] for _ in range(len(v))]

    def pruned(i: int, cap: int) -> list[int]:
        found = np.unique(near[i])
        far = ((v[found] - v[i]) ** 2).sum(1)
        order = np.argsort(far, kind="stable")
        return diverse(v, found[order], far[order], cap).tolist()

    for lo in range(0, len(v), block):
        hi = min(len(v), lo + block)
        d = squares(v[lo:hi], v[:hi])
        d[np.arange(lo, hi)[:, None] <= np.arange(hi)[None, :]] = np.inf
        width = min(JOIN_WIDTH, hi)
        some = np.argpartition(d, width - 1, axis=1)[:, :width]
        far = np.take_along_axis(d, some, 1)
        order = np.argsort(far, axis=1, kind="stable")
        some, far = np.take_along_axis(some, order, 1), np.take_along_axis(far, order, 1)
        for r in range(hi - lo):
            known = int(np.isfinite(far[r]).sum())
            chosen = diverse(v, some[r, :known], far[r, :known], links).tolist()
            near[lo + r] += chosen
            for s in chosen:
                near[s].append(lo + r)
                if len(near[s]) > 2 * most:
                    near[s] = pruned(s, most)
    lists = [pruned(i, most) if len(x) > most else x for i, x in enumerate(near)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return at.astype(np.int32), np.array([j for x in lists for j in x], np.int32)


def build(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays of a shard's graph; nodes are in the order in which they joined."""
    distinct, node = np.unique(v, axis=0, return_inverse=True)
    node = node.reshape(-1)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, node, ids)
    draw = mix(least.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    level = np.floor(-np.log((draw >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54) / np.log(LINKS)).astype(np.int64)
    order = np.argsort(draw, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    nodes, level = distinct[order], level[order]
    members = np.lexsort((ids, place[node]))
    out = {"nodes": nodes, "ids": ids[members], "members": np.searchsorted(place[node][members], np.arange(len(nodes) + 1))}
    sizes, ats, nears, who = [], [], [], []
    for lv in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level >= lv)
        at, near = join_nodes(nodes[mine], LINKS, LINKS * (1 if lv else 2))
        sizes += [len(mine), len(near)]
        ats, nears, who = [*ats, at], [*nears, mine[near] if len(near) else near], [*who, mine]
    return out | {"sizes": np.array(sizes), "at": np.concatenate(ats), "near": np.concatenate(nears), "who": np.concatenate(who)}


KINDS = {"nodes": "<f8", "ids": "<i8", "members": "<i8", "sizes": "<i8", "at": "<i4", "near": "<i4", "who": "<i4"}


class Graph:
    """A shard's graph, read from its flat arrays."""

    def __init__(self, d: int, parts: dict[str, np.ndarray]):
        self.nodes = parts["nodes"].reshape(-1, d)
        self.ids, self.members = parts["ids"], parts["members"]
        self.levels, a, b, w = [], 0, 0, 0
        for n, links in parts["sizes"].reshape(-1, 2).tolist():
            who = parts["who"][w:w + n]
            row = np.full(len(self.nodes), -1, np.int32)
            row[who] = np.arange(n)
            self.levels.append((row, parts["at"][a:a + n + 1], parts["near"][b:b + links]))
            a, b, w = a + n + 1, b + links, w + n
        self.entry = int(who[0]) if len(self.nodes) else -1

    def search(self, q: np.ndarray, width: int) -> list[int]:
        """Up to ``width`` nodes near q."""
        if self.entry < 0:
            return []
        nodes, start = self.nodes, self.entry
        for lv in range(len(self.levels) - 1, -1, -1):
            row, at, near = self.levels[lv]
            hold = width if lv == 0 else 1
            d = float(((nodes[start] - q) ** 2).sum())
            seen = np.zeros(len(nodes), bool)
            seen[start] = True
            todo, best = [(d, start)], [(-d, start)]
            while todo:
                d, i = heappop(todo)
                if d > -best[0][0] and len(best) >= hold:
                    break
                r = row[i]
                to = near[at[r]:at[r + 1]]
                to = to[~seen[to]]
                if not len(to):
                    continue
                seen[to] = True
                diff = nodes[to] - q
                for e, j in zip(np.einsum("ij,ij->i", diff, diff).tolist(), to.tolist(), strict=True):
                    if len(best) < hold:
                        heappush(best, (-e, j))
                        heappush(todo, (e, j))
                    elif e < -best[0][0]:
                        heapreplace(best, (-e, j))
                        heappush(todo, (e, j))
            start = max(best)[1]
        return [j for _, j in best]

    def nearest(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, without qid."""
        ids, far = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in self.search(q, max(SEARCH_WIDTH, 2 * k)):
            own = self.ids[self.members[i]:self.members[i + 1]]
            own = own[own != qid][:k]
            ids.append(own)
            far.append(np.full(len(own), np.sqrt(((self.nodes[i] - q) ** 2).sum())))
        ids, far = np.concatenate(ids), np.concatenate(far)
        order = np.lexsort((ids, far))[:k]
        return ids[order], far[order]


def index(data: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its graph as flat arrays.  data: vec_id, _v, _d, _at."""
    def shard(key, rows):
        parts = build(rows.column("vec_id").to_numpy(), matrix(rows, "_v"))
        cols = {"_d": pa.array([key[0].as_py()], pa.int32()), "_j": pa.array([key[1].as_py()], pa.int32())}
        return pa.table(cols | {c: pa.array([parts[c].astype(t).tobytes()], pa.binary()) for c, t in KINDS.items()})

    dealt = data.withColumn("_j", F.pmod(F.xxhash64("_at"), F.lit(shards)).cast("int"))
    return dealt.groupBy("_d", "_j").applyInArrow(shard, "_d int, _j int, " + ", ".join(f"{c} binary" for c in KINDS))


def nearest(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found."""
    data = vectors(df.filter(F.exists(F.col(vector), lambda x: x != 0)), is_query, id_col, vector, "vectors")
    n = data.agg(F.count("*").alias("v"), F.count(F.when(F.col("_q"), 1)).alias("q")).first()
    shards, rows = blocks_for(n.v, SHARD_ROWS), blocks_for(n.q, QUERY_ROWS)
    graphs = materialize(index(data.drop("_q"), shards), "graphs").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    asked = asked_once(data).withColumn("_i", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int"))
    asked = asked.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(key, left, right):
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            graph = Graph(key[0].as_py(), {c: np.frombuffer(right.column(c)[0].as_py(), t) for c, t in KINDS.items()})
            for qid, q in zip(left.column("vec_id").to_pylist(), matrix(left, "_v"), strict=True):
                found, far = graph.nearest(qid, q, k)
                out["query_id"] += [qid] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += far.tolist()
        cols = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(out[c], t) for c, t in cols.items()} | {"_j": pa.array([key[2].as_py()] * len(out["score"]), pa.int32())})

    lists = asked.groupBy("_d", "_i", "_j").cogroup(graphs.groupBy("_d", "_i", "_j")).applyInArrow(search, "query_id long, vec_id long, score double, _j int")
    return merge_lists(lists, shards, k, [F.col("score"), F.col("vec_id")]).select("query_id", "rank", "vec_id", "score")

"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line's features are shares of its
characters by class, doubled punctuation, length, words, whether the text repeats
it, and the same of the lines before and after.  The field is trained on a bounded
sample of labelled documents, whose label every line of theirs gets.  Forward and
backward sums give each line's probability; weighted by length they make the
document's, which a logistic curve fitted on the same sample turns into a score.

Defined results: null text is empty, and an empty text is one empty line; repeated
rows get scores that are equal but for rounding; without labelled rows of both kinds every score is one half;
an empty table gives an empty table; other columns are carried only if they are
named in ``keys``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textbytes import buffers, chunks, column_of, mix, range_hashes

#: The sample: documents, and lines of each (a stretch at a place drawn from its hash).
SAMPLE_DOCS, SAMPLE_LINES = 4000, 48
STEPS, RATE, DECAY = 150, 0.05, 1e-3
#: Bytes of texts whose lines are looked at together (a byte takes some 50 while that lasts).
AT_ONCE = 1 << 20

#: Classes of bytes: letters, digits, blanks, bytes beyond ASCII, every punctuation mark, others.
_CLASS = np.full(256, 5, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
_CLASS[[9, 32]] = 3
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_MARKS] = np.arange(6, 6 + len(_MARKS))
CLASSES = 6 + len(_MARKS)
OWN = CLASSES + 5


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (lines, OWN), bytes of each, and where each row's begin (n + 1)."""
    data, at = buffers(column)
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(at, breaks, "right") - 1
    per_row = np.bincount(of_break, minlength=len(column)) + 1
    first = np.concatenate([[0], np.cumsum(per_row)])
    starts = np.empty(first[-1], np.int64)
    starts[first[:-1]] = at[:-1]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[inner] = breaks + 1
    ends = np.empty(first[-1], np.int64)
    ends[first[1:] - 1] = at[1:]
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[inner] = breaks
    sizes = ends - starts
    line = np.zeros(len(data) + 1, np.int64)
    line[breaks + 1] = 1
    edges = at[1:-1]
    np.add.at(line, edges, 1)
    line = np.cumsum(line)[:len(data)]
    kind = _CLASS[data]
    counts = np.bincount(line * CLASSES + kind, minlength=len(sizes) * CLASSES).reshape(-1, CLASSES).astype(np.float64)
    counts[:, 5] = 0  # line ends
    n = np.maximum(sizes, 1)
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & (kind[1:] > 5) & (line[1:] == line[:-1])
    doubled = np.bincount(line[twice], minlength=len(sizes))
    row = np.repeat(np.arange(len(column)), per_row)
    name = range_hashes(mix(data.astype(np.uint64) + np.uint64(1)), starts, ends) ^ mix(row.astype(np.uint64))
    _, back, often = np.unique(name, return_inverse=True, return_counts=True)
    words = counts[:, 3] + 1
    own = np.empty((len(sizes), OWN), np.float32)
    own[:, :CLASSES] = np.sqrt(counts / n[:, None])
    own[:, CLASSES:] = np.stack([np.sqrt(doubled / n), np.log1p(sizes) / 10, np.log1p(words) / 5, np.minimum(n / words, 40) / 10, (often[back.reshape(-1)] > 1) & (sizes > 0)], 1)
    return own, sizes, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after in its row, and a constant."""
    n, k = own.shape
    out = np.zeros((n, 3 * k + 3), np.float32)
    out[:, :k] = own
    head, tail = first[:-1], first[1:] - 1
    out[1:, k:2 * k] = own[:-1]
    out[head, k:2 * k] = 0
    out[:-1, 2 * k:3 * k] = own[1:]
    out[tail, 2 * k:3 * k] = 0
    out[head, 3 * k] = 1
    out[tail, 3 * k + 1] = 1
    out[:, 3 * k + 2] = 1
    return out


def marginals(unary: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and expected moves (2 x 2) of all rows.

    unary: score of good against bad; step[a, b]: score of a move from a to b.  All rows
    go through the recursion together, longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    head, sizes = first[:-1][order], sizes[order]
    most = int(sizes.max(initial=0))
    up = np.exp(step - step.max())
    emit = np.stack([1 / (1 + np.exp(np.clip(unary, -30, 30))), 1 / (1 + np.exp(-np.clip(unary, -30, 30)))], 1)
    ahead, behind = np.empty((len(unary), 2)), np.ones((len(unary), 2))
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(most)]  # rows of more than t lines
    for t in range(most):
        i = head[:active[t]] + t
        a = emit[i] if t == 0 else (ahead[i - 1] @ up) * emit[i]
        ahead[i] = a / a.sum(1, keepdims=True)
    moves = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        i = head[:active[t + 1]] + t
        right = emit[i + 1] * behind[i + 1]
        b = right @ up.T
        pair = ahead[i][:, :, None] * up[None] * right[:, None, :]
        moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        behind[i] = b / b.sum(1, keepdims=True)
    both = ahead * behind
    return both[:, 1] / both.sum(1), moves


def of_rows(good: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the lines' probabilities by length, as log odds."""
    weight = sizes + 1.0
    mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    curve: tuple[float, float]

    def lines(self, own, sizes, first) -> tuple[np.ndarray, np.ndarray]:
        unary = ((with_neighbours(own, first) - self.center) * self.scale) @ self.weights
        good, _ = marginals(unary, self.step, first)
        slope, base = self.curve
        return good, 1 / (1 + np.exp(-np.clip(slope * of_rows(good, sizes, first) + base, -50, 50)))


def fit(own: np.ndarray, sizes: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
    """Maximum likelihood of the labels' lines by gradient steps, and the curve of the score."""
    x = with_neighbours(own, first).astype(np.float64)
    width = x.shape[1]
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(width), np.zeros(width), np.zeros(width), np.zeros((2, 2)), (0.0, 0.0))
    center, scale = x.mean(0), 1 / np.maximum(x.std(0), 1e-3)
    center[-1], scale[-1] = 0, 1
    x = (x - center) * scale
    per_row = np.diff(first)
    y = np.repeat(label, per_row).astype(np.float64)
    stays = np.array([((per_row - 1) * (label == 0)).sum(), 0, 0, ((per_row - 1) * (label == 1)).sum()], np.float64).reshape(2, 2)
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        good, moves = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([x.T @ (y - good), (stays - moves).reshape(-1)]) / len(y) - DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    step = theta[-4:].reshape(2, 2)
    good, _ = marginals(x @ theta[:-4], step, first)
    z = of_rows(good, sizes, first)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps of a logistic curve, held down a little
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([((label - p) * z).sum() - 0.1 * a, (label - p).sum() - 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + da, b + db
    return Model(center, scale, theta[:-4], step, (float(a), float(b)))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "quality", most_docs: int = SAMPLE_DOCS, most_lines: int = SAMPLE_LINES) -> Model:
    """Model from at most ``most_docs`` of the labelled documents that ``allowed`` (a
    condition on the key) admits, the first by a hash of the key, and a stretch of at most
    ``most_lines`` lines of each.  A key that documents repeat gives one text, the least, so
    that the driver gets most_docs * most_lines rows of features at most."""
    rows = labels.filter(allowed & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_label"))
    rows = rows.orderBy(F.xxhash64(key), key).limit(most_docs)
    texts = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(rows), key)
    texts = texts.groupBy(key).agg(F.min("_text").alias("_text"), F.first("_label").alias("_label")).select(F.xxhash64(key, "_text").alias("_h"), "_text", "_label")

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "_text", AT_ONCE):
                own, sizes, first = line_features(column_of(b, "_text"))
                cols = {"_h": column_of(b, "_h"), "_label": column_of(b, "_label")}
                parts, lens = [], []
                for i, h in enumerate(cols["_h"].to_pylist()):
                    lo, hi = int(first[i]), int(first[i + 1])
                    if hi - lo > most_lines:
                        lo += h % (hi - lo - most_lines + 1)
                        hi = lo + most_lines
                    parts.append(own[lo:hi].tobytes())
                    lens.append(sizes[lo:hi].tobytes())
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(parts, pa.binary()), pa.array(lens, pa.binary())], names=["_h", "_label", "own", "sizes"])

    got = texts.mapInArrow(run, "_h long, _label int, own binary, sizes binary").toArrow().sort_by([("_h", "ascending"), ("_label", "ascending"), ("own", "ascending")])
    own = [np.frombuffer(x, np.float32).reshape(-1, OWN) for x in got.column("own").to_pylist()]
    sizes = [np.frombuffer(x, np.int64) for x in got.column("sizes").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sizes])]).astype(np.int64)
    empty = np.zeros((0, OWN), np.float32)
    return fit(np.concatenate([empty, *own]), np.concatenate([np.zeros(0, np.int64), *sizes]), first, got.column("_label").to_numpy())


def scored(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, score, and good (each line's probability to be good)."""
    source = docs.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("score", T.DoubleType()), T.StructField("good", T.ArrayType(T.FloatType()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "_text", AT_ONCE):
                own, sizes, first = line_features(column_of(b, "_text"))
                good, score = shared.value.lines(own, sizes, first)
                lines = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(good, pa.float32()))
                yield pa.RecordBatch.from_arrays([*(column_of(b, k) for k in keys), pa.array(score), lines], names=schema.names)

    return source.mapInArrow(run, schema)

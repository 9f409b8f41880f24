"""Embedding whitening: singular values of a bidiagonal factor by qd, directions by twisted factorisations.

1. Each distinct vector of whole numbers is one row of the fit list.  Its count and its
   sums by dimension are exact.
2. Every task turns its centred rows, a block at a time, into a triangular factor R (QR
   of the block below the R so far); the tasks' factors meet in a tree.  V = R'R / n is
   never formed, so that no digits are lost by squaring.
3. R is made bidiagonal by Householder reflections.  The differential qd algorithm with
   shifts finds the squares of its singular values; it only adds, multiplies and
   divides numbers that aren't negative, so that small values are as accurate as large ones.
4. For each of the largest, the stationary and the progressive qd transforms of the
   bidiagonal factor, one from either end, meet in a twisted factorisation at the row
   where its pivot is least; solving with it gives the direction, which the
   reflections take back to the vectors' space.  Values that lie close together are
   made orthogonal between solves.

A task holds a block and one or FAN_IN factors, whatever the number of rows.  The driver
gets, for each length of vectors, a model of a few numbers a dimension.

Defined results: vectors that are null, or hold null or non-finite entries, are left out; a
component that is not whole in double precision (value below TINY of the largest) is
none, so that equal vectors alone have no rows; vectors of different length are
fitted each for themselves; repeated rows, and rows with a null id, count once in the
fit and each have a result; an empty table gives an empty table; other columns are not
looked at.  A number beyond 64 bits in an exact sum raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.textbytes import column_of
from quarry.llm.tiled_topk import usable
from quarry.session import materialize

#: Entries become floor(SCALE * c).
SCALE = 256.0
#: Rows of a block, and factors that one task of the tree merges.
ROWS, FAN_IN = 2048, 16
#: Rounding of doubles; share of the largest singular value below which there is no component.
EPS = np.finfo(float).eps
TINY = 1e-10
#: Values whose distance is less than this share of the larger are made orthogonal.
CLOSE = 1e-3


def merged(factors: list[np.ndarray]) -> np.ndarray:
    """The triangular factor of rows that stand below each other."""
    return np.linalg.qr(np.vstack(factors), mode="r")


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U'RW, and W, by Householder reflections."""
    a, m = np.array(r, float), r.shape[1]
    w = np.eye(m)

    def reflector(x):
        v = x.copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        v[0] += np.copysign(norm, x[0])
        return v / np.linalg.norm(v)

    for k in range(m):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < m - 2 and (v := reflector(a[k, k + 1:])) is not None:
            a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ v, v)
            w[:, k + 1:] -= 2 * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One differential qd step; also the least d (negative: the shift was too large)."""
    n = len(q)
    new_q, new_e, d = np.empty(n), np.zeros(n - 1), q[0] - shift
    least = d
    for i in range(n - 1):
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first."""
    found: list[float] = []
    todo = [(a.astype(float) ** 2, b.astype(float) ** 2, 0.0)]  # unreduced parts, and what has been taken off
    while todo:
        q, e, taken = todo.pop()
        steps = 0
        while len(q):
            n = len(q)
            small = EPS**2 * (taken + np.minimum(q[:-1], q[1:])) if n > 1 else np.zeros(0)
            gone = np.flatnonzero(e <= np.maximum(small, np.finfo(float).tiny))
            if len(gone):  # splits in two
                k = int(gone[-1]) + 1
                if k == n - 1:
                    found.append(taken + max(q[-1], 0.0))
                    q, e = q[:k], e[:k - 1]
                else:
                    todo.append((q[k:], e[k:], taken))
                    q, e = q[:k], e[:k - 1]
                steps = 0
                continue
            if n == 1:
                found.append(taken + max(q[0], 0.0))
                break
            if steps % 8 == 0 and q[0] < q[-1] / 2:  # read from the other end, which has the same values
                q, e = q[::-1].copy(), e[::-1].copy()
            # the lesser eigenvalue of the last two rows bounds the least value from above
            x, y = q[-2] + e[-1], q[-1]
            guess = x * y - q[-1] * e[-1]  # their determinant
            guess /= (x + y) / 2 + np.hypot((x - y) / 2, np.sqrt(q[-1] * e[-1]))
            shift, tries = (guess if steps else 0.0), 0
            new_q, new_e, least = _dqds(q, e, shift)
            while least < 0 and shift > 0:  # too large: what was missing is taken off, then all
                tries += 1
                shift = max(0.0, (shift + least) * (1 - 4 * EPS)) if tries < 3 else 0.0
                new_q, new_e, least = _dqds(q, e, shift)
            q, e, taken = new_q, new_e, taken + shift
            steps += 1
    return np.sort(np.array(found))[::-1]


def direction(q: np.ndarray, e: np.ndarray, value: float, near: list[np.ndarray], seed: int) -> np.ndarray:
    """Unit eigenvector of B'B (squares q of B's diagonal, e of its superdiagonal; B's entries
    positive) near value, orthogonal to those of ``near``, by a twisted factorisation."""
    n = len(q)
    off = np.sqrt(q[:-1] * e)  # off the diagonal of B'B
    d = np.concatenate([q[:1], q[1:] + e])  # its diagonal
    scale = max(d.max(), np.finfo(float).tiny)
    guard = lambda x: x if abs(x) > EPS * EPS * scale else EPS * EPS * scale
    plus, minus = np.empty(n), np.empty(n)
    s = -value  # stationary: top down, pivots q + s
    aux = np.empty(n)
    for i in range(n):
        aux[i] = s
        plus[i] = guard(q[i] + s)
        if i < n - 1:
            s = e[i] * s / plus[i] - value
    p = q[n - 1] - value  # progressive: bottom up, pivots p + e
    prog = np.empty(n)
    for i in range(n - 1, -1, -1):
        prog[i] = p
        if i:
            minus[i] = guard(e[i - 1] + p)
            p = p * q[i - 1] / minus[i] - value
    twist = aux + prog + value
    k = int(np.argmin(np.abs(twist)))
    pivot = guard(twist[k])

    def solve(y):
        """x with N D N' x = y, the factors meeting at row k."""
        x = y.copy()
        for i in range(k):
            x[i + 1] -= off[i] / plus[i] * x[i]
        for i in range(n - 1, k, -1):
            x[i - 1] -= off[i - 1] / minus[i] * x[i]
        x[k] /= pivot
        for i in range(k - 1, -1, -1):
            x[i] = x[i] / plus[i] - off[i] / plus[i] * x[i + 1]
        for i in range(k + 1, n):
            x[i] = x[i] / minus[i] - off[i - 1] / minus[i] * x[i - 1]
        return x

    def orthogonal(x):
        for _ in range(2):
            for v in near:
                x = x - (v @ x) * v
        return x

    x = np.zeros(n)
    x[k] = 1.0
    if near:
        x = orthogonal(x + np.random.default_rng(seed).normal(size=n) / n)
    for _ in range(4 if near else 2):
        x = solve(x / np.linalg.norm(x))
        x = orthogonal(x / np.abs(x).max())
    return x / np.linalg.norm(x)


@dataclass
class Model:
    """Of the vectors of one length: how many distinct ones, their sums, whitening directions
    (a column a component), the components' shares of the variance, and the largest entry of
    the whitened covariance less the identity."""
    n: int
    sums: list[int]
    directions: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n * x - S)**2, exactly."""
        sums = np.array(self.sums, object)
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if far * far * x.shape[1] < 2**63:
            return ((self.n * x - sums.astype(np.int64)) ** 2).sum(1)
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(1)
        if max(exact) >= 2**63:
            raise OverflowError("a deviation does not fit 64 bits")
        return exact.astype(np.int64)


def solved(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitening directions of up to k components, and their shares of the variance, from R."""
    d = r.shape[1]
    a, b, w = bidiagonal(np.vstack([r, np.zeros((max(0, d - len(r)), d))]))
    squares = squared_singular_values(a, b)
    squares = squares[squares > TINY**2 * squares[0]][:k]
    signs = np.cumprod(np.concatenate([[1.0], np.where(a[:-1] * b < 0, -1.0, 1.0)]))
    found: list[np.ndarray] = []
    for j, value in enumerate(squares):
        near = [v for v, x in zip(found, squares, strict=False) if x - value < CLOSE * x]
        found.append(direction(a**2, b**2, value, near, j))
    out = w @ (signs[:, None] * np.array(found).reshape(-1, d).T)
    return out / np.sqrt(squares / n), squares / (r**2).sum()


def whole_numbers(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, _x (whole numbers), _d (length) of the vectors that take part."""
    data = df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("_v")).filter(usable(F.col("_v")) & (F.size("_v") > 0))
    return data.select("vec_id", F.transform("_v", lambda c: F.floor(c * SCALE)).alias("_x"), F.size("_v").alias("_d"))


def by_length(batch: pa.RecordBatch):
    """(length, rows of that length, their whole numbers) of a batch."""
    size = column_of(batch, "_d").to_numpy()
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        values = column_of(batch, "_x").take(pa.array(rows)).flatten()
        yield d, rows, values.to_numpy().reshape(-1, d)


def counted(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of vectors: how many there are and their sums, exactly."""
    def run(batches):
        for b in batches:
            for d, rows, x in by_length(b):
                if int(np.abs(x).max()) * len(rows) >= 2**63:
                    raise OverflowError("a sum does not fit 64 bits")
                yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([len(rows), *x.sum(0).tolist()])], names=["_d", "_i", "_sum"])

    sums = fit.mapInArrow(run, "_d int, _i int, _sum long").groupBy("_d", "_i").agg(F.sum("_sum").alias("_sum"))
    out: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # a row for each dimension of each length there is
        out.setdefault(r._d, {})[r._i] = r._sum
    return {d: (s[-1], [s[i] for i in range(d)]) for d, s in out.items()}


def factors(fit: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """_d, _r: the triangular factor of the centred rows of each length."""
    shared = fit.sparkSession.sparkContext.broadcast(means)

    def row(d, t, r):
        return pa.table({"_d": pa.array([d], pa.int32()), "_t": pa.array([t], pa.int32()), "_r": pa.array([r.tobytes()], pa.binary())})

    def run(batches):
        from pyspark import TaskContext

        own: dict[int, np.ndarray] = {}
        for b in batches:
            for d, rows, x in by_length(b):
                for lo in range(0, len(rows), ROWS):
                    own[d] = merged([own.get(d, np.zeros((0, d))), x[lo:lo + ROWS] - shared.value[d]])
        for d, r in own.items():
            yield from row(d, TaskContext.get().partitionId(), r).to_batches()

    def merge(key, rows):
        d = key[0].as_py()
        return row(d, key[1].as_py(), merged([np.frombuffer(r, float).reshape(-1, d) for r in rows.column("_r").to_pylist()]))

    found = materialize(fit.mapInArrow(run, "_d int, _t int, _r binary"), "factors")
    groups = (found.agg(F.max("_t")).first()[0] or 0) + 1
    while groups > 1:
        groups = -(-groups // FAN_IN)
        found = found.withColumn("_t", F.floor(F.col("_t") / FAN_IN).cast("int")).groupBy("_d", "_t").applyInArrow(merge, "_d int, _t int, _r binary")
    return found.select("_d", "_r")


def fitted(fit: DataFrame, k: int) -> dict[int, Model]:
    """A model of up to k components for each length of vectors."""
    spark = fit.sparkSession
    counts = counted(fit)
    sizes = spark.sparkContext.broadcast({d: n for d, (n, _) in counts.items()})

    def solve(batches):
        for b in batches:
            for d, r in zip(column_of(b, "_d").to_pylist(), column_of(b, "_r").to_pylist(), strict=True):
                directions, explained = solved(np.frombuffer(r, float).reshape(-1, d), sizes.value[d], k)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([directions.tobytes()], pa.binary()), pa.array([explained.tobytes()], pa.binary())], names=["_d", "_w", "_e"])

    models = {}
    means = {d: np.array([s / n for s in sums]) for d, (n, sums) in counts.items()}
    for r in factors(fit, means).mapInArrow(solve, "_d int, _w binary, _e binary").collect():  # k + 1 numbers a dimension
        explained = np.frombuffer(bytes(r._e), float)
        models[r._d] = Model(*counts[r._d], np.frombuffer(bytes(r._w), float).reshape(r._d, len(explained)), explained)
    shared = spark.sparkContext.broadcast(models)

    def products(batches):
        for b in batches:
            for d, _, x in by_length(b):
                w = shared.value[d].whitened(x)  # its mean is zero but for rounding
                yield pa.RecordBatch.from_arrays([pa.array([d] * w.shape[1]**2, pa.int32()), pa.array(range(w.shape[1]**2), pa.int32()), pa.array((w.T @ w).reshape(-1))], names=["_d", "_i", "_sum"])

    for r in fit.mapInArrow(products, "_d int, _i int, _sum double").groupBy("_d", "_i").agg(F.sum("_sum").alias("_sum")).collect():
        m = models[r._d]
        i, j = divmod(r._i, len(m.explained))
        m.error = max(m.error, abs(r._sum / m.n - (i == j)))
    return models


def whiten(df: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for
    each vector that takes part and each of up to k components."""
    data = whole_numbers(df, id_col, vector)
    fit = materialize(data.select("_x", "_d").distinct(), "vectors")
    shared = df.sparkSession.sparkContext.broadcast(fitted(fit, k))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for b in batches:
            for d, rows, x in by_length(b):
                m = shared.value[d]
                c = len(m.explained)
                cols = [np.tile(np.arange(1, c + 1, dtype=np.int32), len(rows)), np.full(len(rows) * c, m.n), np.repeat(m.deviation(x), c), m.whitened(x).reshape(-1), np.tile(m.explained, len(rows)), np.full(len(rows) * c, m.error)]
                yield pa.RecordBatch.from_arrays([column_of(b, "vec_id").take(pa.array(np.repeat(rows, c))), *map(pa.array, cols)], names=names)

    kinds = (df.schema[id_col].dataType.simpleString(), "int", "long", "long", "double", "double", "double")
    return data.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(names, kinds, strict=True)))

"""Whitening against a dense eigenvalue solver; its parts against what defines them."""

import math

import numpy as np
import pytest

from quarry.llm import suite, whitening
from tests.conftest import SMALL


def bidiagonal(a, b):
    return np.diag(a) + np.diag(b, 1)


def cases():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 33, 64):
        yield rng.normal(size=n), rng.normal(size=n - 1)
        yield 10.0 ** -rng.integers(0, 9, n), 10.0 ** -rng.integers(0, 9, n - 1)  # graded
        yield np.ones(n), np.full(n - 1, 1e-9)  # close together
    yield np.array([3.0, 0.0, 2.0, 1.0]), np.array([1.0, 1.0, 1.0])  # singular
    yield np.array([2.0, 2.0, 2.0]), np.zeros(2)
    yield np.zeros(3), np.zeros(2)
    yield np.arange(1.0, 21.0)[::-1], np.ones(19)
    yield np.arange(1.0, 21.0), np.ones(19)


@pytest.mark.parametrize("case", list(cases()))
def test_singular_values(case):
    a, b = case
    want = np.linalg.svd(bidiagonal(a, b), compute_uv=False)
    got = np.sqrt(whitening.squared_singular_values(a, b))
    assert len(got) == len(want)
    assert np.allclose(got, want, rtol=1e-13, atol=1e-14 * want[0])


def test_small_singular_values_are_accurate():
    """A graded matrix whose values are known to all digits, where a dense solver loses them."""
    a, b = np.array([1.0, 1e-10, 1e-20]), np.array([1e-3, 1e-12])
    from fractions import Fraction

    got = np.sqrt(whitening.squared_singular_values(a, b))
    whole = math.prod(map(Fraction, a))  # the determinant: product of the values
    assert abs(float(whole / math.prod(map(Fraction, got))) - 1) < 1e-14


def test_bidiagonal_form():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40):
        r = np.triu(rng.normal(size=(n, n)))
        r[:, n // 2] = 0
        a, b, w = whitening.bidiagonal(r)
        assert np.allclose(w.T @ w, np.eye(n), atol=1e-13)
        form = bidiagonal(a, b)
        assert np.allclose(form.T @ form, w.T @ (r.T @ r) @ w, atol=1e-12)


def dense(rows):
    """(id, vector) rows to (id, component) -> result, by a dense solver in one go."""
    keep = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    x = {i: np.floor(256 * v).astype(int) for i, v in keep}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:4]
    out = {}
    for i, v in x.items():
        far = sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        for c, j in enumerate(order, 1):
            out[i, c] = (n, far, (v - sums / n) @ w[:, j] / np.sqrt(e[j]), e[j] / e.sum())
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for c in range(1, 5):
        own = [r for r in got if r.component == c]
        pairs = np.array([(r.whitened, want[r.vec_id, c][2]) for r in own])
        sign = np.sign((pairs[:, 0] * pairs[:, 1]).sum())
        assert np.allclose(pairs[:, 0], sign * pairs[:, 1], rtol=1e-8, atol=1e-8)
    for r in got:
        n, far, _, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, far)
        assert abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in suite.table(spark, SMALL, "embeddings").collect()]
    got = suite.QUERIES["op12_embedding_whitening"](spark, SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), dense(rows))


def test_edge_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [8, 4, 2, 1, 1, 0.5]).tolist()) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # one vector again and again
    rows += [(200, None), (201, [1.0, None, 0, 0, 0, 0]), (202, [math.nan] * 6), (203, [math.inf] * 6), (204, [0.0] * 6)]
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1.5, 7) for i, v in rows], "vec_id long, embedding array<float>, whitened double, n int")
    floats = [(r.vec_id, r.embedding) for r in df.collect()]
    got = whitening.whiten(df, 4).collect()
    check(got, dense(floats))
    assert whitening.whiten(df.limit(0), 4).count() == 0
    assert whitening.whiten(df.filter("vec_id BETWEEN 100 AND 150"), 4).count() == 0  # equal vectors have no component
    two = whitening.whiten(df.filter("vec_id IN (0, 1, 100)"), 4).collect()  # three points: two components
    assert sorted((r.vec_id, r.component) for r in two) == [(i, c) for i in (0, 1, 100) for c in (1, 2)]


def test_lengths_equal_values_and_null_ids(spark):
    corners = [[a, b, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]  # all variances are equal
    rows = [(None, v) for v in corners] + [(1, [1.0, 5.0]), (2, [2.0, 4.0]), (3, [9.0, 9.0]), (4, []), (2**60 + 1, [2.0, 2.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4).collect()
    assert len(got) == 9 * 3 + 3 * 2
    assert all(r.identity_error < 1e-9 for r in got)
    assert {r.n for r in got} == {9, 3} and 2**60 + 1 in {r.vec_id for r in got}
    assert abs(sum({(r.component, r.n): r.explained for r in got}.values()) - 2) < 1e-9


def test_factors_of_many_tasks(spark):
    """More tasks than one merge takes: the tree gives the factor of all rows."""
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (700, 5))
    fit = spark.createDataFrame([(r.tolist(), 5) for r in x], "_x array<long>, _d int").repartition(40)
    (r,) = whitening.factors(fit, {5: x.mean(0)}).collect()
    r = np.frombuffer(bytes(r._r), float).reshape(-1, 5)
    centred = x - x.mean(0)
    assert np.allclose(r.T @ r, centred.T @ centred)

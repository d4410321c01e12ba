"""Whitening against dense linear algebra, its exact parts against plain whole-number versions, and awkward vectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from textlab.llm import whitening as W
from textlab.llm.queries import op13_whitening

SF_MID = "/root/testdata/sf0.01"


def plain_polynomial(a: list[list[int]]) -> list[int]:
    """Faddeev-LeVerrier on fractions, constant first."""
    d = len(a)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(a[i][x] * m[x][i] for i in range(d) for x in range(d)) / k)
    return [int(x) for x in reversed(c)]


def gram(rnd: np.random.Generator, d: int, rank: int) -> list[list[int]]:
    x = rnd.integers(-50, 50, (rank, d)).astype(object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 5), (5, 3), (7, 20), (9, 1)])
def test_polynomial_is_exact(spark, d, rank):
    a = gram(np.random.default_rng(d), d, rank)
    assert W.characteristic(spark, a) == plain_polynomial(a)


def test_polynomial_with_zero_pivots(spark):
    a = [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]]
    assert W.characteristic(spark, a) == plain_polynomial(a) == [27, -54, 36, -10, 1]


def test_roots_are_counted_and_narrowed():
    c = [1]
    for r in (0, 0, 1, 3, 3, 3, 10):
        c = [x - r * y for x, y in zip([0, *c], [*c, 0])]
    assert [W.roots_beyond(c, k, 0) for k in (-1, 0, 1, 2, 3, 10)] == [7, 5, 4, 4, 1, 0]
    assert W.roots_beyond(c, 5, 1) == 4                       # beyond 5/2
    assert W.largest_roots(c, 2, 40) == [(10 << 40, 1), (3 << 40, 3)]
    found = W.largest_roots([2, -4, 1], 2, 60)               # 2 +- sqrt(2)
    assert [r / 2 ** 60 for r, _ in found] == pytest.approx([2 + math.sqrt(2), 2 - math.sqrt(2)], rel=1e-15)
    assert W.largest_roots([0, 0, 0, 1], 5, 10) == []


def test_primes():
    found = W.primes(60)
    assert found == sorted(set(found), reverse=True) and found[0] == 2 ** 31 - 1
    assert all(pow(a, p - 1, p) == 1 for p in found for a in (2, 3, 5))


def check(rows, x: np.ndarray, distinct: np.ndarray, scale: float = 1e-9):
    """Whitened rows against numpy's eigenvectors, up to sign."""
    n, v = len(distinct), np.cov(distinct.T, bias=True)
    e, u = np.linalg.eigh(v)
    top = np.argsort(-e)[:16]
    want = (x - distinct.mean(axis=0)) @ u[:, top] / np.sqrt(e[top])
    got = np.array([r.whitened for r in rows])
    sign = np.sign((want * got).sum(axis=0))
    assert np.abs(got - want * sign).max() < scale and rows[0].n == n
    assert rows[0].explained == pytest.approx((e[top] / e.sum()).tolist(), rel=1e-9)
    s = distinct.sum(axis=0)
    assert [int(r.deviation) for r in rows] == [int(((n * one - s) ** 2).sum()) for one in x.astype(object)]
    assert 0 <= rows[0].identity_error < 1e-9


def test_table_equals_dense_algebra(spark):
    table = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    rows = sorted(W.whiten(table).collect(), key=lambda r: r.vec_id)
    x = np.floor(64 * np.array([r.embedding for r in sorted(table.collect(), key=lambda r: r.vec_id)], float)).astype(np.int64)
    check(rows, x, np.unique(x, axis=0))
    got = op13_whitening(spark, SF_MID)
    assert got.count() == 16 * len(rows) and dict(got.dtypes)["component"] == "int" and dict(got.dtypes)["deviation"] == "bigint"
    some = {r.component: r for r in got.filter(f"vec_id = {rows[7].vec_id}").collect()}
    assert [some[k + 1].whitened for k in range(16)] == rows[7].whitened
    assert [some[k + 1].explained for k in range(16)] == rows[0].explained


def test_copies_count_once_and_large_numbers_stay_exact(spark):
    rnd = np.random.default_rng(8)
    x = rnd.integers(-10 ** 7, 10 ** 7, (40, 20))
    vectors = [(k % 9, [float(v) / 64 for v in x[k % 40]]) for k in range(200)] + [(5, [float(v) / 64 for v in x[3]])] * 100
    rows = W.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    order = {tuple(v): k for k, v in enumerate(x.tolist())}
    assert len(rows) == 300 and rows[0].n == len(order) == 40
    s = x.sum(axis=0)
    assert sorted(int(r.deviation) for r in rows) == sorted(
        sum((40 * int(64 * c) - int(t)) ** 2 for c, t in zip(v, s)) for _, v in vectors)


def test_equal_eigenvalues_and_low_rank(spark):
    vectors = [(k, [float(s) if k // 2 == j else 0.0 for j in range(5)]) for k in range(6) for s in [1 - 2 * (k % 2)]]
    rows = W.whiten(spark.createDataFrame(vectors, "vec_id int, embedding array<float>")).collect()
    assert all(len(r.whitened) == 3 for r in rows) and rows[0].explained == pytest.approx([1 / 3] * 3, rel=1e-12)
    w = np.array([r.whitened for r in rows])
    assert np.abs(w.T @ w / 6 - np.eye(3)).max() < 1e-9 and rows[0].identity_error < 1e-9


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [2.0, 2.0], "b"), (3, [3.0, 9.5], None), (4, None, "c"), (5, [], "c"),
            (6, [None, 1.0], "c"), (7, [nan, 1.0], "c"), (8, [inf, 1.0], "c"), (9, [1.0, 2.0, 3.0], "c"), (10, [-inf, 0.0], "c")]
    found = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")).collect()
    assert sorted(str(r.vec_id) for r in found) == ["1", "1", "3", "None"] and {r.n for r in found} == {3}
    assert all(len(r.whitened) == 2 for r in found)
    same = W.whiten(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>, n string")).collect()
    assert [(r.n, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same] == [(1, [], [], 0.0, 0)] * 2
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert W.whiten(none).collect() == []
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 2.0])]
    assert len(W.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()) == 3

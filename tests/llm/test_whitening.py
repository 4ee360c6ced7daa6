"""op12: components against an eigendecomposition, deviations against exact arithmetic, odd vectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from kinframe.llm import queries
from kinframe.llm import whitening as w


def plain(vectors):
    """vec_id -> x of rows that count, the distinct x-vectors."""
    width = max((len(v) for _, v in vectors if v is not None), default=0)
    xs = []
    for i, v in vectors:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            xs.append((i, [math.floor(256 * c) for c in v] + [0] * (width - len(v))))
    return xs, [list(x) for x in sorted({tuple(x) for _, x in xs})]


def check(rows, vectors, tolerance=1e-9):
    xs, fit = plain(vectors)
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    _, sigma, vt = np.linalg.svd(a, full_matrices=False)
    rank = int((sigma > sigma[0] * max(a.shape) * 2.3e-16).sum())
    most = min(4, rank)
    e = sigma**2 / n
    assert len(rows) == len(xs) * most
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for k in range(most):
        mine = sorted((r.vec_id, r.deviation, r.whitened) for r in rows if r.component == k + 1)
        want = sorted((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), float((np.array(x) - np.array(sums) / n) @ vt[k] / math.sqrt(e[k]))) for i, x in xs)
        assert [m[:2] for m in mine] == [v[:2] for v in want]
        got, ref = np.array([m[2] for m in mine]), np.array([v[2] for v in want])
        assert min(np.abs(got - ref).max(), np.abs(got + ref).max()) < tolerance
        assert [r.explained for r in rows if r.component == k + 1] == pytest.approx([e[k] / e.sum()] * len(xs), rel=1e-9)


def some(rng, n, d):
    return [(i, [float(c) for c in row]) for i, row in enumerate(rng.standard_normal((n, d)) * np.linspace(3, 1, d))]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, n int, component int").repartition(3)


def test_components(spark):
    vectors = some(np.random.default_rng(1), 300, 6)
    copies = [(1000 + i, vectors[0][1]) for i in range(150)]  # a third of all rows: counts once
    odd = [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2002, [math.nan] * 6), (2003, [math.inf, 0, 0, 0, 0, 0]), (2004, [1.0, 2.0]), (2005, []), (2006, [-0.0] * 6), (3, vectors[5][1])]
    odd = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in odd]
    check(w.whiten(frame(spark, vectors + copies + odd)).collect(), vectors + copies + odd)


def test_ill_conditioned(spark):
    """Directions 1e-9 as wide as the widest: a Cholesky factor of the plain Gram matrix would be noise there."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(10**6), 10**6, (400, 3))
    near = np.concatenate([base * 1000, base[:, :1] * 1000 + rng.integers(-1, 2, (400, 1))], axis=1)
    vectors = [(i, [float(c) / 256 for c in row]) for i, row in enumerate(near)]
    rows = w.whiten(frame(spark, vectors)).collect()
    a = near - near.mean(axis=0)
    # the narrow direction against the one that extended precision gives: residual of the fourth column on the first
    fourth = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component)) if r.component == 4])
    noise = a[:, 3] - a[:, 0]
    part = noise - a[:, :3] @ np.linalg.lstsq(a[:, :3], noise, rcond=None)[0]
    assert len(fourth) == 400 and abs(np.corrcoef(fourth, part)[0, 1]) > 0.9999


def test_dependent_and_constant_entries(spark):
    vectors = [(i, [float(a), 2.0 * int(a), 7.0, float(b)]) for i, (a, b) in enumerate(np.random.default_rng(3).integers(-50, 50, (60, 2)))]
    rows = w.whiten(frame(spark, vectors)).collect()
    check(rows, vectors)
    assert {r.component for r in rows} == {1, 2}
    for few in ([(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])], [(1, None)], []):
        assert w.whiten(frame(spark, few)).count() == 0
    two = w.whiten(frame(spark, [(None, [1.0, 2.0]), (None, [3.0, 9.0])])).collect()
    assert sorted(r.whitened for r in two) == pytest.approx([-1, 1]) and {r.component for r in two} == {1}


def test_numbers_beyond_a_long(spark):
    big = [(1, [2.0**45, 0.0]), (2, [-(2.0**45), 1.0]), (3, [0.0, 2.0]), (4, [2.0**60, 0.0])]
    rows = w.whiten(frame(spark, big)).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and {r.vec_id: r.deviation for r in rows} == {1: None, 2: None, 3: (3 * 512 - 768) ** 2}
    assert w.deviations(np.array([[2**40], [3]]), 4, np.array([0], dtype=object)) == [None, 144]


def test_triangles():
    rng = np.random.default_rng(4)
    a, r = rng.standard_normal((20, 5)), np.triu(rng.standard_normal((5, 5))) + 3 * np.eye(5)
    assert np.allclose(w.solve_right(a, r) @ r, a)
    g = a.T @ a
    plain_r = w.triangle(g, 20, first=False)
    assert np.allclose(plain_r.T @ plain_r, g) and np.allclose(plain_r, np.triu(plain_r))
    singular = np.outer(a[0], a[0])
    shifted = w.triangle(singular, 20, first=False)
    assert np.isfinite(shifted).all() and np.allclose(shifted.T @ shifted, singular, atol=1e-6)


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    table = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, sf).collect(), table)

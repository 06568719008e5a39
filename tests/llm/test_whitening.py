from fractions import Fraction

import numpy as np
import pytest

from basketlens.llm.bidiagonal import bidiagonal, dqds, right_vectors
from basketlens.llm.whitening import deviations, whiten

SCHEMA = "vec_id long, embedding array<double>, component string, n string, size string"


def matrices():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    p, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 3.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield from (np.linalg.qr(rng.standard_normal((5 * n, n)), mode="r") for n in (1, 2, 3, 8, 64))
    yield np.diag(10.0 ** -np.arange(12)) @ rng.standard_normal((12, 12))
    yield q @ np.diag([5] * 10 + [3] * 10 + [1] * 10) @ p
    yield q @ np.diag(5 + 1e-9 * np.arange(30)) @ p
    yield np.linalg.cholesky(wilkinson).T
    yield np.kron(np.eye(3), np.array([[3.0, 1.0], [0.0, 2.0]]))
    yield rng.standard_normal((12, 3)) @ rng.standard_normal((3, 12))
    yield np.ones((10, 10))
    yield 1e150 * np.eye(4)


@pytest.mark.parametrize("m", list(matrices()))
def test_solver_against_numpy(m):
    a, b, v = bidiagonal(m)
    u = m @ v
    assert np.allclose(u.T @ u, (np.diag(a) + np.diag(b, 1)).T @ (np.diag(a) + np.diag(b, 1)), rtol=1e-12, atol=1e-13 * (u.T @ u).max())
    exact = np.linalg.svd(m, compute_uv=False) ** 2
    assert np.abs(dqds(a, b) - exact).max() <= 1e-13 * exact[0]
    values, vectors = right_vectors(m, 32, 1e-22)
    k = len(values)
    assert k == min(32, np.sum(exact > 1e-22 * exact[0])) or exact[k] < 1e-20 * exact[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
    assert np.abs(m.T @ (m @ vectors) - vectors * values).max() < 1e-13 * exact[0]


def test_dqds_keeps_the_digits_of_small_values():
    a = np.array([1.0, 1e-3, 1e-6, 1e-9])
    b = np.array([1e-2, 1e-5, 1e-8])
    product = 1
    for x in dqds(a, b):
        product *= Fraction(float(x))
    exact = 1
    for x in a:
        exact *= Fraction(float(x)) ** 2
    assert abs(float(product / exact) - 1) < 1e-13


def slow(vectors, components=32):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return n, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x], centred @ directions / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("size", [1, 5, 40])
def test_against_brute_force(spark, size):
    rng = np.random.default_rng(size)
    good = (rng.standard_normal((400, size)) * np.linspace(0.2, 3, size)).tolist()
    rows = [(i, v, "clash", "clash", "clash") for i, v in enumerate(good)]
    other = [(9000, [1.0] * (size + 1)), (9001, [2.0] * (size + 1)), (9002, None), (9003, []), (9004, [float("nan")] * size), (9005, [None] + [0.0] * (size - 1)), (9006, [float("inf")] * size)]
    rows += [(i, v, "clash", "clash", "clash") for i, v in other]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(20)
    found = whiten(frame).collect()
    n, deviation, white, explained = slow(good)
    mine = [r for r in found if r.vec_id < 9000]
    width = min(32, size)
    assert sorted((r.vec_id, r.component) for r in mine) == [(i, c) for i in range(400) for c in range(1, width + 1)]
    got = np.empty_like(white)
    for r in mine:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(r.explained - explained[r.component - 1]) <= 1e-10 * explained[r.component - 1]
        assert r.identity_error < 1e-9
        got[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-7
    # Vectors of another length: one direction has variance.
    theirs = [r for r in found if r.vec_id >= 9000]
    assert {(r.vec_id, r.n) for r in theirs} == {(9000, 2), (9001, 2)}
    assert all((r.whitened is None) == (r.component > 1) for r in theirs)
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) for r in theirs if r.component == 1)


def test_one_row_repeated_rows_and_huge_entries(spark):
    rows = [(1, [0.5, 2.0]), (1, [0.5, 2.0]), (None, [0.5, 2.0])]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(found) == 6
    assert all(r.n == 3 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error == 0 for r in found)
    huge = [(i, [1e300 * (i % 2), float(i)]) for i in range(6)]
    found = whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 12 and all(r.deviation is None for r in found)


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[3_000_000_001, 5], [1, 7]])
    sums = [int(s) for s in x.sum(axis=0)]
    assert deviations(x, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums)) if sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums)) < 2**63 else None for row in x]


def test_empty_input(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []

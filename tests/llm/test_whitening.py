"""Whitening against a dense eigensolver in exact integers, and the solver on matrices with awkward spectra."""

import math
import random

import numpy as np
import pytest

from stormrail.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int"


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return n, s, x, y, e[::-1], u[:, ::-1]


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return w.whitened(df.repartition(parts) if rows else df).collect()


def clustered(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6, d))[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_equals_dense_solver(spark):
    x = clustered(700, 32)
    out = run(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    n, s, ints, y, e, u = dense(x)
    assert len(out) == 700 * 8 and {r.component for r in out} == set(range(1, 9))
    z = np.zeros((700, 8))
    for r in out:
        z[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 700 and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-12)
    want = y @ u[:, :8] / np.sqrt(e[:8])
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z * sign - want).max() < 1e-10
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-12
    c = z - z.mean(axis=0)
    assert np.abs(c.T @ c / 700 - np.eye(8)).max() < 1e-12
    exact = [sum((700 * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in ints]
    assert all(r.deviation == exact[r.vec_id] for r in out)


def test_dropped_rows_repeats_and_nulls(spark):
    x = clustered(60, 5, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist())] * 20 + [(None, x[5].tolist())]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [math.nan] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    random.Random(0).shuffle(rows)
    out = run(spark, rows + bad)
    n, _, _, y, e, u = dense([v for _, v in rows])
    assert n == 81 and {r.n for r in out} == {81} and len(out) == 81 * 5
    assert not {900, 901, 902, 903} & {r.vec_id for r in out} and sum(r.vec_id is None for r in out) == 5
    one = {(r.vec_id, r.component): r.whitened for r in out}
    z = np.array([[one[i, c] for c in range(1, 6)] for i, _ in rows])
    assert np.abs(z.T @ z / 81 - np.eye(5)).max() < 1e-12
    assert len({round(abs(r.whitened), 12) for r in out if r.vec_id == 3}) == 5


def test_low_rank_has_fewer_components(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 0.0, 5.0]) for i in range(50)]
    out = run(spark, rows)
    assert {r.component for r in out} == {1} and out[0].explained == pytest.approx(1.0)


def test_no_variation_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5, 0.25])]) == []
    assert run(spark, [(i, [0.5, 0.25]) for i in range(10)]) == []
    assert run(spark, [(1, None), (2, [math.nan])]) == [] and run(spark, [(1, []), (2, [])]) == []


def test_shorter_vectors_and_huge_entries(spark):
    out = run(spark, [(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [3e38, 1.0]), (5, [-3e38, 0.5])])
    assert {r.vec_id for r in out} == {1, 2, 3, 4, 5} and all(math.isfinite(r.whitened) for r in out)
    x = [[1024, 2048], [1024, 0], [0, 0], [1 << 40, 1024], [-(1 << 40), 512]]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((5 * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    assert all(r.deviation == (exact[r.vec_id - 1] if exact[r.vec_id - 1] < 2 ** 63 else None) for r in out)


@pytest.mark.parametrize("spectrum", [np.ones(40), 0.8 ** np.arange(200), np.r_[np.ones(3), np.zeros(37)],
                                      np.r_[5.0, 5.0, 5.0, np.linspace(1, 0.9, 61)], np.r_[1e6, 1.0 + np.zeros(30)],
                                      np.zeros(10), np.array([2.0])])
def test_solver_on_spectra(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(d, d)))
    m = q @ np.diag(spectrum) @ q.T
    m = (m + m.T) / 2
    got = w.leading_pairs(lambda x: m @ x, d, 8)
    want = np.sort(spectrum)[::-1][:8]
    assert np.abs(got.values - want).max() <= 1e-13 * max(want[0], 1e-300) + 1e-300
    assert np.linalg.norm(m @ got.vectors - got.vectors * got.values, axis=0).max() <= 2e-13 * max(want[0], 1e-300)
    assert np.abs(got.vectors.T @ got.vectors - np.eye(len(want))).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    m, b = q @ np.diag(np.linspace(-1, 2, 30)) @ q.T, rng.normal(size=(30, 4))
    b[:, 2] = 0
    t = w.minres(lambda x, _: m @ x, b, 36, 1e-13)  # rounding costs a few steps beyond 30
    assert np.abs(m @ t - b).max() < 1e-9 and not t[:, 2].any()

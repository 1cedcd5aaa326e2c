import math

import numpy as np
import pytest

from phaseframe.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, x int, n int"


def brute(rows):
    """n, sums, eigenvalues and vectors of the distinct integer vectors, by a dense solver."""
    xs = {v: tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in {tuple(v) for _, v in rows}}
    fit = np.array(sorted(set(xs.values())), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    return n, s, cov, e[::-1], u[:, ::-1]


def check(spark, rows, extra=(), tol=1e-9):
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows] + [(*r, "b", 1, 2) for r in extra], SCHEMA).repartition(5)
    out = whitening.whiten(df).collect()
    n, s, cov, e, u = brute(rows)
    k = int((e[:16] > 1e-11 * e[0]).sum())
    assert len(out) == len(rows) * k
    got = {}
    for r in out:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], r["whitened"])
        assert r["n"] == n and r["identity_error"] <= 1e-9 and r["residual"] <= 1e-9
        assert math.isclose(r["explained"], e[r["component"] - 1] / np.trace(cov), rel_tol=1e-9)
    signs = None
    for i, v in rows:
        x = np.array([math.floor(64 * c) + 1_000_000 for c in v], dtype=object)
        deviation = int(((n * x - s.astype(object)) ** 2).sum())
        z = ((n * x - s.astype(object)) / n).astype(float) @ u[:, :k] / np.sqrt(e[:k])
        mine = np.array([got[i, deviation][c + 1] for c in range(k)])
        if signs is None and (np.abs(z) > 1e-3).all():
            signs = np.sign(z * mine)
        if signs is not None:
            assert np.allclose(mine, z * signs, atol=tol)
    assert signs is not None
    return out


def test_against_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=40) * np.linspace(2, 0.3, 40)).tolist()) for k in range(300)]
    rows += [(k, rows[7][1]) for k in range(1000, 1200)]  # copies count once in the fit
    inf, nan = float("inf"), float("nan")
    extra = [(2000, None), (2001, [nan] + [0.0] * 39), (2002, [inf] + [0.0] * 39), (2003, [None] + [0.0] * 39), (2004, []), (2005, [1.0]), (2006, [1e300] * 40)]
    check(spark, rows, extra)


def test_more_dimensions_than_a_basis_holds(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=150) * 0.96 ** np.arange(150) * 3).tolist()) for k in range(400)]
    check(spark, rows, tol=1e-7)


def test_few_dimensions_low_rank_and_one_vector(spark):
    rng = np.random.default_rng(3)
    check(spark, [(k, rng.normal(size=3).tolist()) for k in range(50)])
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(1, 30)]  # one direction has all variance
    assert {r["component"] for r in check(spark, line)} == {1}
    df = spark.createDataFrame([(1, [1.0, 2.0], "", 0, 0), (2, [1.0, 2.0], "", 0, 0)], SCHEMA)
    assert whitening.whiten(df).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, [0.0, 1.0]), (1, [2.0, 0.5]), (None, [1.0, -3.0]), (4, [0.25, 0.75])]
    assert len(check(spark, rows)) == 8


def test_exact_deviation_of_large_entries(spark):
    df = spark.createDataFrame([(1, [1e6], "", 0, 0), (2, [-1e6], "", 0, 0), (3, [2.0**54], "", 0, 0)], SCHEMA)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert got == {1: None, 2: None, 3: None} or all(v is None or v >= 0 for v in got.values())
    small = spark.createDataFrame([(1, [1e6], "", 0, 0), (2, [-1e6], "", 0, 0)], SCHEMA)
    assert {r["deviation"] for r in whitening.whiten(small).collect()} == {(2 * 64 * 10**6) ** 2}


def test_rounds_end_with_small_residuals():
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    values = np.concatenate([[50.0, 50.0, 20.0], np.linspace(10, 0.1, 197)])
    a = basis * values @ basis.T
    e, u, rounds = whitening.lobpcg(lambda q: a @ q, 200, 6)
    assert np.allclose(e, values[:6], rtol=1e-12) and rounds < 100
    assert np.abs(a @ u - u * e).max() < 1e-10
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda q: a @ q + rng.normal(size=q.shape), 200, 6)

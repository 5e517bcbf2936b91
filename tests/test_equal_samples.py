"""Fits, matrices and audits pass over different rows with their numbers, and give what all rows give."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.audits import derivative_audit
from ridgeline.operators import fits, lipschitz, ridge


def _samples(spark, repeat=20):
    x = np.random.default_rng(3).uniform(-1, 1, (40, 2))
    f = (x @ [0.8, 0.6]) ** 3 + 0.1 * x[:, 1]
    rows = [(x[k].tolist(), float(f[k])) for k in range(40) for _ in range(1 + (repeat - 1) * (k % 2))]
    return spark.createDataFrame(rows, "x array<double>, fx double"), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def _seen(monkeypatch, module, name):
    """The numbers of rows of the tables that a step gets."""
    seen, whole = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *a, **k: (seen.append(df.count()), whole(df, *a, **k))[1])
    return seen


@pytest.mark.parametrize("norm, bound", [(1, "lower"), (math.inf, None)])
def test_norm_fits_pass_over_different_rows(spark, monkeypatch, norm, bound):
    df, x, f = _samples(spark)
    seen = [_seen(monkeypatch, fits, n) for n in ("grams", "_worst", "_summed")]
    basis = ridge.Basis("legendre", 2, (0.0, 0.0), (1.0, 1.0))
    fit = fits.norm_fit(df, basis, norm, bound)
    r = f - basis.matrix(x) @ fit.coefficients
    assert fit.loss == pytest.approx({1: np.abs(r).sum(), 2: np.sqrt(r @ r)}.get(norm, np.abs(r).max()), rel=1e-6) and fit.gap <= 1e-3
    assert {n for s in seen for n in s} == {40}


def test_ridge_fits_pass_over_different_rows(spark, monkeypatch):
    df, x, f = _samples(spark)
    seen = _seen(monkeypatch, ridge, "grams")
    fit = ridge.fit_ridge(df, 2, 1, 3, U0=[0.7, 0.7], rounds=1)
    assert set(seen) == {40}
    M = fit.basis.matrix(x @ fit.U)
    assert np.allclose(M.T @ (f - M @ fit.coefficients), 0, atol=1e-8)


def test_broken_gradients_look_at_equal_ones_once(spark, monkeypatch):
    g = spark.createDataFrame([([3.0, 0.0],)] * 30 + [([0.0, 1.0],)] * 5, "grad array<double>")
    seen = _seen(monkeypatch, lipschitz, "gradient_slack")
    assert lipschitz.broken_gradients(ridge.counted(g, "grad"), 4 * np.eye(2), -1e-9).first() == (35, 30)
    assert seen == [2]


def test_derivative_audits_step_equal_rows_once(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("double").alias("x"))
    calls = spark.sparkContext.accumulator(0)

    def counting(v):
        calls.add(1)
        return v * v

    steps = F.udf(counting, "double")
    found = derivative_audit(df, lambda y: steps(y[0]), [2 * F.col("x")], [F.col("x")], steps=4, low=-3.0, high=-1.0).first()
    assert found["e0"] < 1e-6 and calls.value == 3 * 4 * 2

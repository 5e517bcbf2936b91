"""Gaussian processes with fitted metrics and trends, exact and through inducing points."""

import numpy as np
import pytest

from ridgeline.operators import processes as gp


def frame(spark, X, f):
    return spark.createDataFrame([(i, x.tolist(), float(v)) for i, (x, v) in enumerate(zip(X, f))], "id long, x array<double>, fx double").cache()


@pytest.fixture(scope="module")
def samples():
    X = np.random.default_rng(3).uniform(-1, 1, (60, 2))
    return X, np.sin(3 * X[:, 0]) + 0.2 * X[:, 1] + 0.1 * X[:, 0] * X[:, 1]


def test_exponential_of_a_triangle():
    A = np.array([[0.3, 0, 0], [1.0, -2.0, 0], [0.5, 4.0, 1.5]])
    values, V = np.linalg.eig(A)
    assert np.allclose(gp.matrix_exponential(A), (V * np.exp(values)) @ np.linalg.inv(V))
    assert np.allclose(gp.matrix_exponential(np.zeros((2, 2))), np.eye(2))


@pytest.mark.parametrize("limit", [100, 20])
@pytest.mark.parametrize("structure, ell", [("scalar", [0.4]), ("diagonal", [0.5, -0.3]), ("triangular", [0.5, 0.7, -0.3])])
def test_slopes_are_those_of_the_likelihood(spark, samples, limit, structure, ell):
    X, f = samples
    df = frame(spark, X, f)
    of = gp._Likelihood(df, gp.Metric(structure, 2, np.eye(2)), gp.scaled_basis(df, gp.coords("x", 2), 1), limit, 1e-2)
    h, ell = 1e-3, np.array(ell)
    for k, slope in enumerate(of.at(ell).slope):
        e = h * np.eye(len(ell))[k]
        assert slope == pytest.approx((of.at(ell + e).nll - of.at(ell - e).nll) / (2 * h), rel=2e-3, abs=2e-3)


def test_inducing_points_agree_with_the_dense_formula(spark, samples):
    X, f = samples
    of = gp._Likelihood(frame(spark, X, f), gp.Metric("constant", 2, np.eye(2)), None, 20, 1e-3)
    K = gp._kernel(of.X, of.X, np.eye(2)) + 1e-3 * np.eye(20)
    C = gp._kernel(X, of.X, np.eye(2))
    S = C @ np.linalg.solve(K, C.T) + 1e-3 * np.eye(60)
    assert of.at(np.zeros(0)).nll == pytest.approx(0.5 * f @ np.linalg.solve(S, f) + 0.5 * np.linalg.slogdet(S)[1], rel=1e-8)


def test_richer_structures_fit_better(spark, samples):
    X, f = samples
    df = frame(spark, X, f)
    scalar = gp.fit_process(df, 2, "scalar", nugget=1e-4)
    both = gp.fit_process(df, 2, "diagonal", nugget=1e-4, start=[scalar.ell[0]] * 2)
    lower = gp.fit_process(df, 2, "triangular", nugget=1e-4, start=[both.ell[0], 0, both.ell[1]])
    assert scalar.nll > both.nll >= lower.nll and abs(both.L[0, 0]) > 2 * abs(both.L[1, 1])
    got = {r.id: r for r in lower.predict(df).collect()}
    assert max(abs(got[i].mean - v) for i, v in enumerate(f)) < 1e-2


def test_trend_is_found_and_carried_on(spark):
    X = np.random.default_rng(4).uniform(-1, 1, (50, 1))
    df = frame(spark, X, 2 - 3 * X[:, 0])
    for limit, nugget in ((100, 1e-6), (15, 1e-4)):
        fit = gp.fit_process(df, 1, "constant", degree=1, base=[[4.0]], limit=limit, nugget=nugget)
        far = fit.predict(spark.createDataFrame([(0, [9.0])], "id long, x array<double>")).first()
        assert far["mean"] == pytest.approx(2 - 27, abs=1e-2) and far["variance"] == pytest.approx(1)


def test_single_row_and_wrong_arguments(spark):
    one = frame(spark, np.array([[0.5]]), [2.0])
    assert gp.fit_process(one, 1, "constant").predict(one).first()["mean"] == pytest.approx(2, abs=1e-4)
    with pytest.raises(ValueError, match="no rows"):
        gp.fit_process(one.where("false"), 1)
    with pytest.raises(ValueError, match="structure"):
        gp.fit_process(one, 1, "full")

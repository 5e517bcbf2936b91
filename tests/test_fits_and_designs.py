"""Fits with bounds, least and partial matrices, and keyed designs, against brute force and what their proofs say."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import clusters, fits, lipschitz, ridge, summaries
from ridgeline.operators.domain import coords
from ridgeline.operators.programs import least_quadratic, least_trace
from ridgeline.sources import tables


def frame(spark, x, f, parts=3):
    rows = [(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, f, strict=True))]
    return tables.stored(spark.createDataFrame(rows, "id long, x array<double>, fx double").repartition(parts), "samples")


def grads(spark, g):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(g)], "id long, grad array<double>")


def least_eigenvalue(H, g):
    return min(np.linalg.eigvalsh(H - np.outer(v, v))[0] for v in g)


def pair_gap(H, x, f, eps=0.0):
    p = x[:, None] - x[None]
    return (np.einsum("abi,ij,abj->ab", p, H, p) - np.maximum(np.abs(f[:, None] - f[None]) - eps, 0) ** 2).min()


def test_programs_equal_brute_force():
    rng = np.random.default_rng(0)
    x, f = rng.uniform(-1, 1, 9), rng.standard_normal(9)
    V = np.vander(x, 2, increasing=True)
    A = np.vstack([np.column_stack([V, np.ones(9)]), np.column_stack([-V, np.ones(9)])])
    u, z = least_quadratic(np.zeros((3, 3)), np.array([0, 0, 1.0]), A, np.concatenate([f, -f]))
    levels = []
    for rows in itertools.combinations(range(9), 3):
        M = np.column_stack([V[list(rows)], np.array([1, -1, 1.0])[np.argsort(np.argsort(x[list(rows)]))]])
        levels.append(abs(np.linalg.solve(M, f[list(rows)])[2]))
    assert u[2] == pytest.approx(max(levels), rel=1e-7) and z.min() >= 0
    g = rng.standard_normal((40, 3)) * [3, 1, 1e-2]
    shapes = lipschitz.symmetric_shapes(3)
    h, low, _, _ = least_trace(shapes, np.zeros((0, 3)), np.zeros(0), g)
    H = np.einsum("k,kij->ij", h, np.array(shapes))
    assert least_eigenvalue(H, g) >= 0 and low <= np.trace(H) <= low * (1 + 1e-5)


def test_norm_fits_have_their_bounds(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (300, 1))
    f = np.exp(x[:, 0]) + 0.1 * rng.standard_normal(300)
    df = frame(spark, x, f)
    basis = ridge.scaled_basis(df, coords("x", 1), 2)
    V = basis.matrix(x)
    norms = {1: lambda r: np.abs(r).sum(), 2: lambda r: math.sqrt((r * r).sum()), math.inf: lambda r: np.abs(r).max()}
    for norm, size in norms.items():
        for bound in (None, "lower", "upper"):
            fit = fits.norm_fit(df, basis, norm, bound)
            r = f - V @ fit.coefficients
            assert fit.closed and fit.gap <= 1e-3 and size(r) == pytest.approx(fit.loss, rel=1e-6)
            assert bound != "lower" or r.min() >= -1e-9
            assert bound != "upper" or r.max() <= 1e-9
            # No other coefficients near these get below the bound.
            for _ in range(200):
                c = fit.coefficients + rng.standard_normal(3) * 10.0 ** rng.uniform(-4, -1)
                other = f - V @ c
                if bound == "lower" and other.min() < 0 or bound == "upper" and other.max() > 0:
                    continue
                assert size(other) >= fit.bound * (1 - 1e-9)
    # A shifted free fit is worse than the one-sided one.
    free = fits.norm_fit(df, basis).coefficients
    r = f - V @ free
    assert fits.norm_fit(df, basis, 2, "lower").loss < norms[2](r - r.min())
    with pytest.raises(ValueError):
        fits.norm_fit(df.limit(0), basis)
    with pytest.raises(ValueError):
        fits.norm_fit(df, basis, 3)


def test_equal_and_exact_rows_are_fitted(spark):
    x = np.repeat(np.linspace(-1, 1, 12), 5)[:, None]
    f = 2 * x[:, 0] ** 2 - 1
    df = frame(spark, x, f)
    basis = ridge.scaled_basis(df, coords("x", 1), 2)
    for norm in (1, 2, math.inf):
        assert np.abs(f - basis.matrix(x) @ fits.norm_fit(df, basis, norm).coefficients).max() < 1e-6
    assert np.abs(f - basis.matrix(x) @ fits.norm_fit(df, basis, math.inf, "lower").coefficients).max() < 1e-6


@pytest.mark.parametrize(("norm", "bound"), [(math.inf, None), (1, "lower"), (2, "upper")])
def test_ridges_in_other_norms(spark, norm, bound):
    rng = np.random.default_rng(2)
    x, u = rng.uniform(-1, 1, (200, 3)), np.array([0.6, -0.8, 0.0])
    df = frame(spark, x, (x @ u) ** 3 + x @ u + 0.05 * x[:, 2] * x[:, 0])
    found = fits.norm_ridge(df, 3, 1, 3, norm, bound, U0=np.array([0.5, -0.5, 0.4]))
    r = np.array([v[0] for v in df.select(F.col("fx") - found.ridge.value(coords("x", 3))).collect()])
    size = {1: np.abs(r).sum(), 2: math.sqrt((r * r).sum()), math.inf: np.abs(r).max()}[norm]
    assert size == pytest.approx(found.fit.loss, rel=1e-6) and found.fit.gap <= 1e-2
    assert all(a >= b for a, b in itertools.pairwise(found.losses)) and found.losses[-1] < 0.5 * found.losses[0]
    assert abs(found.ridge.U[:, 0] @ u) > 0.98
    assert (bound != "lower" or r.min() >= -1e-9) and (bound != "upper" or r.max() <= 1e-9)


def test_exact_ridge_is_found_in_the_sup_and_1_norm(spark):
    rng = np.random.default_rng(3)
    x, u = rng.uniform(-1, 1, (100, 4)), np.array([0.5, 0.5, -0.5, 0.5])
    df = frame(spark, x, (x @ u) ** 3 + x @ u)
    for norm in (1, math.inf):
        found = fits.norm_ridge(df, 4, 1, 3, norm)
        assert found.closed and found.fit.loss < 1e-6 and abs(found.ridge.U[:, 0] @ u) == pytest.approx(1)
    with pytest.raises(ValueError):
        fits.norm_ridge(df.limit(3), 4, 1, 3)


def test_feasible_matrix_for_uneven_gradients(spark):
    g = np.array([[1e4, 0.0], [0.0, 1e-3]])
    H = lipschitz.feasible_for_gradients(grads(spark, g), np.zeros((2, 2)), 2)
    assert least_eigenvalue(H, g) >= 0 and np.trace(H) <= 1.001e8 and H[1, 1] <= 1.001e-6
    rng = np.random.default_rng(4)
    g = rng.standard_normal((80, 4)) * [1e3, 1, 1e-3, 0]
    H = lipschitz.feasible_for_gradients(grads(spark, g), np.zeros((4, 4)), 4)
    s = np.array([1e3, 1, 1e-3, 1])
    assert min(np.linalg.eigvalsh((H - np.outer(v, v)) / np.outer(s, s))[0] for v in g) >= -1e-12
    empty = grads(spark, g).limit(0)
    assert (lipschitz.feasible_for_gradients(empty, np.eye(4), 4) == np.eye(4)).all()


def test_least_matrices_of_mixed_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (40, 3))
    a = np.array([1, 0.5, 0.1])
    f, g = np.sin(x @ a), np.cos(x[:20] @ a)[:, None] * a * 1.2
    samples, steep = frame(spark, x, f), grads(spark, g)
    for eps, gradients, diagonal in ((0.0, None, False), (0.1, None, False), (0.0, steep, False), (0.0, steep, True)):
        H, gap = lipschitz.matrix_from_samples(samples, 3, eps=eps, gradients=gradients, diagonal=diagonal)
        assert gap <= 1e-3 and pair_gap(H, x, f, eps) >= -1e-12
        assert gradients is None or least_eigenvalue(H, g) >= -1e-12
        assert not diagonal or (H == np.diag(np.diag(H))).all()
        # A certificate has to fail for a matrix that is merely large.
        assert np.trace(1e9 * np.eye(3)) * (1 - 1e-3) > np.trace(H)
    flat = lipschitz.least_matrix(3, frame(spark, x, 0 * f))
    assert flat.closed and not flat.H.any()


def test_partial_matrix_is_near_the_best_of_a_grid(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (30, 2))
    f = np.tanh(2 * x @ [0.8, 0.6]) + 0.2 * x[:, 0]
    samples = frame(spark, x, f)
    free, gap = lipschitz.matrix_from_samples(samples, 2)
    full = lipschitz.partial_matrix(2, 2, samples)
    one = lipschitz.partial_matrix(2, 1, samples)  # any symmetric matrix of two inputs has this form
    for found in (full, one):
        assert found.closed and pair_gap(found.H, x, f) >= -1e-12
        assert np.trace(found.H) == pytest.approx(np.trace(free), rel=5e-3)
        assert np.allclose(found.L @ found.L, found.H)
    g = rng.standard_normal((30, 3)) * [2, 1, 0.3]
    found = lipschitz.partial_matrix(3, 1, gradients=grads(spark, g))
    assert found.gap <= 1e-3 and least_eigenvalue(found.H, g) >= -1e-9
    best = math.inf
    for t, s in itertools.product(np.linspace(0, math.pi, 25), repeat=2):
        U = np.array([[math.sin(t) * math.cos(s)], [math.sin(t) * math.sin(s)], [math.cos(t)]])
        h, _, _, _ = least_trace(lipschitz._partial_shapes(U), np.zeros((0, 3)), np.zeros(0), g, tol=1e-4)
        best = min(best, h[0] + 2 * h[1])
    assert np.trace(found.H) <= 1.01 * best
    with pytest.raises(ValueError):
        lipschitz.partial_matrix(3, 0, samples)


def test_bandwidths_of_every_target(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (60, 2)) * [1, 100]
    df = frame(spark, x, x @ [3.0, -1.0] + 2)
    found = summaries.perplexity_bandwidths(df.select("id", "x").limit(20), df, 2, 10)
    for r in found.collect():
        d2 = ((x - np.array(r["x"])) ** 2).sum(axis=1)
        assert r["beta"] == pytest.approx(summaries.perplexity_beta(d2, 10), rel=1e-6)
    slopes = summaries.local_linear(found, df, 2).select(F.slice("c", 2, 2)).collect()
    assert np.array([r[0] for r in slopes]) == pytest.approx(np.tile([3.0, -1.0], (20, 1)), abs=1e-6)
    with pytest.raises(ValueError):
        summaries.perplexity_bandwidths(df.select("id", "x"), df, 2, 60)


def candidates(spark, z):
    return tables.stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>").repartition(3), "candidates")


def test_least_balls_of_all_keys(spark):
    rng = np.random.default_rng(8)
    groups = {0: rng.standard_normal((200, 3)), 1: np.array([[1.0, 2.0, 3.0]] * 4), 2: np.array([[0.0, 0, 0], [2, 0, 0]]), 7: 1e6 + rng.uniform(0, 1, (50, 3))}
    rows = [(k, v.tolist()) for k, p in groups.items() for v in p]
    found = {r["key"]: r for r in clusters.enclosing_balls(spark.createDataFrame(rows, "key long, z array<double>"), 3).collect()}
    for k, p in groups.items():
        r = found[k]
        assert np.linalg.norm(p - np.array(r["center"]), axis=1).max() <= r["radius"] + 1e-9
        assert r["radius"] <= r["bound"] * 1.0011 + 1e-9
    assert found[2]["radius"] == pytest.approx(1, rel=1e-3) and found[1]["radius"] == pytest.approx(0, abs=1e-9)
    assert clusters.enclosing_balls(spark.createDataFrame([], "key long, z array<double>"), 3).count() == 0


def test_minimax_designs(spark):
    rng = np.random.default_rng(9)
    z = rng.uniform(0, 1, (400, 2))
    df = candidates(spark, z)

    def fill(c):
        return np.linalg.norm(z[:, None] - c[None], axis=2).min(axis=1).max()

    from ridgeline.operators.design import coffee_house

    greedy = z[[r["id"] for r in coffee_house(df, 6).orderBy("place").collect()]]
    for centers, distance in (clusters.minimax_lloyd(df, 2, 6), clusters.minimax_particles(df, 6, particles=4, rounds=6), clusters.spread_designs(df, {0: greedy}, rounds=10)[0]):
        assert len(centers) == 6 and fill(centers) == pytest.approx(distance) and distance < fill(greedy)
    n, low, centers, distance = clusters.cover_size(df, 0.3, rounds=6)
    assert low <= n == len(centers) and fill(centers) == pytest.approx(distance) and distance <= 0.3
    assert n <= 10 and low >= 2
    got = {(r["key"], r["size"]): r["distance"] for r in clusters.fill_distances(df, {0: greedy, 5: z[:4]}, [1, 2, 4]).collect()}
    assert got == pytest.approx({(k, s): fill(c[:s]) for k, c in ((0, greedy), (5, z[:4])) for s in (1, 2, 4)})
    rates = clusters.design_rates(df, {("a", t): z[t * 10 : t * 10 + 8] for t in range(3)}, [4, 8]).collect()
    for r in rates:
        want = np.percentile([fill(z[t * 10 : t * 10 + r["size"]]) for t in range(3)], [25, 50, 75])
        assert r["trials"] == 3 and [r["low"], r["median"], r["high"]] == pytest.approx(want)


def test_matching_takes_each_row_once():
    rng = np.random.default_rng(10)
    a = rng.standard_normal((9, 3))
    b = (a + 1e-3 * rng.standard_normal((9, 3)))[rng.permutation(9)]
    assert np.abs(clusters.matched(a, b) - a).max() < 0.01


def test_swaps_and_low_rank_points(spark):
    rng = np.random.default_rng(11)
    rows = [(d, i, [float((p[i] + 0.5) / 8) for p in perms]) for d in range(3) for perms in [[rng.permutation(8) for _ in range(2)]] for i in range(8)]
    df = spark.createDataFrame(rows, "design_id long, id long, x array<double>")
    again = [clusters.swapped(df, 300, seed=1).orderBy("design_id", "id").collect() for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == 24

    def score(x):
        d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag(np.full(len(x), np.inf))
        return np.sort(d.min(axis=1)).round(9).tolist()

    for d in range(3):
        x, y = (np.array([r[2] for r in rs if r[0] == d]) for rs in (rows, again[0]))
        assert (np.sort(y, axis=0) == np.sort(x, axis=0)).all() and score(y) > score(x)
    L = np.array([[1.0, 1, 1, 1, 1, 1, 1, 1]])
    p = clusters.low_rank_points(spark.range(400), L, [-1] * 8, [2] * 8).collect()
    x, z = np.array([r["x"] for r in p]), np.array([r["z"] for r in p])
    assert x.min() >= -1 - 1e-9 and x.max() <= 2 + 1e-9 and z == pytest.approx(x @ L.T)
    assert np.ptp(z) > 0.9 * 24  # nearly the whole range of L, which even points don't reach


def test_tight_envelope_bounds_all_rows_with_the_least_area(spark):
    rng = np.random.default_rng(12)
    y = np.concatenate([[0.0, 1.0], rng.uniform(0, 1, 300)])
    f = np.sin(6 * y) * 50 + rng.uniform(-5, 5, 302)
    df = tables.stored(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, f, strict=True)], "y1 double, fx double"), "shadow")
    nodes, gap = summaries.tight_envelope(df, 6)
    rows = nodes.orderBy("node").collect()
    at, lb, ub = (np.array([r[c] for r in rows]) for c in ("y", "lb", "ub"))
    assert gap <= 1e-4 and (np.interp(y, at, ub) >= f - 1e-6).all() and (np.interp(y, at, lb) <= f + 1e-6).all()
    for _ in range(300):  # no lower curve above all rows
        other = ub + rng.standard_normal(7) * 10.0 ** rng.uniform(-2, 1)
        if (np.interp(y, at, other) >= f).all() and other.max() <= f.max():
            assert np.trapezoid(other, at) >= np.trapezoid(ub, at) - 1e-3 * np.trapezoid(ub - lb, at)
    assert summaries.tight_envelope(df.limit(0), 6)[0].count() == 0
    flat, gap = summaries.tight_envelope(df.withColumn("fx", F.lit(2.0)), 3)
    assert gap <= 1e-4 and all(r["lb"] == pytest.approx(2) and r["ub"] == pytest.approx(2) for r in flat.collect())


def test_ridge_hessian_equals_differences(spark):
    rng = np.random.default_rng(13)
    U = np.linalg.qr(rng.standard_normal((3, 2)))[0]
    basis = ridge.Basis("legendre", 3, (0.1, -0.2), (0.5, 0.7))
    r = ridge.Ridge(U, basis, rng.standard_normal(len(basis.indices)))
    df = spark.createDataFrame([([0.3, -0.4, 0.2],)], "x array<double>")
    x, e = coords("x", 3), 1e-4
    h = df.select(*[v for row in r.hessian(x) for v in row]).first()

    def at(i, a, j, b):
        return r.value([c + (a * e if k == i else 0) + (b * e if k == j else 0) for k, c in enumerate(x)])

    d = df.select(*[(at(i, 1, j, 1) - at(i, 1, j, -1) - at(i, -1, j, 1) + at(i, -1, j, -1)) / (4 * e * e) for i in range(3) for j in range(3)]).first()
    assert np.array(h) == pytest.approx(np.array(d), abs=1e-5)


def test_sobol_axes_are_nets_in_many_dimensions(spark):
    from ridgeline.operators.design import sobol
    from ridgeline.operators.domain import box

    x = np.array([r["x"] for r in sobol(spark, box([0] * 12, [1] * 12), 255).collect()])
    for axis in x.T:  # with the origin, each of 256 equal bins has one point
        assert sorted(np.floor(axis * 256).astype(int)) == list(range(1, 256))
    pairs = [np.histogram2d(x[:, i], x[:, j], bins=4, range=[[0, 1]] * 2)[0] for i in range(12) for j in range(i)]
    assert max(h.max() for h in pairs) <= 48 and len({tuple(a) for a in x.T}) == 12  # even share: 16


def test_derivative_audits(spark):
    from ridgeline.functions.audits import derivative_audit, forward_differences

    df = spark.createDataFrame([(0.3, -1.0), (2.0, 0.5), (0.3, -1.0)], "a double, b double")
    x = [F.col("a"), F.col("b")]
    f = lambda y: F.sin(y[0]) * y[1] + y[0] * y[0]
    exact = [F.cos(x[0]) * x[1] + 2 * x[0], F.sin(x[0])]
    good = derivative_audit(df, f, exact, x, steps=40).first()
    assert max(good) < 1e-8
    assert derivative_audit(df, f, [exact[0] + 0.1, exact[1]], x, steps=40).first()["e0"] == pytest.approx(0.1, abs=0.02)
    near = df.select(*[F.abs(a - b) for a, b in zip(forward_differences(f, x), exact, strict=True)]).collect()
    assert max(v for r in near for v in r) < 1e-5
    assert derivative_audit(df.limit(0), f, exact, x, steps=5).first()["e0"] is None

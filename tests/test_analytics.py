import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import closed_form as cf
from ridgeline.operators import design, lipschitz, moments, pairs, ridge, summaries
from ridgeline.operators.domain import EmptyDomain, LogNormal, Normal, UnboundedDomain, Uniform, box, chi2_quantile, coords, dot, linquad, sample_product, unbounded
from ridgeline.sources import tables

RNG = np.random.default_rng(1)


def frame(spark, x, fx=None):
    rows = [(i, [float(v) for v in p], None if fx is None else float(fx[i])) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, fx double")


def points(df, column="x"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def test_domain_rules():
    with pytest.raises(EmptyDomain):
        box([1], [0])
    with pytest.raises(ValueError):
        linquad([0], [1], A=[[1]], b=[])
    both = box([-1] * 5, [1] * 5).intersect(linquad([-9] * 5, [9] * 5, Ls=[np.eye(5).tolist()], ys=[[1] * 5], rhos=[0.5]))
    assert both.lb == (-1,) * 5 and not both.is_box and (box([0], [1]) * box([2], [3])).ub == (1, 3)
    assert unbounded(2).center_scale() == ([0, 0], [1, 1])


def test_samples_lie_inside(spark):
    ball = linquad([-1] * 3, [1] * 3, A=[[1, 1, 1]], b=[0.5], Ls=[np.eye(3).tolist()], ys=[[0, 0, 0]], rhos=[0.9])
    assert ball.sample(spark, 50, 2).where(ball.contains(coords("x", 3), 1e-9)).count() == 50
    plane = linquad([-1] * 3, [1] * 3, A_eq=[[1, 1, 0]], b_eq=[0.2])
    found = plane.sample(spark, 20, 3)
    assert found.where(plane.contains(coords("x", 3))).count() == 20
    assert box([0], [1]).sample(spark, 0).count() == 0
    with pytest.raises(UnboundedDomain):
        unbounded(2).sample(spark, 3)
    assert box([-1] * 3, [1] * 3).grid(spark, 5).count() == 125
    assert sample_product([box([0], [1]), Normal((0.0,), ((1.0,),))], spark, 10).where("size(x) = 2").count() == 10


def test_extent_and_projection(spark):
    dom = linquad([-1, -1], [1, 1], A=[[1, 1]], b=[1.0], Ls=[np.eye(2).tolist()], ys=[[0, 0]], rhos=[1.2])
    df = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 1.0]), (1, [0.0, 0.0], [-1.0, 0.0]), (2, [0.0, 0.0], [-1.0, -1.0])], "id long, x array<double>, p array<double>")
    reach = [r.r for r in df.select("id", dom.extent(coords("x", 2), coords("p", 2)).alias("r")).orderBy("id").collect()]
    assert reach == pytest.approx([0.5, 1.0, 1.2 / math.sqrt(2)])
    near = points(dom.closest_rows(df.select("id", F.transform("p", lambda v: 3 * v).alias("x"))), "closest")
    assert near == pytest.approx(np.array([[0.5, 0.5], [-1, 0], [-1.2 / math.sqrt(2)] * 2]), abs=1e-6)


def test_densities_integrate_to_one(spark):
    rule = design.tensor_rule(spark, box([-6, -6], [6, 6]), 40)
    for dist in (Normal((0.2, 0.1), ((1.0, 0.3), (0.3, 0.5))), Uniform(box([-5, -5], [5, 5]))):
        assert rule.agg(F.sum(F.col("w") * dist.pdf(coords("x", 2)))).first()[0] == pytest.approx(1, abs=0.06)
    line = design.tensor_rule(spark, box([0], [30]), 200)
    assert line.agg(F.sum(F.col("w") * LogNormal(0.5, 0.3, scaling=1.5).pdf(coords("x", 1)))).first()[0] == pytest.approx(1, abs=1e-3)
    assert chi2_quantile(0.95, 2) == pytest.approx(5.991464547, abs=1e-6)


def test_gradients_match_differences(spark):
    for work in (cf.BOREHOLE, cf.OTL, cf.PISTON, cf.ROBOT_ARM, cf.WING_WEIGHT, cf.GEARBOX, cf.BEAM, cf.HARTMANN, cf.SINE_OF_SQUARES, cf.PRODUCT_PEAK):
        m = work.domain.m
        df = spark.range(1).select(F.array(*[F.lit(low + (high - low) * (0.3 + 0.4 * k / m)) for k, (low, high) in enumerate(zip(work.domain.lb, work.domain.ub))]).alias("x"))
        x, d = coords("x", m), work.domain.center_scale()[1]
        for k in (0, m - 1):
            h = 1e-5
            up, down = ([xi + F.lit(s * h / d[k]) if i == k else xi for i, xi in enumerate(x)] for s in (1, -1))
            exact = [g[k] for g in work.gradients(x, normalized=True)]
            diff = [(a - b) / F.lit(2 * h) for a, b in zip(work.values(up), work.values(down))]
            row = df.select(*[F.abs(a - b).alias(f"e{i}") for i, (a, b) in enumerate(zip(exact, diff))], *[F.abs(v).alias(f"v{i}") for i, v in enumerate(work.values(x))]).first()
            assert all(row[f"e{i}"] <= 1e-5 * max(1, row[f"v{i}"]) for i in range(len(exact)))


def test_planted_rank_shows(spark):
    B = RNG.standard_normal((4, 2))
    df = frame(spark, RNG.uniform(-1, 1, (200, 4)))
    g = [dot(row, coords("x", 4)) for row in B @ B.T]
    U, s = moments.active_subspace(df, g)
    assert (s > 1e-8).sum() == 2 and moments.principal_angles(U[:, :2], B).max() < 1e-6
    parts = moments.outer_matrix(df.where("id < 50"), g) * 50 + moments.outer_matrix(df.where("id >= 50"), g) * 150
    assert parts / 200 == pytest.approx(moments.outer_matrix(df.repartition(7), g))


def test_joins_match_all_distances(spark):
    x, y = RNG.standard_normal((40, 3)), RNG.standard_normal((25, 3))
    a, b = frame(spark, x).withColumnRenamed("x", "z"), frame(spark, y).withColumnRenamed("x", "z")
    d = np.linalg.norm(x[:, None] - y[None], axis=2)
    got = pairs.nearest(a, b, 3).orderBy("id", "place").collect()
    assert [r.other for r in got] == np.argsort(d, axis=1)[:, :3].ravel().tolist()
    fill = design.fill_distance(a, b).first()
    assert fill["distance"] == pytest.approx(d.min(axis=1).max())
    chosen = [r["distance"] for r in design.coffee_house(a, 8).orderBy("place").collect()][1:]
    assert chosen == sorted(chosen, reverse=True)
    low = pairs.project(frame(spark, x), [[1, 0, 0], [2, 0, 0], [0, 1, 0]])
    assert len(low.first()["z"]) == 2


def test_bounds_equal_the_double_loop(spark):
    x, t = RNG.uniform(-1, 1, (30, 2)), RNG.uniform(-1, 1, (9, 2))
    f, L = np.sin(x[:, 0]) + x[:, 1], np.array([[1.5, 0.2], [0, 1.1]])
    d = np.linalg.norm((t[:, None] - x[None]) @ L.T, axis=2)
    got = lipschitz.uncertainty(frame(spark, t), frame(spark, x, f), L).orderBy("id").collect()
    assert [r.lb for r in got] == pytest.approx((f - d).max(axis=1)) and [r.ub for r in got] == pytest.approx((f + d).min(axis=1))
    data, e = lipschitz.compatible_data(frame(spark, x, f), 0.5 * L)
    y = np.array([r.y for r in data.orderBy("id").collect()])
    assert np.abs(y - f).max() <= e + 1e-9
    assert (np.abs(y[:, None] - y) <= np.linalg.norm((x[:, None] - x) @ (0.5 * L).T, axis=2) + 1e-9).all()


def test_matrices_are_feasible(spark):
    g = RNG.standard_normal((60, 3)) * [3, 1, 0.2]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(g)], "id long, grad array<double>")
    H, gap = lipschitz.matrix_from_gradients(df, 3, rounds=25)
    assert min(np.linalg.eigvalsh(H - np.outer(v, v)).min() for v in g) >= -1e-8 and gap < 0.1
    assert lipschitz.gradient_slack(df, H).agg(F.min("slack")).first()[0] >= -1e-8
    x = RNG.uniform(-1, 1, (15, 2))
    samples = frame(spark, x, 2 * x[:, 0] + 0.3 * x[:, 1])
    H, gap = lipschitz.matrix_from_samples(samples, 2)
    assert gap <= 1e-3 and np.trace(H) == pytest.approx(4.09, rel=2e-3)
    assert lipschitz.pair_slack(samples, H, 2, top=1).first()["slack"] >= -1e-8


def test_bases_and_fits(spark):
    assert ridge.multi_indices(2, 2).tolist() == [[0, 0], [1, 0], [0, 1], [2, 0], [1, 1], [0, 2]]
    y = RNG.uniform(-1, 1, (50, 2))
    for kind in ("monomial", "legendre", "chebyshev", "laguerre", "hermite"):
        basis = ridge.Basis(kind, 4, (0.1, 0.0), (0.9, 1.1))
        h = 1e-6
        diff = (basis.matrix(y + [h, 0]) - basis.matrix(y - [h, 0])) / (2 * h)
        assert basis.slopes(y)[:, :, 0] == pytest.approx(diff, abs=1e-5)
        columns = frame(spark, y[:3]).select("id", F.array(*basis.columns(coords("x", 2))).alias("v"))
        assert points(columns, "v") == pytest.approx(basis.matrix(y[:3]))
    f = 1 + y[:, 0] - 3 * y[:, 0] * y[:, 1]
    df = frame(spark, y, f)
    basis = ridge.scaled_basis(df, coords("x", 2), 2)
    c = ridge.least_squares(df, basis)
    assert basis.matrix(y) @ c == pytest.approx(f)
    lower = ridge.reweighted_fit(frame(spark, y, f + RNG.uniform(0, 0.2, 50)), basis, 2, bound="lower")
    assert (basis.matrix(y) @ lower <= f + 0.2 + 1e-9).all()


def test_ridge_recovers_its_direction(spark):
    x, u = RNG.uniform(-1, 1, (400, 4)), np.array([0.5, -0.5, 0.5, 0.5])
    f = (x @ u) ** 3 + x @ u
    df = frame(spark, x, f)
    fit = ridge.fit_ridge(df, 4, 1, 3, U0=ridge.affine_direction(df, 4), rounds=10)
    assert moments.principal_angles(fit.U, u[:, None]).max() < 1e-4
    assert df.agg(F.max(F.abs(F.col("fx") - fit.value(coords("x", 4))))).first()[0] < 1e-4
    with pytest.raises(ValueError):
        ridge.fit_ridge(df.limit(5), 4, 2, 3)


def test_local_models_recover_affine_data(spark):
    x, a = RNG.standard_normal((40, 3)), np.array([1.0, -2.0, 0.5])
    df = frame(spark, x, x @ a + 4)
    slopes = points(summaries.local_linear(df.select("id", "x"), df, 3, 0.1), "c")[:, 1:]
    assert slopes == pytest.approx(np.tile(a, (40, 1)), abs=1e-6)
    d2 = RNG.uniform(0, 4, 100)
    beta = summaries.perplexity_beta(d2, 10)
    w = np.exp(-beta * d2)
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(math.log(10), abs=1e-8)


def test_thinning_cover_and_ball(spark):
    z = RNG.uniform(0, 1, (150, 2))
    df = frame(spark, z).withColumnRenamed("x", "z")
    kept = points(design.poisson_disk(df, 0.2, 2), "z")
    d = np.linalg.norm(kept[:, None] - kept[None], axis=2) + 9 * np.eye(len(kept))
    assert d.min() > 0.2 and np.linalg.norm(z[:, None] - kept[None], axis=2).min(axis=1).max() <= 0.2
    cover = design.greedy_cover(df, 0.3)
    assert cover.agg(F.sum("gained")).first()[0] == 150
    center, radius = summaries.enclosing_ball(df, 2, 60)
    assert np.linalg.norm(z - center, axis=1).max() <= radius + 1e-12
    twins = frame(spark, [[0, 0], [1, 1], [0, 0]])
    assert sorted(r.id for r in pairs.near_duplicates(twins, 2).collect()) == [1, 2]


def test_designs_generate(spark):
    cubes = design.latin_hypercube(spark, box([0, 0], [1, 1]), 6, designs=3)
    assert cubes.groupBy("design_id").agg(F.countDistinct(F.get("x", 0)).alias("n")).where("n = 6").count() == 3
    assert design.best_design(cubes).count() == 1
    assert design.simplex(spark, 20, 4).where("abs(aggregate(x, 0D, (a, v) -> a + v) - 1) < 1e-9").count() == 20
    x = points(design.sobol(spark, box([0] * 3, [1] * 3), 63))
    assert all(len(np.unique(np.floor(x[:, k] * 64))) == 63 for k in range(3))
    assert points(design.line_design(spark, [0], [1], 4, minimax=True)).ravel() == pytest.approx([0.125, 0.375, 0.625, 0.875])
    nodes, weights = design.gauss_legendre(10, 0.0, 1.0)
    assert (weights * (np.sin(5 * nodes + 0.1) + nodes**2)).sum() == pytest.approx((math.cos(0.1) - math.cos(5.1)) / 5 + 1 / 3)


def test_process_interpolates(spark):
    x = RNG.uniform(-1, 1, (30, 2))
    df = frame(spark, x, np.cos(x[:, 0]) * x[:, 1])
    got = summaries.GaussianProcess(2 * np.eye(2), nugget=1e-10).fit(df).predict(df).orderBy("id").collect()
    assert [r.mean for r in got] == pytest.approx((np.cos(x[:, 0]) * x[:, 1]).tolist(), abs=1e-4) and max(r.variance for r in got) < 1e-4


def test_tables_round_trip(spark, tmp_path):
    df = frame(spark, [[1.5, -2e-300], [math.pi, 0]])
    tables.write_matrix(df, f"{tmp_path}/m")
    assert sorted(r.x for r in tables.read_matrix(spark, f"{tmp_path}/m").collect()) == [[1.5, -2e-300], [math.pi, 0.0]]
    (tmp_path / "t.dat").write_text("y\tlb\t\n1.0\t2.5\t\n")
    assert [tuple(r) for r in tables.read_columns(spark, f"{tmp_path}/t.dat").collect()] == [(1.0, 2.5)]
    assert tables.finite(spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "fx double")).count() == 1


def test_stream_refits(spark, tmp_path):
    from ridgeline.streaming.refit import grouped_moments, refit_on_batches

    for k in range(3):
        spark.createDataFrame([(k, float(v)) for v in range(4)], "k long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    refit_on_batches(spark, f"{tmp_path}/in", "k long, value double", f"{tmp_path}/all", f"{tmp_path}/check", lambda df: grouped_moments(df, ["k"], "value"), f"{tmp_path}/fit")
    got = spark.read.parquet(f"{tmp_path}/fit").orderBy("k").collect()
    assert [(r.k, r.n, r.total, r.squares) for r in got] == [(k, 4, 6.0, 14.0) for k in range(3)]


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ridge_fit_does_not_depend_on_batches(spark):
    rng = np.random.default_rng(21)
    X = rng.uniform(-1, 1, (600, 3))
    rows = [(i, x.tolist(), float(np.tanh(x @ [0.8, 0.5, -0.2]) + 0.1 * x[2] ** 2)) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, x array<double>, fx double").coalesce(1).persist()
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for size in (4, 50, 10_000):
            spark.conf.set(key, str(size))
            fit = ridge.fit_ridge(df, 3, 1, 3, rounds=6, seed=1)
            found.append(fit.U[:, 0] * np.sign(fit.U[0, 0]))
    finally:
        spark.conf.set(key, before)
    assert np.allclose(found[0], found[1], atol=1e-6) and np.allclose(found[0], found[2], atol=1e-6)


@pytest.mark.parametrize("kind", ["monomial", "legendre", "chebyshev", "hermite", "laguerre"])
def test_second_derivatives_are_those_of_first_ones(spark, kind):
    basis = ridge.Basis(kind, 4, (0.1, -0.2), (1.5, 0.5))
    y, h = [F.col("a"), F.col("b")], 1e-5
    df = spark.createDataFrame([(0.3, 0.7), (-0.4, 0.2)], "a double, b double")
    for k in range(2):
        for j in range(2):
            moved = lambda s: [c + F.lit(s * h) if i == j else c for i, c in enumerate(y)]  # noqa: E731, B023
            second, up, down = basis.second_columns(y, min(k, j), max(k, j)), basis.derivative_columns(moved(1), k), basis.derivative_columns(moved(-1), k)
            for r in df.select(F.array(*second).alias("s"), F.array(*[(u - v) / (2 * h) for u, v in zip(up, down, strict=True)]).alias("f")).collect():
                assert np.allclose(r.s, r.f, rtol=1e-5, atol=1e-4)


def test_user_functions(spark):
    from ridgeline.functions import user

    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0])], "id long, x array<double>")
    f = lambda x: (1 / x[:, 0] + x[:, 1], np.stack([-1 / x[:, 0] ** 2, np.ones(len(x))], axis=1))
    got = {r.id: r for r in user.evaluate(df, f, gradients=True, tasks=2).collect()}
    assert got[0].fx == [3.0] and got[0].grad == [[-1.0, 1.0]]
    assert got[1].fx is None and got[2].fx is None and got[2].grad is None
    assert user.evaluate(df.limit(0), f, gradients=True).count() == 0


def test_diagonal_matrix_bounds_all_pairs(spark):
    rng = np.random.default_rng(22)
    rows = [(i, x.tolist(), float(abs(x[0]) + 2 * abs(x[1]))) for i, x in enumerate(rng.uniform(-1, 1, (60, 2)))]
    df = spark.createDataFrame(rows, "id long, x array<double>, fx double")
    H, gap = lipschitz.matrix_from_samples(df, 2, diagonal=True)
    assert gap <= 1e-3
    assert np.allclose(H, np.diag(np.diag(H)))
    for i, x, f in rows:
        for j, y, g in rows[:i]:
            p = np.array(x) - np.array(y)
            assert p @ H @ p - (f - g) ** 2 >= -1e-9


def test_gaussian_process_through_inducing_points_uses_every_row(spark):
    rng = np.random.default_rng(23)
    X = rng.uniform(-1, 1, (400, 1))
    df = spark.createDataFrame([(i, x.tolist(), float(np.sin(3 * x[0]))) for i, x in enumerate(X)], "id long, x array<double>, fx double")
    got = summaries.GaussianProcess(2 * np.eye(1), limit=40, nugget=1e-8).fit(df).predict(df).collect()
    assert max(abs(r["mean"] - np.sin(3 * X[r["id"], 0])) for r in got) < 1e-3


def test_orthonormal_basis_of_high_degree(spark):
    rng = np.random.default_rng(24)
    X = rng.uniform(-1, 1, (300, 1))
    df = spark.createDataFrame([(i, x.tolist(), float(np.exp(x[0]))) for i, x in enumerate(X)], "id long, x array<double>, fx double")
    basis = ridge.orthonormal_basis(df, ridge.Basis("monomial", 18, (0.0,), (1.0,)))
    assert np.allclose(basis.matrix(X).T @ basis.matrix(X), np.eye(19), atol=1e-9)
    fit = basis.matrix(X) @ ridge.orthonormal_fit(df, basis)
    assert np.abs(fit - np.exp(X[:, 0])).max() < 1e-9
    with pytest.raises(ValueError, match="independent"):
        ridge.orthonormal_basis(df.limit(3), ridge.Basis("monomial", 5, (0.0,), (1.0,)))


def test_hessian_audit_finds_a_wrong_entry(spark):
    df = spark.createDataFrame([(0.1, 0.2), (-0.4, 0.3)], "a double, b double")
    f = lambda y: y[0] * y[0] * y[1]
    second = lambda y: [[2 * y[1], y[0]], [y[0], F.lit(0.0)]]
    got = ridge.hessian_audit(df, f, second, [F.col("a"), F.col("b")], [1e-2, 1e-3]).groupBy("i", "j").agg(F.min("worst").alias("w")).collect()
    assert {(r.i, r.j): r.w < 1e-6 for r in got} == {(0, 0): True, (0, 1): False, (1, 1): True}


def test_nonlinearity_of_affine_and_of_bent_data(spark):
    X = np.random.default_rng(25).uniform(-1, 1, (40, 2))
    share = lambda f: lipschitz.nonlinearity(frame(spark, X, [float(f(x)) for x in X]), 2)
    found, a, gap = share(lambda x: 3 * x[0] - x[1] + 5)
    assert found <= gap + 1e-12 and gap <= 1e-3 and np.allclose(a, [3, -1], atol=1e-2)
    assert share(lambda x: 7.0)[0] == 0
    found, a, gap = share(lambda x: 2 * x[0] + np.sin(3 * x[1]))
    assert 0.3 < found < 1 and gap <= 1e-3


def test_exchanged_design_cannot_be_improved_by_one_move(spark):
    X = np.random.default_rng(26).uniform(0, 1, (150, 2))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, z array<double>")
    got = design.block_maximin(df, 5).orderBy("place").collect()
    ids = [r.id for r in got]
    for r in got:
        others = X[[i for i in ids if i != r.id]]
        far = np.sqrt(((X[:, None] - others[None]) ** 2).sum(axis=2)).min(axis=1)
        assert far.max() <= r.distance + 1e-8 and far[r.id] == pytest.approx(r.distance)
    assert design.block_maximin(df, 1).count() == 1


def test_batch_design_has_different_points(spark):
    X = np.random.default_rng(27).uniform(0, 1, (60, 2))
    df = spark.createDataFrame([(i, x.tolist(), [float(x[0])]) for i, x in enumerate(X)], "id long, z array<double>, first array<double>")
    got = [r.id for r in design.batch_maximin(df.where("id >= 5"), df.where("id < 5"), ["first"], 3).orderBy("place").collect()]
    assert len(set(got)) == 3 and min(got) >= 5


def test_bound_functions_and_slopes(spark):
    rng = np.random.default_rng(5)
    X, f, L = rng.random((12, 2)), rng.random(12), np.array([[2.0, 0.5], [0.0, 1.0]])
    df = spark.createDataFrame([(i, X[i].tolist(), float(f[i])) for i in range(12)], "id long, x array<double>, fx double")
    rows = lipschitz.bound_functions(df.select("id", "x"), df, L).collect()
    assert len(rows) == 144
    for r in rows:
        p = L @ (X[r["id"]] - X[r["other"]])
        d = np.linalg.norm(p)
        assert np.allclose([r["low"], r["high"]], [f[r["other"]] - d, f[r["other"]] + d])
        assert np.allclose(r["slope"], L.T @ p / d if d else np.zeros(2))


def test_stretched_sample_and_sphere_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    A, B = rng.random((60, 4)), rng.random((5, 4))
    table = lambda M: spark.createDataFrame([(i, M[i, :2].tolist(), M[i, 2:].tolist()) for i in range(len(M))], "id long, p array<double>, q array<double>")
    parts, left, want = {"p": slice(0, 2), "q": slice(2, 4)}, list(range(60)), []
    while parts:
        far = {c: max((np.linalg.norm(A[i, s] - B[:, s], axis=1).min(), -i) for i in left) for c, s in parts.items()}
        c = max(far, key=lambda c: far[c][0])
        s, i = parts.pop(c), -far[c][1]
        left = [j for j in left if np.linalg.norm(A[j, s] - A[i, s]) <= 0.3]
        want.append((c, i, len(left)))
    got = design.stretched(table(A), table(B), ["p", "q"], 0.3).orderBy("place").collect()
    assert [(r["metric"], r["id"], r["left"]) for r in got] == want

    M = np.vstack([rng.normal(size=(40, 3)), np.zeros((1, 3))])
    U, chosen = M[:40] / np.linalg.norm(M[:40], axis=1)[:, None], [0]
    while len(chosen) < 4:
        chosen.append(int(np.linalg.norm(U[:, None] - U[None, chosen], axis=2).min(axis=1).argmax()))
    found = design.spread_on_sphere(spark.createDataFrame([(i, M[i].tolist()) for i in range(41)], "id long, z array<double>"), 4)
    assert [r["id"] for r in found.orderBy("place").collect()] == chosen

"""Steps over pairs of points: nothing quadratic is written or held, and results equal the double loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import clusters, design, pairs, ridge, summaries

RNG = np.random.default_rng(37)
# A tight cluster with copies, and points around it.
Z = np.vstack([RNG.normal(0, 0.05, (60, 2)), RNG.normal(0, 0.05, (10, 2)).repeat(3, 0), RNG.uniform(-1, 1, (40, 2))])
D = np.sqrt((Z[:, None, 0] - Z[None, :, 0]) ** 2 + (Z[:, None, 1] - Z[None, :, 1]) ** 2)


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(Z)], "id long, z array<double>")


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that a design writes."""
    rows = []

    def stored(df, name="table"):
        from ridgeline.sources import tables

        out = tables.stored(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(design, "stored", stored)
    return rows


def test_cover_is_greedy_and_writes_no_pairs(points, written, monkeypatch):
    monkeypatch.setattr(pairs, "LARGE", 40)
    near, open_, expected = D <= 0.15, np.ones(len(Z), bool), []
    while open_.any():
        gain = (near & open_).sum(axis=1)
        k = int(gain.argmax())
        expected.append((len(expected) + 1, k, int(gain[k])))
        open_ &= ~near[k]
    assert [tuple(r) for r in design.greedy_cover(points, 0.15).orderBy("place").collect()] == expected
    assert max(written) <= len(Z)


def test_cover_of_whole_vectors(spark, written, monkeypatch, tmp_path):
    """Clusters whose first two components are equal, each with copies and points in and out of the radius."""
    from ridgeline.plans import more_queries

    rng = np.random.default_rng(38)
    z = np.vstack([c + 0.0135 * rng.standard_normal((6, 64)) for c in rng.standard_normal((20, 64))] + [rng.standard_normal((30, 64))]).astype("float32")
    z[:, :2], z[5] = 0.25, z[4]
    rows = [(i, x.tolist()) for i, x in enumerate(z)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found, cover = [], design.greedy_cover
    monkeypatch.setattr(design, "greedy_cover", lambda *a: found.append(cover(*a)) or found[0])
    assert more_queries.ds10_cover(spark, str(tmp_path)).collect() == [(150, 0)]
    near, open_, expected = pairs.distances(z.astype(float), z.astype(float)) <= 0.15, np.ones(150, bool), []
    while open_.any():
        gain = (near & open_).sum(axis=1)
        expected.append((len(expected) + 1, int(gain.argmax()), int(gain.max())))
        open_ &= ~near[gain.argmax()]
    assert [tuple(r) for r in found[0].orderBy("place").collect()] == expected
    assert len({r[2] for r in expected}) > 2 and len(expected) > len(written)  # choices apart are made at once


@pytest.mark.parametrize("m", [2, 64])
def test_within_is_that_of_differences(m):
    a = RNG.standard_normal((200, m)) / m
    b = np.vstack([a[:50], RNG.standard_normal((300, m)) / m])
    d = pairs.distances(a, b)
    for radius in (0.0, *d[:20].ravel()[::350], d.max()):
        assert (pairs.within(a, b, radius) == (d <= radius)).all()


def test_thinning_takes_least_ranks_and_writes_no_pairs(spark, points, written, monkeypatch):
    monkeypatch.setattr(pairs, "LARGE", 40)
    ranks = {r["id"]: r["rank"] for r in points.select("id", F.xxhash64(F.lit(0), "id").alias("rank")).collect()}
    expected = []
    for i in sorted(ranks, key=lambda i: (ranks[i], i)):
        if not expected or D[i, expected].min() > 0.1:
            expected.append(i)
    assert sorted(r["id"] for r in design.poisson_disk(points, 0.1, 2).collect()) == sorted(expected)
    assert max(written) <= len(Z)


@pytest.mark.parametrize("shift", [0.0, 1e3])
def test_nearest_of_many_coordinates_are_those_of_differences(shift):
    a, b = RNG.standard_normal((90, 64)) + shift, RNG.standard_normal((300, 64)) + shift
    b[40:60] = a[:20]  # distance 0
    b[100:140] = b[7]  # equals
    b[200:230] = b[8] + 1e-7 * RNG.standard_normal((30, 64))
    d = pairs.distances(a, b)
    for k in (1, 5, 300):
        i, j, found = pairs.closest(a, b, k)
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert (i == np.repeat(np.arange(90), k)).all() and (j == at.ravel()).all() and (found == np.take_along_axis(d, at, 1).ravel()).all()
    low, high, total = pairs.reach(a, b)
    assert (low == d.min(axis=1)).all() and (high == d.max(axis=1)).all() and total == pytest.approx(d.sum(axis=1), rel=1e-12)
    a[3, 5] = np.nan
    assert np.isnan(pairs.closest(a, b)[2][3])


def test_nearest_of_many_coordinates_takes_few_differences(monkeypatch):
    taken, exact = [], pairs._exact

    def counted(a, b, i, j):
        taken.append(len(i))
        return exact(a, b, i, j)

    monkeypatch.setattr(pairs, "_exact", counted)
    pairs.closest(RNG.standard_normal((200, 64)), RNG.standard_normal((1000, 64)), 5)
    pairs.reach(RNG.standard_normal((200, 64)), RNG.standard_normal((1000, 64)))
    assert taken[0] == 1000 and sum(taken[1:]) < 1000


def test_batches_measure_a_candidate_once_in_each_metric(spark, monkeypatch):
    z = RNG.standard_normal((60, 8))
    df = spark.createDataFrame([(i, x.tolist(), x[:2].tolist(), x[2:4].tolist()) for i, x in enumerate(z)], "id long, z array<double>, first array<double>, second array<double>")
    design_rows, expected = list(range(10)), []
    for _ in range(3):
        near = lambda s: np.linalg.norm(z[10:, None, s] - z[None, design_rows, s], axis=2).min(axis=1)
        score, spread = near(slice(0, 2)) * near(slice(2, 4)), near(slice(0, 8))
        k = max(np.flatnonzero(score >= 0.9 * score.max()), key=lambda k: (spread[k], -k))
        expected.append(int(k) + 10)
        design_rows.append(int(k) + 10)
    met, nearest = [], design.nearest

    def counted(test, train, k=1):
        met.append(test.count() * train.count())
        return nearest(test, train, k)

    monkeypatch.setattr(design, "nearest", counted)
    got = design.batch_maximin(df.where("id >= 10"), df.where("id < 10"), ["first", "second"], 3).orderBy("place").collect()
    assert [r["id"] for r in got] == expected
    assert sum(met) < 3 * 50 * 10


def test_designs_pass_over_different_points(spark, monkeypatch):
    z = RNG.integers(0, 6, (300, 2)) / 6.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "id long, z array<double>")
    at = clusters.places(df)
    centers = z[[0, 50, 90]] + 0.01
    (once, far), (every, far_every) = clusters.moved_centers(at, {0: centers}), clusters.moved_centers(df, {0: centers})
    assert once[0] == pytest.approx(every[0]) and far == far_every
    assert at.count() == len(np.unique(z, axis=0)) and at.agg(F.sum("n")).first()[0] == 300
    d = np.linalg.norm(z[:, None] - centers, axis=2)
    owned = clusters.owned_by(df, centers).groupBy("key").agg(F.count("*"), F.max("distance")).orderBy("key").collect()
    assert [tuple(r) for r in owned] == [(k, (d.argmin(axis=1) == k).sum(), pytest.approx(d.min(axis=1)[d.argmin(axis=1) == k].max())) for k in range(3)]
    passed, moved, balls = [], clusters.moved_centers, clusters.enclosing_balls
    monkeypatch.setattr(clusters, "moved_centers", lambda c, *a: passed.append(c.count()) or moved(c, *a))
    monkeypatch.setattr(clusters, "enclosing_balls", lambda c, *a: passed.append(c.count()) or balls(c, *a))
    clusters.minimax_lloyd(df, 2, 3, rounds=2)
    clusters.minimax_particles(df, 3, particles=2, rounds=2)
    clusters.cover_size(df, 0.3, rounds=2)
    assert passed and max(passed) <= 36


def test_processes_add_up_different_points(spark, monkeypatch):
    x, summed, grams = RNG.integers(0, 5, (200, 2)) / 5.0, [], ridge.grams
    f = np.sin(3 * x[:, 0]) + x[:, 1] + 0.1 * RNG.standard_normal(200)
    df = spark.createDataFrame([(i, p.tolist(), float(v)) for i, (p, v) in enumerate(zip(x, f, strict=True))], "id long, x array<double>, fx double")
    monkeypatch.setattr(ridge, "grams", lambda at, *a: summed.append(at.count()) or grams(at, *a))
    gp, noise = summaries.GaussianProcess(3 * np.eye(2), limit=20, nugget=0.1).fit(df), 0.1
    assert summed == [len(np.unique(x, axis=0))]
    K = np.exp(-0.5 * pairs.distances(3 * x, gp.X) ** 2)
    A = K.T @ K + noise * gp.K
    assert gp.alpha == pytest.approx(np.linalg.solve(A, K.T @ f))
    logs = np.linalg.slogdet(A)[1] - np.linalg.slogdet(gp.K)[1] + (200 - 20) * np.log(noise)
    assert gp.nll == pytest.approx(0.5 * (f @ f - (K.T @ f) @ gp.alpha) / noise + 0.5 * logs)

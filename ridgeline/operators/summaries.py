"""Tables behind shadow plots, local models, geometry measures, propagation of uncertainty, and Gaussian processes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.domain import coords, dot
from ridgeline.operators.pairs import _matrix, distances, meet_train
from ridgeline.sources.tables import stored


def shadow(df: DataFrame, U: np.ndarray, m: int) -> DataFrame:
    """id, y1 (and y2), fx: samples in active coordinates."""
    x = coords("x", m)
    return df.select("id", *[dot(U[:, k], x).alias(f"y{k + 1}") for k in range(min(U.shape[1], 2))], "fx")


def bin_count(df: DataFrame, y: str = "y1", most: int = 25, least: int = 3, rows: int = 5) -> int:
    """The largest number of equal bins of which all occur and all but the last have `rows` rows; `least` at least. One
    pass counts all grids at once."""
    low, high = df.agg(F.min(y), F.max(y)).first()
    grids = df.select(F.col(y).alias("y"), F.explode(F.sequence(F.lit(least), F.lit(most))).alias("n"))
    at = F.least(F.floor((F.col("y") - F.lit(low)) / F.lit((high - low) or 1.0) * F.col("n")), F.col("n") - 1)
    counts = grids.groupBy("n", at.alias("bin")).count()
    good = counts.groupBy("n").agg(F.count("*").alias("bins"), F.min(F.when(F.col("bin") < F.col("n") - 1, F.col("count"))).alias("fewest"))
    found = good.where((F.col("bins") == F.col("n")) & (F.col("fewest") >= rows)).agg(F.max("n")).first()[0]
    return int(found or least)


def envelope(df: DataFrame, bins: int, y: str = "y1") -> DataFrame:
    """node, y, lb, ub: at each bin edge the extremes of the adjoining bins, so the piecewise linear curves bound all
    rows."""
    low, high = df.agg(F.min(y), F.max(y)).first()
    h = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(y) - F.lit(low)) / F.lit(h)), F.lit(bins - 1))
    parts = df.groupBy(at.alias("bin")).agg(F.min("fx").alias("lb"), F.max("fx").alias("ub"))
    nodes = parts.select(F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("node"), "lb", "ub")
    return nodes.groupBy("node").agg(F.min("lb").alias("lb"), F.max("ub").alias("ub")).select("node", (F.lit(low) + F.col("node") * h).alias("y"), "lb", "ub")


def tight_envelope(df: DataFrame, bins: int, y: str = "y1", tol: float = 1e-4, rounds: int = 100) -> tuple[DataFrame, float]:
    """node, y, lb, ub: of all continuous curves that are linear in each of `bins` equal bins, with nodes in the range of fx, the
    least above all rows and the greatest below them by area; and the gap, a share of the area between them that other
    curves could still save.

    A small program over the rows so far gives node values and an area that no curves beat; the row of each bin that
    lies farthest outside then joins it. At the end the curves move out by the farthest row that is left. A pass is one aggregate.
    """
    from ridgeline.operators.programs import least_quadratic

    low, high, least, most = df.agg(F.min(y), F.max(y), F.min("fx"), F.max("fx")).first()
    spark = df.sparkSession
    kind = "node long, y double, lb double, ub double"
    if low is None:
        return spark.createDataFrame([], kind), 0.0
    h, span = (high - low) / bins or 1.0, (most - least) or 1.0
    hats = hat_weights(df, bins, y).select(F.col("node").cast("int").alias("node"), "right", ((F.col("fx") - least) / span).alias("f"))
    area = np.array([0.5] + [1.0] * (bins - 1) + [0.5]) / bins
    known: dict[int, set] = {1: set(), -1: set()}  # rows above and below as (node, right, f)
    value, floor = {1: np.zeros(bins + 1), -1: np.ones(bins + 1)}, {1: 0.0, -1: -1.0}

    def curve(u):
        nodes = F.array(*[F.lit(float(v)) for v in u])
        return (1 - F.col("right")) * F.get(nodes, F.col("node")) + F.col("right") * F.get(nodes, F.col("node") + 1)

    for _ in range(rounds):
        worst = [F.max(F.struct((F.lit(float(side)) * (F.col("f") - curve(value[side]))).alias("out"), "right", "f")).alias(name) for side, name in ((1, "above"), (-1, "below"))]
        found = hats.groupBy("node").agg(*worst).collect()  # a row for each bin
        out = {side: max(0.0, *(r[name]["out"] for r in found)) for side, name in ((1, "above"), (-1, "below"))}
        curves = {side: value[side] + side * out[side] for side in out}
        between = area @ (curves[1] - curves[-1])
        gap = (between - floor[1] - floor[-1]) / between if between > 1e-9 else 0.0  # flat data
        if gap <= tol:
            break
        for side, name in ((1, "above"), (-1, "below")):
            known[side] |= {(r["node"], r[name]["right"], r[name]["f"]) for r in found}
            rows = sorted(known[side])
            A = np.zeros((len(rows), bins + 1))
            for k, (node, right, _f) in enumerate(rows):
                A[k, node], A[k, node + 1] = side * (1 - right), side * right
            box = np.vstack([np.eye(bins + 1), -np.eye(bins + 1)])
            b = np.concatenate([[side * r[2] for r in rows], np.zeros(bins + 1), -np.ones(bins + 1)])
            A = np.vstack([A, box])
            value[side], z = least_quadratic(np.zeros((bins + 1, bins + 1)), side * area, A, b)
            floor[side] = max(floor[side], z @ b - np.abs(side * area - A.T @ z).sum())
    else:
        raise RuntimeError(f"curves are open by {gap} after {rounds} rounds")
    back = lambda u: least + span * u
    rows = [(k, float(low + k * h), float(lo), float(hi)) for k, (lo, hi) in enumerate(zip(back(curves[-1]), back(curves[1]), strict=True))]
    return spark.createDataFrame(rows, kind), float(max(0.0, gap))


def hat_weights(df: DataFrame, bins: int, y: str = "y1") -> DataFrame:
    """df with node, left, right: the bin of each row and its weights for the bin's two nodes."""
    low, high = df.agg(F.min(y), F.max(y)).first()
    t = (F.col(y) - F.lit(low)) / F.lit((high - low) / bins or 1.0)
    node = F.least(F.floor(t), F.lit(bins - 1))
    return df.withColumn("node", node).withColumn("right", t - node).withColumn("left", 1 - (t - node))


# Local linear models ------------------------------------------------------------------------------------------------


def _different(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """id, keys, sums: rows of equal keys once, with their smallest id."""
    return stored(rows.groupBy(*keys).agg(F.min("id").alias("id"), *sums), "different")


def local_linear(targets: DataFrame, samples: DataFrame, m: int, beta: float | None = None) -> DataFrame:
    """id, c: constant and slopes of the least-squares fit at each target, weights exp(-beta |x - x_t|^2). Without beta,
    the targets have one each in a column of that name. Samples of equal x are added up first, and targets of equal x and
    beta have one fit. Normal equations are added up by block; each target is then solved by itself. targets: id, x;
    samples: id, x, fx."""
    k = m + 2

    def kernel(ids, z, b):
        x, f, n = _matrix(b["z"]), b["fx"].to_numpy(float), b["n"].to_numpy(float)
        if not len(ids):
            return pd.DataFrame({"id": ids, "s": []}).astype({"id": "int64"})
        out = []
        step = max(1, (1 << 20) // max(1, len(x) * k))
        for lo in range(0, len(ids), step):
            at = z[lo : lo + step]
            p = x[None, :, :] - at[:, None, :m]
            w = np.exp(-at[:, m:] * (p**2).sum(axis=2))
            M = np.concatenate([np.ones((*w.shape, 1)), p, np.broadcast_to((f / n)[None, :, None], (*w.shape, 1))], axis=2)
            out += list(np.matmul(M.transpose(0, 2, 1), M * (w * n)[:, :, None]).reshape(len(at), k * k))
        return pd.DataFrame({"id": ids, "s": out})

    width = F.lit(float(beta)) if beta is not None else F.col("beta").cast("double")
    asked = targets.select("id", F.concat(F.col("x").cast("array<double>"), F.array(width)).alias("z"))
    known = _different(samples.select("id", F.col("x").cast("array<double>").alias("z"), "fx"), ["z"], F.sum("fx").alias("fx"), F.count("fx").alias("n"))
    places = _different(asked, ["z"])
    sums = meet_train(places, known, kernel, "id long, s array<double>", ["fx", "n"])
    total = sums.groupBy("id").agg(F.array(*[F.sum(F.get("s", i)) for i in range(k * k)]).alias("s"))

    def solve(batches):
        for batch in batches:
            out = []
            for s in batch["s"]:
                G = np.array(s).reshape(k, k)
                out.append(np.linalg.lstsq(G[: m + 1, : m + 1], G[: m + 1, m + 1], rcond=1e-13)[0])
            yield pd.DataFrame({"id": batch["id"], "c": out})

    fits = total.mapInPandas(solve, "id long, c array<double>")
    return asked.join(places.join(fits, "id").drop("id"), "z").select("id", "c")


def perplexity_bandwidths(targets: DataFrame, samples: DataFrame, m: int, perplexity: float, parts: int = 16, tol: float = 1e-9) -> DataFrame:
    """id, x, beta: for each target the bandwidth whose weights exp(-beta |x - x_t|^2) over all samples have entropy
    log(perplexity). The perplexity must be below the number of samples and above that of samples nearest to a target.

    All targets go on together: each has a bracket of beta, a round adds up the sums of `parts` bandwidths of every
    bracket in blocks of samples, and the bracket shrinks by as many parts. Entropies fall as beta grows. Equal targets
    have one bracket, and equal samples count as often as they occur.
    """
    from ridgeline.operators.pairs import nearest

    rows = samples.count()
    if not 1 <= perplexity < rows:
        raise ValueError("perplexity is from 1 to below the number of samples")
    x = coords("x", m)
    size = samples.agg(*[F.var_pop(c).alias(f"v{k}") for k, c in enumerate(x)]).first()
    scale = sum(v or 0.0 for v in size) or 1.0
    low, high = math.log(1e-12 / scale), math.log(1e24 / scale)
    train = _different(samples.select("id", F.col("x").cast("array<double>").alias("z")), ["z"], F.count("*").alias("n"))
    places = _different(targets.select("id", F.col("x").cast("array<double>").alias("z")), ["z"])
    near = nearest(places, train).select("id", (F.col("distance") * F.col("distance")).alias("d0"))
    state = places.join(near, "id").select("id", "z", "d0", F.lit(low).alias("low"), F.lit(high).alias("high"))
    goal, steps = math.log(perplexity), np.arange(1, parts) / parts

    def kernel(ids, z, b):
        if not len(ids):
            return pd.DataFrame({"id": ids, "s": []}).astype({"id": "int64"})
        to, count, out = _matrix(b["z"]), b["n"].to_numpy(float), np.empty((len(ids), 2 * len(steps)))
        few = max(1, (1 << 16) // max(1, len(b)))  # rows whose arrays stay in the cache
        for lo in range(0, len(ids), few):
            at = z[lo : lo + few]
            d2 = np.maximum(distances(at[:, :m], to) ** 2 - at[:, m : m + 1], 0)
            d2n, w = d2 * count, np.empty_like(d2)
            for k, t in enumerate(steps):
                np.multiply(d2, -np.exp(at[:, m + 1] + t * (at[:, m + 2] - at[:, m + 1]))[:, None], out=w)
                np.exp(w, out=w)
                out[lo : lo + few, 2 * k], out[lo : lo + few, 2 * k + 1] = w @ count, np.einsum("ij,ij->i", w, d2n)
        return pd.DataFrame({"id": ids, "s": list(out)})

    n, span = 2 * len(steps), high - low
    while span > tol:
        state = stored(state, "brackets")
        asked = state.select("id", F.concat("z", F.array("d0", "low", "high")).alias("z"))
        sums = meet_train(asked, train, kernel, "id long, s array<double>", ["n"]).groupBy("id").agg(F.array(*[F.sum(F.get("s", i)) for i in range(n)]).alias("s"))
        at = lambda k: F.col("low") + F.lit(float(steps[k])) * (F.col("high") - F.col("low"))
        above = sum((F.when(F.log(F.get("s", 2 * k)) + F.exp(at(k)) * F.get("s", 2 * k + 1) / F.get("s", 2 * k) > goal, 1).otherwise(0) for k in range(len(steps))), F.lit(0))
        wide = (F.col("high") - F.col("low")) / parts
        state = state.join(sums, "id").withColumn("above", above).select("id", "z", "d0", (F.col("low") + F.col("above") * wide).alias("low"), (F.col("low") + (F.col("above") + 1) * wide).alias("high"))
        span /= parts
    found = stored(state.select("z", F.exp((F.col("low") + F.col("high")) / 2).alias("beta")), "bandwidths")
    return targets.select("id", "x", F.col("x").cast("array<double>").alias("z")).join(found, "z").select("id", "x", "beta")


def perplexity_beta(d2: np.ndarray, perplexity: float) -> float:
    """The bandwidth whose weights exp(-beta d2) have entropy log(perplexity), by bisection."""
    d2 = d2 - d2.min()

    def entropy(beta):
        w = np.exp(-beta * d2)
        return math.log(w.sum()) + beta * (w * d2).sum() / w.sum()

    low, high, goal = 0.0, 1.0, math.log(perplexity)
    while entropy(high) > goal and high < 1e300:
        high *= 4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) > goal else (low, mid)
    return (low + high) / 2


def bandwidth(m: int, rows: int) -> float:
    """beta of the rule h = 2.34 M^(-1 / (max(m, 3) + 6)), beta = h / 2."""
    return 0.5 * 2.34 * rows ** (-1.0 / (max(m, 3) + 6))


def outer_product_of_gradients(targets: DataFrame, samples: DataFrame, m: int, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Subspace of local slopes, on inputs that are standardised by the samples; 1 / std undoes the scaling."""
    from ridgeline.operators.moments import active_subspace

    x = coords("x", m)
    row = samples.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(x) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, std = ([row[f"{k}{i}"] for i in range(m)] for k in "ms")
    std = [s or 1.0 for s in std]
    scaled = lambda df: df.withColumn("x", F.array(*[(c - F.lit(mu)) / F.lit(s) for c, mu, s in zip(x, mean, std, strict=True)]))
    slopes = local_linear(scaled(targets), scaled(samples), m, beta).select("id", F.slice("c", 2, m).alias("grad"))
    g = [gi / F.lit(s) for gi, s in zip(coords("grad", m), std, strict=True)]
    return active_subspace(slopes, g)


def initial_subspace(m: int, gradients: DataFrame | None = None, samples: DataFrame | None = None, points: DataFrame | None = None, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """A start for ridge fits: the subspace of the given gradients (grad), topped up to `most` by local slopes of the
    samples (id, x, fx) at points (id, x) of smallest hash, if there are more samples than inputs."""
    from ridgeline.operators.moments import active_subspace

    known = gradients.select("grad") if gradients is not None else None
    have = known.limit(most).count() if known is not None else 0
    if samples is not None and points is not None and have < most and samples.limit(m + 1).count() > m:
        chosen = points.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(most - have)
        slopes = local_linear(chosen, samples, m, bandwidth(m, samples.count())).select(F.slice("c", 2, m).alias("grad"))
        known = slopes if known is None else known.unionByName(slopes)
    if known is None:
        raise ValueError("neither gradients nor enough samples")
    return active_subspace(known, coords("grad", m))


# Geometry -----------------------------------------------------------------------------------------------------------


def voronoi_1d(points: DataFrame, low: float, high: float, x: str = "x") -> DataFrame:
    """v: the ends and the middles between neighbouring points of a line."""
    ordered = points.select(F.col(x).alias("x")).withColumn("next", F.lead("x").over(Window.orderBy("x")))
    ends = points.sparkSession.createDataFrame([(float(low),), (float(high),)], "v double")
    return ordered.where("next is not null").select(((F.col("x") + F.col("next")) / 2).alias("v")).unionByName(ends)


def enclosing_ball(points: DataFrame, m: int, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Centre and radius of a ball around all points, within 1 + 1 / sqrt(rounds) of the least (Badoiu and Clarkson): the
    centre moves toward the farthest point by ever smaller steps. points: id, z."""
    from ridgeline.operators.design import _to_point

    center, best = np.array(points.orderBy("id").limit(1).first()["z"], float), (None, math.inf)
    for k in range(rounds):
        far = points.select(_to_point("z", center).alias("d"), "id", "z").orderBy(F.desc("d"), "id").limit(1).first()
        if far["d"] < best[1]:
            best = (center.copy(), far["d"])
        center = center + (np.array(far["z"]) - center) / (k + 2)
    return best


def covering_cells(df: DataFrame, L, epsilons: list[float], m: int) -> DataFrame:
    """eps, cells: cells of size 2 eps / sqrt(m) in coordinates L x that hold a row."""
    x = coords("x", m)
    z = [dot(row, x) for row in np.atleast_2d(L)]
    sized = df.select(*[zi.alias(f"z{k}") for k, zi in enumerate(z)]).withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in epsilons])))
    cell = [F.floor(F.col(f"z{k}") / (2 * F.col("eps") / math.sqrt(m))) for k in range(len(z))]
    return sized.groupBy("eps").agg(F.countDistinct(*cell).alias("cells"))


def log_slopes(df: DataFrame, by: list[str], x: str, y: str, width: int = 5) -> DataFrame:
    """by, x, slope, median: two-point slopes of log y by log x, and their median over a sliding window."""
    over = Window.partitionBy(*by).orderBy(x)
    slope = (F.log(y) - F.log(F.lag(y).over(over))) / (F.log(x) - F.log(F.lag(x).over(over)))
    half = width // 2
    df = df.withColumn("slope", slope)
    return df.select(*by, x, "slope", F.percentile("slope", F.lit(0.5)).over(over.rowsBetween(-half, half)).alias("median"))


def vertices(starts: DataFrame, design: np.ndarray, lb, ub, rounds: int | None = None) -> DataFrame:
    """id, z, distance: start points pushed away from their nearest design point until others are as near or the box
    ends, once for each dimension: local candidates for the farthest point. Each start is independent."""
    X, lb, ub = np.array(design, float), np.array(lb, float), np.array(ub, float)
    m = X.shape[1]

    def push(z):
        active: list[np.ndarray] = []
        for _ in range(rounds or m):
            d = np.linalg.norm(X - z, axis=1)
            k = int(d.argmin())
            p = z - X[k]
            for a in active:
                p = p - (p @ a) * a
            if np.linalg.norm(p) < 1e-12:
                break
            p = p / np.linalg.norm(p)
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(p > 1e-14, (ub - z) / p, np.where(p < -1e-14, (lb - z) / p, np.inf))
                gap = (d**2 - d[k] ** 2) / (2 * ((X - X[k]) @ p))
            gap[((X - X[k]) @ p) <= 1e-14] = np.inf
            gap[k] = np.inf
            t, j = reach.min(), int(gap.argmin())
            if gap[j] <= t:
                t, normal = gap[j], X[j] - X[k]
            else:
                normal = np.eye(m)[int(reach.argmin())]
            if not np.isfinite(t):
                break
            z = z + max(t, 0) * p
            for a in active:
                normal = normal - (normal @ a) * a
            if np.linalg.norm(normal) > 1e-12:
                active.append(normal / np.linalg.norm(normal))
        return np.clip(z, lb, ub)

    def run(batches):
        for batch in batches:
            out = [push(np.array(z, float)) for z in batch["z"]]
            yield pd.DataFrame({"id": batch["id"], "z": out, "distance": [np.linalg.norm(X - z, axis=1).min() for z in out]})

    return starts.select("id", "z").mapInPandas(run, "id long, z array<double>, distance double")


# Propagation of uncertainty -----------------------------------------------------------------------------------------


def density(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """x, density: triangular kernel estimate with bandwidth IQR / 10 at the percentiles 0 to 100. Rows meet only the
    grid points within a bandwidth: an equi-join on cells of that width."""
    at = [k / points for k in range(points + 1)]
    p = df.agg(F.percentile(value, F.array(*[F.lit(a) for a in at])).alias("p"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(value).alias("n")).first()
    h, n = (p["q"][1] - p["q"][0]) / 10 or 1e-12, p["n"]
    spark = df.sparkSession
    grid = spark.createDataFrame([(k, float(x)) for k, x in enumerate(p["p"])], "k int, x double")
    rows = df.select(F.col(value).alias("v"), F.floor(F.col(value) / h).alias("cell"))
    near = grid.withColumn("cell", F.explode(F.array(*[F.floor(F.col("x") / h) + s for s in (-1, 0, 1)])))
    found = rows.join(near, "cell").groupBy("k").agg(F.sum(F.greatest(F.lit(0.0), 1 - F.abs(F.col("x") - F.col("v")) / h)).alias("s"))
    return grid.join(found, "k", "left").select("k", "x", (F.coalesce("s", F.lit(0.0)) / (n * h)).alias("density"))


def failure_share(designs: DataFrame, draws: DataFrame, value: Column, threshold: float, keep_columns: list[str]) -> DataFrame:
    """design columns, share: of the draws whose value exceeds the threshold, for each design. draws carry the design's
    key, so each design has its own."""
    return designs.join(draws, keep_columns).groupBy(*keep_columns).agg(F.avg((value > threshold).cast("double")).alias("share"))


def safety_factor(df: DataFrame, value: str, prob: float = 0.01, upper: bool = True, by: list[str] = ()) -> DataFrame:
    """The percentile that a value exceeds (upper) or falls below with the probability."""
    at = F.percentile(value, F.lit(1 - prob if upper else prob)).alias("factor")
    return df.groupBy(*by).agg(at) if by else df.agg(at)


# Gaussian processes -------------------------------------------------------------------------------------------------


class GaussianProcess:
    """f(x) = sum alpha_i exp(-|L (x - x_i)|^2 / 2) over at most `limit` places x_i (rows of smallest hash). Up to so many
    rows it interpolates them. Beyond, the x_i are inducing points and every row of the table counts: the sums of
    K(x_i, x) K(x, x_j) and K(x_i, x) f(x) are one aggregate over the different points x, each with its rows' count and sum."""

    def __init__(self, L, limit: int = 2000, nugget: float = 5 * np.finfo(float).eps):
        self.L, self.limit, self.nugget = np.atleast_2d(np.array(L, float)), limit, nugget

    def fit(self, train: DataFrame) -> GaussianProcess:
        from ridgeline.operators.ridge import grams

        rows = train.select("id", "x", "fx").orderBy(F.xxhash64("id"), "id").limit(self.limit + 1).toPandas()
        every = len(rows) <= self.limit
        rows = rows.iloc[: self.limit]
        X, L = _matrix(rows["x"]) @ self.L.T, self.L
        self.X, f = X, rows["fx"].to_numpy(float)
        K = np.exp(-0.5 * distances(X, X) ** 2)
        noise = self.nugget if every else max(self.nugget, 1e-8)
        self.K = K + noise * np.eye(len(f))
        self.inverse = np.linalg.pinv(self.K, rcond=1e-14, hermitian=True)
        if every:
            self.alpha = self.inverse @ f
            self.nll = 0.5 * float(f @ self.alpha) + 0.5 * float(np.linalg.slogdet(self.K)[1])
            return self
        n = len(f)
        at = train.groupBy("x").agg(F.count("*").alias("n"), F.sum("fx").alias("s"))

        def weighed(batch):
            root = np.sqrt(batch[["n"]].to_numpy(float))
            return np.hstack([np.exp(-0.5 * distances(_matrix(batch["x"]) @ L.T, X) ** 2) * root, batch[["s"]].to_numpy(float) / root])

        G = grams(at, weighed, n + 1)
        rows, squares = train.agg(F.count("*"), F.sum(F.col("fx") * F.col("fx"))).first()
        A = G[:n, :n] + noise * self.K
        back = np.linalg.pinv(A, rcond=1e-14, hermitian=True)
        self.alpha = back @ G[:n, n]
        self.inverse = self.inverse - noise * back
        logs = np.linalg.slogdet(A)[1] - np.linalg.slogdet(self.K)[1] + (rows - n) * math.log(noise)
        self.nll = 0.5 * float(squares - G[:n, n] @ self.alpha) / noise + 0.5 * float(logs)
        return self

    def predict(self, test: DataFrame) -> DataFrame:
        """id, mean, variance (not below 0)."""
        X, L, alpha, inverse = self.X, self.L, self.alpha, self.inverse

        def run(batches):
            for batch in batches:
                for k in range(0, len(batch), 1024):
                    part = batch[k : k + 1024]
                    c = np.exp(-0.5 * distances(_matrix(part["x"]) @ L.T, X) ** 2)
                    yield pd.DataFrame({"id": part["id"], "mean": c @ alpha, "variance": np.maximum(1 - ((c @ inverse) * c).sum(axis=1), 0)})

        return test.select("id", "x").mapInPandas(run, "id long, mean double, variance double")


def choose_scale(train: DataFrame, m: int, scales: list[float], limit: int = 1000, nugget: float = 1e-6) -> DataFrame:
    """scale, nll of constant metrics over the whole table (beyond `limit` rows through inducing points); the least is
    the best."""
    found = [(float(s), GaussianProcess(s * np.eye(m), limit, nugget).fit(train).nll) for s in scales]
    return train.sparkSession.createDataFrame(found, "scale double, nll double")

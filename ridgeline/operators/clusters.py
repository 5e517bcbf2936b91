"""Designs side by side: many sets of centres, each under a key, moved and measured together.

A pass over the candidates serves all keys: every task holds the centres (a few numbers for each, checked against a
bound), adds up its rows for each key and centre, and sends one row for each of these. Candidate tables: id, z.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.design import coffee_house
from ridgeline.operators.pairs import _matrix, distances
from ridgeline.operators.programs import least_quadratic
from ridgeline.sources.tables import stored

#: Bytes of centres that tasks hold at most; rows of a table of centres that is sent whole.
HELD, SENT = 64 << 20, 1 << 16


def _checked(designs: dict) -> dict:
    if sum(c.nbytes for c in designs.values()) > HELD:
        raise ValueError("too many centres at once: give the keys in portions")
    return designs


def _batches_at(z: np.ndarray, n: int):
    step = max(1, (1 << 22) // max(1, n * z.shape[1]))
    return ((k, z[k : k + step]) for k in range(0, len(z), step))


def _batches(z: np.ndarray, n: int):
    return (part for _, part in _batches_at(z, n))


def places(candidates: DataFrame) -> DataFrame:
    """id, z, n of the different points, stored: least id and number of rows. What only depends on points and counts is
    worked out from these."""
    return stored(candidates.groupBy("z").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "z", "n"), "places")


def owned_by(candidates: DataFrame, centers: np.ndarray) -> DataFrame:
    """key, distance, z: the nearest centre of each candidate, by tasks that hold all centres; ties to the first."""
    _checked({0: centers})

    def run(batches):
        for batch in batches:
            for k, z in _batches_at(_matrix(batch["z"]), len(centers)) if len(batch) else ():
                d = distances(z, centers)
                at = d.argmin(axis=1)
                yield pd.DataFrame({"key": at, "distance": d[np.arange(len(z)), at], "z": batch["z"].iloc[k : k + len(z)].to_numpy()})

    return candidates.select("z").mapInPandas(run, "key long, distance double, z array<double>")


def fill_distances(candidates: DataFrame, designs: dict[int, np.ndarray], sizes: list[int] | None = None) -> DataFrame:
    """key, size, distance: the largest distance of a candidate from the first `size` rows of each design (all of them,
    if no sizes are given); nested sizes share one table of distances."""
    _checked(designs)

    def run(batches):
        most: dict[tuple, float] = {}
        for batch in batches:
            for key, c in designs.items():
                wanted = [n for n in sizes if n <= len(c)] if sizes else [len(c)]
                for z in _batches(_matrix(batch["z"]), len(c)) if len(batch) else ():
                    near = np.minimum.accumulate(distances(z, c), axis=1)[:, [n - 1 for n in wanted]].max(axis=0)
                    for n, d in zip(wanted, near, strict=True):
                        most[key, n] = max(most.get((key, n), 0.0), float(d))
        yield pd.DataFrame([(*k, d) for k, d in most.items()], columns=["key", "size", "distance"]).astype({"key": "int64", "size": "int64"})

    return candidates.mapInPandas(run, "key long, size long, distance double").groupBy("key", "size").agg(F.max("distance").alias("distance"))


def moved_centers(candidates: DataFrame, designs: dict[int, np.ndarray], q: float = 10.0) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Each centre moved toward the q-norm centre of the candidates next to it (a Newton step: weighted mean with
    weights distance^(q - 2), by 1 / (q - 1)), and the fill distance of each design before the move. One pass. A column n of
    the candidates is how many rows each stands for."""
    _checked(designs)
    scale = {key: max(1e-300, float(np.abs(c).max(initial=1.0))) for key, c in designs.items()}

    def run(batches):
        sums = {key: np.zeros((len(c), c.shape[1] + 1)) for key, c in designs.items()}
        most = {key: np.zeros(len(c)) for key, c in designs.items()}
        for batch in batches:
            for key, c in designs.items():
                for start, z in _batches_at(_matrix(batch["z"]), len(c)) if len(batch) else ():
                    d = distances(z, c)
                    at = d.argmin(axis=1)
                    near = d[np.arange(len(z)), at]
                    np.maximum.at(most[key], at, near)
                    w = np.maximum(near / scale[key], 1e-9) ** (q - 2)
                    if "n" in batch:
                        w *= batch["n"].to_numpy(float)[start : start + len(z)]
                    np.add.at(sums[key], at, np.column_stack([w, w[:, None] * z]))
        rows = [(key, k, s.tolist(), float(d)) for key in designs for k, (s, d) in enumerate(zip(sums[key], most[key], strict=True)) if s[0] > 0]
        yield pd.DataFrame(rows, columns=["key", "place", "s", "far"])

    parts = candidates.mapInPandas(run, "key long, place long, s array<double>, far double")
    width = max(c.shape[1] for c in designs.values()) + 1
    totals = parts.groupBy("key", "place").agg(F.array(*[F.sum(F.get("s", i)) for i in range(width)]).alias("s"), F.max("far").alias("far")).collect()
    out, fill = {key: c.copy() for key, c in designs.items()}, dict.fromkeys(designs, 0.0)
    for r in totals:
        s, c = np.array(r["s"], float), out[r["key"]]
        c[r["place"]] += (s[1:] / s[0] - c[r["place"]]) / max(q - 1, 1)
        fill[r["key"]] = max(fill[r["key"]], r["far"])
    return out, fill


def spread_designs(candidates: DataFrame, designs: dict[int, np.ndarray], rounds: int = 20, q: float = 10.0, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """For each key the best centres and their fill distance, after rounds of moved_centers for all keys at once; a key
    whose best one has not gained tol in five rounds stays."""
    best = {key: (c, math.inf) for key, c in designs.items()}
    now, idle = dict(designs), dict.fromkeys(designs, 0)
    for _ in range(rounds + 1):
        new, fill = moved_centers(candidates, now, q)
        for key in list(now):
            gained = fill[key] < best[key][1] * (1 - tol)
            idle[key] = 0 if gained else idle[key] + 1
            if fill[key] < best[key][1]:
                best[key] = (now[key], fill[key])
        now = {key: c for key, c in new.items() if idle[key] < 5}
        if not now:
            break
    return best


def enclosing_balls(points: DataFrame, m: int, tol: float = 1e-3, rounds: int = 100) -> DataFrame:
    """key, center, radius, bound: for every key a ball around its points whose radius is within tol of the least one,
    which is not below bound. points: key, z.

    Each key keeps a core set: its least ball is a small program in the key's own group, and the key's farthest point
    from it joins. All keys go on together until every farthest point is near enough; a pass is one aggregate.
    """

    def ball(group: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(_matrix(group["z"]), axis=0)
        mean = p.mean(axis=0)
        size = max(np.abs(p - mean).max(), 1e-300)
        v = (p - mean) / size
        # The least |c|^2 + s with s >= |v|^2 - 2 v c is the squared radius.
        x, z = least_quadratic(np.diag([2.0] * m + [0.0]), np.array([0.0] * m + [1.0]), np.column_stack([2 * v, np.ones(len(v))]), (v * v).sum(axis=1))
        weight = z / max(z.sum(), 1e-300)
        low = max(0.0, weight @ (v * v).sum(axis=1) - ((weight @ v) ** 2).sum())  # of any weights: a bound
        return pd.DataFrame({"key": group["key"].iloc[:1], "center": [(x[:m] * size + mean).tolist()], "bound": [math.sqrt(low) * size]})

    core = stored(points.groupBy("key").agg(F.max("z").alias("z")), "core")
    for _ in range(rounds):
        centers = stored(core.groupBy("key").applyInPandas(ball, "key long, center array<double>, bound double"), "centers")
        sent = F.broadcast(centers) if centers.count() <= SENT else centers
        d = F.sqrt(F.aggregate(F.zip_with("z", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        far = stored(points.join(sent, "key").groupBy("key").agg(F.max(F.struct(d.alias("d"), "z")).alias("w")), "far")
        found = centers.join(far, "key").select("key", "center", F.col("w.d").alias("radius"), "bound", F.col("w.z").alias("z"))
        open_ = found.where(F.col("radius") > F.col("bound") * (1 + tol) + 1e-12)
        if open_.isEmpty():
            return found.drop("z")
        core = stored(core.unionByName(open_.select("key", "z")), "core")
    raise RuntimeError(f"balls are still open after {rounds} rounds")


def minimax_lloyd(candidates: DataFrame, m: int, n: int, rounds: int = 20, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Centres that keep the farthest candidate near, each the middle of the least ball around the candidates next to it,
    and their fill distance. From the greedy design on; a centre without candidates stays. Ends when a round gains less
    than tol of the distance."""
    at = places(candidates)
    first = coffee_house(at, n).join(at, "id").orderBy("place").select("z").collect()
    centers, best = np.array([r["z"] for r in first], float), (None, math.inf)
    for _ in range(rounds):
        owned = stored(owned_by(at, centers), "owned")
        fill = owned.agg(F.max("distance")).first()[0]
        if not fill < best[1] * (1 - tol):
            break
        best = (centers.copy(), fill)
        for r in enclosing_balls(owned.select("key", "z"), m, tol).collect():  # n rows
            centers[r["key"]] = r["center"]
    return best


def matched(centers: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The rows of `to` in the order of the centres that they are nearest to, each once, nearest pairs first."""
    d, out = distances(centers, to), np.empty_like(centers)
    for _ in range(len(centers)):
        i, j = np.unravel_index(d.argmin(), d.shape)
        out[i] = to[j]
        d[i], d[:, j] = np.inf, np.inf
    return out


def minimax_particles(candidates: DataFrame, n: int, particles: int = 8, rounds: int = 15, q: float = 10.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Centres that keep the farthest candidate near, by several designs that learn from each other: each moves by its
    clusters, then to a random convex mix of that, its own best, the best of all (centres matched first) and random
    candidates; after each round the worst starts again next to the best. One pass a round for all particles."""
    rng, at = np.random.default_rng(seed), places(candidates)
    first = coffee_house(at, n).join(at, "id").orderBy("place").select("z").collect()
    greedy = np.array([r["z"] for r in first], float)
    drawn = candidates.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n * particles).select("z").collect()
    pool = np.array([r["z"] for r in drawn], float)
    now = {0: greedy} | {k: pool[rng.permutation(len(pool))[: len(greedy)]] for k in range(1, particles)}
    own, best = {key: (c, math.inf) for key, c in now.items()}, (greedy, math.inf)
    for step in range(rounds):
        new, fill = moved_centers(at, now, q)
        for key, d in fill.items():
            if d < own[key][1]:
                own[key] = (now[key], d)
            if d < best[1]:
                best = (now[key], d)
        worst = max(fill, key=fill.get)
        for key in now:
            # Later rounds trust the clusters more; the first particle always does.
            w = rng.dirichlet([4.0 + step, 2.0, 2.0, 0.3])
            away = pool[rng.permutation(len(pool))[: len(greedy)]]
            mix = w[0] * new[key] + w[1] * matched(new[key], own[key][0]) + w[2] * matched(new[key], best[0]) + w[3] * matched(new[key], away)
            now[key] = new[key] if key == 0 else mix
        if worst != 0:
            now[worst] = best[0] + rng.standard_normal(best[0].shape) * best[1] / 4
            own[worst] = (now[worst], math.inf)
    final = spread_designs(at, {0: best[0]}, rounds=5, q=q)[0]
    return final if final[1] < best[1] else best


def cover_size(candidates: DataFrame, radius: float, at_once: int = 4, rounds: int = 10, q: float = 10.0) -> tuple[int, int, np.ndarray, float]:
    """The least number of centres found whose balls of the radius hold all candidates, a number below which no centres
    do, the centres and their fill distance.

    The greedy design gives both ends: points that entered it more than two radii from the others need a centre each,
    and it covers once it comes within the radius. In between, `at_once` sizes a round are spread side by side.
    """
    candidates, n = places(candidates), 8
    while True:
        order = coffee_house(candidates, n).orderBy("place").collect()
        if len(order) < n or order[-1]["distance"] is not None and order[-1]["distance"] <= radius:
            break
        n *= 2
    entered = [math.inf if r["distance"] is None else r["distance"] for r in order]
    low = max(1, sum(d > 2 * radius for d in entered))
    high = sum(d > radius for d in entered)
    rows = {r["id"]: r["z"] for r in candidates.join(F.broadcast(candidates.sparkSession.createDataFrame([(r["id"],) for r in order[:high]], "id long")), "id").select("id", "z").collect()}
    z = np.array([rows[r["id"]] for r in order[:high]], float)
    best = (z, float(fill_distances(candidates, {0: z}).first()["distance"]))
    floor = low
    while low < high:
        sizes = sorted({int(round(low + (high - 1 - low) * k / max(1, at_once - 1))) for k in range(at_once)})
        found = spread_designs(candidates, {k: z[:k] for k in sizes}, rounds, q)
        fits = [k for k in sizes if found[k][1] <= radius]
        if fits:
            high, best = min(fits), found[min(fits)]
        low = max([low, *(k + 1 for k in sizes if k < high)])
    return high, floor, best[0], best[1]


def design_rates(candidates: DataFrame, designs: dict[tuple[str, int], np.ndarray], sizes: list[int]) -> DataFrame:
    """method, size, trials, low, median, high: the 25, 50 and 75 per cent points over trials of the fill distances of
    growing designs. designs: points in order of entry under (method, trial); all of them meet the candidates in one
    pass."""
    keys = sorted(designs)
    spark = candidates.sparkSession
    named = spark.createDataFrame([(k, method, trial) for k, (method, trial) in enumerate(keys)], "key long, method string, trial long")
    found = fill_distances(candidates, {k: designs[name] for k, name in enumerate(keys)}, sizes).join(F.broadcast(named), "key")
    points = F.percentile("distance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = found.groupBy("method", "size").agg(F.count("*").alias("trials"), points.alias("p"))
    return out.select("method", "size", "trials", *[F.get("p", k).alias(name) for k, name in enumerate(("low", "median", "high"))])


def low_rank_points(ids: DataFrame, L, lb, ub, seed: int = 0) -> DataFrame:
    """id, x, z = L x for each id: a random convex combination of corners of the box that are extreme along random
    directions of L's rows. Few points of a box of many inputs are near the ends of what L sees; these fill it.

    One more corner than L has rows is mixed; numbers come from hashes of the id, so reruns agree.
    """
    L = np.atleast_2d(np.array(L, float))
    U = np.linalg.svd(L, full_matrices=False)[2]
    r, m = U.shape

    def unit(k: int):
        return (F.xxhash64(F.lit(seed), F.lit(k), "id").bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))

    x, weights = [F.lit(0.0)] * m, [-F.log(unit(k)) for k in range(r + 1)]
    total = sum(weights, F.lit(0.0))
    for k in range(r + 1):
        way = [F.sqrt(-2 * F.log(unit(1000 + 2 * (k * r + j)))) * F.cos(2 * math.pi * unit(1001 + 2 * (k * r + j))) for j in range(r)]
        for i in range(m):
            along = sum((F.lit(float(U[j, i])) * way[j] for j in range(r)), F.lit(0.0))
            corner = F.when(along > 0, F.lit(float(ub[i]))).otherwise(F.lit(float(lb[i])))
            x[i] = x[i] + weights[k] / total * corner
    out = ids.select("id", F.array(*x).alias("x"))
    return out.select("id", "x", F.array(*[sum((F.lit(float(v)) * F.get("x", i) for i, v in enumerate(row)), F.lit(0.0)) for row in L]).alias("z"))


def swapped(designs: DataFrame, swaps: int = 200, seed: int = 0) -> DataFrame:
    """design_id, id, x: each design (a Latin hypercube stays one) after a local search of its own: two rows trade one
    coordinate if the sorted nearest distances get lexicographically greater. Designs go side by side, each in its group
    of as many rows as a design has."""

    def search(key, group):
        group = group.sort_values("id")
        x = _matrix(group["x"])
        n, m = x.shape
        rng = np.random.default_rng([seed, int(key[0])])
        d = distances(x, x) + np.diag(np.full(n, np.inf))
        score = np.sort(d.min(axis=1))
        for _ in range(swaps if n > 2 else 0):
            worst = np.flatnonzero(d.min(axis=1) <= score[0] * (1 + 1e-12))
            i, j, k = int(rng.choice(worst)), int(rng.integers(n)), int(rng.integers(m))
            if i == j:
                continue
            y = x.copy()
            y[[i, j], k] = x[[j, i], k]
            e = d.copy()
            for row in (i, j):
                e[row] = e[:, row] = np.sqrt(((y - y[row]) ** 2).sum(axis=1))
                e[row, row] = np.inf
            new = np.sort(e.min(axis=1))
            differ = np.flatnonzero(np.abs(new - score) > 1e-12)
            if len(differ) and new[differ[0]] > score[differ[0]]:
                x, d, score = y, e, new
        return pd.DataFrame({"design_id": group["design_id"], "id": group["id"], "x": list(x)})

    return designs.groupBy("design_id").applyInPandas(search, "design_id long, id long, x array<double>")

"""Experimental designs chosen from candidate tables, and sampling rules that Spark generates.

Greedy selection keeps one distance column and sends one row a step. Candidate tables: id, z (already in the metric).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators.domain import Domain
from ridgeline.operators.pairs import BLOCK, CELLS, _matrix, by_coordinate, closest, distances, meet_cells, meet_train, nearest, within
from ridgeline.sources.tables import stored

#: Steps of a loop after which its column is written.
WRITE_EVERY = 10


def _to_point(column: str, z) -> Column:
    point = F.array(*[F.lit(float(v)) for v in z])
    return F.sqrt(F.aggregate(F.zip_with(column, point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def coffee_house(candidates: DataFrame, n: int, start: DataFrame | None = None) -> DataFrame:
    """place, id, distance: n candidates, each the farthest from the ones before (and from start, or from the least id
    first); ties to the smaller id. The distance of a first one without start is null."""
    spark = candidates.sparkSession
    df, chosen = candidates.select("id", "z").withColumn("far", F.lit(float("inf"))), []
    if start is not None:
        df = df.drop("far").join(min_distance(candidates, start), "id").withColumnRenamed("distance", "far")
    for k in range(n):
        if k == 0 and start is None:
            row = df.orderBy("id").limit(1).collect()
        else:
            row = df.where("far > 0").orderBy(F.desc("far"), "id").limit(1).collect()
        if not row:
            break
        r = row[0]
        chosen.append((k + 1, r["id"], None if math.isinf(r["far"]) else r["far"]))
        df = df.withColumn("far", F.least("far", _to_point("z", r["z"])))
        if k % WRITE_EVERY == WRITE_EVERY - 1:
            df = stored(df, "far")
    return spark.createDataFrame(chosen, "place int, id long, distance double")


def spread_on_sphere(directions: DataFrame, n: int) -> DataFrame:
    """place, id, distance: n directions that are far apart on the unit sphere, chosen greedily from rows of any length
    other than 0. directions: id, z."""
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v))
    unit = directions.withColumn("_length", length).where("_length > 0").select("id", F.transform("z", lambda v: v / F.col("_length")).alias("z"))
    return coffee_house(stored(unit, "directions"), n)


def min_distance(candidates: DataFrame, design: DataFrame) -> DataFrame:
    """id, distance to the nearest row of the design."""
    return nearest(candidates, design).select("id", "distance")


def fill_distance(candidates: DataFrame, design: DataFrame) -> DataFrame:
    """The largest distance of a candidate from the design, and that candidate (least id of equals)."""
    worst = F.max(F.struct("distance", (-F.col("id")).alias("neg"))).alias("w")
    return min_distance(candidates, design).agg(worst).select((-F.col("w.neg")).alias("id"), F.col("w.distance").alias("distance"))


def _scores(candidates: DataFrame, design: DataFrame, metrics: list[str]) -> DataFrame:
    """id and the distance to the design in each metric, d_ and its name, stored."""
    score = None
    for c in metrics:
        d = nearest(candidates.select("id", F.col(c).alias("z")), design.select("id", F.col(c).alias("z"))).select("id", F.col("distance").alias(f"d_{c}"))
        score = d if score is None else score.join(d, "id")
    return stored(score, "scores")


def _farthest_scored(scores: DataFrame, candidates: DataFrame, design: DataFrame, metrics: list[str], slack: float) -> DataFrame:
    product = F.lit(1.0)
    for c in metrics:
        product = product * F.col(f"d_{c}")
    scored = scores.select("id", product.alias("score"))
    best = scored.agg(F.max("score")).first()[0]
    # Only those with enough score are looked at in the space of all inputs.
    open_ = stored(scored.where(F.col("score") >= slack * best if best is not None else F.lit(False)), "open")
    spread = nearest(candidates.select("id", "z").join(open_, "id", "left_semi"), design.select("id", "z")).select("id", F.col("distance").alias("spread"))
    return open_.join(spread, "id").orderBy(F.desc("spread"), "id").limit(1)


def seq_maximin(candidates: DataFrame, design: DataFrame, metrics: list[str], slack: float = 0.9) -> DataFrame:
    """id, score, spread of the next point: candidates are scored by the product of their distances to the design in
    all metrics; of those with at least slack of the best, the one that is farthest in the first column `z` wins.

    candidates and design: id, z and one array column for each metric.
    """
    return _farthest_scored(_scores(candidates, design, metrics), candidates, design, metrics, slack)


def stretched(candidates: DataFrame, design: DataFrame, metrics: list[str], width: float) -> DataFrame:
    """place, metric, id, distance, left: the metric in which a candidate can be farthest from the design comes first; the
    candidates within `width` of that one in this metric stay (`left` of them), and the next metric is chosen among them.
    The last id is the next point of the design. Ties go to the earlier metric, then to the smaller id.

    candidates and design: id and one array column for each metric.
    """
    open_metrics, chosen, kept = list(metrics), [], candidates
    for place in range(1, len(metrics) + 1):
        best = None
        for c in open_metrics:
            far = fill_distance(kept.select("id", F.col(c).alias("z")), design.select("id", F.col(c).alias("z"))).first()
            if far["distance"] is not None and (best is None or far["distance"] > best[2]):
                best = (c, far["id"], far["distance"])
        if best is None:
            break
        point = kept.where(F.col("id") == best[1]).select(best[0]).first()[0]
        kept = stored(kept.where(_to_point(best[0], point) <= width), "slab")
        open_metrics.remove(best[0])
        chosen.append((place, *best, kept.count()))
    return candidates.sparkSession.createDataFrame(chosen, "place int, metric string, id long, distance double, left long")


def batch_maximin(candidates: DataFrame, design: DataFrame, metrics: list[str], n: int, slack: float = 0.9) -> DataFrame:
    """place, id of n further points, each by seq_maximin with the ones before it in the design, so all of them can be
    evaluated at once. Ends early when every candidate lies on the design in some metric."""
    spark, chosen = candidates.sparkSession, []
    scores = _scores(candidates, design, metrics)
    for place in range(1, n + 1):
        found = _farthest_scored(scores, candidates, design, metrics, slack).collect()
        if not found or not found[0]["score"] > 0:
            break
        chosen.append((place, found[0]["id"]))
        # One row joins the design, and only its distances are new.
        row = stored(candidates.where(F.col("id") == found[0]["id"]).select(*design.columns), "row")
        design = stored(design.unionByName(row), "design")
        new = _scores(candidates, row, metrics).withColumnsRenamed({f"d_{c}": f"n_{c}" for c in metrics})
        scores = stored(scores.join(new, "id").select("id", *[F.least(f"d_{c}", f"n_{c}").alias(f"d_{c}") for c in metrics]), "scores")
    return spark.createDataFrame(chosen, "place int, id long")


def block_maximin(candidates: DataFrame, n: int, tol: float = 1e-9) -> DataFrame:
    """place, id, distance: n candidates of which none can move to a candidate that is farther (by more than tol) from
    the others; distance is the one to the nearest of these. From the greedy design on, the point that gains most moves
    to the farthest candidate from the others. Each move raises the smallest of the distances that it changes, so the
    moves end. One pass over the candidates a move, which returns n rows."""
    spark = candidates.sparkSession
    start = coffee_house(candidates, n).select("place", "id").join(candidates.select("id", "z"), "id").orderBy("place").collect()
    ids, z = [r["id"] for r in start], np.array([r["z"] for r in start], float)
    near = np.full(len(ids), np.inf)
    while len(ids) > 1:
        d = candidates.select("id", F.array(*[_to_point("z", p) for p in z]).alias("d"))
        d = d.select("id", F.array_sort("d").alias("s"), (F.array_position("d", F.array_min("d")) - 1).alias("at"))
        d = d.select("id", "at", F.get("s", 0).alias("first"), F.get("s", 1).alias("second"))
        free = [F.when(F.col("at") == k, F.col("second")).otherwise(F.col("first")) for k in range(len(ids))]
        row = d.agg(*[F.max(F.struct(c.alias("far"), (-F.col("id")).alias("neg"))).alias(f"k{k}") for k, c in enumerate(free)]).first()
        apart = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) + np.diag(np.full(len(ids), np.inf))
        near = apart.min(axis=1)
        gain = [row[f"k{k}"]["far"] - near[k] for k in range(len(ids))]
        k = int(np.argmax(gain))
        if gain[k] <= tol:
            break
        ids[k] = -row[f"k{k}"]["neg"]
        z[k] = candidates.where(F.col("id") == ids[k]).select("z").first()["z"]
    return spark.createDataFrame([(k + 1, i, None if math.isinf(x) else float(x)) for k, (i, x) in enumerate(zip(ids, near))], "place int, id long, distance double")


def scale_design(candidates: DataFrame, design: DataFrame, center, low: float = 0.5, steps: int = 20) -> DataFrame:
    """alpha, distance: fill distances of the design shrunk toward a centre by each scale; the least is the best."""
    c = F.array(*[F.lit(float(v)) for v in center])
    alphas = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    grown = design.withColumn("step", alphas).withColumn("alpha", F.lit(low) + (1 - low) * F.col("step") / max(steps - 1, 1))
    grown = grown.withColumn("z", F.zip_with("z", c, lambda a, b: b + (a - b) * F.col("alpha")))

    def kernel(ids, z, b):
        out = []
        for step, part in b.groupby("step"):
            if len(ids):
                out.append(pd.DataFrame({"id": ids, "step": step, "distance": closest(z, _matrix(part["z"]))[2]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "step": [], "distance": []}).astype({"id": "int64", "step": "int32", "distance": float})

    near = meet_train(candidates, grown, kernel, "id long, step int, distance double", ["step"]).groupBy("id", "step").agg(F.min("distance").alias("distance"))
    return near.groupBy("step").agg(F.max("distance").alias("distance")).select((F.lit(low) + (1 - low) * F.col("step") / max(steps - 1, 1)).alias("alpha"), "distance")


def minimax_clusters(candidates: DataFrame, m: int, n: int, rounds: int = 20, q: float = 10.0, inner: int = 5, seed: int = 0) -> tuple[np.ndarray, float]:
    """Centres that keep the farthest candidate near: Lloyd rounds with the q-norm centre of each cluster (weighted
    means, weights distance^(q - 2)). Returns the best centres found and their fill distance."""
    first = coffee_house(candidates, n).join(candidates, "id").select("z").collect()
    centers, best = np.array([r["z"] for r in first]), (None, math.inf)
    spark = candidates.sparkSession
    for _ in range(rounds):
        table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "id long, z array<double>")
        owned = stored(nearest(candidates, table).join(candidates, "id"), "owned")
        fill = owned.agg(F.max("distance")).first()[0]
        if fill < best[1]:
            best = (centers, fill)
        moved = centers.copy()
        for _ in range(inner):
            here = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(moved)], "other long, c array<double>")
            d = F.sqrt(F.aggregate(F.zip_with("z", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
            weighted = owned.join(F.broadcast(here), "other").withColumn("w", F.pow(F.greatest(d, F.lit(1e-12)), F.lit(q - 2)))
            means = weighted.groupBy("other").agg(*[(F.sum(F.col("w") * F.get("z", i)) / F.sum("w")).alias(f"c{i}") for i in range(m)]).collect()
            new = moved.copy()
            for r in means:
                new[r["other"]] = moved[r["other"]] + (np.array([r[f"c{i}"] for i in range(m)]) - moved[r["other"]]) / max(q - 1, 1)
            moved = new
        if np.abs(moved - centers).max() < 1e-9:
            break
        centers = moved
    return best


def poisson_disk(candidates: DataFrame, radius: float, m: int, seed: int = 0) -> DataFrame:
    """A maximal set of candidates with all distances above the radius: rows of least random rank among their open
    neighbours enter, their neighbours leave, until none is open. Neighbours meet in cells, and no pair is stored; of
    equal points only the one of least rank can enter. Rows that meet a neighbour of lesser rank are compared no more."""
    first = F.min(F.struct(F.xxhash64(F.lit(seed), "id").alias("rank"), "id")).alias("s")
    left = stored(candidates.where("z is not null").groupBy("z").agg(first).select("s.id", "s.rank", "z"), "open")
    chosen = None
    while left.limit(1).count():
        beaten = _near_lesser(left, left, radius)
        enter = stored(left.join(beaten, "id", "left_anti"), "enter")
        chosen = enter.select("id") if chosen is None else chosen.unionByName(enter.select("id"))
        gone = _near_lesser(left.join(enter.select("id"), "id", "left_anti"), enter, radius)
        left = stored(left.join(gone.unionByName(enter.select("id")), "id", "left_anti"), "left")
    return candidates.join(chosen, "id", "left_semi") if chosen is not None else candidates


def _near_lesser(asked: DataFrame, near: DataFrame, radius: float) -> DataFrame:
    """id of the asked rows that have a row of `near` in the radius with a lesser rank, or the same rank and a lesser id."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        order = pd.concat([a, b]).groupby(["rank", "id"]).ngroup().to_numpy()
        place, b = order[: len(a)], b.assign(place=order[len(a) :]).sort_values("place")
        z, to, places, beaten = _matrix(a["z"]), _matrix(b["z"]), b["place"].to_numpy(), np.zeros(len(a), bool)
        step = 64
        for j in range(0, len(b), step):
            still = np.flatnonzero(~beaten & (place > places[j]))
            if not len(still):
                break
            for k in range(0, len(still), max(1, CELLS // step)):
                at = still[k : k + max(1, CELLS // step)]
                beaten[at] = ((by_coordinate(z[at], to[j : j + step]) <= radius) & (places[j : j + step] < place[at, None])).any(axis=1)
        return pd.DataFrame({"id": a["id"][beaten]})

    return meet_cells(asked.select("id", "z", "rank"), near.select("id", "z", "rank"), radius, kernel, "id long").distinct()


def _counts_within(asked: DataFrame, counted: DataFrame, radius: float) -> DataFrame:
    """id, within: the sum of n of the counted points in the radius around each asked one, if there are any."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        z, to, n = _matrix(a["z"]), _matrix(b["z"]), b["n"].to_numpy(float)
        found, step = np.zeros(len(a)), max(1, CELLS // min(BLOCK, len(b)))
        for j in range(0, len(b), BLOCK):
            for k in range(0, len(a), step):
                found[k : k + step] += within(z[k : k + step], to[j : j + BLOCK], radius) @ n[j : j + BLOCK]
        return pd.DataFrame({"id": a["id"], "within": found.astype("int64")})[found > 0]

    found = meet_cells(asked.select("id", "z"), counted.select("id", "z", "n"), radius, kernel, "id long, within long")
    return found.groupBy("id").agg(F.sum("within").alias("within"))


def greedy_cover(points: DataFrame, radius: float) -> DataFrame:
    """place, id, gained: points chosen so that all lie within the radius of one; each is the one with most uncovered
    neighbours after those before it, ties to the smaller id (at most ln n times as many as needed). Equal points are one
    with a count.

    A round takes all points that none within two radii goes before: what they gain is disjoint, and no choice elsewhere
    changes it, so these are the choices of one at a time. A point alone in its radius is taken from the start. Points
    that a round covers are taken from the counts of those around them: no pair is stored."""
    at = stored(points.where("z is not null").groupBy("z").agg(F.min("id").alias("id"), F.count("*").alias("n")), "places")
    counted = stored(at.join(_counts_within(at, at, radius), "id").withColumn("open", F.lit(True)), "gains")
    alone = F.col("within") == F.col("n")
    chosen, state = counted.where(alone).select("id", "within"), counted.where(~alone)
    while True:
        ranked = state.withColumn("rank", -F.col("within"))
        enter = stored(ranked.join(_near_lesser(ranked, ranked, 2.001 * radius), "id", "left_anti").select("id", "z", "within", F.lit(1).alias("n")), "enter")
        if not enter.limit(1).count():
            return _in_order(chosen)
        chosen = chosen.unionByName(enter.select("id", "within"))
        open_ = state.where("open")
        covered = stored(open_.join(_counts_within(open_, enter, radius), "id", "left_semi").select("id", "z", "n"), "covered")
        lost = _counts_within(state, covered, radius).withColumnRenamed("within", "lost")
        left = state.join(lost, "id", "left").join(covered.select("id", F.lit(True).alias("hit")), "id", "left")
        gain = F.col("within") - F.coalesce("lost", F.lit(0))
        state = stored(left.where(gain > 0).select("id", "z", "n", gain.alias("within"), (F.col("open") & F.col("hit").isNull()).alias("open")), "gains")


def _in_order(chosen: DataFrame) -> DataFrame:
    """place, id, gained of chosen points (id, within): the most gained first, then the smaller id. Ranges of that order are
    numbered by themselves, after the sizes of those before."""
    order = [F.desc("within"), F.col("id")]
    dealt = chosen.repartitionByRange(int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), "chosen")
    sizes = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    place = (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).cast("int")
    return dealt.join(sizes.select("part", "before"), "part").select(place.alias("place"), "id", F.col("within").alias("gained"))


def latin_hypercube(spark: SparkSession, domain: Domain, n: int, seed: int = 0, designs: int = 1) -> DataFrame:
    """design_id, id, x: midpoints of n bins on each axis, in independent random orders."""
    out = spark.range(n * designs).select(F.floor(F.col("id") / n).alias("design_id"), (F.col("id") % n).alias("id"))
    for k, (low, high) in enumerate(zip(domain.lb, domain.ub, strict=True)):
        bins = spark.range(n * designs).select(F.floor(F.col("id") / n).alias("design_id"), (F.col("id") % n).alias("bin"))
        order = Window.partitionBy("design_id").orderBy(F.xxhash64(F.lit(seed), F.lit(k), "design_id", "bin"))
        axis = bins.select("design_id", (F.row_number().over(order) - 1).cast("long").alias("id"), (F.lit(low) + (F.col("bin") + 0.5) * F.lit((high - low) / n)).alias(f"x{k}"))
        out = out.join(axis, ["design_id", "id"])
    return out.select("design_id", "id", F.array(*[F.col(f"x{k}") for k in range(domain.m)]).alias("x"))


def best_design(designs: DataFrame) -> DataFrame:
    """design_id, score: of many designs (design_id, id, x) the one whose sorted nearest distances are lexicographically
    greatest; ties to the smaller number."""

    def score(group: pd.DataFrame) -> pd.DataFrame:
        d = distances(_matrix(group["x"]), _matrix(group["x"]))
        np.fill_diagonal(d, np.inf)
        return pd.DataFrame({"design_id": group["design_id"].iloc[:1], "score": [np.sort(d.min(axis=1)).round(12).tolist()]})

    scored = designs.groupBy("design_id").applyInPandas(score, "design_id long, score array<double>")
    return scored.orderBy(F.desc("score"), "design_id").limit(1)


def line_design(spark: SparkSession, low, high, n: int, minimax: bool = False) -> DataFrame:
    """id, x: n points between two corners: evenly with both ends, or the middles of n bins."""
    t = (F.col("id") + 0.5) / n if minimax else F.col("id") / max(n - 1, 1)
    return spark.range(n).select("id", F.array(*[F.lit(float(a)) + t * F.lit(float(b - a)) for a, b in zip(low, high, strict=True)]).alias("x"))


def simplex(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """id, x: uniform points whose m coordinates add up to 1."""
    cuts = F.array_sort(F.array(F.lit(0.0), *[F.rand(seed + k) for k in range(m - 1)], F.lit(1.0)))
    df = spark.range(n).select("id", cuts.alias("c"))
    return df.select("id", F.array(*[F.get("c", k + 1) - F.get("c", k) for k in range(m)]).alias("x"))


def sobol(spark: SparkSession, domain: Domain, n: int) -> DataFrame:
    """id, x: the first n Sobol points (without the origin) of the bounds that lie in the domain. Direction numbers come
    from primitive polynomials found in order; initial numbers are odd ones from a seeded generator, so that high
    dimensions with polynomials of one degree differ from the first bits on."""
    directions, bits = _directions(domain.m), 31
    drawn = n
    while True:
        df = spark.range(1, drawn + 1)
        gray = F.col("id").bitwiseXOR(F.shiftright("id", 1))
        x = []
        for k in range(domain.m):
            total = F.lit(0).cast("long")
            for b in range(bits):
                total = total.bitwiseXOR(F.when(F.shiftright(gray, b).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(directions[k][b])).otherwise(F.lit(0).cast("long")))
            u = total / F.lit(float(1 << bits))
            x.append(F.lit(domain.lb[k]) + F.lit(domain.ub[k] - domain.lb[k]) * u)
        out = df.select("id", F.array(*x).alias("x"))
        out = out if domain.is_box else out.where(domain.contains([F.get("x", i) for i in range(domain.m)]))
        if domain.is_box or out.limit(n).count() >= n:
            return out.orderBy("id").limit(n)
        drawn *= 4


def _directions(m: int, bits: int = 31) -> list[list[int]]:
    out = [[1 << (bits - 1 - b) for b in range(bits)]]
    degree, code, rng = 1, 0, np.random.default_rng(1)
    while len(out) < m:
        poly = (1 << degree) | (code << 1) | 1
        if _primitive(poly, degree):
            # Any odd number below 2^(b + 1) keeps each axis a perfect binary net.
            v = [(2 * int(rng.integers(1 << b)) + 1) << (bits - 1 - b) for b in range(degree)]
            for b in range(degree, bits):
                new = v[b - degree] ^ (v[b - degree] >> degree)
                for k in range(1, degree):
                    if code >> (degree - 1 - k) & 1:
                        new ^= v[b - k]
                v.append(new)
            out.append(v[:bits])
        code += 1
        if code >= 1 << (degree - 1):
            degree, code = degree + 1, 0
    return out


def _primitive(poly: int, degree: int) -> bool:
    """Whether x generates all non-zero residues modulo poly."""
    x, steps = 1, 0
    while True:
        x <<= 1
        if x >> degree:
            x ^= poly
        steps += 1
        if x == 1 or steps > (1 << degree):
            return steps == (1 << degree) - 1


def gauss_legendre(n: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights by the eigenvalues of the Jacobi matrix (Golub and Welsch)."""
    k = np.arange(1, n)
    off = k / np.sqrt(4 * k * k - 1.0)
    values, vectors = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    return (low + high) / 2 + (high - low) / 2 * values, (high - low) * vectors[0] ** 2


def tensor_rule(spark: SparkSession, domain: Domain, per_axis: int) -> DataFrame:
    """id, x, w: the tensor Gauss-Legendre rule, without nodes outside."""
    n, m = per_axis, domain.m
    df = spark.range(n**m)
    x, w = [], F.lit(1.0)
    for k in range(m):
        nodes, weights = gauss_legendre(n, domain.lb[k], domain.ub[k])
        at = (F.floor(F.col("id") / n ** (m - 1 - k)) % n).cast("int")
        x.append(F.get(F.array(*[F.lit(float(v)) for v in nodes]), at))
        w = w * F.get(F.array(*[F.lit(float(v)) for v in weights]), at)
    out = df.select("id", F.array(*x).alias("x"), w.alias("w"))
    return out if domain.is_box else out.where(domain.contains([F.get("x", i) for i in range(m)]))


def monte_carlo_rule(spark: SparkSession, domain: Domain, n: int, seed: int = 0) -> DataFrame:
    """id, x, w with w = volume / n."""
    return domain.sample(spark, n, seed).withColumn("w", F.lit(domain.volume(spark) / n))

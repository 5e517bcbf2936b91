"""Domains that compile to filters, projections and generators.

A domain holds small constants. Applied to coordinate columns it gives Boolean columns (membership), rescaled columns
and distances to its boundary; asked for samples it gives a DataFrame.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOL = 1e-5
INF = float("inf")


class EmptyDomain(ValueError):
    """No point satisfies the constraints."""


class UnboundedDomain(ValueError):
    """The operation needs finite bounds."""


def coords(name: str, m: int) -> list[Column]:
    """The m coordinates of an array column."""
    return [F.get(name, i) for i in range(m)]


def dot(a, x: list[Column]) -> Column:
    """Sum of a_i * x_i over the non-zero a_i."""
    terms = [xi if ai == 1 else F.lit(float(ai)) * xi for ai, xi in zip(a, x, strict=True) if ai != 0]
    return functools.reduce(operator.add, terms) if terms else F.lit(0.0)


def norm(parts: list[Column]) -> Column:
    return F.sqrt(functools.reduce(operator.add, [p * p for p in parts]))


def every(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


@dataclass(frozen=True)
class Domain:
    """lb <= x <= ub, A x <= b, A_eq x = b_eq, |L (x - y)| <= rho for each (L, y, rho). Infinite bounds don't count."""

    lb: tuple[float, ...]
    ub: tuple[float, ...]
    A: tuple[tuple[float, ...], ...] = ()
    b: tuple[float, ...] = ()
    A_eq: tuple[tuple[float, ...], ...] = ()
    b_eq: tuple[float, ...] = ()
    quads: tuple = ()
    names: tuple[str, ...] = ()

    def __post_init__(self):
        if len(self.lb) != len(self.ub) or len(self.A) != len(self.b) or len(self.A_eq) != len(self.b_eq):
            raise ValueError("constraints come in pairs of equal length")
        if any(low > high for low, high in zip(self.lb, self.ub, strict=True)):
            raise EmptyDomain("a lower bound is above its upper bound")
        if not self.names:
            object.__setattr__(self, "names", tuple(f"x{i}" for i in range(self.m)))

    @property
    def m(self) -> int:
        return len(self.lb)

    @property
    def is_bounded(self) -> bool:
        return all(map(math.isfinite, self.lb + self.ub))

    @property
    def is_box(self) -> bool:
        return not (self.A or self.A_eq or self.quads)

    def contains(self, x: list[Column], tol: float = TOL) -> Column:
        """Membership; false for another number of coordinates."""
        if len(x) != self.m:
            return F.lit(False)
        out = [xi >= low - tol for xi, low in zip(x, self.lb, strict=True) if math.isfinite(low)]
        out += [xi <= high + tol for xi, high in zip(x, self.ub, strict=True) if math.isfinite(high)]
        out += [dot(a, x) <= b + tol for a, b in zip(self.A, self.b, strict=True)]
        out += [F.abs(dot(a, x) - F.lit(b)) < tol for a, b in zip(self.A_eq, self.b_eq, strict=True)]
        out += [norm([dot(row, [xi - F.lit(yi) for xi, yi in zip(x, y, strict=True)]) for row in L]) <= rho + tol for L, y, rho in self.quads]
        return every(out)

    def contains_array(self, name: str, tol: float = TOL) -> Column:
        """Membership of an array column; false for arrays of another size."""
        return (F.size(name) == self.m) & self.contains(coords(name, self.m), tol)

    def intersect(self, other: Domain) -> Domain:
        """Both sets of constraints."""
        return Domain(
            tuple(map(max, self.lb, other.lb)), tuple(map(min, self.ub, other.ub)), self.A + other.A, self.b + other.b, self.A_eq + other.A_eq, self.b_eq + other.b_eq, self.quads + other.quads, self.names
        )

    def center_scale(self) -> tuple[list[float], list[float]]:
        """c and d of x_norm = d * (x - c): 0 and 1 where a bound is infinite, d = 1 where the bounds are equal."""
        c, d = [], []
        for low, high in zip(self.lb, self.ub, strict=True):
            finite = math.isfinite(low) and math.isfinite(high)
            c.append((low + high) / 2 if finite else 0.0)
            d.append(2 / (high - low) if finite and high > low else 1.0)
        return c, d

    def normalize(self, x: list[Column]) -> list[Column]:
        return [(xi - F.lit(c)) * F.lit(d) for xi, c, d in zip(x, *self.center_scale(), strict=True)]

    def unnormalize(self, x: list[Column]) -> list[Column]:
        return [xi / F.lit(d) + F.lit(c) for xi, c, d in zip(x, *self.center_scale(), strict=True)]

    def normalized(self) -> Domain:
        """The same set in normalised coordinates."""
        c, d = (np.array(v) for v in self.center_scale())
        rows = lambda A: tuple(tuple((np.array(a) / d).tolist()) for a in A)
        shift = lambda A, b: tuple(float(v - np.dot(a, c)) for a, v in zip(A, b, strict=True))
        quads = tuple((rows(L), tuple((d * (np.array(y) - c)).tolist()), rho) for L, y, rho in self.quads)
        lb, ub = (tuple((d * (np.array(v) - c)).tolist()) for v in (self.lb, self.ub))
        return Domain(lb, ub, rows(self.A), shift(self.A, self.b), rows(self.A_eq), shift(self.A_eq, self.b_eq), quads, self.names)

    def extent(self, x: list[Column], p: list[Column], tol: float = 1e-6) -> Column:
        """The largest a with x + a p inside, from a point inside; 0 if p leaves an equality."""
        out = []
        for xi, pi, low, high in zip(x, p, self.lb, self.ub, strict=True):
            if math.isfinite(high):
                out.append(F.when(pi > 0, (F.lit(high) - xi) / pi))
            if math.isfinite(low):
                out.append(F.when(pi < 0, (F.lit(low) - xi) / pi))
        for a, b in zip(self.A, self.b, strict=True):
            out.append(F.when(dot(a, p) > 0, (F.lit(b) - dot(a, x)) / dot(a, p)))
        for L, y, rho in self.quads:
            u = [dot(row, p) for row in L]
            v = [dot(row, [xi - F.lit(yi) for xi, yi in zip(x, y, strict=True)]) for row in L]
            aa, bb, cc = (functools.reduce(operator.add, [s * t for s, t in zip(q, r, strict=True)]) for q, r in ((u, u), (u, v), (v, v)))
            out.append(F.when(aa > 0, (-bb + F.sqrt(F.greatest(bb * bb - aa * (cc - F.lit(rho**2)), F.lit(0.0)))) / aa))
        reach = F.greatest(F.least(*[F.coalesce(o, F.lit(INF)) for o in out], F.lit(INF)), F.lit(0.0))
        for a in self.A_eq:
            reach = F.when(F.abs(dot(a, p)) > tol, F.lit(0.0)).otherwise(reach)
        return reach

    def corner(self, p: list[Column]) -> list[Column]:
        """The corner of the box that is farthest in direction p."""
        return [F.when(pi >= 0, F.lit(high)).otherwise(F.lit(low)) for pi, low, high in zip(p, self.lb, self.ub, strict=True)]

    def closest(self, x: list[Column]) -> list[Column]:
        """The nearest point of the box."""
        return [F.least(F.greatest(xi, F.lit(low)), F.lit(high)) for xi, low, high in zip(x, self.lb, self.ub, strict=True)]

    def closest_rows(self, df: DataFrame, column: str = "x", rounds: int = 200) -> DataFrame:
        """df with `closest`: the nearest point by Dykstra's projections onto bounds, half-spaces, planes and balls
        (quadratic constraints with L = identity)."""
        domain = self

        def run(batches):
            for batch in batches:
                x = np.stack(batch[column].to_numpy()).astype(float) if len(batch) else np.zeros((0, domain.m))
                yield batch.assign(closest=list(domain._project(x, rounds)))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{fields}, closest array<double>")

    def _project(self, x: np.ndarray, rounds: int) -> np.ndarray:
        maps = [lambda z: np.clip(z, self.lb, self.ub)]
        for a, b in zip(self.A, self.b, strict=True):
            a = np.array(a)
            maps.append(lambda z, a=a, b=b: z - np.maximum(z @ a - b, 0)[:, None] * a / (a @ a))
        for a, b in zip(self.A_eq, self.b_eq, strict=True):
            a = np.array(a)
            maps.append(lambda z, a=a, b=b: z - (z @ a - b)[:, None] * a / (a @ a))
        for L, y, rho in self.quads:
            if not np.allclose(L, np.eye(self.m)):
                raise ValueError("projection takes balls only")
            y = np.array(y)
            maps.append(lambda z, y=y, rho=rho: y + (z - y) * np.minimum(1, rho / np.maximum(np.linalg.norm(z - y, axis=1), 1e-300))[:, None])
        shift = [np.zeros_like(x) for _ in maps]
        for _ in range(rounds):
            for k, project in enumerate(maps):
                moved = project(x + shift[k])
                shift[k] += x - moved
                x = moved
        return x

    # Generators ---------------------------------------------------------------------------------------------------

    def grid(self, spark: SparkSession, n: int) -> DataFrame:
        """id, x: n points on each axis, in the order of the first axis, that lie inside."""
        if not self.is_bounded:
            raise UnboundedDomain("a grid needs finite bounds")
        df = spark.range(n**self.m)
        step = lambda k: F.floor(F.col("id") / n ** (self.m - 1 - k)) % n
        x = [F.lit(low) + step(k) * F.lit((high - low) / max(n - 1, 1)) for k, (low, high) in enumerate(zip(self.lb, self.ub, strict=True))]
        df = df.select("id", F.array(*x).alias("x"))
        return df if self.is_box else df.where(self.contains(coords("x", self.m)))

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """id, x: uniform points. Other constraints than bounds are met by rejection within the bounds."""
        if n <= 0:
            return spark.range(0).select("id", F.array(*[F.lit(0.0)] * self.m).alias("x"))
        if not self.is_bounded:
            raise UnboundedDomain("a uniform sample needs finite bounds")
        if self.is_box:
            x = [F.lit(low) + F.lit(high - low) * F.rand(seed + k) for k, (low, high) in enumerate(zip(self.lb, self.ub, strict=True))]
            return spark.range(n).select("id", F.array(*x).alias("x"))
        if self.A_eq:
            return hit_and_run(self, spark, n, seed)
        box, drawn = replace(self, A=(), b=(), quads=()), 2 * n
        for _ in range(12):
            inside = box.sample(spark, drawn, seed).where(self.contains(coords("x", self.m), 0.0))
            if inside.limit(n).count() >= n:
                return inside.orderBy("id").limit(n)
            drawn *= 4
        return hit_and_run(self, spark, n, seed)

    def from_units(self, df: DataFrame, u: list[Column], to: str = "x") -> DataFrame:
        """df with a point of the bounds for each row, from numbers of its own in [0, 1); rows whose point breaks another
        constraint are left out, so points are even over the domain."""
        x = [F.lit(low) + F.lit(high - low) * ui for low, high, ui in zip(self.lb, self.ub, u, strict=True)]
        out = df.withColumn(to, F.array(*x))
        return out if self.is_box else out.where(self.contains(coords(to, self.m), 0.0))

    def boundary(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """Corners of the box in random directions."""
        return spark.range(n).select("id", F.array(*self.corner([F.randn(seed + k) for k in range(self.m)])).alias("x"))

    def directions(self, df: DataFrame, column: str = "x", seed: int = 0) -> DataFrame:
        """df with `p`: a random direction that can be followed from x."""
        p = [F.randn(seed + k) for k in range(self.m)]
        df = df.withColumn("p", F.array(*p))
        if self.A_eq:
            q, _ = np.linalg.qr(np.array(self.A_eq).T)
            p = coords("p", self.m)
            p = [pi - functools.reduce(operator.add, [F.lit(float(q[i, j])) * dot(q[:, j], p) for j in range(q.shape[1])]) for i, pi in enumerate(p)]
            df = df.withColumn("p", F.array(*p))
        return df.where(self.extent(coords(column, self.m), coords("p", self.m)) > 0)

    def sweep(self, df: DataFrame, n: int, x: str = "x", p: str = "p") -> DataFrame:
        """n points between the two places where the line through x along p meets the boundary: step, y (arc length
        from the first), point."""
        a, d = coords(x, self.m), coords(p, self.m)
        reach, back = self.extent(a, d), self.extent(a, [-di for di in d])
        ends = df.withColumn("_low", -back).withColumn("_high", reach)
        rows = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        t = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("step") / max(n - 1, 1)
        return rows.withColumn("y", (t - F.col("_low")) * norm(d)).withColumn("point", F.array(*[ai + t * di for ai, di in zip(a, d, strict=True)])).drop("_low", "_high")

    def volume(self, spark: SparkSession, n: int = 100_000, seed: int = 0) -> float:
        box = math.prod(high - low for low, high in zip(self.lb, self.ub, strict=True))
        if self.is_box:
            return box
        inside = replace(self, A=(), b=(), A_eq=(), b_eq=(), quads=()).sample(spark, n, seed).agg(F.avg(self.contains(coords("x", self.m)).cast("double")))
        return box * inside.first()[0]

    def volume_from(self, x: list[Column], tol: float = TOL) -> Column:
        """The volume as an aggregate over points that fill the bounds evenly: the share of them inside, times the box."""
        return F.lit(math.prod(high - low for low, high in zip(self.lb, self.ub, strict=True))) * F.avg(self.contains(x, tol).cast("double"))

    def __mul__(self, other: Domain) -> Domain:
        """Tensor product: coordinates side by side."""
        pad = lambda A, before, after: tuple((0.0,) * before + tuple(a) + (0.0,) * after for a in A)
        quads = tuple((pad(L, 0, other.m), tuple(y) + (0.0,) * other.m, r) for L, y, r in self.quads)
        quads += tuple((pad(L, self.m, 0), (0.0,) * self.m + tuple(y), r) for L, y, r in other.quads)
        return Domain(
            self.lb + other.lb,
            self.ub + other.ub,
            pad(self.A, 0, other.m) + pad(other.A, self.m, 0),
            self.b + other.b,
            pad(self.A_eq, 0, other.m) + pad(other.A_eq, self.m, 0),
            self.b_eq + other.b_eq,
            quads,
            self.names + other.names if len({*self.names, *other.names}) == self.m + other.m else (),
        )


def box(lb, ub, names=()) -> Domain:
    return Domain(tuple(map(float, lb)), tuple(map(float, ub)), names=tuple(names))


def point(x) -> Domain:
    """One point; membership is equality of all coordinates within the tolerance that the caller gives."""
    return box(x, x)


def unbounded(m: int) -> Domain:
    return box([-INF] * m, [INF] * m)


def linquad(lb, ub, A=(), b=(), A_eq=(), b_eq=(), Ls=(), ys=(), rhos=(), names=()) -> Domain:
    if any(r <= 0 for r in rhos):
        raise ValueError("radii are positive")
    rows = lambda M: tuple(tuple(map(float, r)) for r in M)
    quads = tuple((rows(L), tuple(map(float, y)), float(r)) for L, y, r in zip(Ls, ys, rhos, strict=True))
    return Domain(tuple(map(float, lb)), tuple(map(float, ub)), rows(A), tuple(map(float, b)), rows(A_eq), tuple(map(float, b_eq)), quads, tuple(names))


def hit_and_run(domain: Domain, spark: SparkSession, n: int, seed: int = 0, steps: int = 200) -> DataFrame:
    """id, x: independent chains from the centre, one for each row; `steps` moves each."""
    start = domain._project(np.mean([domain.lb, domain.ub], axis=0)[None, :], 2000)[0]
    q = np.linalg.qr(np.array(domain.A_eq).T)[0] if domain.A_eq else np.zeros((domain.m, 0))
    lb, ub, A, b, quads = np.array(domain.lb), np.array(domain.ub), np.array(domain.A).reshape(-1, domain.m), np.array(domain.b), domain.quads

    def reach(x, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(p > 0, (ub - x) / p, np.where(p < 0, (lb - x) / p, INF)).min(axis=1)
            if len(A):
                ap = p @ A.T
                out = np.minimum(out, np.where(ap > 0, (b - x @ A.T) / ap, INF).min(axis=1))
            for L, y, rho in quads:
                u, v = p @ np.array(L).T, (x - np.array(y)) @ np.array(L).T
                aa, bb, cc = (u * u).sum(1), (u * v).sum(1), (v * v).sum(1) - rho**2
                out = np.minimum(out, np.where(aa > 0, (-bb + np.sqrt(np.maximum(bb * bb - aa * cc, 0))) / aa, INF))
        return np.maximum(out, 0)

    def run(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            if not len(ids):
                continue
            rng = np.random.Generator(np.random.Philox(key=[seed, int(ids[0])]))
            x = np.tile(start, (len(ids), 1))
            for _ in range(steps):
                p = rng.standard_normal(x.shape)
                p -= (p @ q) @ q.T
                p /= np.linalg.norm(p, axis=1, keepdims=True)
                low, high = -reach(x, -p), reach(x, p)
                x = x + (low + (high - low) * rng.random(len(x)))[:, None] * p
            yield batch.assign(x=list(x))

    return spark.range(n).mapInPandas(run, "id long, x array<double>")


# Random domains -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Uniform:
    domain: Domain

    def pdf(self, x: list[Column]) -> Column:
        size = math.prod(high - low for low, high in zip(self.domain.lb, self.domain.ub, strict=True))
        return self.domain.contains(x, 0.0).cast("double") / F.lit(size)

    def sample(self, spark, n, seed=0):
        return self.domain.sample(spark, n, seed)


def chi2_quantile(q: float, m: int) -> float:
    """The q-quantile of the chi-squared distribution, by bisection on the regularised gamma series."""

    def cdf(x):
        a, z = m / 2, x / 2
        term = total = 1 / a
        k = 0
        while abs(term) > 1e-17 * abs(total) and k < 10_000:
            k += 1
            term *= z / (a + k)
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z > 0 else 0.0

    low, high = 0.0, 10.0 * (m + 10)
    while cdf(high) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return (low + high) / 2


@dataclass(frozen=True)
class Normal:
    """Normal distribution; with truncate > 0 only the ellipsoid of probability 1 - truncate."""

    mean: tuple[float, ...]
    cov: tuple[tuple[float, ...], ...]
    truncate: float = 0.0
    _chol: np.ndarray = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "_chol", np.linalg.cholesky(np.array(self.cov, float)))

    @property
    def m(self) -> int:
        return len(self.mean)

    @property
    def clip2(self) -> float:
        return chi2_quantile(1 - self.truncate, self.m) if self.truncate else INF

    def _distance2(self, x: list[Column]) -> Column:
        white = np.linalg.inv(self._chol)
        z = [dot(row, [xi - F.lit(mu) for xi, mu in zip(x, self.mean, strict=True)]) for row in white]
        return functools.reduce(operator.add, [v * v for v in z])

    def contains(self, x: list[Column]) -> Column:
        return self._distance2(x) <= self.clip2 if self.truncate else F.lit(len(x) == self.m)

    def pdf(self, x: list[Column]) -> Column:
        scale = (2 * math.pi) ** (self.m / 2) * float(np.prod(np.diag(self._chol))) * (1 - self.truncate)
        d2 = self._distance2(x)
        return F.when(d2 <= self.clip2, F.exp(-0.5 * d2) / F.lit(scale)).otherwise(0.0) if self.truncate else F.exp(-0.5 * d2) / F.lit(scale)

    def from_units(self, u: list[Column]) -> list[Column]:
        """Coordinates of a draw for each row, from numbers of its own in [0, 1): two for each pair of coordinates (Box and
        Muller; an odd last coordinate takes two as well). A truncated distribution keeps the rows that it contains."""
        pairs = -(-self.m // 2)
        if len(u) != 2 * pairs:
            raise ValueError(f"{2 * pairs} numbers are needed")
        z = []
        for k in range(pairs):
            far, turn = F.sqrt(-2 * F.log(F.greatest(u[2 * k], F.lit(1e-12)))), 2 * math.pi * u[2 * k + 1]
            z += [far * F.cos(turn), far * F.sin(turn)]
        return [F.lit(mu) + dot(row, z[: self.m]) for mu, row in zip(self.mean, self._chol, strict=True)]

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """id, x; a truncated one is oversampled and filtered until it has n rows."""
        drawn = n if not self.truncate else int(n / (1 - self.truncate) * 1.1) + 50
        while True:
            z = spark.range(drawn).select("id", F.array(*[F.randn(seed + k) for k in range(self.m)]).alias("z"))
            z = z.where(norm(coords("z", self.m)) <= math.sqrt(self.clip2)) if self.truncate else z
            out = z.select("id", F.array(*[F.lit(mu) + dot(row, coords("z", self.m)) for mu, row in zip(self.mean, self._chol, strict=True)]).alias("x"))
            if not self.truncate or out.limit(n).count() >= n:
                return out.orderBy("id").limit(n) if self.truncate else out
            drawn *= 2


@dataclass(frozen=True)
class LogNormal:
    """offset + scaling * exp(y) with y normal of one dimension."""

    mean: float
    cov: float
    offset: float = 0.0
    scaling: float = 1.0
    truncate: float = 0.0

    def _normal(self) -> Normal:
        return Normal((self.mean,), ((self.cov,),), self.truncate)

    def pdf(self, x: list[Column]) -> Column:
        z = (x[0] - F.lit(self.offset)) / F.lit(self.scaling)
        y = F.log(F.when(z > 0, z))
        return F.coalesce(self._normal().pdf([y]) / (z * F.lit(abs(self.scaling))), F.lit(0.0))

    def sample(self, spark, n, seed=0):
        return self._normal().sample(spark, n, seed).select("id", F.array(F.lit(self.offset) + F.lit(self.scaling) * F.exp(F.get("x", 0))).alias("x"))


def sample_product(parts, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Independent draws of domains or distributions side by side, joined by row number."""
    out = None
    for k, part in enumerate(parts):
        drawn = part.sample(spark, n, seed + 1000 * k)
        drawn = drawn.select(F.monotonically_increasing_id().alias("id"), "x") if isinstance(part, Domain) and not part.is_box else drawn
        out = drawn if out is None else out.join(drawn.withColumnRenamed("x", "y"), "id").select("id", F.concat("x", "y").alias("x"))
    return out


def segment_sample(df: DataFrame, a, b, domain: Domain, alpha: Column, tol: float = TOL) -> DataFrame:
    """df with x = alpha a + (1 - alpha) b, where x lies in the domain. alpha: a column of numbers in [0, 1]."""
    x = [alpha * F.lit(float(p)) + (1 - alpha) * F.lit(float(q)) for p, q in zip(a, b, strict=True)]
    return df.where(domain.contains(x, tol)).withColumn("x", F.array(*x))

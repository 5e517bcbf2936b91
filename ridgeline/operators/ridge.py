"""Polynomial bases, regression and ridge approximation by repeated aggregates.

A pass over the rows adds up normal equations (blocks of rows as matrices, one small matrix for each Arrow batch); the
driver solves systems of the size of the basis.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.domain import coords, dot
from ridgeline.sources.tables import stored

#: A column that tells how often a row occurs; tables without it have each row as often as it stands there.
TIMES = "_times"


def multi_indices(degree: int, dim: int) -> np.ndarray:
    """Total-degree exponents, by degree; within one, higher powers of the first coordinate first."""
    out = []
    for d in range(degree + 1):
        out += sorted((a for a in itertools.product(range(d + 1), repeat=dim) if sum(a) == d), reverse=True)
    return np.array(out, dtype=int).reshape(-1, dim)


#: kind: (value of the next polynomial from x, the last two and its degree), see Abramowitz and Stegun, table 22.7.
_NEXT = {
    "monomial": lambda x, p, q, n: x * p,
    "legendre": lambda x, p, q, n: ((2 * n - 1) * x * p - (n - 1) * q) / n,
    "chebyshev": lambda x, p, q, n: x * p if n == 1 else 2 * x * p - q,
    "laguerre": lambda x, p, q, n: ((2 * n - 1 - x) * p - (n - 1) * q) / n,
    "hermite": lambda x, p, q, n: 2 * x * p - 2 * (n - 1) * q,
}


def univariate(kind: str, x, degree: int, one):
    """Values of the polynomials of degree 0 to `degree`; x is an array or a Column."""
    out = [one]
    for n in range(1, degree + 1):
        out.append(_NEXT[kind](x, out[-1], out[-2] if n > 1 else one * 0.0, n))
    return out


def univariate_derivative(kind: str, x, degree: int, one):
    """First derivatives, by differentiating the recurrence."""
    p, d = univariate(kind, x, degree, one), [one * 0.0]
    for n in range(1, degree + 1):
        p1, d1 = p[n - 1], d[n - 1]
        p2, d2 = (p[n - 2], d[n - 2]) if n > 1 else (one * 0.0, one * 0.0)
        if kind == "monomial":
            d.append(p1 + x * d1)
        elif kind == "legendre":
            d.append(((2 * n - 1) * (p1 + x * d1) - (n - 1) * d2) / n)
        elif kind == "chebyshev":
            d.append(p1 + x * d1 if n == 1 else 2 * (p1 + x * d1) - d2)
        elif kind == "laguerre":
            d.append(((2 * n - 1 - x) * d1 - p1 - (n - 1) * d2) / n)
        else:
            d.append(2 * (p1 + x * d1) - 2 * (n - 1) * d2)
    return d


def univariate_second(kind: str, x, degree: int, one):
    """Second derivatives, by differentiating the recurrence twice."""
    d, s = univariate_derivative(kind, x, degree, one), [one * 0.0]
    for n in range(1, degree + 1):
        d1, s1, s2 = d[n - 1], s[n - 1], s[n - 2] if n > 1 else one * 0.0
        both = 2 * d1 + x * s1
        if kind == "monomial" or kind == "chebyshev" and n == 1:
            s.append(both)
        elif kind == "legendre":
            s.append(((2 * n - 1) * both - (n - 1) * s2) / n)
        elif kind == "chebyshev":
            s.append(2 * both - s2)
        elif kind == "laguerre":
            s.append(((2 * n - 1 - x) * s1 - 2 * d1 - (n - 1) * s2) / n)
        else:
            s.append(2 * both - 2 * (n - 1) * s2)
    return s


@dataclass(frozen=True)
class Basis:
    """A tensor basis of total degree on inputs that are scaled to (x - shift) * factor."""

    kind: str
    degree: int
    shift: tuple[float, ...]
    factor: tuple[float, ...]

    @property
    def dim(self) -> int:
        return len(self.shift)

    @property
    def indices(self) -> np.ndarray:
        return multi_indices(self.degree, self.dim)

    def _tables(self, y, one, derivative=False):
        make = univariate_derivative if derivative else univariate
        return [make(self.kind, (yi - s) * f, self.degree, one) for yi, s, f in zip(y, self.shift, self.factor, strict=True)]

    def columns(self, y: list[Column]) -> list[Column]:
        """The basis functions of coordinate columns."""
        tables = self._tables([yi for yi in y], F.lit(1.0))
        return [self._product(tables, a) for a in self.indices]

    def _product(self, tables, a):
        out = None
        for k, power in enumerate(a):
            if power or out is None and k == len(a) - 1:
                out = tables[k][power] if out is None else out * tables[k][power]
        return out

    def derivative_columns(self, y: list[Column], k: int) -> list[Column]:
        """Derivatives of the basis functions by coordinate k, in the units of y."""
        values, slopes = self._tables(y, F.lit(1.0)), self._tables(y, F.lit(1.0), True)
        out = []
        for a in self.indices:
            parts = [F.lit(self.factor[k]) * slopes[k][a[k]]] + [values[i][a[i]] for i in range(self.dim) if i != k and a[i]]
            column = parts[0]
            for p in parts[1:]:
                column = column * p
            out.append(column)
        return out

    def second_columns(self, y: list[Column], k: int, j: int) -> list[Column]:
        """Second derivatives of the basis functions by coordinates k and j, in the units of y."""
        scaled, one = [(yi - s) * f for yi, s, f in zip(y, self.shift, self.factor, strict=True)], F.lit(1.0)
        values = [univariate(self.kind, x, self.degree, one) for x in scaled]
        changed = {k: univariate_second(self.kind, scaled[k], self.degree, one)} if k == j else {i: univariate_derivative(self.kind, scaled[i], self.degree, one) for i in (k, j)}
        out = []
        for a in self.indices:
            column = F.lit(self.factor[k] * self.factor[j])
            for i in range(self.dim):
                column = column * (changed[i] if i in changed else values[i])[a[i]] if i in changed or a[i] else column
            out.append(column)
        return out

    def matrix(self, y: np.ndarray) -> np.ndarray:
        tables = self._tables(y.T, np.ones(len(y)))
        return np.stack([np.prod([t[p] for t, p in zip(tables, a, strict=True)], axis=0) for a in self.indices], axis=1)

    def slopes(self, y: np.ndarray) -> np.ndarray:
        """(rows, functions, coordinates) first derivatives."""
        values, slopes = self._tables(y.T, np.ones(len(y))), self._tables(y.T, np.ones(len(y)), True)
        out = np.empty((len(y), len(self.indices), self.dim))
        for j, a in enumerate(self.indices):
            for k in range(self.dim):
                out[:, j, k] = self.factor[k] * slopes[k][a[k]] * np.prod([values[i][a[i]] for i in range(self.dim) if i != k] or [np.ones(len(y))], axis=0)
        return out


def scaled_basis(df: DataFrame, y: list[Column], degree: int, kind: str = "legendre") -> Basis:
    """Inputs scaled by the table: to [-1, 1], or for Hermite by mean and standard deviation times root two, or for
    Laguerre from the minimum on."""
    if kind == "hermite" and TIMES in df.columns:
        df = df.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col(TIMES).cast("int"))))  # both moments are of all rows
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(y) for k, f in (("a", F.min), ("b", F.max), ("m", F.avg), ("s", F.stddev_pop))]).first()
    n = range(len(y))
    if kind == "hermite":
        return Basis(kind, degree, tuple(row[f"m{i}"] for i in n), tuple(1 / ((row[f"s{i}"] or 1.0) * math.sqrt(2)) for i in n))
    if kind == "laguerre":
        return Basis(kind, degree, tuple(row[f"a{i}"] for i in n), (1.0,) * len(y))
    return Basis(kind, degree, tuple((row[f"a{i}"] + row[f"b{i}"]) / 2 for i in n), tuple(2 / ((row[f"b{i}"] - row[f"a{i}"]) or 2.0) for i in n))


def evaluate(basis: Basis, coefficients, y: list[Column]) -> Column:
    """The polynomial as a column; zero coefficients are left out."""
    return dot(coefficients, basis.columns(y))


def gradient(basis: Basis, coefficients, y: list[Column]) -> list[Column]:
    return [dot(coefficients, basis.derivative_columns(y, k)) for k in range(len(y))]


def hessian(basis: Basis, coefficients, y: list[Column]) -> list[list[Column]]:
    """Second derivatives of the polynomial as columns."""
    return [[dot(coefficients, basis.second_columns(y, min(k, j), max(k, j))) for j in range(len(y))] for k in range(len(y))]


def grams(df: DataFrame, rows_of, size: int) -> np.ndarray:
    """Sum of M'M over the table, where rows_of(batch) gives the rows M of a batch; one matrix for each task is sent."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                M = rows_of(batch)
                total += M.T @ M
        yield pd.DataFrame({"k": np.arange(size), "v": list(total)})

    parts = df.mapInPandas(run, "k int, v array<double>").groupBy("k").agg(F.array(*[F.sum(F.get("v", i)) for i in range(size)]).alias("v")).collect()
    out = np.zeros((size, size))
    for r in parts:
        out[r["k"]] = r["v"]
    return out


def _points(batch, column="x") -> np.ndarray:
    return np.stack(batch[column].to_numpy()).astype(float)


def counted(df: DataFrame, *columns: str) -> DataFrame:
    """The different rows of these columns, stored, with the number of rows that each stands for."""
    if TIMES in df.columns:
        return df
    return stored(df.groupBy(*columns).agg(F.count("*").alias(TIMES)), "counted")


def times(batch) -> np.ndarray:
    """How often each row of a batch occurs."""
    return batch[TIMES].to_numpy(float) if TIMES in batch else np.ones(len(batch))


def _repeated(M: np.ndarray, batch) -> np.ndarray:
    """Rows whose products count as often as the rows of the batch occur."""
    return M * np.sqrt(times(batch))[:, None] if TIMES in batch else M


def least_squares(df: DataFrame, basis: Basis, U=None, weight: str | None = None, target: str = "fx", column: str = "x") -> np.ndarray:
    """Coefficients of the 2-norm fit, weighted if asked, on U'x if U is given."""
    n = len(basis.indices)

    def rows_of(batch):
        x = _points(batch, column)
        M = _repeated(np.hstack([basis.matrix(x if U is None else x @ U), batch[target].to_numpy(float)[:, None]]), batch)
        return M if weight is None else M * np.sqrt(batch[weight].to_numpy(float))[:, None]

    G = grams(df, rows_of, n + 1)
    return np.linalg.lstsq(G[:n, :n], G[:n, n], rcond=1e-14)[0]


@dataclass(frozen=True)
class OrthonormalBasis:
    """A basis times an upper triangle: functions that are orthonormal on a table, by degree as in the basis."""

    basis: Basis
    triangle: np.ndarray

    def columns(self, y: list[Column]) -> list[Column]:
        return self._mixed(self.basis.columns(y))

    def derivative_columns(self, y: list[Column], k: int) -> list[Column]:
        return self._mixed(self.basis.derivative_columns(y, k))

    def _mixed(self, columns):
        return [dot(self.triangle[: n + 1, n], columns[: n + 1]) for n in range(len(columns))]

    def matrix(self, y: np.ndarray) -> np.ndarray:
        return self.basis.matrix(y) @ self.triangle


def orthonormal_basis(df: DataFrame, basis: Basis, column: str = "x", tol: float = 1e-10, passes: int = 8) -> OrthonormalBasis:
    """The functions whose sums of products over the table are 1 for equal ones and 0 for others. Each pass adds up the
    Gram matrix of the functions so far and divides by its Cholesky factor, the first ones shifted so that they exist for
    ill-conditioned bases; passes go on until the matrix is the identity within tol. Raises if that isn't reached, as
    for tables of fewer different rows than functions."""
    n = len(basis.indices)
    found = OrthonormalBasis(basis, np.eye(n))
    for _ in range(passes):
        now = found
        G = grams(df, lambda batch: now.matrix(_points(batch, column)), n)
        if np.abs(G - np.eye(n)).max() <= tol:
            return found
        shift = 0.0
        while True:
            try:
                R = np.linalg.cholesky(G + shift * np.eye(n)).T
                break
            except np.linalg.LinAlgError:
                shift = max(100 * shift, 1e-15 * np.trace(G))
                if shift > np.trace(G) or not np.isfinite(G).all():
                    raise ValueError("the functions are not independent on these rows") from None
        found = OrthonormalBasis(basis, found.triangle @ np.linalg.inv(R))
    raise ValueError("the functions are not independent on these rows")


def orthonormal_fit(df: DataFrame, basis: OrthonormalBasis, column: str = "x", target: str = "fx") -> np.ndarray:
    """Coefficients of the 2-norm fit: sums of the target times each function, one pass."""
    n = len(basis.basis.indices)
    return grams(df, lambda batch: np.hstack([basis.matrix(_points(batch, column)), batch[target].to_numpy(float)[:, None]]), n + 1)[:n, n]


def hessian_audit(df: DataFrame, f, second, x: list[Column], steps: list[float]) -> DataFrame:
    """step, i, j, worst: the largest difference of the four-point stencil of f from second(x)[i][j] over all rows, for
    each step and i <= j. f and second make columns of coordinate columns."""
    m, df = len(x), df.select(F.array(*x).alias("_x"))
    x, out = coords("_x", m), []
    exact = second(x)
    for n, h in enumerate(steps):
        for i in range(m):
            for j in range(i, m):
                at = lambda a, b: f([c + F.lit(h * (a * (k == i) + b * (k == j))) for k, c in enumerate(x)])  # noqa: B023, E731
                stencil = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / F.lit(4 * h * h)
                out.append((n, h, i, j, F.max(F.abs(stencil - exact[i][j])).alias(f"e{n}_{i}_{j}")))
    worst = df.agg(*[e for *_, e in out])
    return worst.select(F.inline(F.array(*[F.struct(F.lit(h).alias("step"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"e{n}_{i}_{j}").alias("worst")) for n, h, i, j, _ in out])))


def reweighted_fit(df: DataFrame, basis: Basis, norm: float, rounds: int = 30, bound: str | None = None) -> np.ndarray:
    """1-norm (weights 1 / |r|) or sup-norm (Lawson: weights w |r|) fit by weighted rounds; with bound "lower" or
    "upper" the constant is then moved until the polynomial stays below or above all rows. df: id, x, fx."""
    y = coords("x", basis.dim)
    df, c = df.withColumn("w", F.lit(1.0)), None
    for _ in range(1 if norm == 2 else rounds):
        c = least_squares(df, basis, weight="w")
        r = F.abs(F.col("fx") - evaluate(basis, c, y))
        if norm == 1:
            df = df.withColumn("w", 1.0 / F.greatest(r, F.lit(1e-8)))
        elif norm == math.inf:
            total = df.agg(F.sum(F.col("w") * r)).first()[0] or 1.0
            df = stored(df.withColumn("w", F.col("w") * r / F.lit(total) + 1e-300), "weights")
    if bound:
        low, high = df.agg(F.min(F.col("fx") - evaluate(basis, c, y)), F.max(F.col("fx") - evaluate(basis, c, y))).first()
        c = c.copy()
        c[0] += low if bound == "lower" else high
    return c


def affine_direction(df: DataFrame, m: int) -> np.ndarray:
    """The normalised slope of the affine fit, on inputs scaled to [-1, 1] by the table."""
    basis = scaled_basis(df, coords("x", m), 1, "monomial")
    slope = least_squares(df, basis)[1:]
    return slope / max(np.linalg.norm(slope), 1e-300)


def needed_rows(m: int, n: int, degree: int) -> int:
    """Rows without which a ridge fit is underdetermined."""
    return math.comb(n + degree, degree) + m * n - n * (n + 1) // 2


@dataclass
class Ridge:
    """p(U'x)."""

    U: np.ndarray
    basis: Basis
    coefficients: np.ndarray

    def active(self, x: list[Column]) -> list[Column]:
        return [dot(self.U[:, k], x) for k in range(self.U.shape[1])]

    def value(self, x: list[Column]) -> Column:
        return evaluate(self.basis, self.coefficients, self.active(x))

    def gradient(self, x: list[Column]) -> list[Column]:
        inner = gradient(self.basis, self.coefficients, self.active(x))
        return [dot(self.U[i], inner) for i in range(len(self.U))]

    def hessian(self, x: list[Column]) -> list[list[Column]]:
        """Second derivatives: U H U' with the polynomial's H."""
        inner = hessian(self.basis, self.coefficients, self.active(x))
        return [[dot([a * b for a in self.U[i] for b in self.U[j]], [h for row in inner for h in row]) for j in range(len(self.U))] for i in range(len(self.U))]

    def profile(self, spark, n: int = 500) -> DataFrame:
        """y1.., value on a line (n points) or a mesh (n by n) over the scaled range."""
        k = self.U.shape[1]
        df = spark.range(n**k)
        y = [F.lit(s - 1 / f) + F.floor(F.col("id") / n ** (k - 1 - i)) % n * F.lit(2 / f / (n - 1)) for i, (s, f) in enumerate(zip(self.basis.shift, self.basis.factor, strict=True))]
        df = df.select("id", *[yi.alias(f"y{i + 1}") for i, yi in enumerate(y)])
        return df.withColumn("value", evaluate(self.basis, self.coefficients, [F.col(f"y{i + 1}") for i in range(k)]))


def fit_ridge(df: DataFrame, m: int, n: int, degree: int, U0=None, targets: list[str] = ("fx",), rounds: int = 20, fixed: int = 0, seed: int = 0) -> Ridge:
    """Variable projection: for each U the coefficients are those of the best fit, and Gauss-Newton moves U on the
    Grassmannian. Each round is two aggregates: normal equations for the coefficients, then the Jacobian's. Several
    targets share U; the first `fixed` columns of U stay. df: x and the targets, or what `counted` makes of them: rounds
    pass over the different rows.
    """
    if df.limit(needed_rows(m, n, degree)).count() < needed_rows(m, n, degree):
        raise ValueError(f"a fit needs {needed_rows(m, n, degree)} rows")
    df = counted(df, "x", *targets)
    U = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, n)) if U0 is None else np.array(U0, float).reshape(m, n))[0]

    def solve(U):
        basis = scaled_basis(df, [dot(U[:, k], coords("x", m)) for k in range(n)], degree)
        size = len(basis.indices)
        G = grams(df, lambda batch: _repeated(np.hstack([basis.matrix(_points(batch) @ U), batch[list(targets)].to_numpy(float)]), batch), size + len(targets))
        C = np.linalg.lstsq(G[:size, :size], G[:size, size:], rcond=1e-14)[0]
        loss = float(np.trace(G[size:, size:] - C.T @ G[:size, size:]))
        return basis, C, loss

    basis, C, loss = solve(U)
    start = max(loss, 1e-300)
    for _ in range(rounds):
        size = m * n

        p, many = len(basis.indices), len(targets)

        def jacobian(batch, U=U, basis=basis, C=C, size=size):
            """The targets' Jacobians for fixed coefficients, the basis, and the targets' residuals."""
            x = _points(batch)
            V, S = basis.matrix(x @ U), basis.slopes(x @ U)
            moved = [(x[:, :, None] * np.einsum("rjk,j->rk", S, C[:, k])[:, None, :]).reshape(len(x), size) for k in range(many)]
            return _repeated(np.hstack([*moved, V, batch[list(targets)].to_numpy(float) - V @ C]), batch)

        # Coefficients follow U: what the basis explains of the Jacobian is taken out, over the table as a whole.
        G, at = grams(df, jacobian, size * many + p + many), size * many
        inverse = np.linalg.pinv(G[at : at + p, at : at + p], rcond=1e-14, hermitian=True)
        JJ, Jr = np.zeros((size, size)), np.zeros(size)
        for k in range(many):
            J, r = slice(size * k, size * (k + 1)), at + p + k
            shared = G[J, at : at + p] @ inverse
            JJ += G[J, J] - shared @ G[at : at + p, J]
            Jr += G[J, r] - shared @ G[at : at + p, r]
        free = np.kron(np.eye(m) - U @ U.T, np.eye(n))
        if fixed:
            free = free @ np.kron(np.eye(m), np.diag([0.0] * fixed + [1.0] * (n - fixed)))
        JJ, Jr = free.T @ JJ @ free, free.T @ Jr
        step = (free @ np.linalg.lstsq(JJ + 1e-12 * np.trace(JJ) * np.eye(size), Jr, rcond=1e-12)[0]).reshape(m, n)
        t, moved = 1.0, False
        while t > 1e-6:
            trial = _geodesic(U, step, t)
            found = solve(trial)
            if found[2] < loss * (1 - 1e-12):
                gain = loss - found[2]
                U, (basis, C, loss), moved = trial, found, True
                break
            t /= 4
        if not moved or gain < 1e-12 * start:
            break
    return Ridge(U, basis, C[:, 0] if len(targets) == 1 else C)


def _geodesic(U: np.ndarray, step: np.ndarray, t: float) -> np.ndarray:
    Y, s, Zt = np.linalg.svd(step, full_matrices=False)
    return _orth(U @ Zt.T @ np.diag(np.cos(t * s)) @ Zt + Y @ np.diag(np.sin(t * s)) @ Zt)


def _orth(U: np.ndarray) -> np.ndarray:
    """The nearest orthonormal columns."""
    a, _, b = np.linalg.svd(U, full_matrices=False)
    return a @ b


def oriented(ridge: Ridge, df: DataFrame, m: int) -> Ridge:
    """U rotated to the principal directions of the profile's gradients, mean slopes not negative, coefficients refit."""
    from ridgeline.operators.moments import outer_matrix

    n = ridge.U.shape[1]
    inner = gradient(ridge.basis, ridge.coefficients, ridge.active(coords("x", m)))
    W = np.linalg.eigh(outer_matrix(df, inner))[1][:, ::-1]
    means = np.array(df.agg(*[F.avg(g) for g in inner]).first(), float) @ W
    U = ridge.U @ (W * np.where(means < 0, -1.0, 1.0))
    basis = scaled_basis(df, [dot(U[:, k], coords("x", m)) for k in range(n)], ridge.basis.degree, ridge.basis.kind)
    return Ridge(U, basis, least_squares(df, basis, U))


def crossings(profile: DataFrame, level: float, by: list[str], y: str = "y", value: str = "value") -> DataFrame:
    """by, y: where profiles (points by y within each) meet a level, by linear interpolation."""
    from pyspark.sql import Window

    over = Window.partitionBy(*by).orderBy(y)
    d = profile.withColumn("d", F.col(value) - level).withColumn("y0", F.lag(y).over(over)).withColumn("d0", F.lag("d").over(over))
    hit = (F.col("d") == 0) | ((F.col("d") * F.col("d0")) < 0)
    at = F.when(F.col("d") == 0, F.col(y)).otherwise(F.col("y0") + (F.col(y) - F.col("y0")) * F.col("d0") / (F.col("d0") - F.col("d")))
    return d.where(hit).select(*by, at.alias("y"))


def failure_points(profile: DataFrame, level: float, by: list[str], low: Column, high: Column, y: str = "y", value: str = "value") -> DataFrame:
    """by, y: crossings of a level that lie in the range of the domain's ridge coordinate, [low, high]."""
    return crossings(profile, level, by, y, value).where(F.col("y").between(low, high))


def gauss_newton(df: DataFrame, residual, start, rounds: int = 50, tol: float = 1e-10) -> tuple[np.ndarray, int]:
    """Least squares over a table: residual(batch, p) gives r and its Jacobian. Returns p and how it ended: 0 small
    step, 1 small gradient, 2 no descent, 4 rounds used up."""
    p = np.array(start, float)
    n = len(p)
    total = lambda p: grams(df, lambda b: np.hstack([residual(b, p)[1], residual(b, p)[0][:, None]]), n + 1)
    G = total(p)
    for _ in range(rounds):
        JJ, Jr, loss = G[:n, :n], G[:n, n], G[n, n]
        if np.abs(Jr).max(initial=0) <= tol * max(1.0, loss):
            return p, 1
        step = -np.linalg.lstsq(JJ, Jr, rcond=1e-14)[0]
        if step @ Jr >= 0:
            step = -Jr
        t = 1.0
        while True:
            new = total(p + t * step)
            if np.isfinite(new[n, n]) and new[n, n] <= loss + 1e-4 * t * 2 * (step @ Jr):
                break
            t /= 2
            if t < 1e-10:
                return p, 2
        p, G = p + t * step, new
        if np.linalg.norm(t * step) <= tol * (1 + np.linalg.norm(p)):
            return p, 0
    return p, 4

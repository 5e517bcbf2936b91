"""Gaussian processes whose metric and trend are fitted to the whole table by marginal likelihood.

The metric is a multiple of a given one, diagonal, or the matrix exponential of a lower triangular matrix; the trend is a
polynomial. Up to `limit` rows the process is exact; beyond, so many rows (of smallest hash) are inducing points and all
rows count. Then the likelihood needs one aggregate, the Gram matrix of kernel values, trend and output, and its slope
one more: each row adds an m x m matrix, whatever the number of parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.domain import coords
from ridgeline.operators.pairs import _matrix, distances
from ridgeline.operators.ridge import Basis, grams, scaled_basis, univariate


def matrix_exponential(A: np.ndarray) -> np.ndarray:
    """Power series of A / 2^k, squared k times."""
    k = max(0, int(np.ceil(np.log2(max(np.abs(A).sum(axis=1).max(), 1e-300)))) + 1)
    A = A / 2.0**k
    out = term = np.eye(len(A))
    for n in range(1, 19):
        term = term @ A / n
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


@dataclass(frozen=True)
class Metric:
    """Metrics L of a structure, by their parameters."""

    structure: str
    m: int
    base: np.ndarray

    @property
    def places(self) -> list[tuple[int, int]]:
        if self.structure == "triangular":
            return [(i, j) for i in range(self.m) for j in range(i + 1)]
        return [(i, i) for i in range(self.m)]

    @property
    def size(self) -> int:
        return {"constant": 0, "scalar": 1}.get(self.structure, len(self.places))

    def exponent(self, ell: np.ndarray) -> np.ndarray:
        A = np.zeros((self.m, self.m))
        for (i, j), e in zip(self.places, ell, strict=True):
            A[i, j] = e
        return A

    def L(self, ell: np.ndarray) -> np.ndarray:
        if self.structure == "constant":
            return self.base
        if self.structure == "scalar":
            return math.exp(ell[0]) * self.base
        return np.diag(np.exp(ell)) if self.structure == "diagonal" else matrix_exponential(self.exponent(ell))

    def slopes(self, ell: np.ndarray) -> list[np.ndarray]:
        """Derivatives of L by each parameter; that of an exponential is a corner of the exponential of a block matrix."""
        if self.structure in ("constant", "scalar"):
            return [self.L(ell)] * self.size
        if self.structure == "diagonal":
            return [np.exp(e) * np.diag(np.eye(self.m)[i]) for i, e in enumerate(ell)]
        A, out = self.exponent(ell), []
        for i, j in self.places:
            E = np.zeros_like(A)
            E[i, j] = 1.0
            out.append(matrix_exponential(np.block([[A, E], [np.zeros_like(A), A]]))[: self.m, self.m :])
        return out


def _trend(basis: Basis | None, X: np.ndarray) -> np.ndarray:
    if basis is None:
        return np.zeros((len(X), 0))
    tables = [univariate(basis.kind, (X[:, k] - s) * f, basis.degree, np.ones(len(X))) for k, (s, f) in enumerate(zip(basis.shift, basis.factor, strict=True))]
    return np.stack([math.prod(tables[k][p] for k, p in enumerate(a)) for a in basis.indices], axis=1)


def _kernel(X: np.ndarray, Z: np.ndarray, L: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * distances(X @ L.T, Z @ L.T) ** 2)


def _moment(W: np.ndarray, X: np.ndarray, Z: np.ndarray) -> np.ndarray:
    """Sum of W_ij (x_i - z_j)(x_i - z_j)'."""
    cross = X.T @ W @ Z
    return (X.T * W.sum(axis=1)) @ X + (Z.T * W.sum(axis=0)) @ Z - cross - cross.T


@dataclass
class Process:
    """mean(x) = sum alpha_i exp(-|L (x - x_i)|^2 / 2) + trend(x) beta; the variance leaves the trend out."""

    L: np.ndarray
    X: np.ndarray
    alpha: np.ndarray
    beta: np.ndarray
    inverse: np.ndarray
    basis: Basis | None
    nll: float
    ell: np.ndarray
    slope: np.ndarray

    def predict(self, test: DataFrame) -> DataFrame:
        """id, mean, variance (not below 0)."""
        L, X, alpha, beta, inverse, basis = self.L, self.X, self.alpha, self.beta, self.inverse, self.basis

        def run(batches):
            for batch in batches:
                for k in range(0, len(batch), 1024):
                    part = batch[k : k + 1024]
                    at = _matrix(part["x"])
                    c = _kernel(at, X, L)
                    yield pd.DataFrame({"id": part["id"], "mean": c @ alpha + _trend(basis, at) @ beta, "variance": np.maximum(1 - ((c @ inverse) * c).sum(axis=1), 0)})

        return test.select("id", "x").mapInPandas(run, "id long, mean double, variance double")


class _Likelihood:
    def __init__(self, train: DataFrame, metric: Metric, basis: Basis | None, limit: int, nugget: float):
        self.train, self.metric, self.basis = train.select("id", "x", "fx"), metric, basis
        rows = self.train.orderBy(F.xxhash64("id"), "id").limit(limit + 1).toPandas()
        if rows.empty:
            raise ValueError("no rows to fit")
        self.every = len(rows) <= limit
        rows = rows.iloc[:limit]
        self.X, self.f = _matrix(rows["x"]), rows["fx"].to_numpy(float)
        self.noise = nugget if self.every else max(nugget, 1e-6)

    def at(self, ell: np.ndarray) -> Process:
        """The process of these parameters, with its negative log-likelihood and the slope of that."""
        L = self.metric.L(ell)
        K0 = _kernel(self.X, self.X, L)
        K = K0 + self.noise * np.eye(len(K0))
        inverse = np.linalg.pinv(K, rcond=1e-14, hermitian=True)
        alpha, beta, inverse, nll, M = (self._exact if self.every else self._induced)(L, K0, K, inverse)
        slope = np.array([-np.sum(d * (L @ M)) for d in self.metric.slopes(ell)])
        return Process(L, self.X, alpha, beta, inverse, self.basis, nll, ell, slope)

    def _exact(self, L, K0, K, inverse):
        V = _trend(self.basis, self.X)
        beta = np.linalg.pinv(V.T @ inverse @ V) @ (V.T @ inverse @ self.f)
        alpha = inverse @ (self.f - V @ beta)
        nll = 0.5 * float(self.f @ alpha) + 0.5 * float(np.linalg.slogdet(K)[1])
        return alpha, beta, inverse, nll, _moment(0.5 * (inverse - np.outer(alpha, alpha)) * K0, self.X, self.X)

    def _induced(self, L, K0, K, inverse):
        X, basis, noise, n, m = self.X, self.basis, self.noise, len(self.X), self.X.shape[1]
        q = 0 if basis is None else len(basis.indices)

        def rows_of(batch):
            at = _matrix(batch["x"])
            return np.hstack([_kernel(at, X, L), _trend(basis, at), batch[["fx"]].to_numpy(float), np.ones((len(at), 1))])

        G = grams(self.train, rows_of, n + q + 2)
        A = G[:n, :n] + noise * K
        back = np.linalg.pinv(A, rcond=1e-14, hermitian=True)
        known = back @ G[:n, n:]
        known += back @ (G[:n, n:] - A @ known)  # takes out the round-off of the inverse
        # Products of trend and output in the inverse covariance of all rows.
        S = (G[n:, n:] - G[n:, :n] @ known) / noise
        beta = np.linalg.pinv(S[:q, :q]) @ S[:q, q]
        alpha = known[:, q] - known[:, :q] @ beta
        logs = np.linalg.slogdet(A)[1] - np.linalg.slogdet(K)[1] + (G[-1, -1] - n) * math.log(noise)
        nll = 0.5 * float(S[q, q] - S[q, :q] @ beta) + 0.5 * float(logs)
        if not self.metric.size:
            return alpha, beta, inverse - noise * back, nll, np.zeros((m, m))

        def run(batches):
            total = np.zeros((m, m))
            for batch in batches:
                for k in range(0, len(batch), 1024):
                    part = batch[k : k + 1024]
                    at = _matrix(part["x"])
                    c = _kernel(at, X, L)
                    rest = part["fx"].to_numpy(float) - _trend(basis, at) @ beta - c @ alpha
                    total += _moment((c @ back - np.outer(rest, alpha) / noise) * c, at, X)
            yield pd.DataFrame({"k": np.arange(m), "v": list(total)})

        M = _moment(0.5 * (np.outer(alpha, alpha) + noise * back - inverse) * K0, X, X)
        for r in self.train.mapInPandas(run, "k int, v array<double>").groupBy("k").agg(F.array(*[F.sum(F.get("v", i)) for i in range(m)]).alias("v")).collect():
            M[r["k"]] += np.array(r["v"])
        return alpha, beta, inverse - noise * back, nll, M


def fit_process(train: DataFrame, m: int, structure: str = "scalar", degree: int | None = None, base=None, start=None, limit: int = 1000, nugget: float = 1e-6, rounds: int = 20, tol: float = 1e-4) -> Process:
    """The process of least negative log-likelihood that descent from `start` reaches. train: id, x, fx.

    structure is constant (L = base), scalar (a multiple of base), diagonal, or triangular (exponentials of lower
    triangular matrices); degree adds a Legendre trend. Steps follow a quasi-Newton model of the likelihood and are
    halved until it falls; they end when no slope exceeds tol or after `rounds`. The result is a local optimum.
    With inducing points the nugget is 1e-6 at least, as a Gram matrix has half the digits; 1e-4 keeps trends exact to
    four of them.
    """
    if structure not in ("constant", "scalar", "diagonal", "triangular"):
        raise ValueError(f"unknown structure {structure}")
    metric = Metric(structure, m, np.eye(m) if base is None else np.atleast_2d(np.array(base, float)))
    basis = None if degree is None else scaled_basis(train, coords("x", m), degree)
    of = _Likelihood(train, metric, basis, limit, nugget)
    now = of.at(np.zeros(metric.size) if start is None else np.array(start, float).ravel())
    B = np.eye(metric.size)
    for _ in range(rounds if metric.size else 0):
        if np.abs(now.slope).max() <= tol:
            break
        step = -B @ now.slope
        if step @ now.slope >= 0:
            B, step = np.eye(metric.size), -now.slope
        step *= min(1.0, 1.0 / np.abs(step).max())  # no scale changes by more than a factor of e at once
        for _ in range(8):
            then = of.at(now.ell + step)
            if then.nll <= now.nll + 1e-4 * float(step @ now.slope):
                break
            step = step / 2
        else:
            break
        s, y = then.ell - now.ell, then.slope - now.slope
        if s @ y > 1e-12:
            V = np.eye(metric.size) - np.outer(s, y) / (s @ y)
            B = V @ B @ V.T + np.outer(s, s) / (s @ y)
        now = then
    return now

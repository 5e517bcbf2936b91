"""Polynomial and ridge fits in the 1-, 2- and sup-norm, from both sides or one, each with a bound that proves it.

What decides such a fit is few rows: a small program on the rows so far gives coefficients and, as it leaves rows out, a
bound that no fit can beat; Spark then looks at every row and returns the worst ones, which join the program. Sums over
all rows enter as Gram matrices. A fit ends when its loss over all rows is within `tol` of the bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.domain import coords, dot
from ridgeline.operators.programs import least_quadratic
from ridgeline.operators.ridge import TIMES, Basis, Ridge, _geodesic, _points, _repeated, affine_direction, counted, evaluate, fit_ridge, grams, needed_rows, scaled_basis, times

#: Rows that join the program in a round.
MOST = 64


@dataclass
class Fit:
    """Coefficients, the loss over all rows (the norm of the residuals), the bound below which no coefficients get, the
    rows that the program used (points and values), and whether the two are within the tolerance."""

    coefficients: np.ndarray
    loss: float
    bound: float
    points: np.ndarray
    values: np.ndarray
    closed: bool

    @property
    def gap(self) -> float:
        """How much smaller than the loss the best one can be, as a share of the loss."""
        return (self.loss - self.bound) / self.loss if self.loss > 0 else 0.0


def _active(m: int, U):
    x = coords("x", m)
    return x if U is None else [dot(U[:, k], x) for k in range(U.shape[1])]


def _worst(df: DataFrame, measure, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, values and measures of the rows that have most of it, largest first. The rows of df are different, so the
    largest of each task are all that is sent."""
    rows = df.select(measure.alias("v"), "x", "fx").orderBy(F.desc("v"), "fx", "x").limit(most).collect()
    return np.array([r["x"] for r in rows], float), np.array([r["fx"] for r in rows], float), np.array([r["v"] for r in rows], float)


def _gram(df: DataFrame, basis: Basis, U) -> np.ndarray:
    """Sums of products of the basis functions and the value."""

    def rows_of(batch):
        x = _points(batch)
        return _repeated(np.hstack([basis.matrix(x if U is None else x @ U), batch["fx"].to_numpy(float)[:, None]]), batch)

    return grams(df, rows_of, len(basis.indices) + 1)


def norm_fit(df: DataFrame, basis: Basis, norm: float = 2, bound: str | None = None, U=None, tol: float = 1e-3, rounds: int = 60, start: tuple | None = None) -> Fit:
    """The fit of fx by the basis in x (or U'x) with the least norm of residuals; bound "lower" or "upper" keeps it below or
    above every row. norm: 1, 2 or math.inf. start: points and values of rows to begin with. df: x, fx, or what `counted`
    makes of them.

    Rows are not weighted; equal rows count as often as they occur in sums, but are brought together first. Null and non-finite rows must be removed
    before. An empty table is refused.
    """
    if norm not in (1, 2, math.inf) or bound not in (None, "lower", "upper"):
        raise ValueError("norm is 1, 2 or inf; bound is lower, upper or None")
    side = {None: 0, "lower": 1, "upper": -1}[bound]
    df = counted(df, "x", "fx")
    G = _gram(df, basis, U)
    n = len(basis.indices)
    if not G.any():
        raise ValueError("no rows to fit")
    c = np.linalg.lstsq(G[:n, :n], G[:n, n], rcond=1e-14)[0]
    if norm == 2 and not side:
        loss = math.sqrt(max(0.0, G[n, n] - c @ G[:n, n]))
        return Fit(c, loss, loss, np.zeros((0, 0)), np.zeros(0), True)
    if norm == 1 and not side:
        return _least_sum(df, basis, U, G, c, tol, rounds)
    return _by_rows(df, basis, norm, side, U, G, c, tol, rounds, start)


def _by_rows(df, basis, norm, side, U, G, c, tol, rounds, start) -> Fit:
    n, m = len(c), len(df.select("x").first()[0])
    y = _active(m, U)
    size = math.sqrt(max(G[n, n], 1e-300))
    reach = 1e4 * (np.abs(c).max(initial=0.0) + size + 1.0)  # of coefficients, so that every program has a least value
    X, f = start if start is not None and len(start[1]) else (np.zeros((0, m)), np.zeros(0))
    best, low = (math.inf, c), 0.0
    count = float(G[0, 0])  # the first function is the constant
    total_size = size * {1: math.sqrt(count), 2: 1.0}.get(norm, 1 / math.sqrt(count))  # of losses that are round-off

    def total(c):
        """Of the residuals' norm, where sums give it."""
        square = max(0.0, G[n, n] - 2 * c @ G[:n, n] + c @ G[:n, :n] @ c)
        return math.sqrt(square) if norm == 2 else abs(G[0, n] - G[0, :n] @ c)

    for k in range(rounds):
        residual = F.col("fx") - evaluate(basis, c, y)
        if side:
            Xs, fs, v = _worst(df, -side * residual, MOST)
            over = max(0.0, v[0])
            moved = c.copy()
            moved[0] -= side * over  # now no row is on the wrong side
            if norm == math.inf:
                Xt, ft, w = _worst(df, side * residual, MOST)
                loss, Xs, fs = w[0] + over, np.vstack([Xs, Xt]), np.concatenate([fs, ft])
            else:
                loss = total(moved)
        else:
            Xs, fs, v = _worst(df, F.abs(residual), MOST)
            moved, loss = c, v[0]
        if loss < best[0]:
            best = (loss, moved)
        if best[0] - low <= tol * best[0] or best[0] <= 1e-9 * total_size:
            return Fit(best[1], float(best[0]), float(low), X, f, True)
        X, f = np.vstack([X, Xs]), np.concatenate([f, fs])
        _, keep = np.unique(np.column_stack([X, f]), axis=0, return_index=True)
        X, f = X[keep], f[keep]
        V = basis.matrix(X if U is None else X @ U)
        ones, none = np.ones((len(f), 1)), np.zeros((len(f), 1))
        box = np.hstack([np.vstack([np.eye(n), -np.eye(n)]), np.zeros((2 * n, 1))])
        # The last unknown is the sup-norm; each row of a program is a condition A u >= b.
        A, b = [box], [np.full(2 * n, -reach)]
        if side:
            A, b = [*A, np.hstack([-side * V, none])], [*b, -side * f]
        if norm == math.inf:
            for sign in (1, -1):
                if not side or sign == side:
                    A, b = [*A, np.hstack([sign * V, ones])], [*b, sign * f]
        else:
            A, b = [*A, np.array([[0.0] * n + [1.0]])], [*b, np.zeros(1)]
        P, q = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
        if norm == math.inf:
            q[n] = 1.0
        elif norm == 2:
            P[:n, :n], q[:n], P[n, n] = 2 * G[:n, :n], -2 * G[:n, n], 1e-6 * G[0, 0]
        else:
            q[:n], q[n] = -side * G[0, :n], 1e-6 * count
        A, b = np.vstack(A), np.concatenate(b)
        u, z = least_quadratic(P, q, A, b)
        c = u[:n]
        # The dual value of the program, which its multipliers prove as far as they balance its slopes.
        dual = z @ b - u @ P @ u / 2
        off = np.abs(P @ u + q - A.T @ z).max() * (np.abs(u).max() + 1)
        if norm == 2:
            low = max(low, math.sqrt(max(0.0, G[n, n] + dual - off)))
        elif norm == 1:
            low = max(low, side * G[0, n] + dual - off)
        else:
            low = max(low, dual - off)
    return Fit(best[1], float(best[0]), float(low), X, f, False)


def _summed(df: DataFrame, of_batch, size: int) -> np.ndarray:
    """The sum of a vector over the table; one vector for each task is sent."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += of_batch(batch)
        yield pd.DataFrame({"v": [total]})

    rows = df.mapInPandas(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["pos"]] = r["s"]
    return out


def _least_sum(df, basis, U, G, c, tol, rounds) -> Fit:
    """The 1-norm fit: residuals within eps count by their square (a Huber loss), Newton's method makes that least, and
    eps falls. The slopes of the loss by each residual, moved so that they balance every function, prove a bound."""
    n = len(c)
    x = _active(len(df.select("x").first()[0]), U)
    largest = np.array(df.agg(*[F.max(F.abs(v)).alias(f"v{k}") for k, v in enumerate(basis.columns(x))]).first(), float)
    eps = math.sqrt(max(G[n, n] - c @ G[:n, n], 0.0) / G[0, 0])
    if eps == 0:
        return Fit(c, 0.0, 0.0, np.zeros((0, 0)), np.zeros(0), True)
    size, best, low = n * n, (math.inf, c), 0.0

    def look(c, eps):
        def of_batch(batch):
            p = _points(batch)
            V = basis.matrix(p if U is None else p @ U)
            r, k = batch["fx"].to_numpy(float) - V @ c, times(batch)
            a = np.abs(r)
            slope, inside = k * np.clip(r / eps, -1, 1), a <= eps
            weighted = V * (k / np.maximum(a, eps))[:, None]
            huber = k @ np.where(inside, r * r / (2 * eps), a - eps / 2)
            return np.concatenate([(V[inside].T @ (V * k[:, None])[inside]).ravel() / eps, (weighted.T @ V).ravel(), slope @ V, V.T @ (k * r), [k @ a, huber, slope @ r]])

        s = _summed(df, of_batch, 2 * size + 2 * n + 3)
        return s[:size].reshape(n, n), s[size : 2 * size].reshape(n, n), s[2 * size : 2 * size + n], s[2 * size + n : -3], *s[-3:]

    def tried(c, eps, ways):
        """The Huber loss after steps of each of the ways, in one pass."""

        def of_batch(batch):
            p = _points(batch)
            V = basis.matrix(p if U is None else p @ U)
            r = np.abs((batch["fx"].to_numpy(float) - V @ c)[:, None] - V @ ways)
            return times(batch) @ np.where(r <= eps, r * r / (2 * eps), r - eps / 2)

        return _summed(df, of_batch, ways.shape[1])

    lengths = 0.5 ** np.arange(8)
    for _ in range(rounds):
        inside, weighted, slope, Vr, loss, huber, turned = look(c, eps)
        if loss < best[0]:
            best = (loss, c)
        balance = np.linalg.lstsq(G[:n, :n], slope, rcond=1e-14)[0]
        low = max(low, (turned - balance @ Vr) / (1 + np.abs(balance) @ largest))
        if best[0] - low <= tol * best[0] or best[0] <= 1e-10 * math.sqrt(G[n, n] * G[0, 0]):
            return Fit(best[1], float(best[0]), float(low), np.zeros((0, 0)), np.zeros(0), True)
        newton = np.linalg.lstsq(inside + 1e-9 * weighted, slope, rcond=1e-14)[0]
        safe = np.linalg.lstsq(weighted, slope, rcond=1e-14)[0]
        # Newton's way may lead too far, the weighted one never does.
        ways = np.concatenate([newton[:, None] * lengths, safe[:, None] * [1.0, 2.0, 4.0, 8.0]], axis=1)
        after = tried(c, eps, ways)
        k = int(after.argmin())
        # What rows within eps hide is loss - turned: eps falls while that is much, and where no way leads on.
        if loss - turned > 0.3 * tol * loss and huber - after[k] <= 0.01 * tol * loss or after[k] >= huber:
            eps /= 4
        if after[k] < huber:
            c = c + ways[:, k]
    return Fit(best[1], float(best[0]), float(low), np.zeros((0, 0)), np.zeros(0), False)


@dataclass
class RidgeFit:
    """A ridge function, the fit of its coefficients with the bound for its directions, the share of the loss that the
    last linear program still promised, and whether that was within the tolerance."""

    ridge: Ridge
    fit: Fit
    promised: float
    closed: bool
    losses: list[float]


def norm_ridge(df: DataFrame, m: int, n: int, degree: int, norm: float = math.inf, bound: str | None = None, U0=None, rounds: int = 30, tol: float = 1e-2, kind: str = "legendre", seed: int = 0) -> RidgeFit:
    """p(U'x) with the least 1-, 2- or sup-norm of residuals, from both sides or one ("lower", "upper").

    A trust region on the Grassmannian: residuals are linear in a turn of U and a change of coefficients; the turn of
    least norm within the radius is a small program over the rows that Spark found (a maximum, or one side) and over
    sums of all rows (a sum, or squares). The coefficients for the turned U are then fitted over all rows, with their
    bound; the turn is kept if the loss falls by a tenth of what was promised. Ends when the promise is below tol of
    the loss at a radius of a hundredth or more, or no turn helps. Starts at U0, or at the directions of the 2-norm fit
    from the affine one. df: x, fx, or what `counted` makes of them.
    """
    if df.limit(needed_rows(m, n, degree)).count() < needed_rows(m, n, degree):
        raise ValueError(f"a fit needs {needed_rows(m, n, degree)} rows")
    side = {None: 0, "lower": 1, "upper": -1}[bound]
    df = counted(df, "x", "fx")
    if U0 is None:
        first = np.random.default_rng(seed).standard_normal((m, n))
        first[:, 0] = affine_direction(df, m)
        U0 = fit_ridge(df, m, n, degree, U0=first, rounds=10).U
    U = np.linalg.qr(np.array(U0, float).reshape(m, n))[0]

    def at(U, start=None):
        basis = scaled_basis(df, _active(m, U), degree, kind)
        return basis, norm_fit(df, basis, norm, bound, U, tol=0.1 * tol, start=start)

    basis, fit = at(U)
    count, mean = df.agg(F.sum(TIMES), F.sum(F.col(TIMES) * F.col("fx")) / F.sum(TIMES)).first()
    spread = math.sqrt(df.agg(F.sum(F.col(TIMES) * (F.col("fx") - mean) ** 2) / count).first()[0] or 0.0)
    exact = 1e-9 * spread * {1: count, 2: math.sqrt(count)}.get(norm, 1.0)
    radius, promised, losses = 0.25, math.inf, [fit.loss]
    for _ in range(rounds):
        if fit.loss <= exact or m == n:
            promised = 0.0
            break
        turn, least = _turn(df, basis, fit, U, norm, side, radius)
        promised = max(0.0, (fit.loss - least) / fit.loss)
        if promised <= tol and radius >= 1e-2 or radius < 1e-7:
            break
        trial = _geodesic(U, turn, 1.0)
        new_basis, new = at(trial, (fit.points, fit.values))
        if new.loss < fit.loss - 0.1 * promised * fit.loss:
            U, basis, fit = trial, new_basis, new
            radius = min(1.0, 2 * radius)
        else:
            # Rows that the trial found make the next program see what it missed.
            if len(new.values) and len(fit.values):
                fit.points, fit.values = np.vstack([fit.points, new.points]), np.concatenate([fit.values, new.values])
            radius /= 4
        losses.append(fit.loss)
    return RidgeFit(Ridge(U, basis, fit.coefficients), fit, promised, bool(promised <= tol and fit.closed or radius < 1e-7), losses)


def _turn(df, basis, fit, U, norm, side, radius) -> tuple[np.ndarray, float]:
    """The turn of U (columns orthogonal to U) whose linear model has the least norm, and that norm."""
    m, n = U.shape
    N = np.linalg.svd(U)[0][:, n:]
    c, p, k = fit.coefficients, len(fit.coefficients), (m - n) * n

    def rows_of(x):
        """Changes of the value by each unknown: turns, then coefficients."""
        slopes = np.einsum("rjk,j->rk", basis.slopes(x @ U), c)
        return np.hstack([((x @ N)[:, :, None] * slopes[:, None, :]).reshape(len(x), k), basis.matrix(x @ U)])

    size = k + p
    eps = 1e-3 * fit.loss / df.agg(F.sum(TIMES)).first()[0] if norm == 1 and not side else 0.0

    def batch_rows(batch):
        x = _points(batch)
        J, r = rows_of(x), batch["fx"].to_numpy(float) - basis.matrix(x @ U) @ c
        w = 1 / np.sqrt(np.maximum(np.abs(r), eps)) if eps else np.ones(len(x))
        return np.hstack([J, r[:, None]]) * w[:, None]

    P, q, A, b = np.zeros((size + 1, size + 1)), np.zeros(size + 1), [], []
    limit = np.zeros((2 * k, size + 1))
    limit[:k, :k], limit[k:, :k] = np.eye(k), -np.eye(k)
    A, b = [limit], [np.full(2 * k, -radius)]
    reach = 10 * (np.abs(c).max() + fit.loss + 1)
    limit = np.zeros((2 * p, size + 1))
    limit[:p, k:size], limit[p:, k:size] = np.eye(p), -np.eye(p)
    A, b = [*A, limit], [*b, np.full(2 * p, -reach)]
    if side or norm == math.inf:
        J, r = rows_of(fit.points), fit.values - basis.matrix(fit.points @ U) @ c
        one = np.ones((len(r), 1))
        if side:
            A, b = [*A, np.hstack([-side * J, 0 * one])], [*b, -side * r]
        if norm == math.inf:
            for sign in (1, -1):
                if not side or sign == side:
                    A, b = [*A, np.hstack([sign * J, one])], [*b, sign * r]
            q[size] = 1.0
    if norm != math.inf:
        if norm == 1 and side:
            G = _summed(df, lambda batch: times(batch) @ batch_rows(batch), size + 1)
            q[:size], rest = -side * G[:size], side * G[size]
        else:
            G = grams(df, lambda batch: _repeated(batch_rows(batch), batch), size + 1)
            P[:size, :size], q[:size], rest = 2 * G[:size, :size], -2 * G[:size, size], G[size, size]
        A, b = [*A, np.array([[0.0] * size + [1.0]])], [*b, np.zeros(1)]
        P[size, size] = 1e-9 * (np.trace(P) + 1)
    u, _ = least_quadratic(P, q, np.vstack(A), np.concatenate(b))
    if norm == math.inf:
        least = u[size]
    else:
        total = max(0.0, rest + q[:size] @ u[:size] + u[:size] @ P[:size, :size] @ u[:size] / 2)
        # Squares over the moduli at the start: of that model, a share of the fall is what the sum falls by.
        least = math.sqrt(total) if norm == 2 else total if side else fit.loss - (rest - total) / 2
    return N @ u[:k].reshape(m - n, n), float(least)

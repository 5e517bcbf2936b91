"""Small programs that the driver solves for fits and matrices; their rows are the few that Spark found to matter."""

from __future__ import annotations

import numpy as np


def least_quadratic(P: np.ndarray, q: np.ndarray, A: np.ndarray, b: np.ndarray, tol: float = 1e-10, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """x with the least x'Px / 2 + q'x where A x >= b, and the multipliers of the rows, none negative. P may be zero.

    A predictor-corrector interior method: the only systems solved are as large as x. A program that has no interior is
    solved as far as it goes.
    """
    n, m = len(q), len(b)
    if not m:
        return -np.linalg.lstsq(P, q, rcond=1e-14)[0], np.zeros(0)
    size = np.maximum(np.linalg.norm(A, axis=1), 1e-300)
    A, b = A / size[:, None], b / size
    heavy = max(np.abs(P).max(initial=0.0), np.abs(q).max(initial=0.0), 1e-300)
    P, q = P / heavy, q / heavy
    x = -np.linalg.lstsq(P + 1e-8 * np.eye(n), q, rcond=None)[0] if P.any() else np.zeros(n)
    s = np.maximum(A @ x - b, 1.0)
    z = np.ones(m)

    def step(v, dv):
        down = dv < 0
        return min(1.0, (-v[down] / dv[down]).min(initial=np.inf))

    best = (np.inf, x, z)
    for _ in range(rounds):
        rd, rp, mu = P @ x + q - A.T @ z, A @ x - s - b, s @ z / m
        worst = max(np.abs(rd).max() / (1 + np.abs(q).max()), np.abs(rp).max() / (1 + np.abs(b).max()), mu / (1 + abs(q @ x)))
        if worst < best[0]:
            best = (worst, x.copy(), z.copy())
        if worst < tol or not np.isfinite(worst):
            break
        D = z / s
        M = P + (A.T * D) @ A
        M += 1e-14 * (np.trace(M) / n + 1e-300) * np.eye(n)

        def direction(rc):
            try:
                dx = np.linalg.solve(M, -rd - A.T @ ((rc + z * rp) / s))  # noqa: B023
            except np.linalg.LinAlgError:
                dx = np.linalg.lstsq(M, -rd - A.T @ ((rc + z * rp) / s), rcond=1e-15)[0]  # noqa: B023
            ds = A @ dx + rp  # noqa: B023
            return dx, ds, (-rc - z * ds) / s  # noqa: B023

        _, ds, dz = direction(s * z)
        a, c = step(s, ds), step(z, dz)
        center = (max((s + a * ds) @ (z + c * dz), 0.0) / m / mu) ** 3 if mu > 0 else 0.0
        dx, ds, dz = direction(s * z + ds * dz - center * mu)
        a = 0.995 * min(step(s, ds), step(z, dz)) if P.any() else None
        a, c = (a, a) if a is not None else (0.995 * step(s, ds), 0.995 * step(z, dz))
        x, s, z = x + a * dx, s + a * ds, z + c * dz
    return best[1], best[2] * heavy / size


def least_trace(shapes: list[np.ndarray], pairs: np.ndarray, need: np.ndarray, gradients: np.ndarray, tol: float = 1e-7) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights h of the symmetric shapes for which H = sum h E has the least trace with p'Hp >= need for each pair,
    H >= g g' for each gradient and H >= 0; a lower bound of that trace; the pairs' multipliers; and the matrix that the
    multipliers put on H, whose product with a change of H tells how much of it the trace must pay for.

    A barrier is followed by Newton's method. On its way, the inverse slacks are multipliers of the dual program; scaled
    until they are feasible there, they give the bound. Some combination of the shapes must be the identity.
    """
    m, n = len(shapes[0]), len(shapes)
    E = np.array(shapes)
    flat = E.reshape(n, -1)
    start = np.linalg.lstsq(flat.T, np.eye(m).ravel(), rcond=None)[0]
    scale = max(need.max(initial=0.0), (gradients**2).sum(axis=1).max(initial=0.0), 1e-300)
    d, G = need / scale, gradients / np.sqrt(scale)
    cost = np.einsum("kii->k", E)
    rows = np.einsum("ai,kij,aj->ak", pairs, E, pairs) if len(pairs) else np.zeros((0, n))
    outer = np.einsum("ai,aj->aij", G, G)
    h, t = start * 2.0, 1.0
    count = len(d) + m * (1 + len(G))

    def slacks(h):
        H = np.einsum("k,kij->ij", h, E)
        return rows @ h - d, np.concatenate([H[None], H - outer])

    def value(h, t):
        slack, blocks = slacks(h)
        if len(slack) and slack.min() <= 0:
            return np.inf
        try:
            roots = np.linalg.cholesky(blocks)
        except np.linalg.LinAlgError:
            return np.inf
        return t * cost @ h - np.log(slack).sum() - 2 * np.log(np.einsum("bii->bi", roots)).sum()

    low, multipliers, weight = 0.0, np.zeros(len(d)), np.zeros((m, m))
    while True:
        for _ in range(60):
            slack, blocks = slacks(h)
            try:
                inverse = np.linalg.inv(blocks)
            except np.linalg.LinAlgError:  # as near to the edge as numbers go
                return h * scale, low * scale, multipliers, weight
            total = inverse.sum(axis=0)
            scaled = rows / slack[:, None]
            g = t * cost - scaled.sum(axis=0) - np.einsum("ij,kij->k", total, E)
            VE = (inverse[:, None] @ E[None]).transpose(1, 0, 2, 3)
            K = scaled.T @ scaled + VE.reshape(n, -1) @ VE.transpose(0, 1, 3, 2).reshape(n, -1).T
            size = np.sqrt(np.diag(K))
            dh = -np.linalg.lstsq(K / np.outer(size, size), g / size, rcond=1e-15)[0] / size
            fall, now, a = -g @ dh, value(h, t), 1.0
            while value(h + a * dh, t) > now - 0.2 * a * fall and a > 1e-10:
                a /= 2
            h = h + a * dh
            if fall < 1e-6 or a <= 1e-10:
                break
        slack, blocks = slacks(h)
        dual = 1 / (t * slack)
        inverse = np.linalg.inv(blocks) / t
        # Multipliers are feasible where they weigh no shape more than its trace: they are shrunk until the matrix that
        # is left of the identity, in the span of the shapes, is positive.
        used = np.einsum("a,ai,aj->ij", dual, pairs, pairs) + inverse[1:].sum(axis=0)
        short = cost - np.einsum("ij,kij->k", used, E)
        keep = 1.0
        if len(short):
            rest = np.einsum("k,kij->ij", np.linalg.lstsq(np.einsum("aij,bij->ab", E, E), short, rcond=1e-12)[0], E)
            ground = np.linalg.eigvalsh((rest + rest.T) / 2)[0]
            keep = 1 / (1 + max(0.0, -ground))
        bound = keep * (dual @ d + np.einsum("bi,bij,bj->", G, inverse[1:], G))
        if bound > low:
            low, multipliers, weight = bound, keep * dual, keep * used
        if cost @ h - low <= tol * (cost @ h) or count / t < 1e-10:
            return h * scale, low * scale, multipliers, weight
        t *= 5.0

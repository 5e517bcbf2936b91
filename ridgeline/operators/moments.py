"""Second moments by one aggregate pass, and the subspaces that a small driver-side solve makes of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outer_sums(df: DataFrame, g: list[Column], w: Column | None = None) -> DataFrame:
    """i, j, value for i <= j: the sum of w g_i g_j (w = 1 / rows unless given). Every task adds up its rows, so
    m (m + 1) / 2 numbers are shuffled for each."""
    weight = F.lit(1.0) if w is None else w
    pairs = [(i, j) for i in range(len(g)) for j in range(i, len(g))]
    sums = df.agg(*[F.sum(weight * g[i] * g[j]).alias(f"s{i}_{j}") for i, j in pairs], F.count("*").alias("n"))
    per = F.lit(1.0) if w is not None else 1.0 / F.greatest(F.col("n"), F.lit(1))
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"s{i}_{j}") * per).alias("value")) for i, j in pairs])
    return sums.select(F.inline(rows))


def outer_matrix(df: DataFrame, g: list[Column], w: Column | None = None) -> np.ndarray:
    out = np.zeros((len(g), len(g)))
    for r in outer_sums(df, g, w).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"] or 0.0
    return out


def active_subspace(df: DataFrame, g: list[Column], w: Column | None = None, names=()) -> tuple[np.ndarray, np.ndarray]:
    """U (columns by importance, the mean slope along each not negative) and singular values, from gradients g."""
    C = outer_matrix(df, g, w)
    mean = np.array(df.agg(*[F.avg(gi).alias(f"g{i}") for i, gi in enumerate(g)]).first(), float)
    values, U = np.linalg.eigh(C)
    values, U = values[::-1], U[:, ::-1]
    U = U * np.where(mean @ U < 0, -1.0, 1.0)
    return U, np.sqrt(np.maximum(values, 0))


def subspace_table(spark, U: np.ndarray, singvals, names=()) -> DataFrame:
    """component, coord, name, loading, singval."""
    m = len(U)
    names = names or [f"x{i}" for i in range(m)]
    rows = [(k, i, names[i], float(U[i, k]), float(singvals[k])) for k in range(U.shape[1]) for i in range(m)]
    return spark.createDataFrame(rows, "component int, coord int, name string, loading double, singval double")


def principal_angles(U: np.ndarray, V: np.ndarray) -> np.ndarray:
    s = np.linalg.svd(np.linalg.qr(U)[0].T @ np.linalg.qr(V)[0], compute_uv=False)
    return np.arccos(np.clip(s, -1, 1))


def convergence(df: DataFrame, g: list[Column], order: Column, sizes: list[int], k: int = 1) -> list[tuple[int, float]]:
    """For growing prefixes (by `order`, a row number) the largest angle between consecutive k-dimensional subspaces; the
    first is pi/2. One pass: moments by size class, then prefix sums of these few matrices."""
    sizes = sorted(sizes)
    bucket = sum((F.when(order >= s, 1).otherwise(0) for s in sizes), F.lit(0))
    m = len(g)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    rows = df.groupBy(bucket.alias("bucket")).agg(*[F.sum(g[i] * g[j]).alias(f"s{i}_{j}") for i, j in pairs]).where(F.col("bucket") < len(sizes)).collect()
    parts = np.zeros((len(sizes), m, m))
    for r in rows:
        for i, j in pairs:
            parts[r["bucket"], i, j] = parts[r["bucket"], j, i] = r[f"s{i}_{j}"]
    out, before = [], None
    for size, C in zip(sizes, np.cumsum(parts, axis=0), strict=True):
        U = np.linalg.eigh(C)[1][:, ::-1][:, :k]
        out.append((size, float(np.pi / 2 if before is None else principal_angles(before, U).max())))
        before = U
    return out


def slope_signs(pairs: DataFrame, U: np.ndarray, m: int) -> DataFrame:
    """component, sign: of the summed slopes (f_i - f_j) / u'(x_i - x_j) over pairs with columns p (array) and df;
    zero denominators are left out and a zero sum counts as +1."""
    from ridgeline.operators.domain import coords, dot

    p = coords("p", m)
    sums = []
    for k in range(U.shape[1]):
        u = dot(U[:, k], p)
        sums.append(F.sum(F.when(u != 0, F.col("df") / u)).alias(f"s{k}"))
    row = pairs.agg(*sums)
    signs = [F.struct(F.lit(k).alias("component"), F.when(F.col(f"s{k}") < 0, -1).otherwise(1).alias("sign")) for k in range(U.shape[1])]
    return row.select(F.inline(F.array(*signs)))


def coordinate_ranks(spark, scores, names) -> DataFrame:
    """coord, name, score, place: by falling score, ties by coordinate."""
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    place = {c: k + 1 for k, c in enumerate(order)}
    return spark.createDataFrame([(i, names[i], float(s), place[i]) for i, s in enumerate(scores)], "coord int, name string, score double, place int")


def column_scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, low, high, mean, std (population) of each column, in one pass."""
    aggs = [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("low", F.min), ("high", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    rows = [F.struct(F.lit(c).alias("name"), *[F.col(f"{k}_{c}").cast("double").alias(k) for k in ("low", "high", "mean", "std")]) for c in columns]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def percentiles(df: DataFrame, column: str, by: list[str] = (), at=(0.0, 0.25, 0.5, 0.75, 1.0), approximate: bool = False) -> DataFrame:
    """The percentiles of a column for each group, one column each: p0, p25, ..."""
    found = F.percentile_approx(column, list(at), 10_000) if approximate else F.percentile(column, F.array(*[F.lit(a) for a in at]))
    out = df.groupBy(*by).agg(found.alias("_p")) if by else df.agg(found.alias("_p"))
    return out.select(*by, *[F.get("_p", k).alias(f"p{round(100 * a)}") for k, a in enumerate(at)])


def errors(df: DataFrame, truth: Column, guess: Column, by: list[str] = ()) -> DataFrame:
    """sup_error and rel_error (2-norm), both over the range of the truth, and rmse."""
    d = truth - guess
    span = F.max(truth) - F.min(truth)
    aggs = [(F.max(F.abs(d)) / F.nullif(span, F.lit(0.0))).alias("sup_error"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.sqrt(F.sum(d * d)) / F.nullif(span * F.sqrt(F.count("*")), F.lit(0.0))).alias("rel_error")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)

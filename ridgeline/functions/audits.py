"""Derivatives checked by differences, for any function of coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moved(x: list[Column], k: int, by: Column) -> list[Column]:
    return [xi + by if i == k else xi for i, xi in enumerate(x)]


def forward_differences(f, x: list[Column], h: float = 1e-7, scale: list[float] | None = None) -> list[Column]:
    """(f(x + h) - f(x)) / h along each input, as columns; h in units of x times scale (1 unless given)."""
    scale = scale or [1.0] * len(x)
    base = f(x)
    return [(f(_moved(x, k, F.lit(h / s))) - base) / F.lit(h) for k, s in enumerate(scale)]


def derivative_audit(df: DataFrame, f, gradient: list[Column], x: list[Column], scale: list[float] | None = None, steps: int = 100, low: float = -14.0, high: float = -1.0) -> DataFrame:
    """e0, e1, ...: for each input the largest, over all rows, of the smallest difference over `steps` step sizes (even in
    the logarithm, from 10^low to 10^high) between the central difference of f and the given derivative. Nulls where
    there are no rows. Equal rows are brought together first, and stay where they are for their minima."""
    scale = scale or [1.0] * len(x)
    sizes = [10.0 ** (low + (high - low) * k / max(1, steps - 1)) for k in range(steps)]
    x_names, g_names = [f"_x{k}" for k in range(len(x))], [f"_g{k}" for k in range(len(x))]
    rows = df.select(*[c.alias(n) for c, n in zip(x, x_names, strict=True)], *[c.alias(n) for c, n in zip(gradient, g_names, strict=True)])
    rows = rows.distinct().withColumn("_h", F.explode(F.array(*map(F.lit, sizes))))
    at, out = [F.col(n) for n in x_names], []
    for k, s in enumerate(scale):
        step = F.col("_h") / F.lit(s)
        out.append(F.abs((f(_moved(at, k, step)) - f(_moved(at, k, -step))) / (2 * F.col("_h")) - F.col(g_names[k])).alias(f"e{k}"))
    best = rows.select(*x_names, *g_names, *out).groupBy(*x_names, *g_names).agg(*[F.min(f"e{k}").alias(f"e{k}") for k in range(len(x))])
    return best.agg(*[F.max(f"e{k}").alias(f"e{k}") for k in range(len(x))])

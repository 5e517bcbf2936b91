"""Queries whose results carry their proof: fits and matrices with the bound that nothing beats, and SQL for what can be
computed another way."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ridgeline.functions import closed_form as cf
from ridgeline.operators import fits, lipschitz, ridge
from ridgeline.operators.domain import coords
from ridgeline.plans.more_queries import ORACLES, QUERIES
from ridgeline.plans.queries import PART_SQL, _workload_rows, parts, query
from ridgeline.sources import tables

__all__ = ["ORACLES", "QUERIES"]


def _sized(spark, d):
    """Prices of parts by their size alone."""
    return tables.stored(parts(spark, d).select("id", F.slice("x", 1, 1).alias("x"), "fx"), "sized")


#: The least sup-norm of a quadratic in one input is the largest level of four inputs with errors of alternating signs.
_LEVEL = f"""WITH s AS (SELECT x0 AS x, max(fx) AS hi, min(fx) AS lo FROM ({PART_SQL}) GROUP BY x0),
q AS (SELECT a.x AS xa, b.x AS xb, c.x AS xc, e.x AS xe, a.hi AS ah, a.lo AS al, b.hi AS bh, b.lo AS bl, c.hi AS ch, c.lo AS cl, e.hi AS eh, e.lo AS el
      FROM s a JOIN s b ON a.x < b.x JOIN s c ON b.x < c.x JOIN s e ON c.x < e.x),
w AS (SELECT *, 1 / ((xb - xa) * (xc - xa) * (xe - xa)) AS wa, 1 / ((xb - xa) * (xc - xb) * (xe - xb)) AS wb,
             1 / ((xc - xa) * (xc - xb) * (xe - xc)) AS wc, 1 / ((xe - xa) * (xe - xb) * (xe - xc)) AS we FROM q),
t AS (SELECT max(greatest(wa * ah - wb * bl + wc * ch - we * el, -wa * al + wb * bh - wc * cl + we * eh) / (wa + wb + wc + we)) AS level FROM w)"""


@query(f"{_LEVEL} SELECT side, round(times * level, 5) AS loss FROM t, (VALUES ('both', 1), ('lower', 2), ('upper', 2)) v(side, times)")
def ra3_sup_norm_fits(spark, d):
    """The least sup-norm of quadratics in the parts' sizes, free and below and above all prices."""
    df = _sized(spark, d)
    basis = ridge.scaled_basis(df, coords("x", 1), 2)
    rows = [(side or "both", round(fits.norm_fit(df, basis, math.inf, side, tol=1e-6).loss, 5)) for side in (None, "lower", "upper")]
    return spark.createDataFrame(rows, "side string, loss double")


@query()
def ra2_ra3_other_norms(spark, d):
    """Quadratic fits of the parts' prices by size: sup-norm, 1-norm, and a lower and an upper bound."""
    df = _sized(spark, d)
    basis, out = ridge.scaled_basis(df, coords("x", 1), 2), df
    for name, norm, bound in (("two", 2, None), ("one", 1, None), ("sup", math.inf, None), ("lower", 2, "lower"), ("upper", 2, "upper")):
        c = fits.norm_fit(df, basis, norm, bound).coefficients
        out = out.withColumn(name, F.col("fx") - ridge.evaluate(basis, c, coords("x", 1)))
    return out.agg(*[F.max(F.abs(n)).alias(f"largest_{n}") for n in ("two", "one", "sup")], F.min("lower").alias("least_lower"), F.max("upper").alias("most_upper"))


def _kept(df, fit, basis, side, tol):
    """Rows on the wrong side of a fit, and whether its loss, added up anew, is the one reported and near its bound."""
    r = F.col("fx") - ridge.evaluate(basis, fit.coefficients, coords("x", basis.dim))
    wrong = {None: F.lit(False), "lower": r < -1e-9, "upper": r > 1e-9}[side]
    found = df.agg(F.count("*").alias("rows"), F.count(F.when(wrong, 1)).alias("wrong"), F.sum(F.abs(r)).alias("one"), F.sum(r * r).alias("two"))
    return found, tol


@query(
    """SELECT 'one' AS norm, side, count(*) AS rows, 0::BIGINT AS wrong, true AS proven FROM part, (VALUES ('both'), ('lower'), ('upper')) v(side) GROUP BY side
UNION ALL SELECT 'two', side, count(*), 0::BIGINT, true FROM part, (VALUES ('both'), ('lower'), ('upper')) v(side) GROUP BY side"""
)
def ra2_ra3_sums(spark, d):
    """Certificates of quadratic fits of the parts' prices in the 1- and 2-norm, free and from one side: rows on the wrong
    side (none), and whether the loss, added up anew, is within a thousandth of a bound that no quadratic beats."""
    df = _sized(spark, d)
    basis, out = ridge.scaled_basis(df, coords("x", 1), 2), None
    for name, norm in (("one", 1), ("two", 2)):
        for side in (None, "lower", "upper"):
            fit = fits.norm_fit(df, basis, norm, side)
            found, _ = _kept(df, fit, basis, side, 1e-3)
            loss = F.col("one") if norm == 1 else F.sqrt("two")
            proven = (F.abs(loss - fit.loss) <= 1e-6 * fit.loss) & (loss * (1 - 1e-3) <= fit.bound * (1 + 1e-9))
            row = found.select(F.lit(name).alias("norm"), F.lit(side or "both").alias("side"), "rows", "wrong", proven.alias("proven"))
            out = row if out is None else out.unionByName(row)
    return out


@query(
    """SELECT norm, side, count(*) AS rows, 0::BIGINT AS wrong, true AS proven, true AS better FROM lineitem,
(VALUES ('sup', 'both'), ('one', 'lower'), ('two', 'upper')) v(norm, side) GROUP BY norm, side"""
)
def ra8_ridge_norms(spark, d):
    """Certificates of cubic ridge functions of the OTL circuit over all line items in other norms: rows on the wrong
    side, whether the loss is within a hundredth of the bound for its direction, and whether it is below the loss that
    the same fit has in the direction of the affine one."""
    df, x = _workload_rows(spark, d, cf.OTL)
    data = ridge.counted(df.select(F.array(*cf.OTL.domain.normalize(x)).alias("x"), cf.OTL.values(x)[0].alias("fx")), "x", "fx")
    start, out = ridge.affine_direction(data, 6), None
    for name, norm, side in (("sup", math.inf, None), ("one", 1, "lower"), ("two", 2, "upper")):
        found = fits.norm_ridge(data, 6, 1, 3, norm, side, U0=start)
        r = F.col("fx") - found.ridge.value(coords("x", 6))
        wrong = {None: F.abs(r) > found.fit.loss * (1 + 1e-6) if norm == math.inf else F.lit(False), "lower": r < -1e-9, "upper": r > 1e-9}[side]
        proven = found.fit.gap <= 1e-2
        row = data.agg(F.lit(name).alias("norm"), F.lit(side or "both").alias("side"), F.coalesce(F.sum(ridge.TIMES), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(wrong, F.col(ridge.TIMES))), F.lit(0)).alias("wrong"), F.lit(bool(proven)).alias("proven"), F.lit(bool(found.fit.loss < found.losses[0])).alias("better"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT rank, count(*) AS gradients, 0::BIGINT AS broken, true AS tight, true AS ordered FROM lineitem, (VALUES (1), (2)) v(rank) GROUP BY rank")
def l10_partial_matrix(spark, d):
    """Certificates of matrices of rank 1 and 2 and a multiple of the identity for the gradients of the OTL circuit: rows
    that break them, whether the trace is within a thousandth of the bound for its directions, and whether it lies
    between that of the free matrix and that of a multiple of the identity."""
    df, x = _workload_rows(spark, d, cf.OTL)
    g = ridge.counted(df.select(F.array(*cf.OTL.gradients(x, normalized=True)[0]).alias("grad")), "grad")
    free, whole = lipschitz.least_matrix(6, gradients=g), lipschitz.least_matrix(6, gradients=g, shapes=[np.eye(6)])
    out, last = None, np.trace(whole.H)
    for rank in (1, 2):
        found = lipschitz.partial_matrix(6, rank, gradients=g)
        trace = np.trace(found.H)
        ordered = free.bound * (1 - 1e-9) <= trace <= last * (1 + 1e-6)
        last = trace
        row = lipschitz.broken_gradients(g, found.H, -1e-9 * trace).select(F.lit(rank).alias("rank"), "gradients", "broken", F.lit(bool(found.gap <= 1e-3)).alias("tight"), F.lit(bool(ordered)).alias("ordered"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT count(*) AS parts, 0::BIGINT AS broken_pairs, 0::BIGINT AS broken_gradients, true AS tight FROM part")
def l4_mixed_matrix(spark, d):
    """Certificate of a matrix for the parts' prices within 0.01 and, at every part, the slopes of price by its inputs in
    the plane that fits all parts."""
    p = tables.stored(parts(spark, d), "parts")
    basis = ridge.Basis("monomial", 1, (0.0, 0.0), (1.0, 1.0))
    c = ridge.least_squares(p, basis)
    x = coords("x", 2)
    slopes = [F.lit(float(v)) * (1 + xi) for v, xi in zip(c[1:], x, strict=True)]
    g = tables.stored(p.select("id", F.array(*slopes).alias("grad")), "slopes")
    H, gap = lipschitz.matrix_from_samples(p, 2, eps=0.01, gradients=g)
    pairs = lipschitz.pair_slack(p, H, 2, eps=0.01, top=1).agg(F.coalesce(F.sum((F.col("slack") < -1e-9).cast("long")), F.lit(0)).alias("broken_pairs"))
    rows = lipschitz.gradient_slack(g, H).agg(F.count("*").alias("parts"), F.count(F.when(F.col("slack") < -1e-9 * float(np.trace(H)), 1)).alias("broken_gradients"))
    return rows.crossJoin(pairs).select("parts", "broken_pairs", "broken_gradients", F.lit(bool(gap <= 1e-3)).alias("tight"))  # one row each

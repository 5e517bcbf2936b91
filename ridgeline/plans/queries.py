"""Registered queries of the analytics operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ridgeline.functions import audits
from ridgeline.functions import closed_form as cf
from ridgeline.operators import design, moments, pairs, summaries
from ridgeline.operators.domain import LogNormal, Normal, Uniform, box, coords, dot, linquad, point
from ridgeline.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, digits: int = 6):
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


# Inputs -------------------------------------------------------------------------------------------------------------

#: Bounds of three numbers of a line item: quantity, discount, tax.
LINE = box([1, 0, 0], [50, 0.1, 0.08], ["l_quantity", "l_discount", "l_tax"])
LINE_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem"
NORM_SQL = f"SELECT *, (a - 25.5) * (2 / 49.0) AS na, (b - 0.05) * (2 / 0.1) AS nb, (c - 0.04) * (2 / 0.08) AS nc FROM ({LINE_SQL})"


def line(spark, d):
    return tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"))




def abc():
    return [F.col(c) for c in "abc"]


def parts(spark, d):
    """Samples (id, x, fx): size and price of parts as inputs, in steps that both engines compute alike."""
    t = tables.table(spark, d, "part")
    return t.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50.0, F.col("p_partkey") % 97 / 97.0).alias("x"), (F.col("p_retailprice") / 1000.0).alias("fx"))


PART_SQL = "SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS x0, (p_partkey % 97) / 97.0::DOUBLE AS x1, p_retailprice / 1000.0::DOUBLE AS fx FROM part"


def vectors(spark, d):
    return tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"))


VEC_SQL = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings"


def unit(column: str, k: int) -> str:
    """SQL of a number in [0, 1) from keys, exact in both engines."""
    return f"((({column}) * {7919 + 104729 * k} + {k} * 15485863) % 1000003) / CAST(1000003 AS DOUBLE)"


# Flagship and moments -----------------------------------------------------------------------------------------------


@query(
    f"""WITH n AS ({NORM_SQL})
SELECT 0 AS i, 0 AS j, round(avg(na * na), 6) AS value FROM n UNION ALL SELECT 0, 1, round(avg(na * nb), 6) + 0.0 FROM n UNION ALL SELECT 0, 2, round(avg(na * nc), 6) + 0.0 FROM n
UNION ALL SELECT 1, 1, round(avg(nb * nb), 6) FROM n UNION ALL SELECT 1, 2, round(avg(nb * nc), 6) + 0.0 FROM n UNION ALL SELECT 2, 2, round(avg(nc * nc), 6) FROM n"""
)
def a1_moments(spark, d):
    return moments.outer_sums(line(spark, d), LINE.normalize(abc())).select("i", "j", r6(F.col("value")).alias("value"))


@query()
def a2_active_subspace(spark, d):
    """Of the borehole's gradients at points derived from line items."""
    df, x = _workload_rows(spark, d, cf.BOREHOLE)
    g = cf.BOREHOLE.gradients(x, normalized=True)[0]
    U, s = moments.active_subspace(df, g)
    return moments.subspace_table(spark, U, s, cf.BOREHOLE.domain.names)


@query()
def a3_quadrature_subspace(spark, d):
    """The same by a 3-point tensor rule, joined with the regions only to follow the tables."""
    rule = design.tensor_rule(spark, box([-1] * 8, [1] * 8), 3).withColumn("w", F.col("w") / 256.0)
    x = cf.BOREHOLE.domain.unnormalize(coords("x", 8))
    g = cf.BOREHOLE.gradients(x, normalized=True)[0]
    rule = rule.withColumn("g", F.array(*g))
    U, s = moments.active_subspace(rule, coords("g", 8), F.col("w"))
    loaded = moments.subspace_table(spark, U, s, cf.BOREHOLE.domain.names)
    df, xs = _workload_rows(spark, d, cf.BOREHOLE)
    spread = df.agg(*[F.stddev_pop(dot(U[:, k], cf.BOREHOLE.domain.normalize(xs))).alias(f"s{k}") for k in range(8)])
    spreads = spread.select(F.inline(F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"s{k}").alias("spread")) for k in range(8)])))
    return loaded.join(spreads, "component")


@query(
    f"""WITH p AS ({PART_SQL}), q AS (SELECT a.fx - b.fx AS df, a.x0 - b.x0 AS p0, a.x1 - b.x1 AS p1 FROM p a JOIN p b ON a.id < b.id)
SELECT 0 AS component, CASE WHEN sum(CASE WHEN p0 <> 0 THEN df / p0 END) < 0 THEN -1 ELSE 1 END AS sign FROM q
UNION ALL SELECT 1, CASE WHEN sum(CASE WHEN p1 <> 0 THEN df / p1 END) < 0 THEN -1 ELSE 1 END FROM q"""
)
def a4_slope_signs(spark, d):
    return pairs.slope_signs(parts(spark, d), 2)


@query()
def a5_a6_local_linear(spark, d):
    """Local fits of the parts' prices at every part, bandwidth by the rule."""
    p = parts(spark, d)
    return summaries.local_linear(p.select("id", "x"), p, 2, summaries.bandwidth(2, p.count())).select("id", F.get("c", 0).alias("value"), F.slice("c", 2, 2).alias("slopes"))


@query()
def a8_outer_product_of_gradients(spark, d):
    p = parts(spark, d)
    U, s = summaries.outer_product_of_gradients(p.select("id", "x"), p, 2, 5.0)
    return moments.subspace_table(spark, U, s)


@query(
    f"""WITH n AS ({NORM_SQL}), s(coord, name, score) AS (SELECT 0, 'l_quantity', avg(na * na) FROM n UNION ALL SELECT 1, 'l_discount', avg(nb * nb) FROM n UNION ALL SELECT 2, 'l_tax', avg(nc * nc) FROM n)
SELECT coord, name, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, coord) AS INTEGER) AS place FROM s"""
)
def a10_coordinate_ranks(spark, d):
    C = moments.outer_matrix(line(spark, d), LINE.normalize(abc()))
    return moments.coordinate_ranks(spark, np.diag(C).tolist(), LINE.names).withColumn("score", F.round("score", 6))


@query()
def a11_subspace_convergence(spark, d):
    df, x = _workload_rows(spark, d, cf.OTL)
    df = df.withColumn("n", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1 << 20)))
    g = cf.OTL.gradients(x, normalized=True)[0]
    found = moments.convergence(df, g, F.col("n"), [1 << k for k in range(12, 21)])
    return spark.createDataFrame(found, "size long, angle double")


@query(f"WITH n AS ({NORM_SQL}) SELECT round(8.0 * avg(CASE WHEN na * na + nb * nb + nc * nc <= 1 THEN 1.0 ELSE 0.0 END), 6) AS volume FROM n")
def a12_volume_share(spark, d):
    ball = linquad([-1] * 3, [1] * 3, Ls=[np.eye(3)], ys=[[0, 0, 0]], rhos=[1])
    return line(spark, d).agg(F.round(ball.volume_from(LINE.normalize(abc()), tol=0.0), 6).alias("volume"))


@query(
    "SELECT user_id, round(quantile_cont(value, 0.0), 6) AS p0, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 1.0), 6) AS p100 FROM events GROUP BY user_id"
)
def a13_percentiles(spark, d):
    out = moments.percentiles(tables.table(spark, d, "events"), "value", ["user_id"])
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("p0", "p25", "p50", "p75", "p100")])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, min({c}) AS low, max({c}) AS high, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
)
def a14_column_scaling(spark, d):
    out = moments.column_scaling(tables.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("name", "low", "high", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(
    """SELECT event_type, round(max(abs(value - g)) / nullif(max(value) - min(value), 0), 8) AS sup_error, round(sqrt(avg((value - g) * (value - g))), 6) AS rmse,
round(sqrt(sum((value - g) * (value - g))) / nullif((max(value) - min(value)) * sqrt(count(*)), 0), 8) AS rel_error
FROM (SELECT *, user_id % 50 AS g FROM events) GROUP BY event_type"""
)
def a15_errors(spark, d):
    out = moments.errors(tables.table(spark, d, "events"), F.col("value"), (F.col("user_id") % 50).cast("double"), ["event_type"])
    return out.select("event_type", F.round("sup_error", 8).alias("sup_error"), F.round("rmse", 6).alias("rmse"), F.round("rel_error", 8).alias("rel_error"))


# Filters and projections --------------------------------------------------------------------------------------------

HALF = linquad([1, 0, 0], [50, 0.1, 0.08], A=[[0.02, 5, 5]], b=[1.0], A_eq=[], b_eq=[])


@query(f"SELECT l_orderkey, l_linenumber, a, b, c FROM ({LINE_SQL}) WHERE a >= 10 - 1e-5 AND a <= 20 + 1e-5 AND b >= 0.02 - 1e-5 AND b <= 0.06 + 1e-5")
def f1_bounds(spark, d):
    inside = box([10, 0.02, -math.inf], [20, 0.06, math.inf]).contains(abc())
    return line(spark, d).where(inside).select("l_orderkey", "l_linenumber", "a", "b", "c")


@query(f"SELECT l_orderkey, l_linenumber FROM ({LINE_SQL}) WHERE 0.02 * a + 5 * b + 5 * c <= 1.0 + 1e-5")
def f2_half_space(spark, d):
    return line(spark, d).where(HALF.contains(abc())).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM ({LINE_SQL}) WHERE abs(b - c - 0.02) < 1e-5")
def f3_plane(spark, d):
    inside = linquad([1, 0, 0], [50, 0.1, 0.08], A_eq=[[0, 1, -1]], b_eq=[0.02]).contains(abc())
    return line(spark, d).where(inside).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM ({LINE_SQL}) WHERE sqrt((0.02 * (a - 25.5)) * (0.02 * (a - 25.5)) + (10 * (b - 0.05)) * (10 * (b - 0.05))) <= 0.4 + 1e-5")
def f4_ball(spark, d):
    ball = linquad([1, 0, 0], [50, 0.1, 0.08], Ls=[[[0.02, 0, 0], [0, 10, 0]]], ys=[[25.5, 0.05, 0]], rhos=[0.4])
    return line(spark, d).where(ball.contains(abc())).select("l_orderkey", "l_linenumber")


@query(f"SELECT count(*) AS inside FROM ({LINE_SQL}) WHERE a BETWEEN 5 - 1e-5 AND 45 + 1e-5 AND b BETWEEN 0.01 - 1e-5 AND 0.09 + 1e-5 AND c BETWEEN 0 - 1e-5 AND 0.05 + 1e-5")
def f5_tensor_product(spark, d):
    product = box([5], [45]) * box([0.01, 0], [0.09, 0.05])
    return line(spark, d).where(product.contains(abc())).agg(F.count("*").alias("inside"))


@query("SELECT p_partkey FROM part WHERE p_size = 7 AND p_partkey % 10 = 3")
def f6_point(spark, d):
    t = tables.table(spark, d, "part")
    return t.where(point([7, 3]).contains([F.col("p_size"), F.col("p_partkey") % 10], tol=0.0)).select("p_partkey")


@query("SELECT vec_id, len(embedding) = 64 AS fits FROM embeddings")
def f7_dimension(spark, d):
    return tables.table(spark, d, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("fits"))


@query(f"SELECT l_orderkey, l_linenumber FROM ({LINE_SQL}) WHERE a >= 10 - 1e-5 AND a <= 30 + 1e-5 AND b >= 0.02 - 1e-5 AND b <= 0.1 + 1e-5 AND c >= -1e-5 AND c <= 0.08 + 1e-5 AND 0.02 * a + 5 * b + 5 * c <= 1.0 + 1e-5")
def f8_intersection(spark, d):
    both = HALF.intersect(box([10, 0.02, 0], [30, 0.2, 1]))
    return line(spark, d).where(both.contains(abc())).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber, round(na, 9) + 0.0 AS x0, round(nb, 9) + 0.0 AS x1, round(nc, 9) + 0.0 AS x2 FROM ({NORM_SQL})")
def p1_normalize(spark, d):
    return line(spark, d).select("l_orderkey", "l_linenumber", *[r6(c, 9).alias(f"x{k}") for k, c in enumerate(LINE.normalize(abc()))])


@query(f"SELECT l_orderkey, l_linenumber, round(a, 6) AS x0, round(b, 6) AS x1, round(c, 6) AS x2 FROM ({LINE_SQL})")
def p2_round_trip(spark, d):
    back = LINE.unnormalize(LINE.normalize(abc()))
    return line(spark, d).select("l_orderkey", "l_linenumber", *[r6(c).alias(f"x{k}") for k, c in enumerate(back)])


@query(f"SELECT l_orderkey, l_linenumber FROM ({LINE_SQL}) WHERE 0.02 * a + 5 * b + 5 * c <= 1.0 + 1e-5")
def p3_normalized_membership(spark, d):
    inside = HALF.normalized().contains(HALF.normalize(abc()))
    return line(spark, d).where(inside).select("l_orderkey", "l_linenumber")


@query(
    f"""SELECT l_orderkey, l_linenumber, round(greatest(least(CASE WHEN a < 50 OR a = 50 THEN (50 - a) / 1.0 END, (b - 0.0) / 0.01, CASE WHEN 0.02 * 1.0 + 5 * -0.01 > 0 THEN (1.0 - (0.02 * a + 5 * b + 5 * c)) / (0.02 - 0.05) ELSE 1e300 END), 0), 6) AS reach
FROM ({LINE_SQL}) WHERE 0.02 * a + 5 * b + 5 * c <= 1.0 + 1e-5"""
)
def p4_extent(spark, d):
    p = [F.lit(1.0), F.lit(-0.01), F.lit(0.0)]
    df = line(spark, d).where(HALF.contains(abc()))
    return df.select("l_orderkey", "l_linenumber", r6(HALF.extent(abc(), p)).alias("reach"))


@query(f"SELECT l_orderkey, l_linenumber, CAST(CASE WHEN a - 25 >= 0 THEN 50.0 ELSE 1.0 END AS DOUBLE) AS x0, CAST(CASE WHEN b - 0.05 >= 0 THEN 0.1 ELSE 0.0 END AS DOUBLE) AS x1, CAST(CASE WHEN 0.04 - c >= 0 THEN 0.08 ELSE 0.0 END AS DOUBLE) AS x2 FROM ({LINE_SQL})")
def p5_corner(spark, d):
    corner = LINE.corner([F.col("a") - 25, F.col("b") - 0.05, 0.04 - F.col("c")])
    return line(spark, d).select("l_orderkey", "l_linenumber", *[c.alias(f"x{k}") for k, c in enumerate(corner)])


@query(f"SELECT l_orderkey, l_linenumber, least(greatest(a, 10.0), 20.0) AS x0, least(greatest(b, 0.02), 0.06) AS x1, least(greatest(c, 0.01), 0.03) AS x2 FROM ({LINE_SQL})")
def p6_closest(spark, d):
    near = box([10, 0.02, 0.01], [20, 0.06, 0.03]).closest(abc())
    return line(spark, d).select("l_orderkey", "l_linenumber", *[c.alias(f"x{k}") for k, c in enumerate(near)])


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN a BETWEEN 10 AND 20 AND b BETWEEN 0.02 AND 0.06 THEN round(1 / (10 * (0.06 - 0.02)), 6) ELSE 0.0 END AS pdf FROM ({LINE_SQL})")
def p7_uniform_pdf(spark, d):
    pdf = Uniform(box([10, 0.02], [20, 0.06])).pdf([F.col("a"), F.col("b")])
    return line(spark, d).select("l_orderkey", "l_linenumber", F.round(pdf, 6).alias("pdf"))


@query(f"SELECT l_orderkey, l_linenumber, round(exp(-0.5 * ((na - 0.1) * (na - 0.1) / 0.25 + nb * nb)) / (2 * pi() * 0.5), 8) AS pdf FROM ({NORM_SQL})")
def p8_normal_pdf(spark, d):
    pdf = Normal((0.1, 0.0), ((0.25, 0.0), (0.0, 1.0))).pdf(LINE.normalize(abc())[:2])
    return line(spark, d).select("l_orderkey", "l_linenumber", F.round(pdf, 8).alias("pdf"))


@query(f"SELECT l_orderkey, l_linenumber, round(exp(-0.5 * (ln((a - 0.5) / 2) - 1) * (ln((a - 0.5) / 2) - 1) / 0.49) / (sqrt(2 * pi()) * 0.7) / (a - 0.5), 8) AS pdf FROM ({LINE_SQL})")
def p9_lognormal_pdf(spark, d):
    pdf = LogNormal(1.0, 0.49, offset=0.5, scaling=2.0).pdf([F.col("a")])
    return line(spark, d).select("l_orderkey", "l_linenumber", F.round(pdf, 8).alias("pdf"))


@query(f"SELECT l_orderkey, l_linenumber, round(0.8 * na + 0.6 * nb, 9) + 0.0 AS y1, round(-0.6 * na + 0.8 * nb, 9) + 0.0 AS y2 FROM ({NORM_SQL})")
def p10_active_coordinates(spark, d):
    x = LINE.normalize(abc())
    return line(spark, d).select("l_orderkey", "l_linenumber", r6(dot([0.8, 0.6, 0], x), 9).alias("y1"), r6(dot([-0.6, 0.8, 0], x), 9).alias("y2"))


@query("SELECT 'customer' AS scheme, c_custkey AS id, c_acctbal AS fx FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def p11_stacked(spark, d):
    a = tables.table(spark, d, "customer").select(F.lit("customer").alias("scheme"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("fx"))
    b = tables.table(spark, d, "supplier").select(F.lit("supplier").alias("scheme"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("fx"))
    return a.unionByName(b)


# Sources ------------------------------------------------------------------------------------------------------------


@query("SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings")
def io1_io2_matrix_round_trip(spark, d):
    """Vectors written as text lines with their id first, and read back."""
    path = f"{tables.shared_dir(spark)}/matrix-{np.random.default_rng().integers(1 << 60)}"
    tables.write_matrix(tables.table(spark, d, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("x")), path)
    x = tables.read_matrix(spark, path)
    total = F.aggregate(F.slice("x", 2, 64), F.lit(0.0), lambda a, v: a + v)
    return x.select(F.get("x", 0).cast("long").alias("id"), r6(total).alias("total"))


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def io3_io4_column_round_trip(spark, d):
    path = f"{tables.shared_dir(spark)}/columns-{np.random.default_rng().integers(1 << 60)}"
    tables.write_columns(tables.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), path)
    return tables.read_columns(spark, path)


@query("SELECT value FROM events")
def io5_column(spark, d):
    return tables.table(spark, d, "events").select("value")


@query("SELECT p_partkey AS id, p_size, round(sum(l_quantity), 4) AS fx FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL")
def io6_aligned(spark, d):
    x = tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("x"))
    fx = tables.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.round(F.sum("l_quantity"), 4).alias("fx"))
    return tables.aligned(x, fx, m=1).select("id", F.get("x", 0).cast("int").alias("p_size"), "fx")


@query("SELECT event_id, v AS value FROM (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL")
def io7_finite(spark, d):
    broken = F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).when(F.col("user_id") % 7 == 1, F.col("value")).otherwise(F.col("value"))
    return tables.finite(tables.table(spark, d, "events").select("event_id", broken.alias("value")), "value")


# Closed-form workloads ----------------------------------------------------------------------------------------------

_KEY = "(l_orderkey * 8 + l_linenumber)"


def _workload_rows(spark, d, work):
    """Line items with inputs x spread over the workload's box by their keys."""
    dom = work.domain
    x = [F.lit(low) + F.lit(high - low) * F.expr(unit(_KEY, k)).cast("double") for k, (low, high) in enumerate(zip(dom.lb, dom.ub, strict=True))]
    df = tables.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(f"x{k}") for k, c in enumerate(x)])
    return df, [F.col(f"x{k}") for k in range(dom.m)]


def _inputs_sql(work, names) -> str:
    dom = work.domain
    cols = ", ".join(f"{low!r}::DOUBLE + {high - low!r}::DOUBLE * (({unit(_KEY, k)})::DOUBLE) AS {n}" for k, (low, high, n) in enumerate(zip(dom.lb, dom.ub, names, strict=True)))
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem"


def _values(work, digits):
    def run(spark, d):
        df, x = _workload_rows(spark, d, work)
        return df.select("l_orderkey", "l_linenumber", *[r6(v, k).alias(n) for v, n, k in zip(work.values(x), work.outputs, digits, strict=True)])

    return run


def _register(name, work, names, formulas, digits):
    cols = ", ".join(f"round({f}, {k}) + 0.0 AS {n}" for f, n, k in zip(formulas, work.outputs, digits, strict=True))
    QUERIES[name] = _values(work, digits)
    ORACLES[name] = f"SELECT l_orderkey, l_linenumber, {cols} FROM ({_inputs_sql(work, names)})"


_register("d1_borehole", cf.BOREHOLE, ["rw", "r", "tu", "hu", "tl", "hl", "len", "kw"], ["2 * pi() * tu * (hu - hl) / (ln(r / rw) * (1 + 2 * len * tu / (ln(r / rw) * rw * rw * kw) + tu / tl))"], [6])
_register("d2_otl", cf.OTL, ["rb1", "rb2", "rf", "rc1", "rc2", "be"], ["(12 * rb2 / (rb1 + rb2) + 0.74) * be * (rc2 + 9) / (be * (rc2 + 9) + rf) + 11.35 * rf / (be * (rc2 + 9) + rf) + 0.74 * rf * be * (rc2 + 9) / ((be * (rc2 + 9) + rf) * rc1)"], [7])
_A, _V = "(p0 * s + 19.62 * m - k * v0 / s)", "(s / (2 * k) * (sqrt({a} * {a} + 4 * k * p0 * v0 / t0 * ta) - {a}))"
_V = _V.format(a=_A)
_register("d3_piston", cf.PISTON, ["m", "s", "v0", "k", "p0", "ta", "t0"], [f"2 * pi() * sqrt(m / (k + s * s * (p0 * v0 / t0) * (ta / ({_V} * {_V}))))"], [7])
_register(
    "d4_robot_arm",
    cf.ROBOT_ARM,
    ["a1", "a2", "a3", "a4", "r1", "r2", "r3", "r4"],
    ["sqrt(pow(r1 * cos(a1) + r2 * cos(a1 + a2) + r3 * cos(a1 + a2 + a3) + r4 * cos(a1 + a2 + a3 + a4), 2) + pow(r1 * sin(a1) + r2 * sin(a1 + a2) + r3 * sin(a1 + a2 + a3) + r4 * sin(a1 + a2 + a3 + a4), 2))"],
    [7],
)
_register(
    "d5_wing_weight",
    cf.WING_WEIGHT,
    ["sw", "wfw", "a", "la", "q", "lm", "tc", "nz", "wdg", "wp"],
    ["0.036 * pow(sw, 0.758) * pow(wfw, 0.0035) * pow(a / pow(cos(la * pi() / 180), 2), 0.6) * pow(q, 0.006) * pow(lm, 0.04) * pow(100 * tc / cos(la * pi() / 180), -0.3) * pow(nz * wdg, 0.49) + sw * wp"],
    [6],
)
_register(
    "d6_gearbox",
    cf.GEARBOX,
    ["x1", "x2", "x4", "x5", "x6", "x7"],
    [
        "0.7854 * x1 * x2 * x2 * (3.3333 * 17.0 * 17.0 + 14.9334 * 17 - 43.0934) - 1.5079 * x1 * (x6 * x6 + x7 * x7) + 7.477 * (pow(x6, 3) + pow(x7, 3)) + 0.7854 * (x4 * x6 * x6 + x5 * x7 * x7)",
        "27 / (x1 * x2 * x2 * 17) - 1",
        "397.5 / (x1 * x2 * x2 * 289) - 1",
        "1.93 * pow(x4, 3) / (x2 * 17 * pow(x6, 4)) - 1",
        "1.93 * pow(x5, 3) / (x2 * 17 * pow(x7, 4)) - 1",
        "sqrt(pow(745 * x4 / (x2 * 17), 2) + 16900000.0) / (110 * pow(x6, 3)) - 1",
        "sqrt(pow(745 * x5 / (x2 * 17), 2) + 157500000.0) / (85 * pow(x7, 3)) - 1",
        "x2 * 17 / 40 - 1",
        "5 * x2 / x1 - 1",
        "x1 / (12 * x2) - 1",
        "(1.5 * x6 + 1.9) / x4 - 1",
        "(1.1 * x7 + 1.9) / x5 - 1",
    ],
    [5] + [7] * 11,
)
_register(
    "d7_beam",
    cf.BEAM,
    ["b", "h"],
    ["b * h", "6 * 5000.0 * 1.5 / (b * h * h) / 1e6", "4 * 5000.0 * 3.375 / (216.62e9 * b * h * h * h)", "6 * 5000.0 * 1.5 / (b * h * h) / 1e6", "1.5 * 5000 / (b * h) / 1e6", "h / b", "4 / 2.25 * sqrt(86.65e9 * (b * b * b * h + b * h * h * h) / 12 * 216.62e9 * (b * b * b * h / 12) / 0.73) / 1e6"],
    [9, 5, 8, 5, 6, 7, 6],
)


def _beam_scaled(spark, d):
    """Stresses in MPa, so that rounding keeps the same digits in both engines."""
    df, x = _workload_rows(spark, d, cf.BEAM)
    scale = [1.0, 1e6, 1.0, 1e6, 1e6, 1.0, 1e6]
    return df.select("l_orderkey", "l_linenumber", *[r6(v / F.lit(s), k).alias(n) for v, s, n, k in zip(cf.BEAM.values(x), scale, cf.BEAM.outputs, [9, 5, 8, 5, 6, 7, 6], strict=True)])


QUERIES["d7_beam"] = _beam_scaled
_register(
    "d8_hartmann",
    cf.HARTMANN,
    ["mu", "dp", "eta", "b0"],
    ["-dp * eta / (b0 * b0) * (1 - b0 / sqrt(eta * mu) / tanh(b0 / sqrt(eta * mu)))", "dp / (2 * b0) * (1 - 2 * sqrt(eta * mu) / b0 * tanh(b0 / (2 * sqrt(eta * mu))))"],
    [7, 7],
)
_AFFINE = cf.affine([0.5, -0.25, 1.5, 0.75, -1.0])
_register("d9_affine", _AFFINE, ["x0", "x1", "x2", "x3", "x4"], ["0.5 * x0 - 0.25 * x1 + 1.5 * x2 + 0.75 * x3 - x4"], [8])
_QUADRATIC = cf.quadratic([[2.0, 0.5], [0.5, 1.0]])
_register("d9_quadratic", _QUADRATIC, ["x0", "x1"], ["0.5 * (2 * x0 * x0 + x0 * x1 + x1 * x1)"], [8])
_register("d10_sine_of_squares", cf.SINE_OF_SQUARES, [f"y{k}" for k in range(20)], ["sin(" + " + ".join(f"y{k} * y{k}" for k in range(20)) + ")"], [7])
_register("d10_product_peak", cf.PRODUCT_PEAK, [f"y{k}" for k in range(20)], ["(" + " * ".join(f"(4 / (4 + (y{k} - 0.5) * (y{k} - 0.5)))" for k in range(20)) + ") / 1099511627776.0"], [20])


@query(f"SELECT l_orderkey, l_linenumber, round(x0 * 2 + 0.5 * x1, 8) + 0.0 AS g0, round(0.5 * x0 + x1, 8) + 0.0 AS g1 FROM ({_inputs_sql(_QUADRATIC, ['x0', 'x1'])})")
def e2_gradients(spark, d):
    df, x = _workload_rows(spark, d, _QUADRATIC)
    g = _QUADRATIC.gradients(x)[0]
    return df.select("l_orderkey", "l_linenumber", *[r6(v, 8).alias(f"g{k}") for k, v in enumerate(g)])


@query()
def e3_forward_differences(spark, d):
    """Largest difference between forward differences (h = 1e-7, normalised) and exact gradients, for each input."""
    df, x = _workload_rows(spark, d, cf.OTL)
    exact = cf.OTL.gradients(x, normalized=True)[0]
    found = audits.forward_differences(lambda y: cf.OTL.values(y)[0], x, scale=cf.OTL.domain.center_scale()[1])
    return df.agg(*[F.max(F.abs(a - b)).alias(f"e{k}") for k, (a, b) in enumerate(zip(found, exact, strict=True))])


@query()
def e6_derivative_audit(spark, d):
    """Best central difference over many step sizes against the exact gradient, worst row by input."""
    df, x = _workload_rows(spark, d, cf.PISTON)
    return audits.derivative_audit(df, lambda y: cf.PISTON.values(y)[0], cf.PISTON.gradients(x, normalized=True)[0], x, cf.PISTON.domain.center_scale()[1])

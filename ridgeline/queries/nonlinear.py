"""Poisson, logit and probit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ridgeline.operators.glm import feglm, fepois
from ridgeline.queries.registry import frame, query, table

TIGHT = 1e-12


def lines(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.withColumns({"returned": (F.col("l_returnflag") == "R").cast("double"), "open": (F.col("l_linestatus") == "O").cast("double")})


@query("""
WITH g AS (SELECT l_returnflag, avg(l_linenumber) AS m, count(*) AS n FROM lineitem GROUP BY 1),
l AS (SELECT sum(l_linenumber * ln(m) - m - lgamma(l_linenumber + 1)) AS ll FROM lineitem JOIN g USING (l_returnflag))
SELECT l_returnflag, round(m, 5) AS mean, n AS n_obs, round(ll, 2) AS loglik FROM g, l""")
def poisson_means(spark, sf_dir):
    """A fixed effect alone: its levels' means."""
    fit = fepois("l_linenumber ~ 1 | l_returnflag", lines(spark, sf_dir), iwls_tol=TIGHT)
    return fit.fixef("l_returnflag").select("l_returnflag", F.round(F.exp("fe_l_returnflag"), 5).alias("mean"), "n_obs", F.lit(round(fit.stats["loglik"], 2)).alias("loglik"))


RATIO = """
WITH g AS (SELECT sum({y}) FILTER ({x}) AS s1, sum({y}) FILTER (NOT {x}) AS s0, count(*) FILTER ({x})::DOUBLE AS n1, count(*) FILTER (NOT {x})::DOUBLE AS n0 FROM lineitem),
b AS (SELECT *, {value} AS b, {variance} AS v, n1 + n0 AS n FROM g)
SELECT '{term}' AS term, round(b, 6) AS estimate, round(sqrt(v * (n - 1) / (n - 2)), 6) AS se_iid FROM b"""


def second(spark, fit):
    """The slope of a model with an intercept."""
    return frame(spark, {"term": fit.names[1:], "estimate": fit.beta[1:], "se_iid": np.sqrt(np.diag(fit.with_vcov("iid").vcov))[1:]}, 6)


@query(RATIO.format(y="l_linenumber", x="l_returnflag = 'R'", value="ln((s1 / n1) / (s0 / n0))", variance="1 / s1 + 1 / s0", term="returned"))
def poisson_ratio(spark, sf_dir):
    """Poisson with one binary covariate: the log of the ratio of means."""
    return second(spark, fepois("l_linenumber ~ returned", lines(spark, sf_dir), iwls_tol=TIGHT))


@query("SELECT 'Intercept' AS term, round(ln(sum(l_linenumber) / sum(l_quantity)), 6) AS estimate, round(1 / sqrt(sum(l_linenumber)), 6) AS se_iid FROM lineitem")
def poisson_offset(spark, sf_dir):
    """Poisson rates: an offset and an intercept."""
    fit = fepois("l_linenumber ~ 1", lines(spark, sf_dir), offset="log(l_quantity)", iwls_tol=TIGHT)
    return frame(spark, {"term": fit.names, "estimate": fit.beta, "se_iid": np.sqrt(np.diag(fit.vcov))}, 6)


@query("""
WITH a AS (SELECT l_returnflag = 'R' AS x, sum(l_quantity * l_linenumber) / sum(l_quantity) AS m, sum(l_quantity * l_linenumber) AS s FROM lineitem GROUP BY 1), w AS (SELECT avg(l_quantity) AS w, count(*)::DOUBLE AS n FROM lineitem)
SELECT 'returned' AS term, round(ln(max(m) FILTER (x) / max(m) FILTER (NOT x)), 6) AS estimate, round(sqrt(sum(w / s) * any_value((n - 1) / (n - 2))), 6) AS se_iid FROM a, w""")
def poisson_weighted(spark, sf_dir):
    """Poisson with analytic weights, which count relative to their mean."""
    return second(spark, fepois("l_linenumber ~ returned", lines(spark, sf_dir), weights="l_quantity", iwls_tol=TIGHT))


@query(RATIO.format(y="(l_linestatus = 'O')::INT", x="l_returnflag = 'R'", value="ln(s1 / (n1 - s1)) - ln(s0 / (n0 - s0))", variance="1 / s1 + 1 / (n1 - s1) + 1 / s0 + 1 / (n0 - s0)", term="returned"))
def logit_odds(spark, sf_dir):
    """Logit with one binary covariate: the log odds ratio."""
    return second(spark, feglm("open ~ returned", lines(spark, sf_dir), "logit", iwls_tol=TIGHT))


@query("SELECT (l_returnflag = 'R')::INT::DOUBLE AS returned, count(*) AS n_obs, round(avg((l_linestatus = 'O')::INT), 6) AS mean FROM lineitem GROUP BY 1")
def probit_cells(spark, sf_dir):
    """Probit with one binary covariate: its predicted means."""
    p = feglm("open ~ returned", lines(spark, sf_dir), "probit", iwls_tol=TIGHT).predict(type="response")
    return p.groupBy("returned").agg(F.count("*").alias("n_obs"), F.round(F.avg("prediction"), 6).alias("mean"))


CELLS = "c AS MATERIALIZED (SELECT l_suppkey AS g, l_quantity::DOUBLE AS x, count(*)::DOUBLE AS n, sum({y})::DOUBLE AS s FROM lineitem GROUP BY 1, 2)"


def poisson_steps(steps: int) -> str:
    """Newton's steps for a slope, the levels' effects concentrated out."""
    out = [CELLS.format(y="l_linenumber"), "b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS h)"]
    for i in range(steps):
        out.append(f"k{i} AS (SELECT g, sum(s) AS y, sum(x * s) AS xy, sum(n * exp(b * x)) AS s0, sum(n * x * exp(b * x)) AS s1, sum(n * x * x * exp(b * x)) AS s2, any_value(b) AS b FROM c, b{i} GROUP BY g)")
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT any_value(b) + sum(xy - y * s1 / s0) / sum(y * (s2 / s0 - (s1 / s0) ** 2)) AS b, sum(y * (s2 / s0 - (s1 / s0) ** 2)) AS h FROM k{i})")
    return ", ".join(out)


def logit_steps(steps: int) -> str:
    """Newton's steps for a slope and the levels' effects; s<last> has the levels' sums under the last estimates."""
    out = [CELLS.format(y="(l_linestatus = 'O')::INT"), "p0 AS MATERIALIZED (SELECT g, ln(sum(s) / (sum(n) - sum(s))) AS a, 0.0::DOUBLE AS b FROM c GROUP BY g)"]
    for i in range(steps):
        out.append(f"q{i} AS (SELECT c.*, a, b, 1 / (1 + exp(-a - b * x)) AS m FROM c JOIN p{i} USING (g))")
        out.append(f"s{i} AS MATERIALIZED (SELECT g, any_value(a) AS a, any_value(b) AS b, sum(n * m * (1 - m)) AS w0, sum(n * m * (1 - m) * x) AS w1, sum(n * m * (1 - m) * x * x) AS w2, sum(s - n * m) AS r0, sum(x * (s - n * m)) AS r1 FROM q{i} GROUP BY g)")
        out.append(f"d{i} AS MATERIALIZED (SELECT sum(r1 - w1 * r0 / w0) / sum(w2 - w1 * w1 / w0) AS d FROM s{i})")
        out.append(f"p{i + 1} AS MATERIALIZED (SELECT g, a + (r0 - w1 * d) / w0 AS a, b + d AS b FROM s{i}, d{i})")
    return ", ".join(out)


def slope(spark, fit):
    """Estimate and iid error of the slope, in thousandths."""
    return frame(spark, {"term": fit.names, "estimate": 1e3 * fit.beta, "se_iid": 1e3 * np.sqrt(np.diag(fit.with_vcov("iid").vcov))}, 6)


@query(f"""
WITH {poisson_steps(9)}, m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT l_suppkey) AS g FROM lineitem)
SELECT 'l_quantity' AS term, round(1e3 * b, 6) AS estimate, round(1e3 * sqrt((n - 1) / (n - 1 - g) / h), 6) AS se_iid FROM b9, m""")
def poisson_fe(spark, sf_dir):
    """Poisson with a fixed effect."""
    return slope(spark, fepois("l_linenumber ~ l_quantity | l_suppkey", lines(spark, sf_dir), iwls_tol=TIGHT))


@query(f"""
WITH {logit_steps(9)}, m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT l_suppkey) AS g FROM lineitem), h AS (SELECT any_value(b) AS b, sum(w2 - w1 * w1 / w0) AS h FROM s8)
SELECT 'l_quantity' AS term, round(1e3 * b, 6) AS estimate, round(1e3 * sqrt((n - 1) / (n - 1 - g) / h), 6) AS se_iid FROM h, m""")
def logit_fe(spark, sf_dir):
    """Logit with a fixed effect."""
    return slope(spark, feglm("open ~ l_quantity | l_suppkey", lines(spark, sf_dir), "logit", iwls_tol=TIGHT))


@query("""
WITH a AS (SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) AS s FROM lineitem GROUP BY 1)
SELECT CASE WHEN n = 1 THEN 'singleton' WHEN s = 0 THEN 'separation' ELSE 'used' END AS reason, sum(n)::BIGINT AS n_rows FROM a GROUP BY 1""")
def separation(spark, sf_dir):
    """Levels without a positive outcome leave a Poisson model."""
    fit = fepois("returned ~ l_quantity | l_orderkey", lines(spark, sf_dir), iwls_tol=1e-4)
    return fit.sample().groupBy(F.coalesce("dropped_because", F.lit("used")).alias("reason")).agg(F.count("*").alias("n_rows"))


@query(f"""
WITH {logit_steps(9)},
f AS (SELECT c.*, m, w1 / w0 AS mx FROM (SELECT c.*, 1 / (1 + exp(-a - b * x)) AS m FROM c JOIN s8 USING (g)) AS c JOIN s8 USING (g)),
t AS (SELECT g, sum(n * (x - mx) * m * (1 - m) * (1 - 2 * m)) / sum(n * m * (1 - m)) AS t FROM f GROUP BY g),
h AS (SELECT any_value(b) AS b, sum(w2 - w1 * w1 / w0) AS h FROM s8), o AS (SELECT -0.5 * sum(t) / any_value(h) AS bias FROM t, h)
SELECT 'l_quantity' AS term, round(1e3 * (b - bias), 6) AS estimate, round(1e3 * bias, 6) AS bias FROM h, o""")
def bias_correction(spark, sf_dir):
    """Incidental-parameter correction of a logit; in thousandths."""
    from ridgeline.operators.glm import bias_corrected

    out = bias_corrected(feglm("open ~ l_quantity | l_suppkey", lines(spark, sf_dir), "logit", iwls_tol=TIGHT))
    return frame(spark, [{"term": t, "estimate": 1e3 * out["estimate"][t], "bias": 1e3 * out["bias"][t]} for t in out["estimate"]], 6)

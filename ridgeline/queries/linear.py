"""Least squares, instruments, variances and what fits return."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ridgeline.operators.linear import feols
from ridgeline.operators.multcomp import bonferroni, holm
from ridgeline.queries.registry import frame, query, regression_sql, table, within_sql

PLAIN = "SELECT l_extendedprice::DOUBLE AS y, 1.0::DOUBLE AS x1, {x}::DOUBLE AS x2, {w}::DOUBLE AS w, {c} AS c, {c2} AS c2 FROM lineitem"
CLUSTER = "g / (g - 1) * (n - 1) / (n - {k})"


def errors(fit, kinds: dict) -> dict:
    """Estimates and standard errors under the given variances, by column."""
    return {"term": fit.names, "estimate": fit.beta} | {c: np.sqrt(np.diag(fit.with_vcov(kind).vcov)) for c, kind in kinds.items()}


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query(regression_sql(within_sql("l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey", "lineitem"), ["l_quantity", "l_discount"], {"se_cluster": ("cluster", CLUSTER.format(k=3)), "se_iid": ("iid", "rss / (n - 2 - g)"), "se_hetero": ("hetero", "n / (n - 2 - g)")}))
def fe_ols(spark, sf_dir):
    """One fixed effect, clusters that hold it."""
    fit = feols("l_extendedprice ~ l_quantity + l_discount | l_suppkey", lines(spark, sf_dir), vcov={"CRV1": "l_suppkey"})
    return frame(spark, errors(fit, {"se_cluster": {"CRV1": "l_suppkey"}, "se_iid": "iid", "se_hetero": "hetero"}))


@query(regression_sql(PLAIN.format(x="l_quantity", w="1.0", c="l_suppkey", c2="l_partkey"), ["Intercept", "l_quantity"], {"se_iid": ("iid", "rss / (n - 2)"), "se_hetero": ("hetero", "n / (n - 2)"), "se_cluster": ("cluster", CLUSTER.format(k=2)), "se_two_way": ("two_way", "least(g, g2) / (least(g, g2) - 1) * (n - 1) / (n - 2)")}))
def ols(spark, sf_dir):
    """No fixed effect: iid, robust, one-way and two-way clustered errors."""
    fit = feols("l_extendedprice ~ l_quantity", lines(spark, sf_dir), vcov={"CRV1": "l_suppkey + l_partkey"})
    return frame(spark, errors(fit, {"se_iid": "iid", "se_hetero": "hetero", "se_cluster": {"CRV1": "l_suppkey"}, "se_two_way": {"CRV1": "l_suppkey + l_partkey"}}))


@query(regression_sql(PLAIN.format(x="l_discount", w="l_quantity", c="0", c2="0"), ["Intercept", "l_discount"], {"se_iid": ("iid", "rss / (n - 2)"), "se_hetero": ("hetero", "n / (n - 2)")}))
def ols_analytic_weights(spark, sf_dir):
    fit = feols("l_extendedprice ~ l_discount", lines(spark, sf_dir), weights="l_quantity")
    return frame(spark, errors(fit, {"se_iid": "iid", "se_hetero": "hetero"}))


@query(regression_sql(PLAIN.format(x="l_discount", w="l_quantity", c="0", c2="0"), ["Intercept", "l_discount"], {"se_iid": ("iid", "rss / (sw - 2)"), "se_hetero": ("freq", "sw / (sw - 2)")}))
def ols_frequency_weights(spark, sf_dir):
    fit = feols("l_extendedprice ~ l_discount", lines(spark, sf_dir), weights="l_quantity", weights_type="fweights")
    return frame(spark, errors(fit, {"se_iid": "iid", "se_hetero": "hetero"}))


TWO_WAY = """
SELECT y - gy * f AS y, x - gx * f AS x1, 0.0::DOUBLE AS x2, 1.0::DOUBLE AS w, c, 0 AS c2
FROM (SELECT *, sum(f * y) OVER () / sum(f * f) OVER () AS gy, sum(f * x) OVER () / sum(f * f) OVER () AS gx
      FROM (SELECT y - avg(y) OVER p AS y, x - avg(x) OVER p AS x, f - avg(f) OVER p AS f, c
            FROM (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x, (l_linestatus = 'F')::INT::DOUBLE AS f, l_suppkey AS c FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey) > 1)
            WINDOW p AS (PARTITION BY c)))"""


@query(regression_sql(TWO_WAY, ["l_quantity"], {"se_iid": ("iid", "rss / (n - 1 - (g + 1))"), "se_hetero": ("hetero", "n / (n - 1 - (g + 1))"), "se_cluster": ("cluster", CLUSTER.format(k=3))}))
def fe_two_way(spark, sf_dir):
    """Two fixed effects, exact degrees of freedom."""
    fit = feols("l_extendedprice ~ l_quantity | l_suppkey + l_linestatus", lines(spark, sf_dir), vcov={"CRV1": "l_suppkey"})
    return frame(spark, errors(fit, {"se_iid": "iid", "se_hetero": "hetero", "se_cluster": {"CRV1": "l_suppkey"}}))


def alternating_sql(dims: list[str], rounds: int) -> str:
    """Means of each dimension taken out of y and x in turn: what is left after enough rounds is free of all of them."""
    steps = [f"r0 AS MATERIALIZED (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x, {', '.join(dims)} FROM lineitem)"]
    for i in range(rounds):
        for j, d in enumerate(dims):
            old, new = f"r{i}" if j == 0 else f"r{i}_{j}", f"r{i + 1}" if j == len(dims) - 1 else f"r{i}_{j + 1}"
            steps.append(f"{new} AS MATERIALIZED (SELECT y - avg(y) OVER p AS y, x - avg(x) OVER p AS x, {', '.join(dims)} FROM {old} WINDOW p AS (PARTITION BY {d}))")
    return ", ".join(steps)


@query(f"""
WITH {alternating_sql(["l_partkey", "l_suppkey", "l_returnflag"], 30)},
k AS (SELECT count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) + count(DISTINCT l_returnflag) - 2 AS k FROM lineitem),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS a, count(*)::DOUBLE AS n FROM r30),
e AS (SELECT sum((y - b * x) ** 2) AS rss, sum((x * (y - b * x)) ** 2) AS meat FROM r30, b)
SELECT 'l_quantity' AS term, round(b, 4) AS estimate, round(sqrt(rss / (n - 1 - k) / a), 4) AS se_iid, round(sqrt(n / (n - 1 - k) * meat) / a, 4) AS se_hetero FROM b, e, k""")
def fe_three_way(spark, sf_dir):
    """Three fixed effects, of which two are solved for."""
    fit = feols("l_extendedprice ~ l_quantity | l_partkey + l_suppkey + l_returnflag", lines(spark, sf_dir), fixef_rm="none")
    return frame(spark, errors(fit, {"se_iid": "iid", "se_hetero": "hetero"}))


SLOPES = """
SELECT y - ty * t AS y, x - tx * t AS x1, 0.0::DOUBLE AS x2, 1.0::DOUBLE AS w, c, 0 AS c2
FROM (SELECT *, sum(t * y) OVER p / sum(t * t) OVER p AS ty, sum(t * x) OVER p / sum(t * t) OVER p AS tx
      FROM (SELECT y - avg(y) OVER p AS y, x - avg(x) OVER p AS x, t - avg(t) OVER p AS t, c
            FROM (SELECT l_extendedprice::DOUBLE AS y, l_discount::DOUBLE AS x, l_quantity::DOUBLE AS t, l_suppkey AS c FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey) > 1)
            WINDOW p AS (PARTITION BY c)) WINDOW p AS (PARTITION BY c))"""


@query(regression_sql(SLOPES, ["l_discount"], {"se_iid": ("iid", "rss / (n - 1 - 2 * g)"), "se_hetero": ("hetero", "n / (n - 1 - 2 * g)")}))
def fe_slopes(spark, sf_dir):
    """A slope for each level of the fixed effect."""
    fit = feols("l_extendedprice ~ l_discount | l_suppkey[l_quantity]", lines(spark, sf_dir))
    return frame(spark, errors(fit, {"se_iid": "iid", "se_hetero": "hetero"}))


W = within_sql("l_extendedprice", ["l_quantity"], "l_suppkey", "lineitem")


@query(f"""
WITH r AS ({W}), b AS (SELECT sum(x1 * y) / sum(x1 * x1) AS b, sum(x1 * x1) AS a, count(*)::DOUBLE AS n, count(DISTINCT c)::DOUBLE AS g FROM r),
s AS (SELECT c, sum(x1 * (y - b * x1)) AS s, sum(x1 * x1) AS own FROM r, b GROUP BY c)
SELECT 'l_quantity' AS term, round(any_value(b), 4) AS estimate, round(sqrt(any_value(g / (g - 1) * (n - 1) / (n - 2)) * sum((s / (a - own)) ** 2)), 4) AS se_jackknife FROM s, b""")
def jackknife(spark, sf_dir):
    """Cluster jackknife (CRV3)."""
    fit = feols("l_extendedprice ~ l_quantity | l_suppkey", lines(spark, sf_dir), vcov={"CRV1": "l_suppkey"})
    return frame(spark, errors(fit, {"se_jackknife": {"CRV3": "l_suppkey"}}))


@query(f"""
WITH r AS ({W}), b AS (SELECT sum(x1 * y) / sum(x1 * x1) AS b, sum(y * y) AS tss, count(*)::DOUBLE AS n, count(DISTINCT c)::DOUBLE AS g FROM r),
e AS (SELECT sum((y - b * x1) ** 2) AS rss FROM r, b),
t AS (SELECT var_pop(l_extendedprice) * count(*) AS ssy FROM (SELECT l_extendedprice FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey) > 1)),
l AS (SELECT *, -n / 2 * (ln(2 * pi()) + ln(rss / n) + 1) AS ll FROM b, e, t)
SELECT n::BIGINT AS n_obs, round(1 - rss / ssy, 6) AS r2, round(1 - (rss / ssy) * (n - 1) / (n - 1 - g), 6) AS adj_r2, round(1 - rss / tss, 6) AS r2_within, round(sqrt(rss / n), 4) AS rmse,
       round(ll, 2) AS loglik, round(-2 * ll + 2 * (1 + g), 2) AS aic, round(-2 * ll + ln(n) * (1 + g), 2) AS bic FROM l""")
def fit_statistics(spark, sf_dir):
    fit = feols("l_extendedprice ~ l_quantity | l_suppkey", lines(spark, sf_dir))
    digits = {"r2": 6, "adj_r2": 6, "r2_within": 6, "rmse": 4, "loglik": 2, "aic": 2, "bic": 2}
    return frame(spark, pd.DataFrame([{"n_obs": int(fit.n_obs)} | {k: round(fit.stats[k], d) for k, d in digits.items()}]), 6)


#: Added before rounding, so that means of a few prices, which are often halfway between two results, round alike everywhere.
OFF = 0.0000137
ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS y, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS x FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1"
ORDER_FIT = f"o AS ({ORDERS}), d AS (SELECT *, avg(y) OVER p AS my, avg(x) OVER p AS mx FROM o WINDOW p AS (PARTITION BY o_custkey)), b AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM d)"


def orders_fit(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumns({"urgent": (F.col("o_orderpriority") == "1-URGENT").cast("double"), "row_id": F.col("o_orderkey")})
    return feols("o_totalprice ~ urgent | o_custkey", df)


@query(f"WITH {ORDER_FIT} SELECT o_orderkey AS row_id, o_custkey, round(y - my - b * (x - mx) + {OFF}, 4) AS resid, round(my + b * (x - mx) + {OFF}, 4) AS fitted FROM d, b")
def residuals(spark, sf_dir):
    """Residuals and fitted values of every row of the sample."""
    r = orders_fit(spark, sf_dir).resid()
    return r.select("row_id", "o_custkey", F.round(F.col("resid") + OFF, 4).alias("resid"), F.round(F.col("o_totalprice") - F.col("resid") + OFF, 4).alias("fitted"))


@query(f"WITH {ORDER_FIT} SELECT o_custkey, round(avg(y) - any_value(b) * avg(x) + {OFF}, 4) AS effect, count(*) AS n_obs FROM d, b GROUP BY o_custkey")
def level_effects(spark, sf_dir):
    """Estimated effects of the fixed effect's levels."""
    t = orders_fit(spark, sf_dir).fixef("o_custkey")
    return t.select("o_custkey", F.round(F.col("fe_o_custkey") + OFF, 4).alias("effect"), "n_obs")


@query(f"WITH {ORDER_FIT}, a AS (SELECT o_custkey, avg(y) - any_value(b) * avg(x) AS a FROM d, b GROUP BY o_custkey) SELECT c_custkey, round(a + b + {OFF}, 4) AS prediction FROM customer LEFT JOIN a ON o_custkey = c_custkey, b")
def predictions(spark, sf_dir):
    """An urgent order of every customer; null for those without an estimated effect."""
    new = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"), F.lit(1.0).alias("urgent"))
    return orders_fit(spark, sf_dir).predict(new).select("c_custkey", F.round(F.col("prediction") + OFF, 4).alias("prediction"))


@query("""
WITH o AS (SELECT *, CASE WHEN l_discount > 0 THEN l_quantity END AS x FROM lineitem),
m AS (SELECT *, x IS NULL AS missing FROM o),
s AS (SELECT l_orderkey FROM m WHERE NOT missing GROUP BY l_orderkey HAVING count(*) = 1),
t AS (SELECT CASE WHEN missing THEN 'missing' WHEN l_orderkey IN (FROM s) THEN 'singleton' ELSE 'used' END AS reason FROM m)
SELECT reason, count(*) AS n_rows FROM t GROUP BY reason""")
def sample_reasons(spark, sf_dir):
    """What became of every source row."""
    df = lines(spark, sf_dir).withColumn("x", F.when(F.col("l_discount") > 0, F.col("l_quantity")))
    s = feols("l_extendedprice ~ x | l_orderkey", df).sample()
    return s.groupBy(F.coalesce("dropped_because", F.lit("used")).alias("reason")).agg(F.count("*").alias("n_rows"))


def _one(y: str, x: str, model: int) -> str:
    return f"SELECT {model} AS model, '{y}' AS outcome, '{x}' AS term, round(sum(x1 * y) / sum(x1 * x1), 6) AS estimate FROM ({within_sql(y, [x], 'l_suppkey', 'lineitem')})"


@query(" UNION ALL ".join(_one(y, x, i) for i, (x, y) in enumerate([("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_discount", "l_extendedprice"), ("l_discount", "l_tax")])))
def many_models(spark, sf_dir):
    """Several outcomes and alternative covariates from one formula."""
    fits = feols("l_extendedprice + l_tax ~ sw(l_quantity, l_discount) | l_suppkey", lines(spark, sf_dir))
    return frame(spark, [{"model": i, "outcome": f.outcome, "term": f.names[0], "estimate": float(f.beta[0])} for i, f in enumerate(fits)], 6).selectExpr("int(model) AS model", "outcome", "term", "estimate")


@query("""
WITH a AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), z AS (SELECT m AS base FROM a ORDER BY f LIMIT 1)
SELECT CASE WHEN row_number() OVER (ORDER BY f) = 1 THEN 'Intercept' ELSE 'l_returnflag::' || f END AS term, round(CASE WHEN row_number() OVER (ORDER BY f) = 1 THEN m ELSE m - base END, 4) AS estimate FROM a, z""")
def indicators(spark, sf_dir):
    """A category as indicators."""
    fit = feols("l_extendedprice ~ i(l_returnflag)", lines(spark, sf_dir))
    return frame(spark, {"term": fit.names, "estimate": fit.beta})


@query("""
SELECT count(*) AS n_rows, round(sum(log(1 + l_quantity) ), 3) AS a FROM lineitem""".replace("log(1 + l_quantity)", "ln(1 + l_quantity) + floor(l_extendedprice / l_quantity) + (l_extendedprice - 7 * floor(l_extendedprice / 7)) + (l_discount >= 0.05)::INT + sqrt(l_tax) - abs(l_tax - 0.04) ** 2"))
def expressions(spark, sf_dir):
    """The formula language's scalar functions."""
    from ridgeline.functions.formula import expression

    e = expression("log1p(l_quantity) + l_extendedprice // l_quantity + l_extendedprice % 7 + (l_discount >= 0.05) + sqrt(l_tax) - abs(l_tax - 0.04) ** 2")
    return lines(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.round(F.sum(e), 3).alias("a"))


IV = within_sql("l_tax", ["l_extendedprice", "l_quantity"], "l_suppkey", "lineitem")


@query(f"""
WITH r AS ({IV}),
m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT c)::DOUBLE AS g, sum(x1 * x2) AS zx, sum(x2 * x2) AS zz, sum(x2 * y) AS zy FROM r),
b AS (SELECT *, zy / zx AS b, zx / zz AS p FROM m),
e AS (SELECT sum((y - b * x1) ** 2) AS rss, sum((y - b * x1) ** 2 * (p * x2) ** 2) AS meat, sum((x1 - p * x2) ** 2) AS rss1 FROM r, b)
SELECT 'l_extendedprice' AS term, round(1e6 * b, 4) AS estimate, round(1e6 * sqrt(rss / (n - 1 - g) / (p * p * zz)), 4) AS se_iid, round(1e6 * sqrt(n / (n - 1 - g) * meat) / (p * p * zz), 4) AS se_hetero,
       round(p * p * zz / (rss1 / (n - 1 - g)), 2) AS first_stage_f FROM b, e""")
def iv_exact(spark, sf_dir):
    """Two-stage least squares, exactly identified; estimates in millionths."""
    fit = feols("l_tax ~ 1 | l_suppkey | l_extendedprice ~ l_quantity", lines(spark, sf_dir))
    se = {c: 1e6 * np.sqrt(np.diag(fit.with_vcov(k).vcov)) for c, k in (("se_iid", "iid"), ("se_hetero", "hetero"))}
    return frame(spark, {"term": fit.names, "estimate": 1e6 * fit.beta} | se | {"first_stage_f": [round(fit.stats["first_stages"]["l_extendedprice"]["f"], 2)]})


@query(f"""
WITH r AS ({IV}),
m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT c)::DOUBLE AS g, sum(x1 * x2) AS zx, sum(x2 * x2) AS zz, sum(x2 * y) AS zy, sum(x1 * x1) AS xx, sum(x1 * y) AS xy, sum(y * y) AS yy FROM r),
p AS (SELECT *, zx / zz AS p, xx - zx * zx / zz AS vv, n - 1 - g AS df, zy / zx AS b1 FROM m),
s AS (SELECT sum((x1 - p * x2) ** 2 * x2 * x2) AS s, sum((y - zy / zz * x2) ** 2 * x2 * x2) AS sy FROM r, p),
h AS (SELECT *, yy - b1 * xy - ((xy - p * zy) / vv - b1) * (xy - p * zy) AS rss_u, yy - xy * xy / xx AS rss_r FROM p)
SELECT round(p * p * zz / (vv / df), 2) AS cragg_donald, round(p * p * zz * zz / s * df / n, 2) AS kleibergen_paap, round(p * p * zz * zz / s * df / n, 2) AS effective, round(zx * zx / (zz * xx), 8) AS partial_r2,
       round(zy * zy / sy * df / n, 5) AS anderson_rubin, round((rss_r - rss_u) / (rss_u / (df - 1)), 5) AS endogeneity FROM h, s""")
def iv_weak(spark, sf_dir):
    """Weak instruments, weak-instrument-robust and endogeneity tests of an exactly identified model, robust to heteroskedasticity."""
    t = feols("l_tax ~ 1 | l_suppkey | l_extendedprice ~ l_quantity", lines(spark, sf_dir), vcov="hetero").stats["iv"]
    return frame(spark, [{"cragg_donald": round(t["cragg_donald_f"], 2), "kleibergen_paap": round(t["kleibergen_paap"]["wald_f"], 2), "effective": round(t["effective_f"]["statistic"], 2), "partial_r2": t["partial_r2"]["l_extendedprice"], "anderson_rubin": round(t["anderson_rubin"]["statistic"], 5), "endogeneity": round(t["endogeneity"]["statistic"], 5)}], 8)


@query(regression_sql(within_sql("l_extendedprice", ["l_quantity"], "l_suppkey::VARCHAR || '_' || l_linestatus", "lineitem"), ["l_quantity"], {"se_iid": ("iid", "rss / (n - 1 - g)"), "se_hetero": ("hetero", "n / (n - 1 - g)")}))
def fe_interacted(spark, sf_dir):
    """A fixed effect of two columns together."""
    fit = feols("l_extendedprice ~ l_quantity | l_suppkey^l_linestatus", lines(spark, sf_dir))
    return frame(spark, errors(fit, {"se_iid": "iid", "se_hetero": "hetero"}))


@query("""
WITH a AS (SELECT l_quantity AS q, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), z AS (SELECT m AS base, q AS b FROM a ORDER BY q LIMIT 1)
SELECT CASE WHEN q = b THEN 'Intercept' ELSE 'l_quantity::' || q::INT END AS term, round(CASE WHEN q = b THEN m ELSE m - base END, 3) AS estimate FROM a, z""")
def wide_design(spark, sf_dir):
    """Fifty indicators: cross-products in blocks of rows."""
    fit = feols("l_extendedprice ~ i(l_quantity)", lines(spark, sf_dir))
    return frame(spark, {"term": fit.names, "estimate": fit.beta}, 3)


@query("""
WITH r AS (SELECT y - avg(y) OVER p AS y, x - avg(x) OVER p AS x, z1 - avg(z1) OVER p AS z1, z2 - avg(z2) OVER p AS z2
           FROM (SELECT l_tax::DOUBLE AS y, l_extendedprice::DOUBLE AS x, l_quantity::DOUBLE AS z1, l_discount::DOUBLE AS z2, l_suppkey AS c FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey) > 1) WINDOW p AS (PARTITION BY c)),
m AS (SELECT count(*)::DOUBLE AS n, sum(z1 * z1) AS a, sum(z1 * z2) AS c, sum(z2 * z2) AS d, sum(z1 * x) AS x1, sum(z2 * x) AS x2, sum(z1 * y) AS y1, sum(z2 * y) AS y2 FROM r),
p AS (SELECT *, (d * x1 - c * x2) / (a * d - c * c) AS p1, (a * x2 - c * x1) / (a * d - c * c) AS p2 FROM m),
b AS (SELECT *, (p1 * y1 + p2 * y2) / (p1 * x1 + p2 * x2) AS b FROM p),
e AS (SELECT sum((y - b * x) ** 2) AS rss, sum(z1 * (y - b * x)) AS g1, sum(z2 * (y - b * x)) AS g2 FROM r, b)
SELECT round(1e6 * b, 4) AS estimate, round(n * (g1 * (d * g1 - c * g2) + g2 * (a * g2 - c * g1)) / (a * d - c * c) / rss, 5) AS sargan, 1 AS df FROM b, e""")
def iv_overidentified(spark, sf_dir):
    """More instruments than needed: Sargan's test."""
    fit = feols("l_tax ~ 1 | l_suppkey | l_extendedprice ~ l_quantity + l_discount", lines(spark, sf_dir))
    over = fit.stats["iv"]["overid"]
    return frame(spark, [{"estimate": round(1e6 * float(fit.beta[0]), 4), "sargan": round(over["statistic"], 5), "df": int(over["df"])}], 6).selectExpr("estimate", "sargan", "int(df) AS df")


WALD = within_sql("l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey", "lineitem")


@query(f"""
WITH r AS ({WALD}), m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT c)::DOUBLE AS g, sum(x1 * x1) AS a, sum(x1 * x2) AS c, sum(x2 * x2) AS d, sum(x1 * y) AS q1, sum(x2 * y) AS q2, sum(y * y) AS yy FROM r),
b AS (SELECT *, (d * q1 - c * q2) / (a * d - c * c) AS b1, (a * q2 - c * q1) / (a * d - c * c) AS b2 FROM m)
SELECT round((b1 * q1 + b2 * q2) / 2 / ((yy - b1 * q1 - b2 * q2) / (n - 2 - g)), 2) AS statistic, 2 AS df1, (n - 2 - g)::BIGINT AS df2 FROM b""")
def wald(spark, sf_dir):
    """Joint test of all coefficients."""
    t = feols("l_extendedprice ~ l_quantity + l_discount | l_suppkey", lines(spark, sf_dir)).wald_test()
    return frame(spark, [{"statistic": round(t["statistic"], 2), "df1": t["df1"], "df2": int(t["df2"])}], 6).selectExpr("statistic", "int(df1) AS df1", "df2")


@query(f"""
WITH f AS ({" UNION ALL ".join(f"SELECT '{y}' AS y, sum(x1 * y) / sum(x1 * x1) AS b, sum(x1 * x1) AS a, sum(y * y) AS yy, count(*)::DOUBLE AS n, count(DISTINCT c)::DOUBLE AS g FROM ({within_sql(y, ['l_quantity'], 'l_suppkey', 'lineitem')})" for y in ("l_tax", "l_discount"))}),
t AS (SELECT y, n - 1 - g AS df, abs(b) / sqrt((yy - b * b * a) / (n - 1 - g) / a) AS t FROM f),
i AS (SELECT y, any_value(t) / 4000 * sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(df + 1) / 2 * ln(1 + (t * k / 4000) ** 2 / df))) / 3 * exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(any_value(df) * pi()) AS half FROM t, range(0, 4001) AS r(k) GROUP BY y),
p AS (SELECT y, 1 - 2 * half AS p, row_number() OVER (ORDER BY 1 - 2 * half) AS place FROM i)
SELECT y || ' ~ l_quantity | l_suppkey' AS fml, round(least(1, 2 * p), 5) AS bonferroni, round(least(1, max((3 - place) * p) OVER (ORDER BY place)), 5) AS holm FROM p""")
def multiple_testing(spark, sf_dir):
    """Bonferroni's and Holm's adjustments over outcomes."""
    fits = feols("l_tax + l_discount ~ l_quantity | l_suppkey", lines(spark, sf_dir))
    a, b = bonferroni(fits, "l_quantity"), holm(fits, "l_quantity")
    return frame(spark, {"fml": a["fml"], "bonferroni": a["Bonferroni Pr(>|t|)"], "holm": b["Holm Pr(>|t|)"]}, 5)


@query(f"""
WITH r AS (SELECT l_returnflag AS c, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y FROM lineitem),
m AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS xx, sum(y) AS sy, sum(x * y) AS xy FROM r),
b AS (SELECT *, (n * xy - sx * sy) / (n * xx - sx * sx) AS b, -sx / (n * xx - sx * sx) AS i1, n / (n * xx - sx * sx) AS i2 FROM m),
k AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k, count(*)::DOUBLE AS cn, sum(x) AS cx, sum(x * x) AS cxx, sum(y) AS cy, sum(x * y) AS cxy FROM r GROUP BY c),
s AS (SELECT k, cn, cx, cxx, i1, i2, b, cy - cn * sy / n AS s1, cxy - cx * sy / n AS s2, cy - cn * (sy - b * sx) / n - b * cx AS u1, cxy - cx * (sy - b * sx) / n - b * cxx AS u2, n, sx, xx FROM k, b),
w AS (SELECT d, s.*, CASE WHEN (d >> k) & 1 = 1 THEN 1.0 ELSE -1.0 END AS v FROM s, (SELECT unnest(range(0, 8)) AS d)),
t AS (SELECT d, sum(v * s1) AS t1, sum(v * s2) AS t2 FROM w GROUP BY d),
q AS (SELECT w.*, (xx * t1 - sx * t2) / (n * xx - sx * sx) AS d1, (n * t2 - sx * t1) / (n * xx - sx * sx) AS d2 FROM w JOIN t USING (d)),
z AS (SELECT d, any_value(d2) / sqrt(sum((i1 * (v * s1 - cn * d1 - cx * d2) + i2 * (v * s2 - cx * d1 - cxx * d2)) ** 2)) AS tb FROM q GROUP BY d),
o AS (SELECT any_value(b) / sqrt(sum((i1 * u1 + i2 * u2) ** 2)) AS t FROM s)
SELECT count(*) AS reps, avg((abs(tb) >= abs(t) * (1 - 1e-9))::INT) AS p_value FROM z, o""")
def wild_bootstrap(spark, sf_dir):
    """Wild cluster bootstrap under the null hypothesis, all sign patterns of three clusters."""
    fit = feols("l_discount ~ l_quantity", lines(spark, sf_dir), vcov={"CRV1": "l_returnflag"})
    t = fit.wildboottest("l_quantity", reps=999)
    return frame(spark, [{"reps": t["reps"], "p_value": t["p_value"]}], 6)


@query(f"SELECT 'l_quantity' AS term, round(1e6 * sum(x1 * y) / sum(x1 * x1), 6) AS coef FROM ({within_sql('l_tax', ['l_quantity'], 'l_suppkey', 'lineitem')})")
def normal_equations(spark, sf_dir):
    """The normal equations of a fit, solved for another column; in millionths."""
    fit = feols("l_extendedprice ~ l_quantity | l_suppkey", lines(spark, sf_dir))
    s = fit.solve_normal_equations(lines(spark, sf_dir), ["l_tax"])
    return frame(spark, {"term": list(s.coef().index), "coef": 1e6 * s.coef()["l_tax"].to_numpy()}, 6)

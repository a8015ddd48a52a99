"""Balance, weights and influence-function variances."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ridgeline.operators import treatment
from ridgeline.operators.bootstrap import resample_groups
from ridgeline.operators.glm import feglm
from ridgeline.queries.registry import frame, query, table

SOURCE = "SELECT l_linestatus = 'F' AS t, 1 + l_tax AS w, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_extendedprice::DOUBLE AS l_extendedprice, (l_returnflag = 'R')::INT::DOUBLE AS returned, l_suppkey, l_partkey FROM lineitem"


def lines(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.withColumns({"t": F.col("l_linestatus") == "F", "w": 1 + F.col("l_tax"), "returned": (F.col("l_returnflag") == "R").cast("double")})


def _balance(term: str) -> str:
    return f"""
SELECT '{term}' AS term, * FROM (
  WITH r AS (SELECT t, w, {term} AS x FROM ({SOURCE})),
  a AS (SELECT t, sum(w) AS sw, sum(w * w) AS sww, sum(w * x) / sum(w) AS m FROM r GROUP BY t),
  v AS (SELECT t, any_value(m) AS m, sum(w * (x - m) ** 2) / any_value(sw) / (1 - any_value(sww) / any_value(sw) ** 2) AS v FROM r JOIN a USING (t) GROUP BY t),
  o AS (SELECT max(m) FILTER (t) AS m1, max(m) FILTER (NOT t) AS m0, max(v) FILTER (t) AS v1, max(v) FILTER (NOT t) AS v0 FROM v),
  s AS (SELECT x, sum(CASE WHEN t THEN w / sw ELSE -w / sw END) AS s FROM r JOIN a USING (t) GROUP BY x),
  g AS (SELECT abs(sum(s) OVER (ORDER BY x)) AS g FROM s)
  SELECT round(m1, 5) AS mean1, round(m0, 5) AS mean0, round(v1, 4) AS var1, round(v0, 4) AS var0, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS smd, round(v1 / v0, 6) AS var_ratio,
         round((SELECT avg(g) FROM g), 6) AS ecdf_mean, round((SELECT max(g) FROM g), 6) AS ecdf_max FROM o)"""


@query(" UNION ALL ".join(map(_balance, ["l_quantity", "l_discount"])))
def balance(spark, sf_dir):
    """Weighted covariate balance of two groups."""
    t = treatment.weighted_balance(lines(spark, sf_dir), "t", ["l_quantity", "l_discount"], "w")
    digits = {"mean1": 5, "mean0": 5, "var1": 4, "var0": 4}
    return t.select("term", *[F.round(c, digits.get(c, 6)).alias(c) for c in t.columns if c != "term"])


@query(f"SELECT t AS arm, count(*) AS n, round(sum(w) ** 2 / sum(w * w), 3) AS ess FROM ({SOURCE}) GROUP BY t")
def effective_sizes(spark, sf_dir):
    """Kish's effective sizes."""
    return treatment.effective_sizes(lines(spark, sf_dir), "t", "w").withColumn("ess", F.round("ess", 3))


@query(f"""
WITH r AS (SELECT t, p, CASE WHEN t THEN 1.0 ELSE p / (1 - p) END AS raw FROM (SELECT *, 0.2 + 5 * l_discount AS p FROM ({SOURCE})) WHERE p >= 0.25 AND p <= 0.6),
n AS (SELECT *, raw * count(*) OVER g / sum(raw) OVER g AS weight FROM r WINDOW g AS (PARTITION BY t))
SELECT t AS arm, count(*) AS n, round(sum(weight), 3) AS sum_weight, round(sum(weight * weight), 3) AS sum_squares FROM n GROUP BY t""")
def ipw_weights(spark, sf_dir):
    """Inverse-probability weights of the treated's effect, trimmed, on Hajek's scale."""
    df = lines(spark, sf_dir).withColumn("p", 0.2 + 5 * F.col("l_discount"))
    w = treatment.ipw_weights(df, "t", "p", "att", trim=(0.25, 0.6), name="weight")
    return w.groupBy(F.col("t").alias("arm")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("sum_weight"), F.round(F.sum(F.col("weight") ** 2), 3).alias("sum_squares"))


PHI = f"""
WITH r AS ({SOURCE}), a AS (SELECT t, sum(w) AS sw, sum(w * l_extendedprice) / sum(w) AS m FROM r GROUP BY t),
p AS (SELECT r.*, CASE WHEN t THEN 1 ELSE -1 END * w * (l_extendedprice - m) / sw AS phi FROM r JOIN a USING (t)),
m AS (SELECT max(m) FILTER (t) AS m1, max(m) FILTER (NOT t) AS m0 FROM a)"""


@query(f"""{PHI},
c AS (SELECT sum(phi) AS s FROM p GROUP BY l_suppkey), n AS (SELECT count(*)::DOUBLE AS n FROM p)
SELECT round(m1 - m0, 4) AS estimate, round(m1, 4) AS mean1, round(m0, 4) AS mean0, round(sqrt((SELECT sum(s * s) * count(*) / (count(*) - 1) FROM c) * (n - 1) / (n - 2)), 4) AS std_error FROM m, n""")
def mean_difference(spark, sf_dir):
    """Difference of weighted means with a clustered influence-function error."""
    d = treatment.weighted_mean_difference(lines(spark, sf_dir), "l_extendedprice", "t", "w", ["l_suppkey"])
    return frame(spark, [{k: d[k] for k in ("estimate", "mean1", "mean0", "std_error")}])


@query(f"""{PHI},
x AS (SELECT sum(s * s) AS v, count(*)::DOUBLE AS g FROM (SELECT sum(phi) AS s FROM p GROUP BY l_suppkey)),
y AS (SELECT sum(s * s) AS v, count(*)::DOUBLE AS g FROM (SELECT sum(phi) AS s FROM p GROUP BY l_partkey)),
z AS (SELECT sum(s * s) AS v FROM (SELECT sum(phi) AS s FROM p GROUP BY l_suppkey, l_partkey))
SELECT round((x.v + y.v - z.v) * least(x.g, y.g) / (least(x.g, y.g) - 1), 4) AS variance FROM x, y, z""")
def influence_variance(spark, sf_dir):
    """Two-way clustered variance of given influences."""
    df = treatment.group_mean_phis(lines(spark, sf_dir), "l_extendedprice", "t", "w").withColumn("phi", F.col("phi1") - F.col("phi0"))
    return frame(spark, [{"variance": float(treatment.if_vcov(df, ["phi"], ["l_suppkey", "l_partkey"])[0, 0])}])


@query(f"""
WITH r AS (SELECT *, avg(t::INT) OVER (PARTITION BY returned) AS p FROM ({SOURCE})), q AS (SELECT *, CASE WHEN t THEN 1 / p ELSE 1 / (1 - p) END AS wt FROM r)
SELECT round(sum(wt * l_extendedprice) FILTER (t) / sum(wt) FILTER (t) - sum(wt * l_extendedprice) FILTER (NOT t) / sum(wt) FILTER (NOT t), 3) AS estimate, count(*) AS n FROM q""")
def ipw_difference(spark, sf_dir):
    """Effect by inverse-probability weights from a fitted logit (saturated, so that its probabilities are cell means)."""
    df = lines(spark, sf_dir).withColumn("d", F.col("t").cast("int"))
    first = treatment.BinaryFirstStage(feglm("d ~ returned", df, "logit", iwls_tol=1e-12))
    r = treatment.ipw_mean_difference(df, "l_extendedprice", "d", first, "ate")
    return frame(spark, [{"estimate": round(r["estimate"], 3), "n": int(r["n"])}])


@query("""
WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS r FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL)), n AS (SELECT count(*) AS n FROM c),
s AS (SELECT slot, ('0x' || substr(sha256('1:1:' || slot), 1, 13))::BIGINT % n AS r FROM n, range(0, (SELECT n FROM n)) AS t(slot))
SELECT slot || '#' || o_custkey AS unit_id, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM s JOIN c USING (r) JOIN orders USING (o_custkey) GROUP BY slot, o_custkey""")
def resampling(spark, sf_dir):
    """A bootstrap draw of whole customers."""
    draw = resample_groups(table(spark, sf_dir, "orders"), "o_custkey", 1)
    return draw.groupBy("unit_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def partitioned_sink(spark, sf_dir):
    """A table written in folders by column and read again."""
    import uuid

    from ridgeline.plans.cache import shared
    from ridgeline.sources import sink, source

    path = sink(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), f"{shared(spark)}/sink-{uuid.uuid4().hex}", ["l_returnflag"])
    return source(path, spark).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) AS b FROM lineitem)
SELECT n::BIGINT AS n_obs, round(my - b * mx, 3) AS intercept, round(b, 4) AS slope FROM m""")
def stream_ols(spark, sf_dir):
    """A regression kept up to date over a stream of files."""
    from ridgeline.streaming import StreamingRegression

    s = StreamingRegression("l_extendedprice", ["l_quantity"])
    s.follow(spark, f"{sf_dir}/lineitem.parquet", table(spark, sf_dir, "lineitem").schema)
    beta = s.coefficients()
    out = {"n_obs": int(s.n), "intercept": round(beta["Intercept"], 3), "slope": round(beta["l_quantity"], 4)}
    assert all(math.isfinite(v) for v in out.values())
    return spark.createDataFrame([out])

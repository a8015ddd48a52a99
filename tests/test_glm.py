import numpy as np
import pandas as pd
import pytest

from ridgeline.functions.special import norm_cdf, norm_pdf
from ridgeline.operators.glm import bias_corrected, feglm, fepois


def newton(x, y, family, w=None, off=0.0):
    b, w = np.zeros(x.shape[1]), np.ones(len(y)) if w is None else w
    for _ in range(60):
        eta = x @ b + off
        if family == "poisson":
            mu = np.exp(eta)
            g, h = x.T @ (w * (y - mu)), x.T @ (x * (w * mu)[:, None])
        elif family == "logit":
            mu = 1 / (1 + np.exp(-eta))
            g, h = x.T @ (w * (y - mu)), x.T @ (x * (w * mu * (1 - mu))[:, None])
        else:
            mu, f = norm_cdf(eta), norm_pdf(eta)
            g, h = x.T @ (w * (y - mu) * f / (mu * (1 - mu))), x.T @ (x * (w * f * f / (mu * (1 - mu)))[:, None])
        b = b + np.linalg.pinv(h) @ g
    return b, h


def design(panel, y, family):
    d = panel.dropna()
    d = d[d.groupby("w").w.transform("size") > 1]
    if family == "poisson":
        d = d[d.groupby("w")[y].transform("max") > 0]
    else:
        d = d[d.groupby("w")[y].transform("mean").between(1e-9, 1 - 1e-9)]
    return d, np.column_stack([d.x, pd.get_dummies(d.w).to_numpy(float)])


@pytest.mark.parametrize("family, y", [("poisson", "yp"), ("logit", "yb"), ("probit", "yb")])
def test_against_newton(spark, panel, family, y):
    df = spark.createDataFrame(panel)
    fit = fepois(f"{y} ~ x | w", df) if family == "poisson" else feglm(f"{y} ~ x | w", df, family, iwls_tol=1e-12)
    d, x = design(panel, y, family)
    b, h = newton(x, d[y].to_numpy(float), family)
    assert fit.n_obs == len(d) and fit.stats["converged"]
    assert np.allclose(fit.beta[0], b[0], atol=1e-6)
    n, k = len(d), x.shape[1]
    assert np.allclose(fit.vcovs["iid"][0, 0], np.linalg.pinv(h)[0, 0] * (n - 1) / (n - k), rtol=1e-4)


def test_offset_no_effects_and_prediction(spark, panel):
    d = panel.dropna()
    fit = fepois("yp ~ x", spark.createDataFrame(d), offset="x2 * 0.1")
    b, _ = newton(np.column_stack([np.ones(len(d)), d.x]), d.yp.to_numpy(float), "poisson", off=0.1 * d.x2.to_numpy())
    assert np.allclose(fit.beta, b, atol=1e-6)
    p = fit.predict(type="response").toPandas()
    assert np.allclose(np.sort(p.prediction), np.sort(fit.resid().toPandas().fitted), atol=1e-6)


def test_bias_correction_and_refusals(spark, panel):
    df = spark.createDataFrame(panel)
    out = bias_corrected(feglm("yb ~ x | w", df, "logit"))
    assert abs(out["estimate"]["x"]) < abs(out["estimate"]["x"] + out["bias"]["x"])
    with pytest.raises(ValueError):
        feglm("yb ~ x", df, "gaussian")
    with pytest.raises(ValueError):
        fepois("y ~ x", df)


def test_a_single_step_over_rows_follows_cells_that_converged(spark, panel, monkeypatch):
    from ridgeline.operators import glm

    # sums of many rows come out a little different each time: no step and no halving may hang on that
    seen = []

    class Family(type(glm.FAMILIES["poisson"])):
        def deviance(self, y, eta):
            seen.append(1)
            return super().deviance(y, eta) * float(1 + 1e-9 * len(seen))

    monkeypatch.setitem(glm.FAMILIES, "poisson", Family())
    fit = fepois("yp ~ x | yr", spark.createDataFrame(panel.dropna()), iwls_tol=1e-12)
    assert fit.parts["irls"]["converged"] and len(fit.parts["irls"]["path"]) == 1 and fit.parts["irls"]["halvings"] == 0


def test_means_of_few_groups_leave_rows_where_they_are(spark):
    from ridgeline.plans.absorb import Absorber

    rows = spark.range(2000).selectExpr("id AS row_id", "id % 3 AS f0", "double(id) AS u0")
    out = Absorber(rows, ["f0"]).residualise(rows, ["u0"])[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Absorber(rows, ["f0"]).residualise(rows, ["u0"])[0]._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    t = out.toPandas()
    assert np.allclose(t.groupby("f0").u0.mean(), 0)

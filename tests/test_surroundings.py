import os
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline import lifecycle, simulate
from ridgeline.operators.estimators import GeneralizedModel, LinearModel
from ridgeline.operators.glm import bias_corrected, feglm, fepois
from ridgeline.operators.graph import label_pairs
from ridgeline.operators.linear import feols
from ridgeline.plans.absorb import Absorber, gram
from ridgeline.plans.cache import cut, shared
from ridgeline.plans.ranges import numbered_by, running_sum
from ridgeline.sources import group_batches, steady, with_row_id


def tables(spark):
    root = shared(spark).replace("file:", "")
    return {x for x in os.listdir(root) if len(x) == 32}


def test_cleanup_leaves_nothing(spark, panel):
    before = tables(spark)
    with feols("y ~ x | w + f", spark.createDataFrame(panel), vcov="hetero") as fit:
        fit.fixef("f").count(), fit.resid().count()
        assert len(tables(spark)) > len(before)
    assert tables(spark) == before and fit.se().notna().all()
    with pytest.raises(RuntimeError):
        fit.resid()
    left = cut(spark.range(3))
    assert [p.rstrip("/").split("/")[-1] for p in lifecycle.cleanup(spark, 0.0, dry_run=True)].count(left._cut_at.split("/")[-1]) == 1 and left.count() == 3
    assert not lifecycle.cleanup(spark, 1.0)


def test_row_ids_hold_after_a_shuffle(spark, panel):
    df = spark.createDataFrame(panel).repartition(7)
    assert steady(spark.createDataFrame(panel).filter("x > 0").select("x")) and not steady(df) and not steady(df.groupBy("w").count()) and not steady(df.withColumn("u", F.rand()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    fit = feols("y ~ x | w", df.dropDuplicates(["y"]))
    s = fit.sample().toPandas()
    r = fit.resid().select("row_id", "y").toPandas()
    both = s[s.in_sample].merge(r, on="row_id")
    assert len(both) == fit.n_obs and np.allclose(both.y_x, both.y_y)
    assert s[s.dropped_because == "missing"].x.isna().all()
    ids = with_row_id(df.orderBy(F.rand()))
    assert ids.join(ids, "row_id").count() == len(panel)


def test_products_over_a_table_of_cells(spark, panel):
    d = panel.dropna()
    df = spark.createDataFrame(d)
    for w, slopes in ((None, ()), ("wt", ("x2",))):
        out = []
        for most in (10**6, 0):
            a = Absorber(df.select("w", "f", "yr", "wt", "x2", F.col("x").alias("u"), F.col("y").alias("v"), F.col("y").alias("key")), ["w", "f", "yr"], w, slopes, most)
            res, eff = a.residualise(a.rows, ["u", "v"], 1e-12)
            out.append(res.select("key", "u", "v").toPandas().sort_values("key").to_numpy())
        assert np.allclose(out[0], out[1], atol=1e-8)
        dummies = [pd.get_dummies(d[k]).to_numpy(float) for k in ("w", "f", "yr")]
        z = np.column_stack([*dummies, *[dummies[0] * d[s].to_numpy()[:, None] for s in slopes]])
        s = np.sqrt(d[w].to_numpy()) if w else np.ones(len(d))
        v = d[["x", "y"]].to_numpy()
        want = v - z @ (np.linalg.pinv(s[:, None] * z) @ (s[:, None] * v))
        assert np.allclose(out[0][:, 1:], want[np.argsort(d.y.to_numpy(), kind="stable")], atol=1e-7)


def test_one_group_of_many_levels(spark):
    n = 50_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("l"), (F.col("id") % 7).cast("double").alias("v")).union(spark.range(n).select((F.col("id") % 9 + 2).cast("int"), "id", (F.col("id") % 5).cast("double")))
    a = Absorber(df, ["g", "l"])
    res, eff = a.residualise(df, ["v"])
    top = res.groupBy("l").agg(F.sum("v").alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert top < 1e-6 and len(eff.tables["l"][0]) == n


def test_wide_cross_products(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(300, 200)), rng.uniform(0.5, 2, 300)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(200)]).assign(w=w)).repartition(5)
    a, extra = gram(df, [f"c{i}" for i in range(200)], "w", [F.count("*")])
    assert np.allclose(a, x.T @ (x * w[:, None])) and extra == [300]


def test_steps_on_cells_and_on_rows_agree(spark, panel):
    from ridgeline.operators import glm

    df = spark.createDataFrame(panel.assign(occ=panel.occ.fillna("k0")))
    for run in (lambda: fepois("yp ~ x | w + yr", df, iwls_tol=1e-11), lambda: feglm("yb ~ i(occ) | yr", df, "probit", iwls_tol=1e-11)):
        on = run()
        assert on.parts["irls"]["cell_steps"] > 0
        with pytest.MonkeyPatch.context() as m:
            m.setattr(glm, "on_cells", lambda *a, **k: None)
            off = run()
        assert np.allclose(on.beta, off.beta, atol=1e-7) and np.allclose(on.se(), off.se(), rtol=1e-5) and on.stats["loglik"] == pytest.approx(off.stats["loglik"], rel=1e-9)


def test_bias_correction_with_lags(spark):
    rng = np.random.default_rng(7)
    n, t = 40, 8
    i, p = np.repeat(np.arange(n), t), np.tile(np.arange(t), n)
    x = rng.normal(size=n * t)
    y = (0.8 * x + rng.normal(size=n)[i] * 0.5 + rng.logistic(size=n * t) > 0).astype(int)
    d = pd.DataFrame({"y": y, "x": x, "i": i, "t": p})
    keep = d.groupby("i").y.transform("mean").between(0.01, 0.99)
    d = d[keep & d[keep].groupby("t").y.transform("mean").between(0.01, 0.99).reindex(d.index, fill_value=True)]
    fit = feglm("y ~ x | i + t", spark.createDataFrame(d), "logit", iwls_tol=1e-12)
    out = bias_corrected(fit, time="t", lags=2, refit=True)
    z = np.column_stack([pd.get_dummies(d.i), pd.get_dummies(d.t)]).astype(float)
    b = np.zeros(1 + z.shape[1])
    full = np.column_stack([d.x, z])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-full @ b))
        b = b + np.linalg.pinv(full.T @ (full * (mu * (1 - mu))[:, None])) @ (full.T @ (d.y - mu))
    mu = 1 / (1 + np.exp(-full @ b))
    w = mu * (1 - mu)
    s = np.sqrt(w)
    u = d.x.to_numpy() - z @ (np.linalg.pinv(s[:, None] * z) @ (s * d.x.to_numpy()))
    h, v = (w * u * u).sum(), d.y.to_numpy() - mu
    total = 0.0
    for k in ("i", "t"):
        g = pd.DataFrame({"k": d[k].to_numpy(), "a": u * w * (1 - 2 * mu), "w": w}).groupby("k").sum()
        total += (g.a / g.w).sum() / 2
    for _, own in d.reset_index(drop=True).groupby("i"):
        at = own.sort_values("t").index.to_numpy()
        for lag in (1, 2):
            if len(at) > lag:
                total += ((w * u)[at[lag:]] * v[at[:-lag]]).sum() * len(at) / (len(at) - lag) / w[at].sum()
    assert out["estimate"]["x"] == pytest.approx(b[0] + total / h, abs=1e-6)
    eta = out["refit"].parts["rows"].select("eta", F.col("v0").alias("y"), "f0").toPandas()
    sums = eta.assign(r=eta.y - 1 / (1 + np.exp(-eta.eta))).groupby("f0").r.sum()
    assert np.abs(sums).max() < 1e-4  # effects fit again, with the corrected slope held
    with pytest.raises(ValueError):
        bias_corrected(fit, lags=1)


def test_column_estimators(spark, panel):
    df = spark.createDataFrame(panel)
    a = feols("y ~ x + x2 | w + f", df, vcov={"CRV1": "cl"}, weights="wt")
    b = LinearModel("y", ["x", F.col("x2")], {"w": "w", "firm": F.col("f") + 0}, weights="wt").fit(df, cluster="cl")
    assert np.allclose(a.beta, b.beta) and np.allclose(a.se(), b.se())
    c = GeneralizedModel("poisson", "yp", {"x": "x"}, "w", offset=F.col("x2") * 0.1).fit(df)
    assert np.allclose(c.beta, fepois("yp ~ x | w", df, offset="x2 * 0.1").beta)
    e = LinearModel("y", "x", endog="e", instruments=["z1", "z2"]).fit(df)
    assert np.allclose(e.beta, feols("y ~ x | e ~ z1 + z2", df).beta)
    for bad in (F.sum("x"), F.rand(), F.explode(F.array("x"))):
        with pytest.raises(Exception, match="expression of single rows|AGGREGATE|aggregat"):
            LinearModel("y", {"bad": bad}).fit(df)


def test_profiles_and_warnings(spark, panel):
    p = lifecycle.profile("y ~ x + x2 | w + f", spark.createDataFrame(panel), memory_mb=0.001)
    assert p.rows == len(panel) and p.stream == "w" and abs(p.levels["f"] - 15) <= 2 and p.columns == 3 and "passes" in p.summary()
    with pytest.warns(lifecycle.ExperimentalWarning):
        warnings.warn("new", lifecycle.ExperimentalWarning, stacklevel=1)


def test_simulated_panels_hang_on_the_seed_alone(spark):
    a = simulate.simulate_rich(spark, 300, seed=4, keep_effects=True)
    b = simulate.simulate_rich(spark, 300, seed=4, keep_effects=True).repartition(3)
    key = ["worker_id", "year"]
    x, y = (t.toPandas().sort_values(key).reset_index(drop=True) for t in (a, b))
    pd.testing.assert_frame_equal(x, y)
    assert not x[key].duplicated().any() and 0.8 < len(x) / 3000 < 0.9 and x.firm_id.nunique() <= 50
    assert {"log_earn", "true_firm_effect", "state", "occ", "y_iv", "x_na"} <= set(x.columns)
    fit = feols("log_earn ~ age_squared + age_cubed | worker_id + firm_id", a)
    assert np.allclose(fit.beta, [0.08, -0.012], atol=0.03)
    t = simulate.simulate_trends(spark, 50)
    assert {"t", "t2", "x", "xe", "y"} <= set(t.columns) and t.count() > 300
    n = simulate.simulate_bottleneck(spark, 200, 10, 6)
    half = F.floor(F.substring("firm_id", 2, 9).cast("int") / 5)
    assert n.groupBy("worker_id").agg(F.countDistinct(half).alias("c")).filter("c > 1").count() == 6
    assert sorted(r[0] for r in simulate.shuffled(spark.range(20)).collect()) == list(range(20))


def test_ranges(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 101).alias("x"), (F.col("id") % 3).alias("g"), F.lit(1.5).alias("v"))
    got = numbered_by(df, [F.desc("x")], "place").toPandas().sort_values("place")
    assert got.place.tolist() == list(range(1, 101)) and got.x.is_monotonic_decreasing
    r = running_sum(df, "g", "x", "v", "s").toPandas().sort_values(["g", "x"])
    assert np.allclose(r.s, r.groupby("g").v.cumsum())


def test_whole_groups(spark):
    df = spark.range(1000).select((F.col("id") % 13).alias("k"), F.col("id").alias("v"))

    def sizes(groups):
        import pyarrow as pa

        for t in groups:
            yield pa.RecordBatch.from_pydict({"k": [t["k"][0].as_py()], "n": [t.num_rows]})

    out = group_batches(df, ["k"], sizes, "k long, n long").collect()
    assert sorted((r.k, r.n) for r in out) == sorted((k, len(range(k, 1000, 13))) for k in range(13))


def test_labels_by_rounds(spark):
    pairs = spark.createDataFrame([(i, i // 2, 1) for i in range(20)] + [(i, i // 2 + 1, 1) for i in range(0, 10)] + [(90, 90, 1)], "a long, b long, n long")
    want = {r.a: r.component for r in label_pairs(pairs).collect()}
    assert {r.a: r.component for r in label_pairs(pairs, 0).collect()} == want


@pytest.mark.parametrize("fes", [["w"], ["w", "f"], ["w", "f", "yr"]])
def test_inverse_of_the_normal_matrix(spark, panel, fes):
    from ridgeline.operators.normal import apply_inverse

    d = panel.dropna()
    d = d[d.groupby("w").w.transform("size") > 1]
    fit = feols(f"y ~ x + x2 | {' + '.join(fes)}", spark.createDataFrame(d), weights="wt", fixef_rm="none")
    names = {f: np.sort(d[f].unique()) for f in fes}
    z = np.column_stack([d[["x", "x2"]].to_numpy(), *[(d[f].to_numpy()[:, None] == v[None, :]).astype(float) for f, v in names.items()]])
    s = z.T @ (z * d.wt.to_numpy()[:, None])
    c = s @ np.random.default_rng(1).normal(size=(len(s), 2))  # in the range of S
    at, frames = 2, {}
    for f, v in names.items():
        frames[f] = pd.DataFrame({"level": v, "a": c[at : at + len(v), 0], "b": c[at : at + len(v), 1]})
        at += len(v)
    beta, out = apply_inverse(fit, frames, c[:2])
    u = np.concatenate([beta, *[out[f].sort_values("level").iloc[:, 1:].to_numpy() for f in fes]])
    assert np.allclose(s @ u, c, atol=1e-6 * np.abs(c).max())
    assert np.allclose(z @ u, z @ np.linalg.pinv(s) @ c, atol=1e-7)
    df = spark.createDataFrame(d.assign(v=d.x * d.z1))
    sol = fit.solve_normal_equations(df, ["v"])
    got = np.concatenate([sol.coef().to_numpy(), *[sol.fixef(f).sort_values("level")[["v"]].to_numpy() for f in fes]])
    assert np.allclose(z @ got, z @ np.linalg.pinv(s) @ (z.T @ (d.x * d.z1).to_numpy()[:, None]), atol=1e-7)


@pytest.mark.parametrize("family, fe", [("logit", False), ("probit", False), ("logit", True)])
def test_first_stage_projections(spark, panel, family, fe):
    from ridgeline.operators.treatment import BinaryFirstStage

    d = panel.dropna()
    d = d[d.groupby("f").yb.transform("mean").between(0.01, 0.99)]
    df = spark.createDataFrame(d)
    first = BinaryFirstStage(feglm("yb ~ x + x2" + (" | f" if fe else ""), df, family, iwls_tol=1e-12))
    rows = first.prob(df).withColumn("c", F.col("z1"))
    t = first.project(rows, {"c": F.col("c")}).toPandas()
    eta, p, y = t.link.to_numpy(), t.prob.to_numpy(), t.yb.to_numpy(float)
    if family == "logit":
        w = p * (1 - p)
    else:  # by differences of the log-likelihood
        from ridgeline.functions.special import log_norm_cdf

        ll = lambda e: np.where(y == 1, log_norm_cdf(e), log_norm_cdf(-e))
        w = -(ll(eta + 1e-3) - 2 * ll(eta) + ll(eta - 1e-3)) / 1e-6
    x = np.column_stack([t[["x", "x2"]].to_numpy(), pd.get_dummies(t.f).to_numpy(float) if fe else np.ones(len(t))])
    h = x.T @ (x * w[:, None])
    want = x @ np.linalg.pinv(h) @ (x.T @ t.c.to_numpy())
    assert np.allclose(t.c_fit, want, rtol=1e-4, atol=1e-5)
    j = x.T @ t.c.to_numpy()
    assert first.quad(rows, {"c": F.col("c")})["c"] == pytest.approx(j @ np.linalg.pinv(h) @ j, rel=1e-4)
    if not fe:
        assert np.allclose(np.sort(np.diag(first.information)), np.sort(np.diag(h)), rtol=1e-3)

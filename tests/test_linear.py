import numpy as np
import pandas as pd
import pytest

from ridgeline.operators.linear import feols
from ridgeline.operators.results import MultiFit, etable


def dummies(d, names):
    return np.column_stack([pd.get_dummies(d[n]).to_numpy(float) for n in names])


def brute(d, y, xs, fes, w=None):
    """Coefficients, residuals, within-transformed X and rank of the whole design, by dense least squares."""
    s = np.sqrt(d[w].to_numpy()) if w else np.ones(len(d))
    z = dummies(d, fes) if fes else np.ones((len(d), 1))
    x = d[xs].to_numpy(float)
    p = np.linalg.pinv(s[:, None] * z)
    mx = s[:, None] * x - s[:, None] * z @ (p @ (s[:, None] * x))
    my = s * d[y].to_numpy(float) - s[:, None] * z @ (p @ (s * d[y].to_numpy(float)))
    b = np.linalg.solve(mx.T @ mx, mx.T @ my)
    return b, (my - mx @ b), mx, np.linalg.matrix_rank(z)


def usable(panel, fes):
    d = panel.dropna()
    while True:
        n = len(d)
        for f in fes:
            d = d[d.groupby(f)[f].transform("size") > 1]
        if len(d) == n:
            return d


@pytest.mark.parametrize("fes, w", [(["w"], None), (["w", "f"], None), (["w", "f", "yr"], "wt")])
def test_coefficients_and_variances(spark, panel, fes, w):
    fit = feols(f"y ~ x + x2 | {' + '.join(fes)}", spark.createDataFrame(panel), vcov={"CRV1": "cl"}, weights=w)
    d = usable(panel, fes)
    b, e, mx, rank = brute(d, "y", ["x", "x2"], fes, w)
    assert fit.n_obs == len(d)
    assert np.allclose(fit.beta, b, atol=1e-8)
    bread, n, k = np.linalg.inv(mx.T @ mx), len(d), 2 + rank
    assert fit.stats["k_fe"] == rank
    assert np.allclose(fit.vcovs["iid"], e @ e / (n - k) * bread)
    se = mx * e[:, None]
    assert np.allclose(fit.vcovs["hetero"], n / (n - k) * bread @ (se.T @ se) @ bread)
    s = pd.DataFrame(se).groupby(d.cl.to_numpy()).sum().to_numpy()
    g = len(s)
    assert np.allclose(fit.vcov, g / (g - 1) * (n - 1) / (n - k) * bread @ (s.T @ s) @ bread)
    r = fit.resid().toPandas()
    assert len(r) == n
    assert np.allclose(np.sort(r.resid), np.sort(e / (np.sqrt(d[w].to_numpy()) if w else 1)), atol=1e-7)


def test_nested_cluster_and_jackknife(spark, panel):
    fit = feols("y ~ x + x2 | w", spark.createDataFrame(panel), vcov={"CRV1": "w"})
    d = usable(panel, ["w"])
    b, e, mx, _ = brute(d, "y", ["x", "x2"], ["w"])
    a = mx.T @ mx
    bread, n = np.linalg.inv(a), len(d)
    groups = list(d.reset_index(drop=True).groupby("w").groups.values())
    g = len(groups)
    s = np.array([mx[i].T @ e[i] for i in groups])
    adj = g / (g - 1) * (n - 1) / (n - 2 - 1)
    assert np.allclose(fit.vcov, adj * bread @ s.T @ s @ bread)
    j = np.array([np.linalg.pinv(a - mx[i].T @ mx[i]) @ mx[i].T @ e[i] for i in groups])
    assert np.allclose(fit.with_vcov({"CRV3": "w"}).vcov, adj * j.T @ j)


def test_plain_and_categories(spark, panel):
    fit = feols("y ~ x + C(yr) + occ:x2", spark.createDataFrame(panel))
    assert fit.names == ["Intercept", "x", *[f"C(yr)[T.{v}]" for v in range(2001, 2006)], "occ[k0]:x2", "occ[k1]:x2", "occ[k2]:x2"]
    d = panel.dropna()
    x = np.column_stack([np.ones(len(d)), d.x, *[(d.yr == v) for v in range(2001, 2006)], *[(d.occ == k) * d.x2 for k in ("k0", "k1", "k2")]]).astype(float)
    assert np.allclose(fit.beta, np.linalg.lstsq(x, d.y, rcond=None)[0])


def test_two_stage(spark, panel):
    fit = feols("y ~ x | w + f | e ~ z1 + z2", spark.createDataFrame(panel), vcov="hetero")
    d = usable(panel, ["w", "f"])
    m = lambda v: d[v] - dummies(d, ["w", "f"]) @ np.linalg.lstsq(dummies(d, ["w", "f"]), d[v], rcond=None)[0]
    x, z, y = np.column_stack([m("e"), m("x")]), np.column_stack([m("x"), m("z1"), m("z2")]), m("y")
    hat = z @ np.linalg.solve(z.T @ z, z.T @ x)
    assert fit.names == ["e", "x"]
    assert np.allclose(fit.beta, np.linalg.solve(hat.T @ x, hat.T @ y))
    iv = fit.stats["iv"]
    assert iv["overid"]["df"] == 1 and 0 <= iv["overid"]["p_value"] <= 1
    assert fit.stats["first_stages"]["e"]["f"] > 50
    lo, hi = iv["anderson_rubin"]["confidence_set"][0]
    assert lo < fit.beta[0] < hi


def test_many_models_and_table(spark, panel):
    fits = feols("y + e ~ csw(x, x2) | sw0(w, w + f)", spark.createDataFrame(panel))
    assert isinstance(fits, MultiFit) and len(fits) == 12
    assert "(12) e" in etable(fits) and fits.tidy().columns[0] == "fml" and etable(fits, "md").startswith("|")
    assert fits.fetch_model(0).summary_json()


def test_slopes(spark, panel):
    fit = feols("y ~ x | f[x2] + yr", spark.createDataFrame(panel))
    d = usable(panel, ["f", "yr"])
    f = pd.get_dummies(d.f).to_numpy(float)
    z = np.column_stack([d.x, f, f * d.x2.to_numpy()[:, None], pd.get_dummies(d.yr).to_numpy(float)])
    assert np.allclose(fit.beta[0], np.linalg.lstsq(z, d.y, rcond=None)[0][0], atol=1e-8)


def test_predict_fixef_sample(spark, panel):
    df = spark.createDataFrame(panel)
    fit = feols("y ~ x + x2 | w + f", df)
    p = fit.predict().toPandas().dropna(subset=["prediction"])
    r = fit.resid().toPandas()
    assert np.allclose(np.sort(p.prediction), np.sort(r.y - r.resid), atol=1e-7)
    s = fit.sample().toPandas()
    assert len(s) == len(panel) and s.in_sample.sum() == fit.n_obs and set(s.dropped_because.dropna()) == {"missing", "singleton"}
    assert abs((r["fe_f"]).mean()) < 1e-8


def test_refusals(spark, panel):
    df = spark.createDataFrame(panel)
    for bad in ("y ~ x | w + w", "y ~ x | w[[x2]]", "y ~ foo(x)"):
        with pytest.raises(ValueError):
            feols(bad, df)
    with pytest.raises(NotImplementedError):
        feols("y ~ x | w + f", df, cluster="cl").with_vcov({"CRV3": "cl"})


def test_many_columns_over_cells_stay_off_the_driver(spark, monkeypatch):
    from ridgeline.plans import absorb

    rng = np.random.default_rng(4)
    d = pd.DataFrame({"row_id": np.arange(900), "f0": rng.integers(0, 60, 900), "f1": rng.integers(0, 7, 900)} | {f"u{i}": rng.normal(size=900) for i in range(40)})
    rows, names = spark.createDataFrame(d), [f"u{i}" for i in range(40)]
    dense = np.column_stack([pd.get_dummies(d.f0), pd.get_dummies(d.f1)]).astype(float)
    want = d[names].to_numpy() - dense @ (np.linalg.pinv(dense) @ d[names].to_numpy())
    got, most = absorb.collected, []
    monkeypatch.setattr(absorb, "collected", lambda df: (most.append(t.size), t)[1] if (t := got(df)) is not None else None)
    for cells, bound in ((500, 8 * 500), (10, 7 * 41)):  # on the driver; as a table
        a = absorb.Absorber(rows, ["f0", "f1"], most_cells=cells)
        a.system(["u0"])
        jobs = []
        if cells == 10:
            monkeypatch.setattr(a.s, "product", lambda p: jobs.append(1))
        most.clear()
        out = a.residualise(rows, names)[0].toPandas().set_index("row_id").sort_index()
        assert np.abs(out[names].to_numpy() - want).max() < 1e-8
        assert max(most) <= bound and not jobs


def test_sample_without_effects_is_written_once(spark, panel, monkeypatch):
    from ridgeline.operators import linear

    whole, written = linear.cut, []
    monkeypatch.setattr(linear, "cut", lambda df: (written.append(df.columns), whole(df))[1])
    d = panel[["y", "occ", "x"]].dropna()
    fit = feols("y ~ i(occ) + x", spark.createDataFrame(d))
    z = np.column_stack([np.ones(len(d)), d.occ == "k1", d.occ == "k2", d.x]).astype(float)
    assert fit.beta == pytest.approx(np.linalg.lstsq(z, d.y, rcond=None)[0]) and len(written) == 1

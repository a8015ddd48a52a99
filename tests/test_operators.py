import numpy as np
import pandas as pd
import pytest

from ridgeline.functions import special as sp
from ridgeline.operators import multcomp, treatment
from ridgeline.operators.bootstrap import refit_bootstrap, resample_groups
from ridgeline.operators.glm import feglm
from ridgeline.operators.graph import connected_components, cut_vertices
from ridgeline.operators.kss import exact_components, leave_out_kss
from ridgeline.operators.linear import feols
from ridgeline.plans.sample import drop_singletons


def test_distributions():
    assert sp.t_ppf(0.975, 10) == pytest.approx(2.228138851964939, abs=1e-9)
    assert sp.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert sp.f_sf(3.4928284767356, 2, 20) == pytest.approx(0.05, abs=1e-6)
    assert sp.ncx2_ppf(sp.ncx2_cdf(20.0, 3, 7.0), 3, 7.0) == pytest.approx(20.0)
    assert float(sp.log_norm_cdf(-40.0)) == pytest.approx(-804.608442, abs=1e-5)


def test_components(spark):
    rows = [(1, "A"), (1, "B"), (2, "B"), (3, "C"), (4, "C"), (4, "C"), (5, None), (6, "D")]
    c = connected_components(spark.createDataFrame(rows, "w long, f string"), ("w", "f"))
    assert [(r["component"], r["rows"], r["w"], r["f"]) for r in c.sizes().orderBy("component").collect()] == [(0, 3, 2, 2), (1, 3, 2, 1), (2, 1, 1, 1)]
    assert c.largest().count() == 3 and c.label().filter("component is null").count() == 1
    assert c.n_components == 3 and "next largest: 3 rows" in c.summary()
    assert {(r["f"], r["component"]) for r in c.levels("f").collect()} == {("A", 0), ("B", 0), ("C", 1), ("D", 2)}
    assert connected_components(spark.createDataFrame(rows, "w long, f string"), ("w", "f"), min_degree=(2, 1)).pairs.count() == 2


def test_cut_vertices_and_leave_one_out(spark):
    # workers 0 and 1 tie firms 0 and 1 twice; worker 2 alone ties firm 2
    a, b = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 1, 2])
    assert cut_vertices(a, b, 3, 3)[:3].tolist() == [False, False, True]
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)] + [(9, 0), (8, 1), (8, 1)], "w long, f long")
    kept = connected_components(df, ("w", "f"), leave_one_out=True).pairs.select("a").distinct().toPandas().a
    assert sorted(kept) == [0, 1, 8]


def test_singleton_chain(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 3, 1), (3, 3, 1), (4, 4, 1)], "a long, b long, n long").groupBy("a", "b").sum("n").withColumnRenamed("sum(n)", "n")
    assert [tuple(r) for r in drop_singletons(df, ["a", "b"]).select("a", "b", "n").collect()] == [(3, 3, 2)]


def test_balance(spark):
    rng = np.random.default_rng(0)
    d = pd.DataFrame({"t": rng.random(200) < 0.4, "x": np.round(rng.normal(size=200), 1), "w": rng.uniform(0.5, 2, 200)})
    r = treatment.weighted_balance(spark.createDataFrame(d), "t", ["x"], "w").toPandas().iloc[0]
    m = [np.average(d.x[d.t == f], weights=d.w[d.t == f]) for f in (True, False)]
    v = [(d.w * (d.x - m[i]) ** 2)[d.t == f].sum() / (d.w[d.t == f].sum() - (d.w[d.t == f] ** 2).sum() / d.w[d.t == f].sum()) for i, f in enumerate((True, False))]
    assert r.smd == pytest.approx((m[0] - m[1]) / np.sqrt((v[0] + v[1]) / 2))
    xs = np.sort(d.x.unique())
    gap = [abs(np.average(d.x[d.t] <= q, weights=d.w[d.t]) - np.average(d.x[~d.t] <= q, weights=d.w[~d.t])) for q in xs]
    assert r.ecdf_max == pytest.approx(max(gap)) and r.ecdf_mean == pytest.approx(np.mean(gap))
    ess = treatment.effective_sizes(spark.createDataFrame(d), "t", "w").toPandas().set_index("arm").ess
    assert ess[True] == pytest.approx(d.w[d.t].sum() ** 2 / (d.w[d.t] ** 2).sum())


def test_influence(spark, panel):
    d = panel.dropna().assign(g=lambda d: d.x > 0)
    r = treatment.weighted_mean_difference(spark.createDataFrame(d), "y", "g", "wt", ["cl"], df_k=None)
    w1, w0 = d.wt[d.g], d.wt[~d.g]
    m1, m0 = np.average(d.y[d.g], weights=w1), np.average(d.y[~d.g], weights=w0)
    phi = np.where(d.g, d.wt * (d.y - m1) / w1.sum(), -d.wt * (d.y - m0) / w0.sum())
    s = pd.Series(phi).groupby(d.cl.to_numpy()).sum()
    assert r["estimate"] == pytest.approx(m1 - m0) and r["std_error"] == pytest.approx(np.sqrt((s**2).sum() * len(s) / (len(s) - 1)))


def test_ipw(spark, panel):
    d = panel.dropna().assign(t=lambda d: (d.yb > 0).astype(int))
    df = spark.createDataFrame(d)
    first = treatment.BinaryFirstStage(feglm("t ~ x + x2", df, "logit"))
    r = treatment.ipw_mean_difference(df, "y", "t", first, "att")
    p = first.prob().toPandas().prob.to_numpy()
    w = np.where(d.t == 1, 1, p / (1 - p))
    t = d.t.to_numpy() == 1
    y = d.y.to_numpy()
    assert r["estimate"] == pytest.approx(y[t].mean() - np.average(y[~t], weights=w[~t])) and r["std_error"] > 0


def test_wild_bootstrap_and_tests(spark, panel):
    df = spark.createDataFrame(panel)
    fits = feols("y + e ~ x + x2 | w", df, vcov={"CRV1": "w"})
    r = fits.fetch_model(0).wildboottest("x", reps=199)
    assert r["p_value"] < 0.05 and r["t"] == pytest.approx(float(fits.fetch_model(0).tidy()["t value"][0]))
    assert (multcomp.holm(fits, "x2")["Holm Pr(>|t|)"] >= multcomp.holm(fits, "x2")["Pr(>|t|)"] - 1e-15).all()
    assert multcomp.rwolf(fits, "x", 99, 1)["RW Pr(>|t|)"].between(0, 1).all() and multcomp.wyoung(fits, "x", 99, 1)["WY Pr(>|t|)"].between(0, 1).all() and multcomp.bonferroni(fits, "x")["Bonferroni Pr(>|t|)"].le(1).all()


def test_resample(spark, panel):
    df = spark.createDataFrame(panel)
    one = resample_groups(df, "w", 3, cluster="cl")
    assert one.select("unit_id").distinct().count() >= one.select("w").distinct().count()
    assert one.count() == resample_groups(df, "w", 3, cluster="cl").count()
    r = refit_bootstrap(df, lambda d: d.agg({"x2": "avg"}).toPandas().iloc[0].rename({"avg(x2)": "m"}), "w", 5)
    assert len(r.draws()) == 5 and list(r.confint().columns) == ["Coefficient", "Estimate", "Lower", "Upper"] and r.failures().empty


@pytest.mark.parametrize("w", [None, "wt"])
def test_normal_equations(spark, panel, w):
    fit = feols("y ~ x | w + f", spark.createDataFrame(panel), weights=w)
    used = fit.sample().filter("in_sample").drop("dropped_because").toPandas()
    new = used.sample(40, random_state=1).assign(v=lambda d: np.arange(40) - 10.0)
    s = fit.solve_normal_equations(spark.createDataFrame(new), ["v"])
    z = lambda d: np.column_stack([d.x, *[d.w == k for k in sorted(used.w.unique())], *[d.f == k for k in sorted(used.f.unique())]]).astype(float)
    zu, wt = z(used), used[w].to_numpy() if w else np.ones(len(used))
    u = np.linalg.pinv(zu.T @ (wt[:, None] * zu)) @ (z(new).T @ new.v.to_numpy())
    assert s.coef().loc["x", "v"] == pytest.approx(u[0], abs=1e-9)
    assert np.allclose(s.predict().toPandas().set_index("row_id").v.loc[used.row_id], zu @ u, atol=1e-8)


def test_leave_out_components(spark):
    rng = np.random.default_rng(5)
    n = 120
    d = pd.DataFrame({"w": np.repeat(np.arange(30), 4), "f": rng.integers(0, 5, n)})
    d["y"] = rng.normal(size=30)[d.w] + rng.normal(size=5)[d.f] + 0.5 * rng.normal(size=n)
    k = leave_out_kss("y ~ 1 | w + f", spark.createDataFrame(d), psi="f", n_draws=24, block=12, leave_out="observation")
    x = exact_components(d.y.to_numpy(), d.w.to_numpy(), d.f.to_numpy())
    for c in ("var_psi", "var_alpha", "cov"):
        assert k.plug_in[c] == pytest.approx(x["plug_in"][c], abs=1e-7)
        assert k.bias[c] == pytest.approx(x["bias"][c], abs=0.7 * max(abs(v) for v in x["bias"].values()))


def test_variance_components_are_registered_with_all_draws(monkeypatch):
    import inspect

    from ridgeline.operators.kss import leave_out_kss
    from ridgeline.queries import graphs

    seen = {}

    class Result:
        def tidy(self):
            return None

    def called(*args, **options):
        bound = inspect.signature(leave_out_kss).bind(*args, **options)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return Result()

    monkeypatch.setattr(graphs, "leave_out_kss", called)
    monkeypatch.setattr(graphs, "table", lambda *a: None)
    monkeypatch.setattr(graphs, "frame", lambda *a: None)
    graphs.variance_components(None, "")
    assert (seen["n_draws"], seen["block"]) == (250, 50)


def test_wild_bootstrap_counts_the_draw_that_gives_the_statistic_again(spark):
    # three clusters, all eight patterns, a small slope about a large mean: exact p by fractions
    from fractions import Fraction
    from itertools import product

    rng = np.random.default_rng(9)
    d = pd.DataFrame({"g": np.repeat([0, 1, 2], 100), "x": rng.integers(0, 50, 300) + 200_000, "y": rng.integers(0, 11, 300) + 5_000})
    k = [tuple(Fraction(int(v)) for v in (len(q), q.x.sum(), (q.x**2).sum(), q.y.sum(), (q.x * q.y).sum())) for _, q in d.groupby("g")]
    n, sx, xx, sy, xy = (sum(c) for c in zip(*k, strict=True))
    det = n * xx - sx * sx

    def square_t(scores):  # of the second coefficient, from clusters' scores
        t1, t2 = (sum(c) for c in zip(*scores, strict=True))
        d1, d2 = (xx * t1 - sx * t2) / det, (n * t2 - sx * t1) / det
        return d2**2 / sum((-sx * (u - c[0] * d1 - c[1] * d2) + n * (v - c[1] * d1 - c[2] * d2)) ** 2 for (u, v), c in zip(scores, k, strict=True))

    null = [(c[3] - c[0] * sy / n, c[4] - c[1] * sy / n) for c in k]
    draws = [square_t([(z * u, z * v) for z, (u, v) in zip(signs, null, strict=True)]) for signs in product((1, -1), repeat=3)]
    t = feols("y ~ x", spark.createDataFrame(d), vcov={"CRV1": "g"}).wildboottest("x", reps=999)
    assert t["p_value"] == float(sum(q >= draws[0] for q in draws)) / 8


def test_core_is_peeled_to_the_end(spark):
    # a path of levels: each round takes one end off, more rounds than the twelve of degree_core's SQL
    df = spark.createDataFrame([(i, i + j) for i in range(15) for j in (0, 1)] + [(x, y) for x in (100, 101) for y in (200, 201)], "a long, b long")
    assert {tuple(r) for r in connected_components(df, ("a", "b"), min_degree=(2, 2)).pairs.select("a", "b").collect()} == {(x, y) for x in (100, 101) for y in (200, 201)}


def test_few_rows_decide_which_level_disconnects():
    import pyarrow as pa

    from ridgeline.operators.graph import ties

    rng = np.random.default_rng(2)
    for n, m in ((6, 5), (25, 12), (400, 30), (3000, 40)):
        rows = [sorted(set(rng.choice(m, rng.integers(2, 4)).tolist()) | {int(k) % m}) for k in rng.integers(0, m, n)]
        if n <= 25:
            rows += [[m - 1, m], [m, m + 1]]
        lists = [pa.record_batch({"a": pa.array(range(i, min(i + 7, len(rows)))), "b": pa.array(rows[i : i + 7])}) for i in range(0, len(rows), 7)]
        half = len(lists) // 2
        kept = list(ties(iter([*ties(iter(lists[:half])), *ties(iter(lists[half:]))])))  # in two parts, then what stays of both

        def cuts(chosen):
            names = sorted(chosen)
            a = np.array([i for i, k in enumerate(names) for _ in rows[k]], int)
            b = np.array([x for k in names for x in rows[k]], int)
            return {names[i] for i in np.flatnonzero(cut_vertices(a, b, len(names), m + 2)[: len(names)])}

        own = [k for t in kept for k in t.column(0).to_pylist()]
        assert cuts(own) == cuts(range(len(rows))) and len(own) <= 2 * (m + 1)

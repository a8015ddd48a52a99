"""Poisson, logit and probit models with fixed effects, by iterated weighted least squares."""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import formula as fo
from ridgeline.operators.families import FAMILIES
from ridgeline.operators.linear import Meats, Panel, attach, cluster_columns, independent, lazy_variances, prepare
from ridgeline.operators.results import FitResult, MultiFit, vcov_key
from ridgeline.plans.absorb import MOST_CELLS, Absorber, Cells, collected, conjugate_gradients, gram, uploaded
from ridgeline.plans.cache import Run, cut, discard
from ridgeline.plans.sample import separated
from ridgeline.sources import source, with_row_id

log = logging.getLogger("ridgeline")


def without_effects(v: np.ndarray, codes: list[np.ndarray], sizes: list[int], w: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Columns of v less the effects of levels under weights w, and the effects of all dimensions but the first (one after another)."""
    if not codes:
        return v, np.zeros((0, v.shape[1]))
    total = np.bincount(codes[0], w, sizes[0])
    gamma = np.zeros((0, v.shape[1]))
    if len(codes) > 1:
        offset = np.cumsum([0, *sizes[1:]])
        own = [c + o for c, o in zip(codes[1:], offset, strict=False)]
        cells = Cells(codes[0], own, int(offset[-1]), [w], [total])
        right = np.stack([cells.without_groups([w * v[:, j]]) for j in range(v.shape[1])], axis=1)
        gamma, _ = conjugate_gradients(cells.product, cells.diagonal(), right, tol)
        v = v - sum(gamma[c] for c in own)
    means = np.stack([np.bincount(codes[0], w * v[:, j], sizes[0]) / total for j in range(v.shape[1])], axis=1)
    return v - means[codes[0]], gamma


def on_cells(p: Panel, y: str, xs: list[str], family, weight, mean: float, tol: float, most: int, inner: float, fixed: dict | None, most_cells: int) -> tuple[DataFrame, list[float], bool] | None:
    """The steps on cells: rows that agree in covariates, levels and offset share a linear predictor, and their weight and mean outcome are all that the steps need.

    Returns the rows with their linear predictor eta, the log-likelihoods of the steps and whether these converged; None if cells are too many for the driver (or slopes vary by level), and the
    steps then run over the rows."""
    held = [*p.dims, *[p.variables[x] for x in xs], *(p.variables[n] for n in fixed or ()), *(["offset"] if "offset" in p.rows.columns else [])]
    held = list(dict.fromkeys(held))
    if p.slopes:
        return None
    cells = cut(p.rows.groupBy(*held).agg(F.sum(weight).alias("__n"), (F.sum(weight * F.col(p.variables[y])) / F.sum(weight)).alias("__y")))
    if cells.count() * (len(held) + 2) > 8 * most_cells:
        discard(cells)
        return None
    t = collected(cells)
    discard(cells)
    n, mu = t["__n"].to_numpy(float), t["__y"].to_numpy(float)
    x = t[[p.variables[v] for v in xs]].to_numpy(float).reshape(len(t), len(xs))
    known = t["offset"].to_numpy(float).copy() if "offset" in t else np.zeros(len(t))
    for name, b in (fixed or {}).items():
        known += b * t[p.variables[name]].to_numpy(float)
    levels, codes = zip(*[np.unique(t[d].to_numpy(), return_inverse=True) for d in p.dims], strict=True) if p.dims else ((), ())
    codes, sizes = list(codes), [len(v) for v in levels]
    eta, last, path, keep = family.first(mu, mean), -math.inf, [], None
    effects = np.zeros((0, 1))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for it in range(most):
            w, step, _ = family.arrays(mu, eta)
            w = n * w
            z = eta - known + step
            u, gamma = without_effects(np.column_stack([z, x]), codes, sizes, w, min(inner, 1e-10))
            a = u.T @ (u * w[:, None])
            keep = independent(a[1:, 1:], (x * x * w[:, None]).sum(axis=0)) if keep is None else keep
            at = [j + 1 for j in keep]
            beta = np.linalg.solve(a[np.ix_(at, at)], a[at, 0]) if at else np.empty(0)
            new = z - (u[:, 0] - u[:, at] @ beta) + known
            ll = float((n * family.arrays(mu, new)[2]).sum())
            tries = 0
            while not (math.isfinite(ll) and ll >= last - 1e-12 * abs(last)) and it and tries < 30:
                new, tries = (new + eta) / 2, tries + 1
                ll = float((n * family.arrays(mu, new)[2]).sum())
            change, last, eta = abs(ll - last) / (0.1 + abs(ll)), ll, new
            path.append(ll)
            effects = gamma[:, [0]] - gamma[:, at] @ beta[:, None]
            if change < tol * 1e-2:
                break
    if not np.isfinite(eta).all():
        return None
    rows = p.rows
    linear = sum((F.lit(float(b)) * F.col(p.variables[xs[j]]) for b, j in zip(beta, keep or [], strict=True)), F.lit(0.0))
    linear = linear + sum((F.lit(float(b)) * F.col(p.variables[m]) for m, b in (fixed or {}).items()), F.lit(0.0)) + (F.col("offset") if "offset" in p.rows.columns else F.lit(0.0))
    if p.dims:
        # the first dimension's effect is what the linear predictor has besides; every cell of a level tells the same
        rest, at = eta - known - x[:, keep or []] @ beta, 0
        for c, k in zip(codes[1:], sizes[1:], strict=True):
            rest = rest - effects[at : at + k, 0][c]
            at += k
        first = np.zeros(sizes[0])
        first[codes[0]] = rest
        own = [first, *np.split(effects[:, 0], np.cumsum(sizes[1:])[:-1])] if len(sizes) > 1 else [first]
        for d, names, e in zip(p.dims, levels, own, strict=True):
            rows = rows.join(uploaded(rows.sparkSession, {"__l": names, f"__e_{d}": e}), F.col(d) == F.col("__l")).drop("__l")
            linear = linear + F.col(f"__e_{d}")
    return cut(rows.select(*p.rows.columns, linear.alias("eta"))), path, change < tol


def irls(p: Panel, y: str, xs: list[str], family, weight, tol: float, most: int, inner: float, fixed: dict | None = None, most_cells: int = MOST_CELLS) -> dict:
    """The steps: each regresses the working response on the covariates and the fixed effects under the working weights.

    Steps run on cells until they converge there, if the driver takes the cells; then a single step over the rows is left, for what is asked of them later: sums of many rows differ by
    rounding from run to run, so that their deviance says less of convergence than that of the cells. A step that raises the deviance is halved. The rows are written out once a step, so
    that a lost executor costs one step."""
    yc = F.col(p.variables[y])
    mean = p.rows.agg(F.sum(weight * yc) / F.sum(weight)).first()[0]
    offset = F.col("offset") if "offset" in p.rows.columns else F.lit(0.0)
    begun = on_cells(p, y, xs, family, weight, mean, tol, most, inner, fixed, most_cells)
    rows = cut(p.rows.withColumn("eta", family.start(yc, mean))) if begun is None else begun[0]
    loss = lambda r, eta="eta": r.agg(F.sum(weight * family.deviance(yc, F.col(eta)))).first()[0]
    dev, path, keep, converged, halvings = math.inf, [], None, False, 0
    beta, last, cell_steps = np.empty(0), None, 0
    if begun is not None:
        dev, cell_steps = loss(rows), len(begun[1])
    for it in range(1, most + 1):
        work = rows.withColumns({"ww": weight * family.weight(yc, F.col("eta")), "u0": F.col("eta") - offset + family.step(yc, F.col("eta"))} | {f"u{i + 1}": F.col(p.variables[x]) for i, x in enumerate(xs)})
        if fixed:
            work = work.withColumn("u0", F.col("u0") - sum(F.lit(float(b)) * F.col(p.variables[n]) for n, b in fixed.items()))
        names = ["u0", *[f"u{i + 1}" for i in range(len(xs))]]
        effects = absorber = None
        zed = work.withColumn("z", F.col("u0"))
        if p.dims:
            absorber = Absorber(zed, p.dims, "ww", tuple(p.slopes))
            out, effects = absorber.residualise(absorber.rows, names, inner)
        else:
            out = zed
        residual = cut(out)
        out = residual
        a, raw = gram(out, names, "ww", [F.array(*[F.sum(F.col("ww") * F.col(p.variables[x]) ** 2) for x in xs] or [F.lit(0.0)])])
        if keep is None:
            own = independent(a[1:, 1:], np.array(raw[0], float)[: len(xs)]) if xs else []
            keep = [xs[i] for i in own]
            if xs and not keep:
                raise ValueError("all covariates are collinear with each other or with the fixed effects")
        at = [xs.index(n) + 1 for n in keep]
        beta = np.linalg.solve(a[np.ix_(at, at)], a[at, 0]) if at else np.empty(0)
        e = F.col("u0")
        for b, j in zip(beta, at, strict=True):
            e = e - F.lit(float(b)) * F.col(f"u{j}")
        known = sum((F.lit(float(b)) * F.col(p.variables[n]) for n, b in fixed.items()), F.lit(0.0)) if fixed else F.lit(0.0)
        out = cut(out.withColumn("e", e).withColumns({"eta_old": F.col("eta"), "eta": F.col("z") - F.col("e") + offset + known}))
        new, tries = loss(out), 0
        ok = lambda v: v is not None and math.isfinite(v) and (v < dev or abs(v - dev) / (0.1 + abs(dev)) < tol)  # noqa: B023, E731
        done = begun is not None and begun[2]
        while not done and not ok(new) and math.isfinite(dev) and tries < 30:
            out = cut(out.withColumn("eta", (F.col("eta") + F.col("eta_old")) / 2))
            new, tries = loss(out), tries + 1
        halvings += tries
        discard(residual)
        last = {"out": out, "effects": effects, "absorber": absorber, "a": a, "at": at}
        path.append(new)
        change = abs(new - dev) / (0.1 + abs(dev)) if math.isfinite(dev) else math.inf
        dev = new
        rows = out.select(*[c for c in p.rows.columns], "eta")
        if change < tol or done:
            converged = True
            break
    if not converged:
        log.warning("no convergence within %d steps", most)
    ll, sw = rows.agg(F.sum(weight * family.loglik(yc, F.col("eta"))), F.sum(weight)).first()
    null = p.rows.agg(F.sum(weight * family.loglik(yc, F.lit(family.null(mean))))).first()[0]
    return {"beta": beta, "keep": keep or [], "deviance": dev, "path": path, "iterations": len(path) + cell_steps, "cell_steps": cell_steps, "converged": converged, "halvings": halvings, "loglik": ll, "loglik_null": null, "rows": rows, **last}


def fit_glm(p: Panel, d: fo.Design, family, vcov, rule: str, tol: float, most: int, inner: float, within_r2: bool, text: str) -> FitResult:
    """One model on a prepared sample."""
    weight = F.lit(1.0)
    if p.weights:
        scale = 1.0 if p.kind == "fweights" else p.rows.agg(F.avg("w")).first()[0]  # analytic weights count relative to their mean
        weight = F.col("w") / F.lit(scale)
    xs = list(d.x)
    s = irls(p, d.outcome, xs, family, weight, tol, most, inner)
    keep, at, a = s["keep"], s["at"], s["a"]
    k = len(keep)
    bread = np.linalg.inv(a[np.ix_(at, at)]) if k else np.empty((0, 0))
    own = Panel(**{**p.__dict__, "weights": "ww"})
    own.rows = s["out"]
    meats = Meats(own, s["out"], [f"u{j}" for j in at], "e", bread, k, math.nan, rule, iid_n1=True)
    default = vcov if vcov is not None else "iid"
    vcovs, dfs = lazy_variances(meats, k)
    ll, ll0, n, params = s["loglik"], s["loglik_null"], p.n_obs, k + meats.k_fe
    stats = {"deviance": s["deviance"], "loglik": ll, "loglik_null": ll0, "pseudo_r2": 1 - ll / ll0 if ll0 else math.nan, "aic": -2 * ll + 2 * params, "bic": -2 * ll + math.log(n) * params, "k_fe": meats.k_fe, "iterations": s["iterations"], "converged": s["converged"]}
    if p.dims and within_r2 and xs:
        base = irls(p, d.outcome, [], family, weight, tol, most, inner)
        stats["pseudo_r2_within"] = 1 - ll / base["loglik"] if base["loglik"] else math.nan
    fit = FitResult(d.outcome, keep, s["beta"], vcovs, dfs, vcov_key(default), n, stats, [f.name for f in p.fe], {}, [x for x in xs if x not in keep], family.name, text)
    out = s["out"].withColumn("resid_response", F.col(p.variables[d.outcome]) - family.mean(F.col("eta")))
    fit.parts |= {"rows": out, "panel": p, "make_vcov": meats.make, "meats": meats, "design": d, "irls": s, "family": family, "weight": weight, "bread": bread}
    solved = s["effects"]
    view = Panel(**p.__dict__)
    view.variables, view.weights = {d.outcome: p.variables[d.outcome]} | {x: p.variables[x] for x in xs}, None
    attach(fit, view, d, s["absorber"], solved, y="z")
    effects_ = [F.col(f"fe_{dim}").alias(f"fe_{f.name}") for dim, f in zip(p.dims, p.fe, strict=True)]
    weights = [F.col(p.weights).alias("weights")] if p.weights else []
    fit.parts["resid"] = lambda: fit.parts["with_effects"]().select(*view.carried(), "row_id", *weights, F.col(p.variables[d.outcome]).alias(d.outcome), *effects_, "xb", F.col("resid_response").alias("resid"), "eta", family.mean(F.col("eta")).alias("fitted"), F.col("e").alias("resid_working"))
    linear = fit.parts["predict"]

    def predict(newdata=None, type: str = "link", name: str = "prediction") -> DataFrame:
        df = linear(newdata, type, name)
        link = F.col(name)
        if fit.parts.get("offset") is not None:
            link = link + fit.parts["offset"].cast("double")
        return df.withColumn(name, link if type == "link" else family.mean(link))

    fit.parts["predict"] = predict
    _ = fit.vcov
    return fit


def _estimate(fml: str, data, family_name: str, vcov=None, cluster=None, fe_dof: str = "exact", weights=None, weights_type: str = "aweights", offset=None, stream=None, connected=None, min_degree=None, fixef_rm: str = "singleton", separation_check: bool = True, iwls_tol: float = 1e-8, iwls_maxiter: int = 25, tol: float = 1e-10, within_pseudo_r2: bool = False) -> FitResult | MultiFit:
    if family_name not in FAMILIES:
        raise ValueError(f"families are {', '.join(FAMILIES)}; for gaussian use feols")
    run = Run()
    with run:
        return _fit_families(run, fml, source(data), FAMILIES[family_name], vcov, cluster, fe_dof, weights, weights_type, offset, stream, connected, min_degree, fixef_rm, separation_check, iwls_tol, iwls_maxiter, tol, within_pseudo_r2)


def _fit_families(run: Run, fml, df, family, vcov, cluster, fe_dof, weights, weights_type, offset, stream, connected, min_degree, fixef_rm, separation_check, iwls_tol, iwls_maxiter, tol, within_pseudo_r2) -> FitResult | MultiFit:
    df = df if "row_id" in df.columns else with_row_id(df)
    if vcov is None and cluster:
        vcov = {"CRV1": cluster}
    if isinstance(vcov, dict) and "CRV3" in vcov:
        raise NotImplementedError("CRV3 is for linear models")
    compiler, fits = fo.Compiler(df), []
    for m in fo.parse(fml):
        if m.endogenous:
            raise NotImplementedError("instruments are for linear models")
        d = compiler.design(m)
        extra = {"offset": fo.expression(offset) if isinstance(offset, str) else offset} if offset is not None else None
        p = prepare(df, m.fe, {d.outcome: fo.expression(d.outcome)} | d.x, weights, weights_type, cluster_columns([vcov]), stream, extra, connected=connected, min_degree=min_degree, fixef_rm=fixef_rm)
        y = p.variables[d.outcome]
        lo, hi, odd = p.rows.agg(F.min(y), F.max(y), F.sum((~F.col(y).isin(0.0, 1.0)).cast("int"))).first()
        family.check(lo, hi, odd)
        if separation_check and p.dims:
            rows, gone = separated(p.rows, p.dims, y, family.name)
            if gone is not None:
                p.gone = gone if p.gone is None else p.gone.union(gone)
            n = rows.agg(F.count("*"), F.sum("w") if p.weights else F.lit(0.0)).first()
            p.lost["separation"], p.rows = p.n - n[0], rows
            p.n, p.n_obs = n[0], n[1] if p.weights and weights_type == "fweights" else n[0]
        fit = fit_glm(p, d, family, vcov, fe_dof, iwls_tol, iwls_maxiter, tol, within_pseudo_r2, fml)
        fit.parts |= {"run": run, "source": df, "offset": None if extra is None else extra["offset"]}
        fits.append(fit)
    return fits[0] if len(fits) == 1 else MultiFit(fits)


def fepois(fml: str, data, **options) -> FitResult | MultiFit:
    """Poisson pseudo-maximum likelihood with fixed effects."""
    return _estimate(fml, data, "poisson", **options)


def feglm(fml: str, data, family: str = "logit", **options) -> FitResult | MultiFit:
    """Logit or probit with fixed effects."""
    return _estimate(fml, data, family, **options)


def bias_corrected(fit: FitResult, time: str | None = None, lags: int = 0, refit: bool = False) -> dict:
    """Coefficients of a binary model less their incidental-parameter bias (analytic): one half for each fixed effect of the
    sum over its levels of sum(x~ * w2) / sum(w), where w2 is the derivative of the working weights times the deviation of the link.

    With lags, for regressors that answer to past outcomes: time names the fixed effect of the period, and the other one, the unit, adds the products of a row's
    weighted regressors with the scores of up to `lags` rows before it in its unit, scaled by T / (T - lag). refit: estimates the fixed effects again with
    the corrected coefficients held; that fit is returned, too."""
    p, s, fam = fit.parts["panel"], fit.parts["irls"], fit.parts["family"]
    if fam.name == "poisson" or len(p.dims) not in (1, 2):
        raise ValueError("the correction is for logit and probit with one or two fixed effects")
    names = [f.name for f in p.fe]
    if lags and (len(p.dims) != 2 or time not in names or len(p.fe[names.index(time)].keys) != 1):
        raise ValueError("lags need two fixed effects, of which time names the period, one column")
    with fit.parts["run"]:
        return _bias(fit, p, s, fam, names, time, lags, refit)


def _bias(fit: FitResult, p: Panel, s: dict, fam, names: list[str], time, lags: int, refit: bool) -> dict:
    eta, w, k = F.col("eta_old"), fit.parts["weight"], len(fit.names)
    mu = fam.mean(eta)
    second = w * mu * (1 - mu) * (1 - 2 * mu) if fam.name == "logit" else -F.col("ww") * eta
    total = np.zeros(k)
    for d in p.dims:
        sums = s["out"].groupBy(d).agg(F.sum("ww").alias("w"), *[F.sum(second * F.col(f"u{j}")).alias(f"b{i}") for i, j in enumerate(s["at"])])
        total += 0.5 * np.array(sums.agg(*[F.sum(F.col(f"b{i}") / F.col("w")) for i in range(k)]).first(), float)
    if lags:
        from pyspark.sql import Window

        unit, period = (p.dims[i] for i in ((1 - names.index(time)), names.index(time)))
        score = w * (F.col(p.variables[fit.outcome]) - mu)
        if fam.name == "probit":  # the density over the variance: weight times step, over the distance of outcome and mean
            score = F.col("ww") * fam.step(F.col(p.variables[fit.outcome]), eta)
        order = Window.partitionBy(unit).orderBy(period)
        rows = s["out"].withColumn("score", score)
        rows = rows.withColumns({f"l{n}": F.lag("score", n).over(order) for n in range(1, lags + 1)})
        t = F.count("*")
        term = lambda j: sum((F.when(t > n, F.coalesce(F.sum(F.col("ww") * F.col(f"u{j}") * F.col(f"l{n}")), F.lit(0.0)) * t / (t - n)).otherwise(0.0) for n in range(1, lags + 1)), F.lit(0.0))
        own = rows.groupBy(unit).agg(F.sum("ww").alias("w"), *[term(j).alias(f"b{i}") for i, j in enumerate(s["at"])])
        total += np.array(own.agg(*[F.sum(F.col(f"b{i}") / F.col("w")) for i in range(k)]).first(), float)
    bias = -fit.parts["bread"] @ total
    corrected = dict(zip(fit.names, (fit.beta - bias).tolist(), strict=True))
    out = {"estimate": corrected, "bias": dict(zip(fit.names, bias.tolist(), strict=True)), "time": time, "lags": lags}
    if refit:
        held = irls(p, fit.outcome, [], fam, w, 1e-8, 25, 1e-10, corrected)
        again = FitResult(fit.outcome, [], np.empty(0), {fit.vcov_type: np.empty((0, 0))}, {fit.vcov_type: fit.df}, fit.vcov_type, fit.n_obs, {"deviance": held["deviance"], "loglik": held["loglik"], "converged": held["converged"]}, fit.fe, {}, [], fit.family, fit.formula)
        again.parts |= {"rows": held["out"], "panel": p, "run": fit.parts["run"], "irls": held, "family": fam, "source": fit.parts["source"]}
        view = Panel(**p.__dict__)
        view.variables, view.weights = {fit.outcome: p.variables[fit.outcome]}, None
        attach(again, view, fit.parts["design"], held["absorber"], held["effects"], y="z")
        out["refit"] = again
    return out

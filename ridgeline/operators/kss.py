"""Leave-out variance components of two-way fixed effects (workers and firms, say)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import formula as fo
from ridgeline.operators.linear import feols
from ridgeline.operators.normal import project
from ridgeline.operators.leaveout_inference import COMPONENTS, MOST_ROWS, ComponentSE, WeakIdDiagnostics, inference
from ridgeline.plans.absorb import uploaded
from ridgeline.plans.cache import Run, cut


@dataclass
class LeaveOut:
    """Plug-in and bias-corrected variance components."""

    n: float
    plug_in: dict[str, float]
    bias: dict[str, float]
    max_leverage: float
    draws: int
    level: str
    diagnostics: dict = field(default_factory=dict)
    se: dict[str, ComponentSE] = field(default_factory=dict)
    weak: dict[str, WeakIdDiagnostics] = field(default_factory=dict)
    intervals: dict[str, tuple[float, float]] = field(default_factory=dict)  # that allow for one weakly identified direction

    @property
    def leave_out(self) -> dict[str, float]:
        return {k: self.plug_in[k] - self.bias[k] for k in self.plug_in}

    @property
    def correlation(self) -> float:
        v = self.leave_out
        return v["cov"] / math.sqrt(v["var_psi"] * v["var_alpha"]) if v["var_psi"] > 0 and v["var_alpha"] > 0 else math.nan

    def tidy(self) -> pd.DataFrame:
        out = pd.DataFrame({"component": COMPONENTS, "plug_in": [self.plug_in[c] for c in COMPONENTS], "bias": [self.bias[c] for c in COMPONENTS], "leave_out": [self.leave_out[c] for c in COMPONENTS]})
        if self.se:
            out["std_error"] = [self.se[c].std_error if c in self.se else math.nan for c in COMPONENTS]
        if self.weak:
            out["q"] = [self.weak[c].q if c in self.weak else 0 for c in COMPONENTS]
        return out

    def summary(self) -> str:
        return f"leave-out components over {self.n:g} rows ({self.level} level, {self.draws} draws, largest leverage {self.max_leverage:.4f})\n{self.tidy().to_string(index=False)}\ncorrelation {self.correlation:.4f}"


def signs(n: int, seed: int, block: int) -> list:
    """n columns of +-1 that hang on row_id, seed and draw alone."""
    return [(F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(block + i)), F.lit(2)) * 2 - 1).cast("double").alias(f"d{i}") for i in range(n)]


def leave_out_kss(fml: str, data, psi: str | None = None, n_draws: int = 250, seed: int = 1, block: int = 50, leave_out: str = "match", weights: str | None = None, prune: bool = True, **how) -> LeaveOut:
    """Variance of psi and alpha and their covariance for ``y ~ x | alpha + psi``, less the bias that estimated effects bring.

    The sample is the leave-one-out connected set. leave_out="match": covariates are taken out first and rows collapse to matches, so that
    shocks may be correlated within one; "observation": rows are left out singly. Leverages P_ii come from random projections, P and M = I - P from the
    same draws so that they add to one, with the correction of order 1/draws of their ratio; the bias is the trace of
    B diag(sigma_i^2), by random vectors through both sides' effects. Draws run as columns, `block` at a time. Further options: see leave_out_result().
    """
    m = fo.parse(fml)[0]
    if len(m.fe) != 2:
        raise ValueError("two fixed effects are expected")
    names = [f.name for f in m.fe]
    psi = psi or names[1]
    with feols(fml, data, weights=weights, connected="leave_one_out" if prune else "largest", fixef_rm="none", stream=next(n for n in names if n != psi)) as first:
        return leave_out_result(first, psi, n_draws, seed, block, leave_out, **how)


def leave_out_result(fit, psi: str | None = None, n_draws: int = 250, seed: int = 1, block: int = 50, leave_out: str = "match", stayers: str | None = None, centering: str = "reference", se: bool = False, se_draws: int = 100, diagnose: bool = False, weak_interval: bool = False, confidence: float = 0.95) -> LeaveOut:
    """leave_out_kss on a fit.

    stayers: whose variance levels of alpha with one level of psi get: "own", their own like all others (the rule for observations); "firm_mean", that of
    movers' rows of the same level of psi; "drop", none; "within_match" (the rule for matches), from the rows of their match about the fitted mean.
    centering: of the outcome in variances: "weighted", its weighted mean; "reference", sqrt(w) y about its plain mean. se, diagnose and weak_interval add
    standard errors, the shares of the largest directions, and intervals that allow for one such direction; these take rows to the driver, MOST_ROWS at most.
    """
    if leave_out not in ("match", "observation"):
        raise ValueError("leave_out is 'match' or 'observation'")
    if centering not in ("reference", "weighted"):
        raise ValueError("centering is 'reference' or 'weighted'")
    stayers = stayers or ("within_match" if leave_out == "match" else "own")
    if stayers not in ("own", "firm_mean", "drop", "within_match") or (stayers == "within_match") != (leave_out == "match"):
        raise ValueError("stayers is 'own', 'firm_mean' or 'drop' for observations, and 'within_match' for matches")
    with Run() as run:
        try:
            return _leave_out(fit, psi, n_draws, seed, block, leave_out, stayers, centering, se, se_draws, diagnose, weak_interval, confidence)
        finally:
            run.cleanup()


def _leave_out(fit, psi, n_draws, seed, block, leave_out, stayers, centering, se, se_draws, diagnose, weak_interval, confidence) -> LeaveOut:
    p = fit.parts["panel"]
    if len(p.dims) != 2:
        raise ValueError("two fixed effects are expected")
    psi = psi or p.fe[1].name
    side = [f.name for f in p.fe].index(psi)
    alpha_dim, psi_dim = p.dims[1 - side], p.dims[side]
    w = F.col("w") if p.weights else F.lit(1.0)
    y = F.col(p.variables[fit.outcome]) - sum((F.lit(float(b)) * F.col(p.variables[n]) for b, n in zip(fit.beta, fit.names, strict=True)), F.lit(0.0))
    rows = person = p.rows.select("row_id", F.col(alpha_dim).alias("alpha"), F.col(psi_dim).alias("psi"), w.alias("wt"), y.alias("y"))
    if leave_out == "match":
        rows = rows.groupBy("alpha", "psi").agg(F.min("row_id").alias("row_id"), F.sum("wt").alias("wt"), (F.sum(F.col("wt") * F.col("y")) / F.sum("wt")).alias("y"))
        movers = rows.groupBy("alpha").agg(F.count("*").alias("c"))
        rows = rows.join(movers, "alpha")
    else:
        movers = rows.groupBy("alpha").agg(F.count("*").alias("c"))
        rows = rows.join(movers, "alpha")
    rows = cut(rows)
    inner = feols("y ~ 1 | alpha + psi", rows.select("row_id", "alpha", "psi", "wt", "y", "c"), weights="wt", fixef_rm="none", stream="alpha", tol=1e-12)
    q = inner.parts["panel"]
    used = inner.parts["with_effects"]().select("row_id", "f0", "f1", "w", F.col("v0").alias("y"), "e", F.col("fe_f0").alias("a"), F.col("fe_f1").alias("b"))
    used = cut(used.join(rows.select("row_id", "c"), "row_id"))
    total, n = used.agg(F.sum("w"), F.count("*")).first()
    # leverages
    got = used.select("row_id", "f0", "f1", "w")
    stats = None
    for start in range(0, n_draws, block):
        k = min(block, n_draws - start)
        drawn = cut(got.select("*", *signs(k, seed, start)))
        # projection in the metric of the weights: sqrt(w) r on sqrt(w) [A, B]
        scaled = drawn.select("row_id", "f0", "f1", "w", *[(F.col(f"d{i}") / F.sqrt("w")).alias(f"d{i}") for i in range(k)])
        out, _ = project(inner, scaled, [f"d{i}" for i in range(k)])
        res = [F.sqrt("w") * F.col(f"r{i}") for i in range(k)]
        fit_ = [F.sqrt("w") * F.col(f"d{i}") - r for i, r in enumerate(res)]
        sums = {"p2": sum((f**2 for f in fit_), F.lit(0.0)), "m2": sum((r**2 for r in res), F.lit(0.0)), "pp": sum((f**4 for f in fit_), F.lit(0.0)), "mm": sum((r**4 for r in res), F.lit(0.0)), "pm": sum(((f * r) ** 2 for f, r in zip(fit_, res, strict=True)), F.lit(0.0))}
        part = out.select("row_id", *[c.alias(x) for x, c in sums.items()])
        stats = part if stats is None else cut(stats.unionByName(part).groupBy("row_id").agg(*[F.sum(x).alias(x) for x in sums]))
    d = float(n_draws)
    ph, mh = F.col("p2") / d, F.col("m2") / d
    pbar, mbar = F.try_divide(ph, ph + mh), F.try_divide(mh, ph + mh)
    mpp, mmm, mpm = F.col("pp") / d - ph**2, F.col("mm") / d - mh**2, F.col("pm") / d - ph * mh
    v = (mbar**2 * mpp + pbar**2 * mmm - 2 * pbar * mbar * mpm) / d
    bc = (mbar * mpp - pbar * mmm + (mbar - pbar) * mpm) / d
    factor = 1 - F.try_divide(v, mbar**2) + F.try_divide(bc, mbar)  # null where a row alone determines an effect
    lev = used.join(stats, "row_id").select(*used.columns, pbar.alias("P"), mbar.alias("M"), factor.alias("factor"))
    grand, plain = used.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w"), F.avg(F.sqrt("w") * F.col("y"))).first()
    # a level of one row has leverage one and no say in its own variance
    shock = F.col("w") * (F.col("y") - grand) * F.col("e") if centering == "weighted" else (F.sqrt("w") * F.col("y") - plain) * F.sqrt("w") * F.col("e")
    sigma = F.when(F.col("M") > 1e-9, F.try_divide(shock, F.col("M")) * F.col("factor"))
    mover = F.col("c") > 1
    if stayers == "own":
        lev = lev.withColumn("sigma2", F.coalesce(sigma, F.lit(0.0)))
    elif stayers == "drop":
        lev = lev.withColumn("sigma2", F.when(mover, F.coalesce(sigma, F.lit(0.0))).otherwise(0.0))
    elif stayers == "firm_mean":  # the w-weighted mean of sigma2 / w over the firm's movers
        lev = lev.withColumn("sigma2", F.when(mover, sigma))
        means = lev.filter(mover & F.col("sigma2").isNotNull()).groupBy("f1").agg((F.sum(F.col("sigma2") * F.col("w")) / F.sum(F.col("w") ** 2)).alias("firm_mean"))
        lev = lev.join(means, "f1", "left")
        if lev.filter(~mover & F.col("firm_mean").isNull()).limit(1).count():
            raise ValueError("rows of stayers lie at levels of psi without movers: there is no variance to stand in")
        lev = lev.withColumn("sigma2", F.when(mover, F.coalesce("sigma2", F.lit(0.0))).otherwise(F.col("firm_mean") * F.col("w")))
    else:
        own = within_match(person, used)
        lev = lev.join(own, (F.col("f0") == F.col("__a")) & (F.col("f1") == F.col("__p")), "left")
        lev = lev.withColumn("sigma2", F.coalesce(F.when(mover, sigma).otherwise(F.col("within")), F.lit(0.0))).drop("__a", "__p", "within")
    lev = cut(lev)
    top = lev.filter("c > 1").agg(F.max("P")).first()[0] or 0.0
    if top >= 1 - 1e-9:
        raise ValueError("a row determines an effect alone: the sample is not leave-out connected")
    s = used.agg(*[F.sum(F.col("w") * x) for x in (F.col("a"), F.col("b"), F.col("a") ** 2, F.col("b") ** 2, F.col("a") * F.col("b"))]).first()
    div = total * (n - 1) / n
    plug = {"var_psi": (s[3] - s[1] ** 2 / total) / div, "var_alpha": (s[2] - s[0] ** 2 / total) / div, "cov": (s[4] - s[0] * s[1] / total) / div}
    bias = trace_bias(inner, lev, n_draws, seed + 7919, block, total, div)
    out = LeaveOut(n, plug, bias, float(top), n_draws, leave_out, {"rows": n, "weight": total, "stayers": stayers, "centering": centering})
    if se or diagnose or weak_interval:
        if n > MOST_ROWS:
            raise NotImplementedError(f"standard errors work on the driver, with {MOST_ROWS} rows at most")
        t = lev.select("f0", "f1", "w", "y", "sigma2", F.coalesce("M", F.lit(0.0)).alias("M")).toArrow().to_pandas()
        found = inference(t["f0"].to_numpy(), t["f1"].to_numpy(), t["w"].to_numpy(), t["y"].to_numpy(), t["sigma2"].to_numpy(), t["M"].to_numpy(), out.leave_out, se_draws, seed, diagnose, weak_interval, confidence)
        out.se, out.weak, out.intervals = found["se"], found["weak"], found["intervals"]
    inner.cleanup()
    return out


def within_match(person: DataFrame, used: DataFrame) -> DataFrame:
    """__a, __p, within: for matches of stayers, sum w^2 r / sum w over the match's rows, with r = (y - mean) (y - fitted) / (1 - w / the weight of its alpha); and
    nothing for a match of one row, which says nothing of its own variance."""
    mean = person.agg(F.sum(F.col("wt") * F.col("y")) / F.sum("wt")).first()[0]
    size = person.groupBy("alpha").agg(F.sum("wt").alias("worker"), F.countDistinct("psi").alias("firms")).filter("firms = 1").select("alpha", "worker")
    fitted = used.select(F.col("f0").alias("__a"), F.col("f1").alias("__p"), (F.col("a") + F.col("b")).alias("fitted"))
    rows = person.join(size, "alpha").join(fitted, (F.col("alpha") == F.col("__a")) & (F.col("psi") == F.col("__p")))
    r = F.try_divide((F.col("y") - mean) * (F.col("y") - F.col("fitted")), 1 - F.col("wt") / F.col("worker"))
    return rows.groupBy("__a", "__p").agg((F.sum(F.col("wt") ** 2 * r) / F.sum("wt")).alias("within"))


def within_match_variance(fit) -> DataFrame:
    """alpha, psi, within: of each match, the mean squared distance of its rows' outcomes (covariates taken out) from their mean. Unweighted fits."""
    p = fit.parts["panel"]
    if p.weights:
        raise NotImplementedError("unweighted fits only")
    y = F.col(p.variables[fit.outcome]) - sum((F.lit(float(b)) * F.col(p.variables[n]) for b, n in zip(fit.beta, fit.names, strict=True)), F.lit(0.0))
    return p.rows.groupBy(*[F.col(d).alias(f.name) for d, f in zip(p.dims[:2], p.fe[:2], strict=True)]).agg(F.var_pop(y).alias("within"))


def trace_bias(inner, lev: DataFrame, n_draws: int, seed: int, block: int, total: float, div: float) -> dict[str, float]:
    """E over random signs z of the components of the effects that the shocks sigma_i z_i bring: their mean is the trace of the bias.

    Shocks with variances sigma_i^2 (of sqrt(w) y) are regressed on the two effects; the variance components of what comes out average to the bias. A negative
    estimate of sigma_i^2 enters by its sign: components are differences of those under the positive and under the negative part.
    """
    out = dict.fromkeys(COMPONENTS, 0.0)
    p = inner.parts["panel"]
    for part in (1, -1):
        own = lev.withColumn("sd", F.sqrt(F.greatest(F.col("sigma2") * part, F.lit(0.0))))
        if not own.filter("sd > 0").limit(1).count():
            continue
        for start in range(0, n_draws, block):
            k = min(block, n_draws - start)
            drawn = cut(own.select("row_id", "f0", "f1", "w", "sd", *signs(k, seed + part, start)).select("row_id", "f0", "f1", "w", *[(F.col("sd") * F.col(f"d{i}") / F.sqrt("w")).alias(f"d{i}") for i in range(k)]))
            effects = two_way(p, drawn, [f"d{i}" for i in range(k)], inner.parts["absorber"])
            row = effects.agg(*[F.sum(F.col("w") * c) for i in range(k) for c in (F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"a{i}") ** 2, F.col(f"b{i}") ** 2, F.col(f"a{i}") * F.col(f"b{i}"))]).first()
            m = np.array(row, float).reshape(k, 5)
            out["var_psi"] += part * float((m[:, 3] - m[:, 1] ** 2 / total).sum()) / div / n_draws
            out["var_alpha"] += part * float((m[:, 2] - m[:, 0] ** 2 / total).sum()) / div / n_draws
            out["cov"] += part * float((m[:, 4] - m[:, 0] * m[:, 1] / total).sum()) / div / n_draws
    return out


def two_way(p, rows: DataFrame, names: list[str], absorber) -> DataFrame:
    """a_i and b_i: what the two effects of a regression of each column add to a row."""
    raw = rows.withColumns({f"u{i}": F.col(n) for i, n in enumerate(names)})
    res, eff = absorber.residualise(raw, [f"u{i}" for i in range(len(names))])
    levels, g = eff.tables["f1"]
    t = uploaded(rows.sparkSession, {"__l": levels} | {f"b{i}": g[:, i] for i in range(len(names))})
    out = res.join(t, F.col("f1") == F.col("__l"))
    return out.select("w", *[f"b{i}" for i in range(len(names))], *[(F.col(n) - F.col(f"u{i}") - F.col(f"b{i}")).alias(f"a{i}") for i, n in enumerate(names)])


def exact_components(y: np.ndarray, alpha: np.ndarray, psi: np.ndarray, w: np.ndarray | None = None) -> dict:
    """Leave-one-out components of a small panel by dense algebra, for checking the draws."""
    w = np.ones(len(y)) if w is None else w
    a, b = pd.get_dummies(alpha).to_numpy(float), pd.get_dummies(psi).to_numpy(float)
    x, s = np.column_stack([a, b]), np.sqrt(w)
    pinv = np.linalg.pinv((s[:, None] * x).T @ (s[:, None] * x))
    coef = pinv @ x.T @ (w * y)
    h = (s[:, None] * x) @ pinv
    lev = (h * (s[:, None] * x)).sum(axis=1)
    e = y - x @ coef
    sigma = w * (y - np.average(y, weights=w)) * e / (1 - lev)
    n, total = len(y), w.sum()
    div = total * (n - 1) / n
    out = {"plug_in": {}, "bias": {}}
    za, zb = np.column_stack([a, 0 * b]), np.column_stack([0 * a, b])
    c = np.diag(w) - np.outer(w, w) / total
    for name, l, r in (("var_psi", zb, zb), ("var_alpha", za, za), ("cov", za, zb)):  # noqa: E741
        q = (l.T @ c @ r + r.T @ c @ l) / 2 / div
        out["plug_in"][name] = float(coef @ q @ coef)
        out["bias"][name] = float(((h @ q) * h).sum(axis=1) @ sigma)
    return out

"""Solving the normal equations of a fit for other right-hand sides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.graph import min_labels
from ridgeline.plans.absorb import MOST_CELLS, MOST_LEVELS, Absorber, Cells, collected, conjugate_gradients, gram, uploaded
from ridgeline.plans.cache import cut
from ridgeline.sources import source


@dataclass
class NormalEquationsSolution:
    """Coefficients and projections of columns on a fit's covariates and fixed effects."""

    columns: list[str]
    beta: np.ndarray
    names: list[str]
    rows: DataFrame
    effects: dict[str, pd.DataFrame] | None = None

    def fixef(self, name: str | None = None):
        """level and a column for each solved one: the coefficients of a fixed effect's levels (all fixed effects as a dict, without a name)."""
        if self.effects is None:
            raise NotImplementedError("level coefficients need cells that fit the driver")
        return self.effects if name is None else self.effects[name]

    def coef(self) -> pd.DataFrame:
        return pd.DataFrame(self.beta, self.names, self.columns)

    def predict(self) -> DataFrame:
        """row_id and z'u of each column for the rows of the fit: how a weighted sum of predictions answers to a row's outcome."""
        return self.rows.select("row_id", *[F.col(f"p{i}").alias(c) for i, c in enumerate(self.columns)])


def project(fit, rows: DataFrame, names: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Adds r0..: the columns less their regression on the fit's covariates and fixed effects; and the coefficients of the covariates."""
    p = fit.parts["panel"]
    k = len(fit.names)
    work = rows.withColumns({f"r{i}": F.col(n) for i, n in enumerate(names)} | {f"q{j}": F.col(p.variables[x]) for j, x in enumerate(fit.names)})
    every = [f"r{i}" for i in range(len(names))] + [f"q{j}" for j in range(k)]
    if p.dims:
        a = Absorber(work, p.dims, p.weights, tuple(p.slopes))
        work, _ = a.residualise(a.rows, every)
        work = cut(work)
    g, _ = gram(work, every, p.weights)
    m = len(names)
    beta = np.linalg.solve(g[m:, m:], g[m:, :m]) if k else np.zeros((0, m))
    out = work
    for i in range(m):
        out = out.withColumn(f"r{i}", F.col(f"r{i}") - sum((F.lit(float(beta[j, i])) * F.col(f"q{j}") for j in range(k)), F.lit(0.0)))
    return cut(out), beta


def solve_columns(fit, data, columns) -> NormalEquationsSolution:
    """S u = Z'v for each column v: S is the fit's normal matrix, and Z'v adds up the design rows of data, weighted by v.

    Fixed effects first: the level sums of v, as values of the fit's rows, are what the groups and the solved dimensions make of them; covariates follow."""
    p, d = fit.parts["panel"], fit.parts["design"]
    if p.slopes or fit.parts.get("endog") or fit.family != "gaussian":
        raise NotImplementedError("linear models without slopes and instruments")
    columns = [columns] if isinstance(columns, str) else list(columns)
    m, k = len(columns), len(fit.names)
    df = source(data)
    v = [F.col(c).cast("double") for c in columns]
    rx = np.zeros((k, m))
    if k:
        rx = np.array(df.agg(*[F.sum(x * d.x[n].cast("double")) for n in fit.names for x in v]).first(), float).reshape(k, m)
    rows, w = fit.parts["rows"], F.col(p.weights) if p.weights else F.lit(1.0)
    rows = rows.select("row_id", *p.dims, *([p.weights] if p.weights else []), *[F.col(p.variables[n]).alias(f"q{j}") for j, n in enumerate(fit.names)], *[F.col(fit.parts["u"][n]).alias(f"t{j}") for j, n in enumerate(fit.names)])
    names = [f"c{i}" for i in range(m)]
    rows = rows.withColumns({c: F.lit(0.0) for c in names})
    if p.dims:
        sums = lambda f: df.groupBy(f.level.alias("__l")).agg(*[F.sum(x).alias(f"r{i}") for i, x in enumerate(v)])
        for f, dim in zip(p.fe, p.dims, strict=True):
            if sums(f).join(rows.select(F.col(dim).alias("__l")).distinct(), "__l", "left_anti").limit(1).count():
                raise ValueError(f"data has levels of {f.name} that the fit has not")
        size = rows.groupBy(F.col("f0").alias("__g")).agg(F.sum(w).alias("__n"))
        first = size.join(sums(p.fe[0]), F.col("__g") == F.col("__l"), "left").select("__g", *[(F.coalesce(f"r{i}", F.lit(0.0)) / F.col("__n")).alias(f"g{i}") for i in range(m)])
        rows = cut(rows.join(first, F.col("f0") == F.col("__g")).withColumns({f"c{i}": F.col(f"g{i}") for i in range(m)}).drop("__g", *[f"g{i}" for i in range(m)]))
        if len(p.dims) > 1:
            a = fit.parts["absorber"]
            right = np.zeros((a.n, m))
            for f, dim in zip(p.fe[1:], p.dims[1:], strict=True):
                own, held = sums(f).toPandas(), rows.groupBy(F.col(dim).alias("__l")).agg(*[F.sum(w * F.col(c)).alias(f"r{i}") for i, c in enumerate(names)]).toPandas()
                for t, sign in ((own, 1), (held, -1)):
                    right[a.offset[dim] + np.searchsorted(a.levels[dim], t["__l"].to_numpy())] += sign * t[[f"r{i}" for i in range(m)]].to_numpy(float)
            gamma, _ = a.solve(right)
            extra = [f"e{i}" for i in range(m)]
            rows = rows.withColumns({e: F.lit(0.0) for e in extra})
            for dim in p.dims[1:]:
                levels = a.levels[dim]
                t = uploaded(rows.sparkSession, {"__l": levels} | {f"h{i}": gamma[a.offset[dim] : a.offset[dim] + len(levels), i] for i in range(m)})
                rows = rows.join(t, F.col(dim) == F.col("__l")).withColumns({f"e{i}": F.col(f"e{i}") + F.col(f"h{i}") for i in range(m)}).drop("__l", *[f"h{i}" for i in range(m)])
            rows = Absorber(rows, p.dims[:1], p.weights).within(cut(rows), extra)
            rows = cut(rows.withColumns({c: F.col(c) + F.col(e) for c, e in zip(names, extra, strict=True)}))
    ux = np.zeros((k, m))
    if k:
        have = np.array(rows.agg(*[F.sum(w * F.col(f"q{j}") * F.col(c)) for j in range(k) for c in names]).first(), float).reshape(k, m) if p.dims else 0.0
        ux = fit.parts["meats"].bread @ (rx - have)
    out = rows.withColumns({f"p{i}": F.col(c) + sum((F.lit(float(ux[j, i])) * F.col(f"t{j}" if p.dims else f"q{j}") for j in range(k)), F.lit(0.0)) for i, c in enumerate(names)})
    return NormalEquationsSolution(columns, ux, list(fit.names), cut(out.select("row_id", *[f"p{i}" for i in range(m)])), _level_coefficients(fit, df, columns, v, ux))


def level_sums(rows: DataFrame, dim: str, columns: list) -> pd.DataFrame:
    """level and the sums of the columns, sorted by level; on the driver."""
    t = collected(rows.groupBy(F.col(dim).alias("level")).agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).limit(MOST_LEVELS + 1))
    if len(t) > MOST_LEVELS:
        raise NotImplementedError(f"more than {MOST_LEVELS} levels of {dim}: level coefficients live on the driver")
    return t.sort_values("level", ignore_index=True)


class Effects:
    """The block of the fixed effects' levels in the normal equations, D'W D, as operators on the driver: for fits whose cells fit there."""

    def __init__(self, fit):
        p = fit.parts["panel"]
        w = F.col(p.weights) if p.weights else F.lit(1.0)
        t = collected(p.rows.groupBy(*p.dims).agg(F.sum(w).alias("n")).limit(MOST_CELLS + 1))
        if len(t) > MOST_CELLS or p.slopes:
            raise NotImplementedError(f"more than {MOST_CELLS} cells of levels, or slopes: level coefficients live on the driver")
        self.levels, codes = zip(*[np.unique(t[d].to_numpy(), return_inverse=True) for d in p.dims], strict=True)
        self.n, self.w = [len(v) for v in self.levels], t["n"].to_numpy(float)
        self.codes, self.p = codes, p
        offset = np.cumsum([0, *self.n[1:]])
        own = [c + o for c, o in zip(codes[1:], offset, strict=False)]
        self.size = np.bincount(codes[0], self.w, self.n[0])
        self.cells = Cells(codes[0], own, int(offset[-1]), [self.w], [self.size])
        self.offset = offset

    def placed(self, d: int, t: pd.DataFrame) -> np.ndarray:
        out = np.zeros((self.n[d], t.shape[1] - 1))
        at = np.searchsorted(self.levels[d], t["level"].to_numpy())
        out[at] = t.iloc[:, 1:].to_numpy(float)
        return out

    def solve(self, c: list[np.ndarray], tol: float = 1e-12) -> list[np.ndarray]:
        """u with D'W D u = c, for each column: the first dimension is taken out, and what no u can give (the null space: levels of one component of two
        dimensions that grow and shrink together) goes first."""
        c = [x.copy() for x in c]
        if len(c) == 2:
            labels = min_labels(self.codes[0], self.codes[1], self.n[0], self.n[1])
            other = np.zeros(self.n[1], np.int64)
            other[self.codes[1]] = labels[self.codes[0]]
            for j in range(c[0].shape[1]):
                count = np.bincount(labels, minlength=self.n[0]) + np.bincount(other, minlength=self.n[0])
                gap = np.bincount(labels, c[0][:, j], self.n[0]) - np.bincount(other, c[1][:, j], self.n[0])
                share = np.divide(gap, count, out=np.zeros(len(gap)), where=count > 0)
                c[0][:, j] -= share[labels]
                c[1][:, j] += share[other]
        if len(c) == 1:
            return [c[0] / self.size[:, None]]
        right = np.concatenate(c[1:])
        for j in range(right.shape[1]):
            right[:, j] -= self.cells.by_level(self.w * (c[0][:, j] / self.size)[self.codes[0]])
        gamma, _ = conjugate_gradients(self.cells.product, self.cells.diagonal(), right, tol)
        held = sum(gamma[k] for k in self.cells.codes)
        first = np.stack([np.bincount(self.codes[0], self.w * held[:, j], self.n[0]) for j in range(right.shape[1])], axis=1)
        return [(c[0] - first) / self.size[:, None], *np.split(gamma, self.offset[1:-1])]


def apply_inverse(fit, levels: dict[str, pd.DataFrame], covariates: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, pd.DataFrame]]:
    """S^- v in the space of coefficients: v has a number for each covariate (rows of covariates) and each level (a frame of level and columns for
    each fixed effect; levels that are left out have zero), a column for each vector. Returns the same of the solution."""
    p, k = fit.parts["panel"], len(fit.names)
    if fit.parts.get("endog") or fit.family != "gaussian":
        raise NotImplementedError("linear models without instruments")
    m = len(next(iter(levels.values())).columns) - 1 if levels else np.asarray(covariates).shape[1]
    cx = np.zeros((k, m)) if covariates is None else np.asarray(covariates, float).reshape(k, m)
    with fit.parts["run"]:
        e = Effects(fit)
        c = [e.placed(d, levels[f.name]) if f.name in levels else np.zeros((e.n[d], m)) for d, f in enumerate(p.fe)]
        w = F.col(p.weights) if p.weights else F.lit(1.0)
        xs = [w * F.col(p.variables[n]) for n in fit.names]
        crossed = [e.placed(d, level_sums(p.rows, dim, xs)) for d, dim in enumerate(p.dims)] if k else []
    beta = np.zeros((0, m))
    if k:
        held = e.solve(c)
        beta = fit.parts["meats"].bread @ (cx - sum(x.T @ u for x, u in zip(crossed, held, strict=True)))
        c = [v - x @ beta for v, x in zip(c, crossed, strict=True)]
    u = e.solve(c)
    return beta, {f.name: pd.DataFrame({"level": e.levels[d]} | {str(j): u[d][:, j] for j in range(m)}) for d, f in enumerate(p.fe)}


def _level_coefficients(fit, df: DataFrame, columns: list[str], v: list, ux: np.ndarray) -> dict[str, pd.DataFrame] | None:
    p = fit.parts["panel"]
    if not p.dims or p.n > MOST_CELLS:
        return None
    rx = np.array(df.agg(*[F.sum(x * fit.parts["design"].x[n].cast("double")) for n in fit.names for x in v]).first(), float).reshape(len(fit.names), len(v)) if fit.names else None
    sums = {f.name: level_sums(df.withColumn("__l", f.level), "__l", v) for f in p.fe}
    _, out = apply_inverse(fit, sums, rx)
    return {name: t.set_axis(["level", *columns], axis=1) for name, t in out.items()}

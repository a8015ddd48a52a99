"""Least squares and two-stage least squares with fixed effects."""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import formula as fo
from ridgeline.operators import graph
from ridgeline.operators.results import FitResult, MultiFit, vcov_key
from ridgeline.plans.absorb import Absorber, gram, uploaded
from ridgeline.plans.cache import Run, cut, discard
from ridgeline.plans.sample import restrict, usable
from ridgeline.sources import source, with_row_id

COLLINEAR = 1e-10


@dataclass
class Panel:
    """The estimation sample of models with the same fixed effects: columns v0.. (variables), f0.. (levels), t0.. (slopes), c_* (clusters), w, row_id."""

    rows: DataFrame
    coded: DataFrame  # all source rows, with the same columns and a flag ok
    variables: dict[str, str]
    dims: list[str]
    fe: list[fo.FixedEffect]
    slopes: list[str]
    weights: str | None
    kind: str
    clusters: list[str]
    n: int
    n_obs: float
    lost: dict
    means: dict
    gone: DataFrame | None = None  # cells of levels that the sample's restriction took out, with the reason
    keep: tuple[str, ...] = ()
    labels: dict = field(default_factory=dict)
    run: Run = field(default_factory=lambda: Run.open[-1] if Run.open else Run())  # to which tables of later requests belong

    def components(self, a: int, b: int) -> tuple[int, DataFrame]:
        """How many components two dimensions' levels make, and the pairs with theirs; kept."""
        if (a, b) not in self.labels:
            pairs = cut(self.rows.groupBy(F.col(self.dims[a]).alias("a"), F.col(self.dims[b]).alias("b")).agg(F.count("*").alias("n")))
            self.labels[a, b] = graph.counted_components(pairs)
        return self.labels[a, b]

    def keys(self, i: int) -> list:
        """Source columns of a dimension."""
        f = self.fe[i]
        return [F.col(self.dims[i]).alias(f.keys[0])] if len(f.keys) == 1 else [F.col(f"s_{k}").alias(k) for k in f.keys]

    def carried(self) -> list:
        """Source columns of all dimensions and clusters, and those to keep; each once."""
        out = {k: c for i, f in enumerate(self.fe) for k, c in zip(f.keys, self.keys(i), strict=True)}
        for c in self.clusters:
            ks = c.split("^")
            out |= {k: (F.col(f"c_{c}") if len(ks) == 1 else F.col(f"s_{k}")).alias(k) for k in ks if k not in out}
        return [*out.values(), *[F.col(f"s_{k}").alias(k) for k in self.keep if k not in out]]


def cluster_columns(kinds) -> list[str]:
    out = []
    for k in kinds:
        if isinstance(k, dict):
            out += [c.strip() for c in re.split(r"[+]", next(iter(k.values())))]
    return list(dict.fromkeys(out))


def prepare(df: DataFrame, fe: tuple[fo.FixedEffect, ...], columns: dict, weights=None, weights_type: str = "aweights", clusters: list[str] | None = None, stream: str | None = None, extra: dict | None = None, keep: tuple[str, ...] = (), **how) -> Panel:
    """Codes the columns of the models, drops rows with missing values and restricts the sample."""
    if "row_id" not in df.columns:
        df = with_row_id(df)
    fe, clusters = list(fe), clusters or []
    sloped = [f for f in fe if f.slopes]
    if len(sloped) > 1 or (sloped and stream and sloped[0].name != stream):
        raise ValueError("slopes may vary by one fixed effect, which is the one taken out by groups")
    names = list(columns)
    select = [F.col("row_id")] + [columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)]
    select += [f.level.alias(f"f{i}") for i, f in enumerate(fe)]
    select += [fo.expression(t).alias(f"t{j}") for j, t in enumerate(sloped[0].slopes if sloped else ())]
    select += [fo.FixedEffect(c, tuple(re.split(r"\^", c))).level.alias(f"c_{c}") for c in clusters]
    select += [c.cast("double").alias(n) for n, c in (extra or {}).items()]
    composite = [k for f in fe if len(f.keys) > 1 for k in f.keys] + [k for c in clusters if "^" in c for k in c.split("^")]
    select += [F.col(f"`{k}`").alias(f"s_{k}") for k in dict.fromkeys([*composite, *keep])]
    if weights is not None:
        select.append((fo.expression(weights) if isinstance(weights, str) else weights).cast("double").alias("w"))
    coded = df.select(*select)
    dims, slopes = [f"f{i}" for i in range(len(fe))], [f"t{j}" for j in range(len(sloped[0].slopes) if sloped else 0)]
    values = [f"v{i}" for i in range(len(names))] + slopes + (["w"] if weights is not None else []) + list(extra or {})
    coded = coded.withColumn("ok", usable(coded, dims + [f"c_{c}" for c in clusters], values))
    rows = cut(coded.filter("ok").drop("ok"))
    first = rows.agg(F.count("*"), F.min("w") if weights is not None else F.lit(1.0), *[F.approx_count_distinct(d) for d in dims if len(fe) > 1]).first()
    if not first[0]:
        raise ValueError("no complete rows")
    if first[1] <= 0:
        raise ValueError("weights must be positive")
    sizes, counted = first[2:], first[0]
    # the dimension with most levels is taken out by groups
    if len(fe) > 1:
        if stream:
            first = [f.name for f in fe].index(stream)
        elif sloped:
            first = fe.index(sloped[0])
        else:
            first = max(range(len(dims)), key=lambda i: (sizes[i], -i))
        order = [first, *(i for i in range(len(fe)) if i != first)]
        # level columns are renamed so that f0 is that dimension
        new = {f"f{o}": f"f{k}" for k, o in enumerate(order)}
        swap = lambda d: d.select(*[F.col(c).alias(new.get(c, c)) for c in d.columns])
        rows, coded, fe = swap(rows), swap(coded), [fe[i] for i in order]
        pair = how.get("connected_fe")
        how["connected_fe"] = tuple(order.index(i) for i in (pair or (0, 1)))
    rows, lost, gone = restrict(rows, dims, n=counted, **how)
    if lost and any(lost.values()):
        whole, rows = rows, cut(rows)
        discard(whole)
    stats = rows.agg(F.count("*"), F.sum("w") if weights is not None else F.lit(0.0), *[F.avg(v) for v in values]).first()
    if not stats[0]:
        raise ValueError("no rows are left after singletons and components are taken out")
    n_obs = stats[1] if weights is not None and weights_type == "fweights" else stats[0]
    return Panel(rows, coded, {n: f"v{i}" for i, n in enumerate(names)}, dims, fe, slopes, "w" if weights is not None else None, weights_type, clusters, stats[0], n_obs, lost, dict(zip(values, stats[2:], strict=True)), gone, tuple(keep))


def fe_parameters(p: Panel, rule: str = "exact") -> tuple[int, list[int], list[list[bool]]]:
    """k_fe, parameters of each dimension."""
    if not p.dims:
        return 0, []
    sizes = list(p.rows.agg(*[F.countDistinct(d) for d in p.dims]).first())
    if p.slopes:
        a = Absorber(p.rows, p.dims[:1], p.weights, tuple(p.slopes))
        spread = a.rows.groupBy("f0").agg(*[(F.sum(F.col(b) ** 2) > 0).cast("int").alias(b) for b in a.basis])
        sizes[0] += sum(spread.agg(*[F.sum(b) for b in a.basis]).first())
    redundant = len(p.dims) - 1
    if rule == "exact" and len(p.dims) > 1:
        parts = [p.components(a, b)[0] for a, b in itertools.combinations(range(len(p.dims)), 2)]
        redundant = max(parts) + len(p.dims) - 2
    return sum(sizes) - redundant, sizes


def nested(p: Panel, cluster: str) -> list[bool]:
    """For each dimension, whether each of its levels lies in one cluster."""
    out = []
    for d, f in zip(p.dims, p.fe, strict=True):
        c = f"c_{cluster}"
        out.append(f.name == cluster or not p.rows.groupBy(d).agg(F.min(c).alias("a"), F.max(c).alias("b")).filter("a <> b").limit(1).count())
    return out


def independent(a: np.ndarray, raw: np.ndarray, tol: float = COLLINEAR) -> list[int]:
    """Positions of columns that are not spanned by the fixed effects or by columns before them (pivots of a Cholesky factorisation)."""
    keep: list[int] = []
    low = np.zeros_like(a)
    for j in range(len(a)):
        if a[j, j] <= 1e-6 * 1e-6 * max(raw[j], 0) or a[j, j] <= 0:
            continue
        v = a[j, keep].astype(float).copy()
        for k in range(len(keep)):
            v[k] = (v[k] - low[j, :k] @ low[keep[k], :k]) / low[keep[k], k]
            low[j, k] = v[k]
        r = a[j, j] - v @ v
        if r <= max(tol, 1e-9) * a[j, j]:
            continue
        low[j, len(keep)] = math.sqrt(r)
        keep.append(j)
    return keep


class Meats:
    """Variance of scores h * e of rows: what every variance estimator needs from them."""

    def __init__(self, p: Panel, rows: DataFrame, h: list[str], e: str, bread: np.ndarray, k: int, rss: float, rule: str = "exact", iid_n1: bool = False):
        self.p, self.rows, self.h, self.e, self.bread, self.k, self.rss, self.iid_n1 = p, rows, h, e, bread, k, rss, iid_n1
        self.w = F.col(p.weights) if p.weights else F.lit(1.0)
        self.k_fe, self.sizes = fe_parameters(p, rule)
        self.rule = rule

    def outer(self, rows: DataFrame, names: list[str]) -> np.ndarray:
        return gram(rows, names, None)[0]

    def cluster_sums(self, by: list[str]) -> DataFrame:
        return self.rows.groupBy(*[F.col(f"c_{c}") for c in by]).agg(*[F.sum(self.w * F.col(self.e) * F.col(h)).alias(f"s{i}") for i, h in enumerate(self.h)])

    def k_cluster(self, clusters: list[str]) -> float:
        if not self.p.dims:
            return self.k
        inside = [any(x) for x in zip(*[nested(self.p, c) for c in clusters], strict=True)]
        total = sum(self.sizes)
        redundant = len(self.p.dims) - 1
        if self.rule == "exact" and len(self.p.dims) > 1:
            parts = [1]
            parts += [self.p.components(i, j)[0] for i, j in itertools.combinations(range(len(self.p.dims)), 2) if not (inside[i] and inside[j])]
            redundant = max(parts) + len(self.p.dims) - 2
        own = [s for s, x in zip(self.sizes, inside, strict=True) if x]
        return self.k + total - redundant - sum(own) + len(own)

    def make(self, kind) -> tuple[np.ndarray, float]:
        n, k = self.p.n_obs, self.k + self.k_fe
        b = self.bread
        key = vcov_key(kind)
        if key == "iid":
            df = n - k
            factor = (n - 1) / df if self.iid_n1 and df > 0 else self.rss / df if df > 0 else math.nan
            return b * factor, df
        if key == "hetero":
            scale = self.w if self.p.kind != "fweights" else F.sqrt(self.w) if not self.iid_n1 else self.w / F.sqrt(F.col("w"))
            rows = self.rows.select(*[(scale * F.col(self.e) * F.col(h)).alias(f"s{i}") for i, h in enumerate(self.h)])
            df = n - k
            return b @ self.outer(rows, [f"s{i}" for i in range(len(self.h))]) @ b * (n / df if df > 0 else math.nan), df
        name, by = key.split(":")
        clusters = by.split("+")
        for c in clusters:
            if c not in self.p.clusters:
                raise ValueError(f"{c} must be given as cluster= to the fit")
        names = [f"s{i}" for i in range(len(self.h))]
        groups = [self.rows.select(f"c_{c}").distinct().count() for c in clusters]
        g = min(groups)
        adj = g / (g - 1) * (n - 1) / (n - self.k_cluster(clusters)) if g > 1 and n > self.k_cluster(clusters) else math.nan
        if name == "CRV3":
            if len(clusters) > 1 or self.iid_n1 or self.p.slopes:
                raise NotImplementedError("CRV3 is for one-way clusters of linear models without instruments")
            if self.p.dims and not all(nested(self.p, clusters[0])):
                raise NotImplementedError("CRV3 needs every fixed effect to lie within clusters")
            return adj * self.jackknife(clusters[0]), g - 1
        meat = np.zeros_like(b)
        for m in range(1, len(clusters) + 1):
            for subset in itertools.combinations(clusters, m):
                meat += (-1) ** (m + 1) * self.outer(self.cluster_sums(list(subset)), names)
        return adj * (b @ meat @ b), g - 1

    def jackknife(self, cluster: str) -> np.ndarray:
        """Sum of d d' with d = pinv(A - A_g) s_g: a row for each cluster from one aggregation, solved where it lies."""
        k = len(self.h)
        a = np.linalg.inv(self.bread)
        at = [(i, j) for i in range(k) for j in range(i, k)]
        sums = [F.sum(self.w * F.col(self.e) * F.col(h)).alias(f"s{i}") for i, h in enumerate(self.h)]
        sums += [F.sum(self.w * F.col(self.h[i]) * F.col(self.h[j])).alias(f"a{n}") for n, (i, j) in enumerate(at)]
        own = self.rows.groupBy(f"c_{cluster}").agg(*sums).drop(f"c_{cluster}")

        def solve(batches):
            import pandas as pd

            for t in batches:
                x = t.to_numpy(float)
                m = np.zeros((len(x), k, k))
                for n, (i, j) in enumerate(at):
                    m[:, i, j] = m[:, j, i] = x[:, k + n]
                d = np.einsum("nij,nj->ni", np.linalg.pinv(a[None] - m, hermitian=True), x[:, :k]) if len(x) else np.empty((0, k))
                o = d.T @ d
                yield pd.DataFrame([o.ravel()], columns=[f"o{i}" for i in range(k * k)])

        out = own.mapInPandas(solve, ", ".join(f"o{i} double" for i in range(k * k)))
        return np.array(out.agg(*[F.sum(f"o{i}") for i in range(k * k)]).first(), float).reshape(k, k)


def within_rows(p: Panel, tol: float) -> tuple[DataFrame, Absorber | None, object]:
    """Rows with the variables residualised as u0.., the raw ones kept."""
    names = [f"u{i}" for i in range(len(p.variables))]
    rows = p.rows.withColumns({u: F.col(v) for u, v in zip(names, p.variables.values(), strict=True)})
    if not p.dims:
        return rows, None, None  # the sample is a table already: nothing to write again
    # taking out means first keeps sums small
    center = {u: F.col(v) - F.lit(p.means[v]) for u, v in zip(names, p.variables.values(), strict=True)}
    a = Absorber(p.rows, p.dims, p.weights, tuple(p.slopes))
    rows, effects = a.residualise(a.rows.withColumns(center), names, tol)
    return cut(rows), a, effects


def fit_linear(p: Panel, d: fo.Design, within: tuple, vcov, clusters, rule: str, text: str = "", boot: str | None = None) -> FitResult:
    rows, absorber, effects = within
    u = {n: f"u{list(p.variables).index(n)}" for n in p.variables}
    y, xs, en, zs = d.outcome, list(d.x), list(d.endog), list(d.z)
    every = [y, *xs, *en, *zs]
    a, (weight, sum_y, raw) = gram(rows, [u[n] for n in every], p.weights, [F.sum(F.col(p.weights)) if p.weights else F.count("*").cast("double"), F.sum((F.col(p.weights) if p.weights else F.lit(1.0)) * F.col(p.variables[y])), F.array(*[F.count("*") * F.var_samp(p.variables[n]) for n in every])])
    raw = np.array([r or 0 for r in raw])
    if "Intercept" in xs:
        raw[every.index("Intercept")] = 1.0
    pos = {n: i for i, n in enumerate(every)}
    keep = [xs[i] for i in independent(a[np.ix_([pos[n] for n in xs], [pos[n] for n in xs])], raw[[pos[n] for n in xs]])] if xs else []
    dropped = [n for n in xs if n not in keep]
    if not keep and not en and xs:
        raise ValueError("all covariates are collinear with each other or with the fixed effects")
    x = en + keep if en else keep
    sub = lambda r, c: a[np.ix_([pos[n] for n in r], [pos[n] for n in c])]
    first, pi = {}, None
    if en:
        inst = keep + zs
        inst = [inst[i] for i in independent(sub(inst, inst), raw[[pos[n] for n in inst]])]
        if len(inst) - len(keep) < len(en):
            raise ValueError("fewer excluded instruments than endogenous variables")
        pi = np.linalg.solve(sub(inst, inst), sub(inst, x))
        bread_inv = sub(x, inst) @ pi
        if np.linalg.matrix_rank(bread_inv, tol=1e-10 * np.abs(bread_inv).max()) < len(x):
            raise ValueError("the instruments don't identify the endogenous variables")
        beta = np.linalg.solve(bread_inv, pi.T @ sub(inst, [y])[:, 0])
    else:
        inst, bread_inv = [], sub(x, x)
        beta = np.linalg.solve(bread_inv, sub(x, [y])[:, 0]) if x else np.empty(0)
    bread = np.linalg.inv(bread_inv) if x else np.empty((0, 0))
    e = F.col(u[y])
    for b, n in zip(beta, x, strict=True):
        e = e - F.lit(float(b)) * F.col(u[n])
    h = {}
    for i, n in enumerate(x):
        h[f"h{i}"] = sum((F.lit(float(pi[j, i])) * F.col(u[m]) for j, m in enumerate(inst)), F.lit(0.0)) if en else F.col(u[n])
    scored = rows.withColumns({"e": e, **h})  # rows are a table: what each variance needs of them is read from it
    w = F.col(p.weights) if p.weights else F.lit(1.0)
    mean = sum_y / weight
    extra = [F.sum(w * F.col("e") ** 2), F.sum(w * (F.col(p.variables[y]) - mean) ** 2), F.sum(F.ln(w))]
    rss, ssy, log_w = scored.agg(*extra).first()
    meats = Meats(p, scored, list(h), "e", bread, len(x), rss, rule)
    default = vcov if vcov is not None else "iid"
    vcovs, dfs = lazy_variances(meats, len(x))
    n, k_fe = p.n_obs, meats.k_fe
    stats = {"rss": rss, "k_fe": k_fe, "n_rows": p.n}
    if not en:
        tss_within = a[0, 0]
        r2 = 1 - rss / ssy if ssy > 0 else math.nan
        k_r2 = len(x) + sum(meats.sizes) - len(p.dims) + 1 if p.dims else len(x)
        ll = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1) + (0.5 * log_w if p.weights and p.kind == "aweights" else 0) if rss > 0 else math.nan
        stats |= {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k_r2) if n > k_r2 else math.nan, "rmse": math.sqrt(rss / weight), "loglik": ll, "aic": -2 * ll + 2 * (len(x) + k_fe), "bic": -2 * ll + math.log(n) * (len(x) + k_fe)}
        if p.dims:
            stats["r2_within"] = 1 - rss / tss_within if tss_within > 0 else math.nan
    fit = FitResult(y, x, beta, vcovs, dfs, vcov_key(default), n, stats, [f.name for f in p.fe], {}, dropped, "gaussian", text)
    fit.parts |= {"within": rows, "rows": scored, "panel": p, "make_vcov": meats.make, "meats": meats, "design": d, "u": u, "absorber": absorber, "effects": effects, "gram": a, "pos": pos, "inst": inst, "pi": pi, "exog": keep, "endog": en}
    attach(fit, p, d, absorber, effects)
    _ = fit.vcov
    if en:
        from ridgeline.operators.iv import diagnostics, first_stages

        fit.stats["first_stages"] = first_stages(fit)
        fit.stats["iv"] = diagnostics(fit)
    return fit


class Lazy(dict):
    """Values by key, made when they are first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


def lazy_variances(meats: Meats, k: int) -> tuple[Lazy, Lazy]:
    """Variances and their degrees of freedom by vcov_key: a job each, run when it is asked for."""
    def make(key):
        with meats.p.run:
            return meats.make(key) if k else (np.empty((0, 0)), meats.p.n_obs - meats.k_fe)

    both = Lazy(make)
    return Lazy(lambda key: both[key][0]), Lazy(lambda key: both[key][1])


def group_slopes(rows: DataFrame, dim: str, value: str, slopes: list[str], w) -> DataFrame:
    """level, c0.. : of each level, the regression of value on an intercept and the slopes; sums first, solved where they lie."""
    names = ["__one", *slopes]
    cols = {"__one": F.lit(1.0)} | {t: F.col(t) for t in slopes}
    k = len(names)
    at = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(w * cols[names[i]] * cols[names[j]]).alias(f"a{n}") for n, (i, j) in enumerate(at)] + [F.sum(w * cols[m] * F.col(value)).alias(f"b{i}") for i, m in enumerate(names)]
    own = rows.groupBy(F.col(dim).alias("level")).agg(*sums)

    def solve(batches):
        for t in batches:
            m, b = np.zeros((len(t), k, k)), t[[f"b{i}" for i in range(k)]].to_numpy(float)
            for n, (i, j) in enumerate(at):
                m[:, i, j] = m[:, j, i] = t[f"a{n}"]
            c = np.einsum("nij,nj->ni", np.linalg.pinv(m, rcond=1e-12, hermitian=True), b) if len(t) else b
            out = t[["level"]].copy()
            for i in range(k):
                out[f"c{i}"] = c[:, i]
            yield out

    return own.mapInPandas(solve, f"level {dict(own.dtypes)['level']}, " + ", ".join(f"c{i} double" for i in range(k)))


def attach(fit: FitResult, p: Panel, d: fo.Design, absorber, effects, y: str | None = None) -> None:
    """fixef, resid, sample and predict of a fit. y: the column that the effects add up to (a GLM's working response); the outcome otherwise."""
    scored, names = fit.parts["rows"], list(p.variables)
    y = y or p.variables[fit.outcome]
    w = F.col(p.weights) if p.weights else F.lit(1.0)
    made: dict = {}

    def with_effects() -> DataFrame:
        """Rows with xb and the effect fe_<dim> of each dimension: the first solved one has mean zero within components, further ones overall."""
        if "rows" in made:
            return made["rows"]
        rows = scored.withColumn("xb", sum((F.lit(float(b)) * F.col(p.variables[n]) for b, n in zip(fit.beta, fit.names, strict=True)), F.lit(0.0)))
        for k, dim in enumerate(p.dims[1:], 1):
            levels, g = effects.tables[dim]
            own = g[:, names.index(fit.outcome)] - sum((b * g[:, names.index(n)] for b, n in zip(fit.beta, fit.names, strict=True)), np.zeros(len(levels)))
            t = uploaded(rows.sparkSession, {"__l": levels, f"fe_{dim}": own})
            rows = rows.join(t, F.col(dim) == F.col("__l")).drop("__l")
            mean = F.sum(w * F.col(f"fe_{dim}")) / F.sum(w)
            if k == 1 and p.components(0, 1)[0] > 1:
                rows = rows.join(component_of(dim), dim)
                means = rows.groupBy("component").agg(mean.alias("__m"))
                rows = rows.join(means, "component").withColumn(f"fe_{dim}", F.col(f"fe_{dim}") - F.col("__m")).drop("__m", "component")
            else:
                rows = rows.withColumn(f"fe_{dim}", F.col(f"fe_{dim}") - F.lit(rows.agg(mean).first()[0]))
        if p.dims:
            rows = rows.withColumn("fe_f0", sum((-F.col(f"fe_{dim}") for dim in p.dims[1:]), F.col(y) - F.col("xb") - F.col("e")))
        made["rows"] = cut(rows)
        return made["rows"]

    def component_of(dim: str) -> DataFrame:
        """Levels of the first solved dimension and their component, numbered by size from 0."""
        labelled = p.components(0, 1)[1]
        return labelled.join(graph.ranked(labelled).select("component", (F.col("rank") - 1).alias("__c")), "component").select(F.col("b").alias(dim), F.col("__c").alias("component")).distinct()

    def table(i: int) -> DataFrame:
        """level, the source columns, fe_<name> (and fe_<name>[slope]) and n_obs of a dimension."""
        rows, f, dim = with_effects(), p.fe[i], p.dims[i]
        own = rows.select(F.col(dim).alias("level"), *([c for c in p.keys(i)]), F.col(f"fe_{dim}").alias("__e"))
        t = own.groupBy("level").agg(*[F.first(k).alias(k) for k in f.keys], F.avg("__e").alias(f"fe_{f.name}"), F.count("*").alias("n_obs"))
        if i == 0 and p.slopes:
            g = group_slopes(rows, dim, f"fe_{dim}", p.slopes, w)
            g = g.select(F.col("level").alias("__l"), F.col("c0"), *[F.col(f"c{j + 1}").alias(f"fe_{f.name}[{s}]") for j, s in enumerate(f.slopes)])
            t = t.join(g, F.col("level") == F.col("__l")).select("level", *f.keys, F.col("c0").alias(f"fe_{f.name}"), *[F.col(f"`fe_{f.name}[{s}]`") for s in f.slopes], "n_obs")
        return t

    def fixef(name: str | None = None):
        if name is None:
            return {f.name: fixef(f.name) for f in p.fe}
        at = {f.name: i for i, f in enumerate(p.fe)}
        if name not in at:
            raise KeyError(f"{name!r} is not a fixed effect of this model: {list(at)}")
        t = table(at[name])
        if at[name] == 1:
            t = t.join(component_of("level"), "level")
        return t.drop("level")

    def resid() -> DataFrame:
        effects_ = [F.col(f"fe_{dim}").alias(f"fe_{f.name}") for dim, f in zip(p.dims, p.fe, strict=True)]
        weights = [F.col(p.weights).alias("weights")] if p.weights else []
        return with_effects().select(*p.carried(), "row_id", *weights, F.col(p.variables[fit.outcome]).alias(fit.outcome), *effects_, "xb", F.col("e").alias("resid"))

    def sample() -> DataFrame:
        src = fit.parts["source"]
        flags = p.coded.select("row_id", "ok", *p.dims)
        flags = flags.join(p.gone, p.dims, "left") if p.gone is not None else flags.withColumn("gone", F.lit(None).cast("string"))
        flags = flags.select("row_id", F.when(~F.col("ok"), F.lit("missing")).otherwise(F.col("gone")).alias("dropped_because"))
        rest = [c for c in src.columns if c != "row_id"]
        return src.join(flags, "row_id").select("row_id", *rest, F.col("dropped_because").isNull().alias("in_sample"), "dropped_because")

    def predict(newdata=None, type: str = "link", name: str = "prediction") -> DataFrame:
        if type not in ("link", "response"):
            raise ValueError("type is 'link' or 'response'")
        df = fit.parts["source"] if newdata is None else source(newdata)
        if name in df.columns:
            raise ValueError(f"newdata has a column {name}; pass another name=")
        out, columns = df, d.x | d.endog
        total = sum((F.lit(float(b)) * columns[n].cast("double") for b, n in zip(fit.beta, fit.names, strict=True)), F.lit(0.0))
        for i, f in enumerate(p.fe):
            t = table(i).select(F.col("level").alias(f"__l{i}"), F.col(f"`fe_{f.name}`").alias(f"__e{i}"), *[F.col(f"`fe_{f.name}[{s}]`").alias(f"__s{j}") for j, s in enumerate(f.slopes)])
            out = out.join(t, f.level == F.col(f"__l{i}"), "left")
            total = total + F.col(f"__e{i}") + sum((F.col(f"__s{j}") * fo.expression(s) for j, s in enumerate(f.slopes)), F.lit(0.0))
        return out.select(*df.columns, total.alias(name))

    fit.parts |= {"fixef": fixef, "resid": resid, "sample": sample, "predict": predict, "with_effects": with_effects}


def feols(fml: str, data, vcov=None, cluster=None, fe_dof: str = "exact", weights=None, weights_type: str = "aweights", stream: str | None = None, connected: str | None = None, connected_fe: tuple[int, int] | None = None, min_degree=None, fixef_rm: str = "singleton", tol: float = 1e-10, bootcluster: str | None = None, keep: tuple[str, ...] = ()) -> FitResult | MultiFit:
    """Linear models of a formula; instruments by ``| endogenous ~ instruments``. See README for the options."""
    run = Run()
    with run:
        return _feols(run, fml, source(data), vcov, cluster, fe_dof, weights, weights_type, stream, connected, connected_fe, min_degree, fixef_rm, tol, bootcluster, keep)


def _feols(run: Run, fml, df, vcov, cluster, fe_dof, weights, weights_type, stream, connected, connected_fe, min_degree, fixef_rm, tol, bootcluster, keep) -> FitResult | MultiFit:
    df = df if "row_id" in df.columns else with_row_id(df)
    if vcov is None and cluster:
        vcov = {"CRV1": cluster if isinstance(cluster, str) else "+".join(cluster)}
    clusters = cluster_columns([vcov, *([{"CRV1": cluster}] if isinstance(cluster, str) else [{"CRV1": c} for c in cluster or []]), *([{"CRV1": bootcluster}] if bootcluster else [])])
    compiler = fo.Compiler(df)
    models = fo.parse(fml)
    fits: dict[int, FitResult] = {}
    for fe in dict.fromkeys(m.fe for m in models):
        own = [i for i, m in enumerate(models) if m.fe == fe]
        designs = {i: compiler.design(models[i]) for i in own}
        columns: dict = {}
        for d in designs.values():
            columns |= {d.outcome: fo.expression(d.outcome)} | d.x | d.endog | d.z
        how = {"connected": connected, "min_degree": min_degree, "fixef_rm": fixef_rm} | ({"connected_fe": connected_fe} if connected_fe else {})
        p = prepare(df, fe, columns, weights, weights_type, clusters, stream, keep=tuple(keep), **how)
        within = within_rows(p, tol)
        for i in own:
            fits[i] = fit_linear(p, designs[i], within, vcov, [bootcluster] if bootcluster else [], fe_dof, fml)
            fits[i].parts |= {"source": df, "run": run}
    out = [fits[i] for i in range(len(models))]
    return out[0] if len(out) == 1 else MultiFit(out)

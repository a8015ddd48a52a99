"""Estimators that take columns, not formulas: outcome, covariates and fixed effects by name, as SQL expressions or as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.families import FAMILIES
from ridgeline.operators.glm import _fit_families
from ridgeline.operators.linear import _feols
from ridgeline.operators.results import FitResult
from ridgeline.plans.cache import Run
from ridgeline.sources import source, with_row_id


def column(x) -> Column:
    """A Column as it is, text as a SQL expression, a number as a constant."""
    return x if isinstance(x, Column) else F.expr(x) if isinstance(x, str) else F.lit(x)


def row_wise(df: DataFrame, name: str, c: Column) -> Column:
    """Refuses columns that need more than their own row: aggregates, windows, generators, and what isn't deterministic."""
    node = df.select(c.alias(name))._jdf.queryExecution().analyzed()
    if node.nodeName() != "Project" or any(node.children().apply(0).nodeName().startswith(k) for k in ("Window", "Generate")) or not all(node.projectList().apply(i).deterministic() for i in range(node.projectList().size())):
        raise ValueError(f"{name} must be an expression of single rows, the same each time it is read")
    return c


class Columns:
    """Names columns and adds them to the data, so that a formula of plain names describes the model."""

    def __init__(self, df: DataFrame):
        self.source, self.df = df, df if "row_id" in df.columns else with_row_id(df)
        self.taken = set(self.df.columns)

    def add(self, label: str, x) -> str:
        """The name under which the data have the column: its own if it is a plain one."""
        if isinstance(x, str) and x in self.df.columns:
            return x
        name = label
        while name in self.taken:
            name += "_"
        self.taken.add(name)
        self.df = self.df.withColumn(name, row_wise(self.source, name, column(x)))
        return name


def named(what, prefix: str) -> dict[str, object]:
    """Labels and columns of a list, a dict or a single column."""
    if what is None:
        return {}
    if isinstance(what, dict):
        return dict(what)
    items = list(what) if isinstance(what, (list, tuple)) else [what]
    return {x if isinstance(x, str) and x.isidentifier() else f"{prefix}{i}": x for i, x in enumerate(items)}


class _Estimator:
    def __init__(self, y, x=(), fe=(), weights=None, weights_type: str = "aweights", endog=(), instruments=(), offset=None, stream: str | None = None, connected: str | None = None, min_degree=None, fixef_rm: str = "singleton", tol: float = 1e-10):
        self.y, self.x, self.fe = y, named(x, "x"), named(fe, "fe")
        self.endog, self.z = named(endog, "endog"), named(instruments, "z")
        self.weights, self.kind, self.offset = weights, weights_type, offset
        self.how = {"stream": stream, "connected": connected, "min_degree": min_degree, "fixef_rm": fixef_rm, "tol": tol}

    def described(self, data, clusters: dict) -> tuple[DataFrame, str, dict, dict]:
        """The data with all columns, the formula over them, cluster names as they are there, and options."""
        c = Columns(source(data))
        (label, y), = named(self.y, "y").items()
        y = c.add(label, y)
        x, fe, en, z = ([c.add(k, v) for k, v in group.items()] for group in (self.x, self.fe, self.endog, self.z))
        rhs = " + ".join(x) or "1"
        fml = f"{y} ~ {rhs}" + (f" | {' + '.join(fe)}" if fe else "") + (f" | {' + '.join(en)} ~ {' + '.join(z)}" if en else "")
        own = {k: c.add(k, v) for k, v in clusters.items()}
        options = {"weights": None if self.weights is None else column(self.weights), "offset": None if self.offset is None else column(self.offset)}
        return c.df, fml, own, options


class LinearModel(_Estimator):
    """Least squares (two-stage with endog and instruments) with fixed effects: LinearModel(y, x, fe).fit(data).

    y, x, fe, endog, instruments, clusters: names, SQL expressions, Columns, or dicts of them by label."""

    def fit(self, data, vcov=None, cluster=None, fe_dof: str = "exact") -> FitResult:
        df, fml, own, options = self.described(data, named(cluster, "cluster"))
        kind = {"CRV1": " + ".join(own.values())} if own else vcov
        run = Run()
        with run:
            return _feols(run, fml, df, kind, None, fe_dof, options["weights"], self.kind, self.how["stream"], self.how["connected"], None, self.how["min_degree"], self.how["fixef_rm"], self.how["tol"], None, ())


class GeneralizedModel(_Estimator):
    """Poisson, logit or probit with fixed effects: GeneralizedModel("poisson", y, x, fe).fit(data)."""

    def __init__(self, family: str, y, x=(), fe=(), iwls_tol: float = 1e-8, iwls_maxiter: int = 25, separation_check: bool = True, within_pseudo_r2: bool = False, **options):
        if family not in FAMILIES:
            raise ValueError(f"families are {', '.join(FAMILIES)}; LinearModel is for gaussian ones")
        super().__init__(y, x, fe, **options)
        if self.endog:
            raise NotImplementedError("instruments are for linear models")
        self.family, self.steps = FAMILIES[family], (separation_check, iwls_tol, iwls_maxiter)
        self.within = within_pseudo_r2

    def fit(self, data, vcov=None, cluster=None, fe_dof: str = "exact") -> FitResult:
        df, fml, own, options = self.described(data, named(cluster, "cluster"))
        kind = {"CRV1": " + ".join(own.values())} if own else vcov
        run = Run()
        with run:
            return _fit_families(run, fml, df, self.family, kind, None, fe_dof, options["weights"], self.kind, options["offset"], self.how["stream"], self.how["connected"], self.how["min_degree"], self.how["fixef_rm"], *self.steps, self.how["tol"], self.within)



"""Wild cluster bootstrap, resampling of whole groups, refits."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.ranges import numbered_by
from ridgeline.sources import source

log = logging.getLogger("ridgeline")
MOST_CLUSTERS = 1_000_000


def multipliers(g: int, reps: int, kind: str, seed: int) -> np.ndarray:
    """(clusters, draws). Rademacher signs are enumerated when there are fewer patterns than draws."""
    rng = np.random.default_rng(seed)
    if kind == "rademacher":
        if 2**g < reps:
            return np.array([[1 if (k >> i) & 1 else -1 for k in range(2**g)] for i in range(g)], float)
        return rng.choice([-1.0, 1.0], (g, reps))
    if kind == "mammen":
        r5 = np.sqrt(5)
        return rng.choice([(1 - r5) / 2, (1 + r5) / 2], (g, reps), p=[(r5 + 1) / (2 * r5), (r5 - 1) / (2 * r5)])
    if kind == "webb":
        return rng.choice(np.concatenate([-np.sqrt([1.5, 1, 0.5]), np.sqrt([0.5, 1, 1.5])]), (g, reps))
    if kind == "normal":
        return rng.standard_normal((g, reps))
    raise ValueError("weights are rademacher, mammen, webb or normal")


def wild_cluster(fit, param: str, cluster: str | None, reps: int, kind: str, null: bool, seed: int) -> dict:
    """t of param = 0 against its wild cluster bootstrap distribution, with the null imposed (WCR) or not (WCU).

    Rows are aggregated to a cluster's scores and cross-products once; draws run on those, MOST_CLUSTERS at most. Every fixed effect must lie
    within clusters, or be absent: only then do a cluster's signs leave the within transformation alone.
    """
    from ridgeline.operators.linear import nested

    meats, p = fit.parts["meats"], fit.parts["panel"]
    if fit.family != "gaussian" or fit.parts.get("endog"):
        raise NotImplementedError("the wild bootstrap is for linear models without instruments")
    if cluster is None:
        if not fit.vcov_type.startswith("CRV") or "+" in fit.vcov_type:
            raise NotImplementedError("name one cluster for the bootstrap")
        cluster = fit.vcov_type.split(":")[1]
    if p.dims and not all(nested(p, cluster)):
        raise NotImplementedError("every fixed effect must lie within clusters")
    names, k = meats.h, len(meats.h)
    j = fit.names.index(param)
    at = [(a, b) for a in range(k) for b in range(a, k)]
    w = meats.w
    sums = [F.sum(w * F.col("e") * F.col(h)).alias(f"s{i}") for i, h in enumerate(names)] + [F.sum(w * F.col(names[a]) * F.col(names[b])).alias(f"a{i}") for i, (a, b) in enumerate(at)]
    t = meats.rows.groupBy(f"c_{cluster}").agg(*sums).orderBy(f"c_{cluster}").limit(MOST_CLUSTERS + 1).toPandas()
    if len(t) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    g = len(t)
    s = t[[f"s{i}" for i in range(k)]].to_numpy()
    m = np.zeros((g, k, k))
    for i, (a, b) in enumerate(at):
        m[:, a, b] = m[:, b, a] = t[f"a{i}"]
    bread = meats.bread
    beta0 = fit.beta.copy()
    if null:  # scores under the restriction: the other coefficients are those of a fit without param
        rest = [i for i in range(k) if i != j]
        total = m.sum(axis=0)
        beta0 = np.zeros(k)
        if rest:
            beta0[rest] = fit.beta[rest] + np.linalg.solve(total[np.ix_(rest, rest)], total[rest, j]) * fit.beta[j]
        s = s + np.einsum("gij,j->gi", m, fit.beta - beta0)
    # all signs plus, under the null, give the statistic again: it is compared as worked out like the draws, since another order of sums, in which b may cancel, could part it from them
    v = np.column_stack([np.ones(g), multipliers(g, reps, kind, seed)])
    adj = meats.make({"CRV1": cluster})[0][j, j] / max((bread[j] @ (t[[f"s{i}" for i in range(k)]].to_numpy()).T @ t[[f"s{i}" for i in range(k)]].to_numpy() @ bread[j]), 1e-300)
    stat = fit.beta[j] / np.sqrt(meats.make({"CRV1": cluster})[0][j, j])
    delta = bread @ (s.T @ v)  # draws' coefficients about beta0
    draws = np.empty(v.shape[1])
    for b in range(0, v.shape[1], 256):
        score = s[:, :, None] * v[:, None, b : b + 256] - np.einsum("gij,jb->gib", m, delta[:, b : b + 256])
        a = np.einsum("i,gib->gb", bread[j], score)
        draws[b : b + 256] = (delta[j, b : b + 256] + (beta0[j] - (0 if null else fit.beta[j]))) / np.sqrt(adj * (a * a).sum(axis=0))
    own, draws = draws[0] if null else stat, draws[1:]
    p_value = float((np.abs(draws) >= abs(own) * (1 - 1e-9)).mean())  # a draw that gives the statistic again, but for rounding, counts
    return {"param": param, "t": float(stat), "p_value": p_value, "reps": len(draws), "clusters": g, "impose_null": null, "draws": draws}


def resample_groups(data, unit: str, draw: int, cluster: str | None = None, seed: int = 1, id_name: str = "unit_id") -> DataFrame:
    """A bootstrap draw of whole clusters (or units) with replacement: all rows of those drawn, as often as drawn, under new unit ids.

    How often a cluster is drawn is multinomial; here it is read from the SHA-256 of seed, draw and a slot number over the clusters' ranks,
    so that nothing but (slot, rank) pairs is joined and a rerun gives the same draw.
    """
    df = source(data)
    c = cluster or unit
    ranked = numbered_by(df.select(F.col(c).alias("__c")).filter(F.col(c).isNotNull()).distinct(), [F.col("__c")], "__n").select("__c", (F.col("__n") - 1).cast("long").alias("__r"))
    n = ranked.count()
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(draw), F.col("id")), 256), 1, 13)
    slots = df.sparkSession.range(n).select(F.col("id").alias("__slot"), (F.conv(digits, 16, 10).cast("long") % n).alias("__r"))
    drawn = slots.join(ranked, "__r").select("__slot", "__c")
    return df.join(drawn, F.col(c) == F.col("__c")).withColumn(id_name, F.concat_ws("#", F.col("__slot").cast("string"), F.col(unit).cast("string"))).drop("__c", "__slot")


@dataclass
class RefitResult:
    """Estimates of the draws and of the draws that failed."""

    estimate: pd.Series
    values: np.ndarray  # a row for each draw; NaN where it failed
    ledger: list = field(default_factory=list)
    warned: list = field(default_factory=list)

    def _valid(self, allow_incomplete: bool) -> np.ndarray:
        if self.ledger and not allow_incomplete:
            raise ValueError(f"{len(self.ledger)} of {len(self.values)} draws failed: see failures(); allow_incomplete=True goes on without them")
        own = self.values[np.isfinite(self.values).all(axis=1)]
        if len(own) < 2:
            raise ValueError("two draws are needed")
        return own

    def se(self, allow_incomplete: bool = False) -> pd.Series:
        return pd.Series(self._valid(allow_incomplete).std(axis=0, ddof=1), self.estimate.index)

    def confint(self, alpha: float = 0.05, method: str = "percentile", allow_incomplete: bool = False) -> pd.DataFrame:
        from ridgeline.functions.special import norm_ppf

        own, b = self._valid(allow_incomplete), self.estimate.to_numpy(float)
        lo, hi = np.quantile(own, [alpha / 2, 1 - alpha / 2], axis=0)  # linear interpolation
        if method == "basic":
            lo, hi = 2 * b - hi, 2 * b - lo
        elif method == "normal":
            z = norm_ppf(1 - alpha / 2) * own.std(axis=0, ddof=1)
            lo, hi = b - z, b + z
        elif method != "percentile":
            raise ValueError("method is percentile, basic or normal")
        return pd.DataFrame({"Coefficient": self.estimate.index, "Estimate": b, "Lower": lo, "Upper": hi})

    def tidy(self, alpha: float = 0.05, method: str = "percentile", allow_incomplete: bool = False) -> pd.DataFrame:
        own = self._valid(allow_incomplete)
        out = self.confint(alpha, method, allow_incomplete)
        return out.assign(**{"Std. Error": own.std(axis=0, ddof=1), "Bootstrap Mean": own.mean(axis=0), "Bias": own.mean(axis=0) - self.estimate.to_numpy(float), "Successful Reps": len(own)})

    def draws(self) -> pd.DataFrame:
        return pd.DataFrame({"draw": np.arange(len(self.values)), "successful": np.isfinite(self.values).all(axis=1)} | {n: self.values[:, j] for j, n in enumerate(self.estimate.index)})

    def failures(self) -> pd.DataFrame:
        return pd.DataFrame(self.ledger, columns=["draw", "error_type", "reason"])

    def refit_warnings(self) -> pd.DataFrame:
        return pd.DataFrame(self.warned, columns=["draw", "category", "message"])


def refit_bootstrap(data, fit, unit: str, reps: int = 99, cluster: str | None = None, seed: int = 1) -> RefitResult:
    """Runs fit(DataFrame) -> Series on the data and on draws of whole groups. Numerical failures of a draw are noted; other errors end the run."""
    import warnings

    df = source(data)
    base = fit(df)
    values, ledger, warned = np.full((reps, len(base)), np.nan), [], []
    for r in range(reps):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            try:
                values[r] = fit(resample_groups(df, unit, r, cluster, seed)).reindex(base.index).to_numpy(float)
            except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                ledger.append((r, type(e).__name__, str(e)))
                log.info("draw %d failed: %s", r, e)
        warned += [(r, w.category.__name__, str(w.message)) for w in seen]
    return RefitResult(base, values, ledger, warned)

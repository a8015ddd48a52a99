"""Adjustments of p-values for many tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

from ridgeline.functions import special as sp
from ridgeline.operators.results import FitResult, MultiFit


def _fits(models) -> list[FitResult]:
    return [f for m in (models if isinstance(models, (list, tuple)) else [models]) for f in (m if isinstance(m, MultiFit) else [m])]


def _tests(models, param) -> tuple[pd.DataFrame, list[tuple[FitResult, str]]]:
    """One row for each model and parameter, with tidy()'s columns."""
    params = [param] if isinstance(param, str) else list(param)
    tests = [(f, p) for f in _fits(models) for p in params]
    rows = []
    for i, f in enumerate(_fits(models)):
        t = f.tidy().set_index("Coefficient", drop=False)
        for p in params:
            if p not in t.index:
                raise ValueError(f"{p} is no coefficient of model {i}: {f.names}")
            rows.append({"model": i, "fml": f.fml} | t.loc[p].to_dict())
    table = pd.DataFrame(rows)
    if table["Pr(>|t|)"].isna().any():
        raise ValueError("a p-value is not a number")
    return table, tests


def bonferroni(models, param) -> pd.DataFrame:
    out, _ = _tests(models, param)
    return out.assign(**{"Bonferroni Pr(>|t|)": np.minimum(out["Pr(>|t|)"] * len(out), 1)})


def step_down(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p, kind="stable")
    out = np.empty(len(p))
    out[order] = np.minimum(np.maximum.accumulate(p[order] * (len(p) - np.arange(len(p)))), 1)
    return out


def holm(models, param) -> pd.DataFrame:
    out, _ = _tests(models, param)
    return out.assign(**{"Holm Pr(>|t|)": step_down(out["Pr(>|t|)"].to_numpy())})


def _draws(tests, reps: int, seed: int | None, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """|t| of each test, of its draws under the null hypothesis (the same cluster weights for all), and degrees of freedom."""
    seed = np.random.SeedSequence().entropy if seed is None else seed
    runs = [f.wildboottest(p, reps=reps, weights=kind, seed=seed) for f, p in tests]
    return np.array([abs(r["t"]) for r in runs]), np.column_stack([np.abs(r["draws"]) for r in runs]), np.array([r["clusters"] - 1 for r in runs], float)


def rwolf(models, param, reps: int = 9999, seed: int | None = None, weights: str = "rademacher") -> pd.DataFrame:
    """Romano and Wolf's step-down by the largest |t| of the tests that are left."""
    out, tests = _tests(models, param)
    t, draws, _ = _draws(tests, reps, seed, weights)
    order = np.argsort(-t)
    p = np.array([(1 + (draws[:, order[i:]].max(axis=1) >= t[j] * (1 - 1e-9)).sum()) / (len(draws) + 1) for i, j in enumerate(order)])
    adjusted = np.empty(len(t))
    adjusted[order] = np.minimum(np.maximum.accumulate(p), 1)
    return out.assign(**{"RW Pr(>|t|)": adjusted})


def wyoung(models, param, reps: int = 9999, seed: int | None = None, weights: str = "rademacher") -> pd.DataFrame:
    """Westfall and Young's free step-down by the smallest p-value of the tests that are left."""
    out, tests = _tests(models, param)
    t, draws, df = _draws(tests, reps, seed, weights)
    p = np.array([sp.t_sf2(x, d) for x, d in zip(t, df, strict=True)])
    order = np.argsort(p)
    share = np.empty(len(p))
    for i, j in enumerate(order):  # a draw's p-value is below p_j if one of its |t| passes the |t| that has p_j
        rest = order[i:]
        bound = np.array([sp.t_ppf(1 - p[j] / 2, df[m]) if df[m] != df[j] else t[j] for m in rest])
        share[i] = (draws[:, rest] >= bound * (1 - 1e-9)).any(axis=1).mean()
    adjusted = np.empty(len(p))
    adjusted[order] = np.maximum.accumulate(share)
    return out.assign(**{"WY Pr(>|t|)": adjusted})

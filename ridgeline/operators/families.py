"""Likelihood families of generalised linear models, as columns of y and the linear predictor."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import special as sp


@F.pandas_udf(T.DoubleType())
def cdf(x: pd.Series) -> pd.Series:
    return pd.Series(sp.norm_cdf(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def log_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(sp.log_norm_cdf(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def log_factorial(x: pd.Series) -> pd.Series:
    return pd.Series(sp.lgamma(x.to_numpy() + 1))


def pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


class Poisson:
    name = "poisson"

    def check(self, lo: float, hi: float, odd: int) -> None:
        if lo < 0 or hi <= 0:
            raise ValueError("a Poisson outcome is not negative and not zero throughout")

    def start(self, y: Column, mean: float) -> Column:
        return F.ln((y + F.lit(mean)) / 2)

    def arrays(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight, step of the working response and log-likelihood (but for terms of y alone) in NumPy; y may be a mean of outcomes that share eta."""
        mu = np.exp(eta)
        return mu, y / mu - 1, y * eta - mu

    def first(self, y: np.ndarray, mean: float) -> np.ndarray:
        return np.log((y + mean) / 2)

    def mean(self, eta: Column) -> Column:
        return F.exp(eta)

    def weight(self, y: Column, eta: Column) -> Column:
        return F.exp(eta)

    def step(self, y: Column, eta: Column) -> Column:
        return y * F.exp(-eta) - 1

    def deviance(self, y: Column, eta: Column) -> Column:
        return 2 * (F.when(y > 0, y * (F.ln(y) - eta)).otherwise(0.0) - y + F.exp(eta))

    def loglik(self, y: Column, eta: Column) -> Column:
        return y * eta - F.exp(eta) - log_factorial(y)

    def null(self, mean: float) -> float:
        return math.log(mean)


class Logit:
    name = "logit"

    def check(self, lo: float, hi: float, odd: int) -> None:
        if odd or lo == hi:
            raise ValueError("a binary outcome is 0 or 1, and not the same throughout")

    def start(self, y: Column, mean: float) -> Column:
        return F.lit(0.0)

    def arrays(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = np.logaddexp(0, eta)
        return np.exp(eta - 2 * top), y * (1 + np.exp(-eta)) - (1 - y) * (1 + np.exp(eta)), y * eta - top

    def first(self, y: np.ndarray, mean: float) -> np.ndarray:
        return np.zeros(len(y))

    def mean(self, eta: Column) -> Column:
        return F.exp(-softplus(-eta))

    def weight(self, y: Column, eta: Column) -> Column:
        return F.exp(-softplus(-eta) - softplus(eta))

    def step(self, y: Column, eta: Column) -> Column:
        return F.when(y == 1, 1 + F.exp(-eta)).otherwise(-(1 + F.exp(eta)))

    def deviance(self, y: Column, eta: Column) -> Column:
        return -2 * self.loglik(y, eta)

    def loglik(self, y: Column, eta: Column) -> Column:
        return F.when(y == 1, -softplus(-eta)).otherwise(-softplus(eta))

    def null(self, mean: float) -> float:
        return math.log(mean / (1 - mean))


class Probit(Logit):
    name = "probit"

    def arrays(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, down, f = sp.log_norm_cdf(eta), sp.log_norm_cdf(-eta), -0.5 * eta * eta - 0.5 * math.log(2 * math.pi)
        return np.exp(2 * f - up - down), y * np.exp(down - f) - (1 - y) * np.exp(up - f), y * up + (1 - y) * down

    def mean(self, eta: Column) -> Column:
        return cdf(eta)

    def weight(self, y: Column, eta: Column) -> Column:
        return F.exp(-eta * eta - math.log(2 * math.pi) - log_cdf(eta) - log_cdf(-eta))

    def step(self, y: Column, eta: Column) -> Column:
        q = F.when(y == 1, 1.0).otherwise(-1.0)
        return q * F.exp(log_cdf(-q * eta) - (-0.5 * eta * eta - 0.5 * math.log(2 * math.pi)))

    def loglik(self, y: Column, eta: Column) -> Column:
        return log_cdf(F.when(y == 1, eta).otherwise(-eta))

    def null(self, mean: float) -> float:
        return sp.norm_ppf(mean)


FAMILIES = {"poisson": Poisson(), "logit": Logit(), "probit": Probit()}

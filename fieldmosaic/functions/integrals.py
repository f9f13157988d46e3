"""Moments of expit(X) for a normal X, and prior densities, as column functions."""

from __future__ import annotations

from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmosaic.functions.scalar import expit


def logit_normal_moment(mu: Column, sigma: Column, power: int = 1) -> Column:
    """Mean of expit(X) ** power by the trapezoid rule over 7.5 standard deviations; expit(mu) ** power where sigma is 0, null where one is null.

    The rule's error falls as exp(-2 pi^2 m / sigma) with the number m of nodes for each standard deviation, so m is 2, or 1.6 sigma if that is
    more: 31 nodes up to a sigma of 1.25. The error is under 1e-12.
    """
    m = F.greatest(F.lit(2), F.ceil(F.abs(sigma) * 1.6).cast("int"))
    half = F.ceil(m * 7.5).cast("int")
    at = lambda i: expit(mu + sigma * i / m)
    term = lambda i: F.exp(-(i * i) / (m * m * 2.0)) * (at(i) if power == 1 else F.pow(at(i), F.lit(power)))
    total = F.aggregate(F.sequence(-half, half), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(sigma == 0, F.pow(expit(mu), F.lit(float(power)))).otherwise(total / (m * F.lit((2 * pi) ** 0.5)))


def logit_normal_variance(mu: Column, sigma: Column) -> Column:
    m = logit_normal_moment(mu, sigma)
    return logit_normal_moment(mu, sigma, 2) - m * m


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "mv"]))
def _moments(mu: pd.Series, sigma: pd.Series) -> pd.DataFrame:
    mu, sigma = mu.to_numpy("float64"), sigma.to_numpy("float64")
    first, second = np.full(len(mu), np.nan), np.full(len(mu), np.nan)
    steps = np.where(np.isfinite(sigma), np.maximum(2, np.ceil(np.abs(np.where(np.isfinite(sigma), sigma, 0)) * 1.6)), 0).astype(int)
    with np.errstate(over="ignore"):
        for m in np.unique(steps[steps > 0]):
            rows = steps == m
            a, b, half = mu[rows], sigma[rows], int(np.ceil(m * 7.5))
            sums = np.zeros((2, len(a)))
            for i in range(-half, half + 1):
                p = 1 / (1 + np.exp(-(a + b * i / m)))
                q = np.exp(-(i * i) / (m * m * 2.0))
                sums += q * p, q * p * p
            sums /= m * (2 * pi) ** 0.5
            p = 1 / (1 + np.exp(-a))
            first[rows], second[rows] = np.where(b == 0, p, sums[0]), np.where(b == 0, p * p, sums[1])
    return pd.DataFrame({"m": first, "v": second - first * first})


def logit_normal_moments(mu: Column, sigma: Column) -> Column:
    """(m, v): mean and variance of expit(X), both from one pass over `logit_normal_moment`'s nodes, for many rows at a time; null where one is null."""
    held = _moments(mu.cast("double"), sigma.cast("double"))
    return F.when(mu.isNotNull() & sigma.isNotNull(), F.struct(*[F.coalesce(held[c], F.lit(float("nan"))).alias(c) for c in "mv"]))


def logit_normal_means(draws: Column, sigmas: Column) -> Column:
    """The mean for each draw, with that draw's own sigma: two arrays of one length."""
    return F.zip_with(draws, sigmas, lambda m, s: logit_normal_moment(m, s))


def pc_precision_rate(u: float, alpha: float) -> float:
    """The rate for which the standard deviation exceeds u with probability alpha."""
    return -log(alpha) / u


def pc_precision_log_density(log_tau: Column, rate: float) -> Column:
    """Log density of a precision under an exponential prior of its standard deviation, from the log of the precision."""
    return F.lit(log(rate) - log(2)) - 1.5 * log_tau - F.lit(rate) * F.exp(-log_tau / 2)


def pc_variance_density(v: Column, rate: float) -> Column:
    return F.lit(rate) / (2 * F.sqrt(v)) * F.exp(-F.lit(rate) * F.sqrt(v))


def pc_variance_cdf(v: Column, rate: float) -> Column:
    return 1 - F.exp(-F.lit(rate) * F.sqrt(v))


def pc_variance_quantile(p: Column, rate: float) -> Column:
    return F.pow(F.log(1 - p) / F.lit(rate), F.lit(2))


def mixing_distance(phi: Column, scales: list[float]) -> Column:
    """Distance of a share phi of structured variation from none: the root of twice a Kullback-Leibler divergence. scales: the structured part's variances along its axes."""
    s = F.array(*[F.lit(float(x) - 1) for x in scales])
    divergence = (phi * F.lit(float(sum(scales) - len(scales))) - F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.log1p(phi * x))) / 2
    return F.sqrt(2 * F.greatest(divergence, F.lit(0.0)))


def mixing_log_density(phi: Column, scales: list[float], rate: float) -> Column:
    """Log density of phi when its distance is exponential with that rate."""
    s = F.array(*[F.lit(float(x) - 1) for x in scales])
    slope = (F.lit(float(sum(scales) - len(scales))) - F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x / (1 + phi * x))) / 2
    d = mixing_distance(phi, scales)
    return F.lit(log(rate)) - F.lit(rate) * d + F.log(F.abs(slope)) - F.log(d)


def matern(distance: Column, scale: Column, nu: float) -> Column:
    """The correlation for nu of 0.5 or 1.5, with distances scaled by sqrt(8 nu) / range."""
    x = F.lit((8 * nu) ** 0.5) * distance * scale
    return F.exp(-x) if nu == 0.5 else (1 + x) * F.exp(-x)

"""Log-likelihoods of counts as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series of the logarithm of gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 8
NOISE = 0.01


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: moved up by 8, then Stirling's series.

    x (x + 1) ... (x + 7) is y (y + 6) (y + 10) (y + 12) with y = x (x + 7), which
    keeps the expression small. Arguments should be columns or small sums of them.
    """
    x = x.cast("double")
    y = x * (x + 7)
    z = x + SHIFT
    w = 1 / (z * z)
    series = F.lit(STIRLING[-1])
    for c in STIRLING[-2::-1]:
        series = c + w * series
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series / z - F.log(y * (y + 6) * (y + 10) * (y + 12))


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def log_sum(a: Column, b: Column) -> Column:
    """ln(e^a + e^b)."""
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def poisson(x: Column, mu: Column) -> Column:
    return x * F.log(mu) - mu - log_gamma(x + 1)


def negbin_counts(x: Column, r: Column) -> Column:
    """The part of ``negbin`` that the mean doesn't enter."""
    return log_gamma(x + r) - log_gamma(x + 1) - log_gamma(r)


def negbin_mean(x: Column, mu: Column, r: Column) -> Column:
    """The part of ``negbin`` that the mean enters."""
    p = mu / (r + mu)
    p = F.when((p > 0) & (p < 1), p).otherwise(F.lit(0.5))
    return x * F.log(p) + r * F.log(1 - p)


def negbin(x: Column, mu: Column, r: Column) -> Column:
    """Negative binomial with mean mu and size r; a success probability outside (0, 1) counts as 0.5."""
    return negbin_counts(x, r) + negbin_mean(x, mu, r)


def negbin_mixture(x: Column, mu: Column, r: Column, r_noise: Column, z: float = NOISE) -> Column:
    return log_sum(math.log(1 - z) + negbin(x, mu, r), math.log(z) + negbin(x, mu, r_noise))


def binomial(k: Column, n: Column, p: Column) -> Column:
    return log_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)


def betabin_counts(k: Column, n: Column, m: Column) -> Column:
    """The part of ``betabin`` that the ratio doesn't enter; the same for k and n - k."""
    return log_choose(n, k) - log_gamma(n + m) + log_gamma(m)


def betabin_ratio(p: Column, m: Column) -> Column:
    """The part of ``betabin`` that the counts don't enter."""
    return log_gamma(m * p) + log_gamma(m * (1 - p))


def betabin_both(k: Column, rest: Column, p: Column, m: Column) -> Column:
    """The part of ``betabin`` that counts (k and n - k) and ratio enter together."""
    return log_gamma(k + m * p) + log_gamma(rest + m * (1 - p))


def betabin(k: Column, n: Column, p: Column, m: Column) -> Column:
    """Beta-binomial with mean p and M = m."""
    return betabin_counts(k, n, m) + betabin_both(k, n - k, p, m) - betabin_ratio(p, m)


def betabin_uniform(k: Column, n: Column, p: Column, m: Column, z: float = NOISE) -> Column:
    return log_sum(math.log(1 - z) + betabin(k, n, p, m), math.log(z) - F.log(n + 1))

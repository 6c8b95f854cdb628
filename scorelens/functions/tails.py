"""Tail probabilities of the drift tests, for tables of one row per column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov_tail(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value: 2 * sum over j of (-1)^(j-1) exp(-2 j^2 lambda^2)."""
    lam2 = (n * m).cast("double") / (n + m) * statistic * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * lam2),
    )
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2.0)), na_action="ignore")


#: From this shape on the uniform expansion is used, whose error there is below 1e-9 and which takes constant time.
LARGE_SHAPE = 10_000.0


def _uniform_tail(a: float, x: float) -> float:
    """Q(a, x) for a large shape: the complementary error function and two terms of Temme's expansion."""
    mu = x / a - 1.0
    eta = math.copysign(math.sqrt(2.0 * max(0.0, mu - math.log1p(mu))), mu)
    if abs(eta) < 1e-2:
        first, second = -1.0 / 3.0 + eta / 12.0 - 2.0 * eta * eta / 135.0, -1.0 / 540.0
    else:
        first = 1.0 / mu - 1.0 / eta
        second = 1.0 / eta**3 - 1.0 / mu**3 - 1.0 / mu**2 - 1.0 / (12.0 * mu)
    rest = math.exp(-0.5 * a * eta * eta) / math.sqrt(2.0 * math.pi * a) * (first + second / a)
    return 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + rest


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x).

    A series below the shape, a continued fraction above; both end after some sqrt(a) steps, and shapes from
    ``LARGE_SHAPE`` on take the uniform expansion, so no degree costs more than about a thousand steps.
    """
    if x <= 0:
        return 1.0
    if a >= LARGE_SHAPE:
        return min(1.0, max(0.0, _uniform_tail(a, x)))
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * math.exp(scale))
    # Modified Lentz evaluation of the fraction with terms -i (i - a) and x + 2 i + 1 - a.
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return min(1.0, value * math.exp(scale))


def _chi2_tail(x: float, df: int) -> float:
    return 1.0 if df < 1 else upper_gamma(df / 2.0, x / 2.0)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(d) else _chi2_tail(float(a), int(d)) for a, d in zip(x, df)],
        dtype="float64",
    )

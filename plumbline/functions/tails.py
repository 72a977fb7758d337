"""Upper tail probabilities for the test statistics.

Applied to result tables with one row per feature, never to data rows. The
incomplete gamma and beta functions use their textbook series and continued
fractions.
"""

from __future__ import annotations

import math
import sys
from itertools import count

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the functions with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: From this parameter on the expansions for large arguments are used: the sums would lose digits there.
LARGE = 1e6


def _gamma_upper_large(a: float, x: float) -> float:
    """First two terms of the uniform expansion of Q(a, x); the error is below 1e-9 from LARGE on."""
    mu = (x - a) / a
    # mu - log1p(mu) cancels near 0, where its series takes over.
    half = mu * mu * (1 / 2 - mu * (1 / 3 - mu * (1 / 4 - mu * (1 / 5 - mu / 6)))) if abs(mu) < 1e-2 else mu - math.log1p(mu)
    eta = math.copysign(math.sqrt(2 * half), mu)
    bend = 1 / mu - 1 / eta if abs(mu) > 1e-4 else -1 / 3 + mu / 12
    rest = math.exp(-a * half) / math.sqrt(2 * math.pi * a) * bend
    return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(a / 2)) + rest))


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    if a >= LARGE:
        return _gamma_upper_large(a, x)
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in count(1):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in count(1):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    if dof >= LARGE:  # normal with the first correction for the degrees of freedom
        return normal_two_sided(t * (1 - 1 / (4 * dof)) / math.sqrt(1 + t * t / (2 * dof)))
    return beta_lower(dof / 2, 0.5, dof / (dof + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_upper(x: float) -> float:
    """Limiting distribution of the scaled two-sample Kolmogorov-Smirnov distance."""
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def _over(fn, *series: pd.Series) -> pd.Series:
    def one(*args):
        if any(a is None or pd.isna(a) for a in args):
            return None
        return fn(*args)
    return pd.Series([one(*row) for row in zip(*series)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _over(lambda a, b: t_two_sided(a, b) if b > 0 else None, t, dof)


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _over(lambda a, b: gamma_upper(b / 2, a / 2) if b > 0 else 1.0, x, dof)


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return _over(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def kolmogorov_pvalue(x: pd.Series) -> pd.Series:
    return _over(kolmogorov_upper, x)
